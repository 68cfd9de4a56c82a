"""Readers and writers: round trips and normalised places."""

import gzip
import os
import random
import struct
import zlib

import pytest

from helixframe.sources import bgzf, readers, schemas
from helixframe.streaming import ingest


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(text)
    return path


def test_fasta_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">s1 first one\nACGT\nAC\n>s2\nGG\n>s3 x y\n" + "T" * 170 + "\n")
    seqs = readers.read_fasta(spark, path)
    got = [(r.id, r.description, r.seq) for r in seqs.orderBy("ord").collect()]
    assert got == [("s1", "s1 first one", "ACGTAC"), ("s2", "s2", "GG"), ("s3", "s3 x y", "T" * 170)]
    readers.write_fasta(seqs, f"{tmp_path}/out")
    again = readers.read_fasta(spark, f"{tmp_path}/out")
    assert sorted((r.id, r.seq) for r in again.collect()) == sorted((i, s) for i, _, s in got)


def test_vcf_round_trip(spark, tmp_path):
    text = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tALT\tB\nc1\t5\tv1\tA\tT\t.\tPASS\tSVTYPE=INS\tGT\t0|1\t1|1:9\n"
    calls = readers.read_vcf(spark, put(tmp_path / "v", "a.vcf", text))
    got = sorted((r.variant_id, r.chrom, r.pos, r.sample, r.gt, r.qual) for r in calls.collect())
    assert got == [("v1", "c1", 5, "ALT", "0|1", None), ("v1", "c1", 5, "B", "1|1", None)]
    readers.write_vcf(calls, ["ALT", "B"], f"{tmp_path}/out")
    back = readers.read_vcf(spark, f"{tmp_path}/out")
    assert sorted((r.variant_id, r.sample, r.gt) for r in back.collect()) == [("v1", "ALT", "0|1"), ("v1", "B", "1|1")]


def test_gff_gfa_tables(spark, tmp_path):
    gff = readers.read_gff(spark, put(tmp_path / "g", "a.gff", "#c\nchr1\tx\tgene\t11\t20\t.\t+\t.\tID=a;Name=b\n")).first()
    assert (gff.lo, gff.hi, gff.attr["Name"]) == (10, 20, "b")
    s, l = readers.read_gfa(spark, put(tmp_path / "f", "a.gfa", "H\tVN:Z:1.0\nS\t1\tAC\nS\t2\tG\nL\t1\t+\t2\t-\t0M\n"))
    readers.write_gfa(s, l, f"{tmp_path}/gfa")
    s2, l2 = readers.read_gfa(spark, f"{tmp_path}/gfa")
    assert sorted(map(tuple, s2.collect())) == [("1", "AC"), ("2", "G")] and [tuple(r) for r in l2.collect()] == [("1", "+", "2", "-", "0M")]
    put(tmp_path / "d", "st1.depth", "g1\t1\t5\ng1\t2\t7\n")
    assert sorted((r.strain, r.gene, r.depth) for r in readers.read_depth(spark, str(tmp_path / "d")).collect()) == [("st1", "g1", 5), ("st1", "g1", 7)]
    ld = readers.read_whitespace(spark, put(tmp_path / "l", "a.ld", " SNP_A  SNP_B\n a   b\n"), ["SNP_A", "SNP_B"])
    assert [tuple(r) for r in ld.collect()] == [("a", "b")]


def test_tables_come_back_as_they_were_written(spark, tmp_path):
    lines = "chr1\tx\tgene\t11\t20\t.\t+\t.\tID=a;Name=b\nchr2\tx\tgene\t1\t9\t3.5\t-\t0\tID=c\n"
    gff = readers.read_gff(spark, put(tmp_path / "g", "a.gff", lines))
    readers.write_gff(gff, f"{tmp_path}/gff")
    assert "".join(sorted(r.value + "\n" for r in spark.read.text(f"{tmp_path}/gff").collect())) == lines
    bare = spark.createDataFrame([("c", "x", "gene", 0, 3, None, "+", None, {})], "seqid string, source string, type string, lo long, hi long, score string, strand string, phase string, attr map<string,string>")
    readers.write_gff(bare, f"{tmp_path}/bare")
    assert [r.value for r in spark.read.text(f"{tmp_path}/bare").collect()] == ["c\tx\tgene\t1\t3\t.\t+\t.\t."]
    hits = readers.read_hits(spark, put(tmp_path / "h", "a.tsv", "q2\ts1\t99.5\t10\t0\t0\t1\t10\t5\t14\t1e-30\t50\t10\t20\t100\nq1\ts1\t90\t8\t1\t0\t1\t8\t5\t12\t\t40\t8\t20\t100\n"))
    readers.write_hits(hits, f"{tmp_path}/hits")
    assert [tuple(r) for r in readers.read_hits(spark, f"{tmp_path}/hits").orderBy("ord").drop("ord").collect()] == [tuple(r) for r in hits.orderBy("ord").drop("ord").collect()]
    depth = spark.createDataFrame([(f"s{i % 3}", f"g{i % 5}", i, i * i) for i in range(60)], "strain string, gene string, pos long, depth long")
    readers.write_depth(depth, f"{tmp_path}/depth")
    back = readers.read_table(spark, f"{tmp_path}/depth", f"{schemas.DEPTH}, strain string")
    assert sorted(map(tuple, back.select(depth.columns).collect())) == sorted(map(tuple, depth.collect()))
    coords = spark.createDataFrame([("a1", 1, 5, 2, 6, 5, 5, 99.0, "r", "q")], f"asm string, {schemas.COORDS}")
    readers.write_coords(coords, f"{tmp_path}/coords")
    assert [tuple(r) for r in readers.read_table(spark, f"{tmp_path}/coords", f"{schemas.COORDS}, asm string").select(coords.columns).collect()] == [tuple(coords.first())]


def test_streaming_depth(spark, tmp_path):
    put(tmp_path / "in", "st1.depth", "g1\t1\t5\ng1\t2\t7\n")
    totals = ingest.running_totals(ingest.stream_depth(spark, str(tmp_path / "in")))
    q = totals.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("totals").collect()] == [("st1", "g1", 12, 2)]


def blocked(text, sizes):
    """Bytes of a block-compressed file: text cut into members of the given sizes, in turn, and the empty last one."""
    out, at, i = [], 0, 0
    while at < len(text) or not out:
        part = text[at : at + sizes[i % len(sizes)]]
        at, i = at + len(part), i + 1
        out.append(part)
    packed = []
    for part in [*out, b""]:
        press = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = press.compress(part) + press.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        packed.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(packed)


@pytest.mark.parametrize("split", [1, 40, 200, 10**9])
def test_blocks_give_each_line_once(spark, tmp_path, split):
    """Parts smaller than a block, blocks that end at line breaks, a line over many blocks, no last line break."""
    draw = random.Random(split)
    found = ["", "a", "", *("x" * draw.randint(0, 40) for _ in range(40)), "long " * 300, "é", "", "end"]
    text = "\n".join(found).encode()
    for name, sizes in (("a", [7, 23, 1]), ("b", [30_000]), ("c", [len(text.split(b"long")[0])])):
        (tmp_path / f"{name}.gz").write_bytes(blocked(text, sizes))
    (tmp_path / "d.gz").write_bytes(blocked(b"one\r\ntwo\n", [4]))
    (tmp_path / "e.gz").write_bytes(gzip.compress(text) + gzip.compress(b"\nmore"))
    (tmp_path / "f.gz").write_bytes(blocked(b"", [4]))
    rows = {}
    for r in bgzf.read_bgzf(spark, str(tmp_path), split).collect():
        rows.setdefault(r.file, []).append(r.value)
    want = {"a.gz": found, "b.gz": found, "c.gz": found, "d.gz": ["one", "two"], "e.gz": [*found, "more"]}
    assert {k: sorted(v) for k, v in rows.items()} == {k: sorted(v) for k, v in want.items()}


def test_block_compressed_calls(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
    text = head + "".join(f"c{i % 3}\t{i}\tv{i}\tA\tT\t.\tPASS\tN={i}\tGT\t0|{i % 2}\t1|1:9\n" for i in range(500))
    plain = put(tmp_path / "p", "a.vcf", text)
    (tmp_path / "a.vcf.gz").write_bytes(blocked(text.encode(), [700]))
    calls = readers.read_vcf(spark, f"file://{tmp_path}/a.vcf.gz", blocks=True, split=1000)
    assert sorted(map(tuple, calls.collect()), key=str) == sorted(map(tuple, readers.read_vcf(spark, plain).collect()), key=str)
    assert bgzf.read_bgzf(spark, f"{tmp_path}/a.vcf.gz", 1000).rdd.getNumPartitions() > 5
    with pytest.raises(Exception, match="none.gz"):
        bgzf.read_bgzf(spark, f"{tmp_path}/none.gz").collect()


def test_every_file_of_a_population_is_whole(spark, tmp_path):
    calls = spark.range(400).selectExpr("concat('v', id) AS variant_id", "concat('c', id % 4) AS chrom", "id AS pos", "'A' AS ref", "'T' AS alt", "'.' AS info", "'S' AS sample", "'0|1' AS gt")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        readers.write_vcf(calls, ["S"], f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for f in os.listdir(tmp_path / "out") if f.startswith("part")]
    assert len(files) > 1 and all((tmp_path / "out" / f).read_text().startswith("##fileformat") for f in files)
    assert readers.read_vcf(spark, f"{tmp_path}/out").count() == 400
