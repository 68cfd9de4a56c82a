"""Readers and writers of genomic text files. Readers give 0-based half-open places in long form.

All read through Spark's own text and CSV sources, so any file system that Spark knows will do, and
gzip files are read as they are (one task each; `bgzf` cuts block-compressed ones). In-band nulls (* . NA -)
become null here only. Writers give ordered files, one for each range of the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import wrapped
from . import schemas
from .bgzf import SPLIT_BYTES, read_bgzf

NULLS = ("*", ".", "NA", "-", "")


def null_marker(column: str) -> Column:
    return F.when(~F.col(column).isin(*NULLS), F.col(column))


def file_name() -> Column:
    return F.col("_metadata.file_name")


def read_table(spark: SparkSession, path: str, schema: str | None = None, comment: str | None = None, header: bool = False, strain_pattern: str | None = None) -> DataFrame:
    """A tab-separated file or folder; strain_pattern takes a key from the file's name."""
    reader = spark.read.option("sep", "\t").option("header", header).option("quote", "")
    reader = reader.schema(schema) if schema else reader
    reader = reader.option("comment", comment) if comment else reader
    df = reader.csv(path)
    return df.withColumn("strain", F.regexp_extract(file_name(), strain_pattern, 1)) if strain_pattern else df


def read_whitespace(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Columns separated by any blanks, the first line a header."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    out = rows.select(*(parts[i].alias(n) for i, n in enumerate(names)))
    return out.filter(F.col(names[0]) != names[0])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, id, description, seq: records are split at the > that starts a line."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("file", file_name()).withColumn("ord", F.monotonically_increasing_id())
    text = F.regexp_replace("value", r"^>", "")
    header = F.rtrim(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit("\r"))
    body = F.regexp_replace(F.expr(r"substring(regexp_replace(value, '^>', ''), length(split_part(regexp_replace(value, '^>', ''), '\n', 1)) + 1)"), r"\s", "")
    return raw.filter(F.trim("value") != "").select("file", "ord", F.split_part(F.trim(F.regexp_replace(header, r"\s+", " ")), F.lit(" "), F.lit(1)).alias("id"), header.alias("description"), body.alias("seq"))


def write_fasta(seqs: DataFrame, path: str, width: int = 80) -> None:
    """One ordered text file for each range of ord; lines of `width`."""
    wrapped(seqs, width).repartitionByRange("ord").sortWithinPartitions("ord").select("fasta").write.text(path)


def read_vcf(spark: SparkSession, path: str, blocks: bool = False, split: int = SPLIT_BYTES) -> DataFrame:
    """variant_id, chrom, pos (1-based), ref, alt, qual, filter, info, sample, gt: one row per sample.

    Sample names come from each file's #CHROM line, so no wide frame is ever built. blocks: the files are
    block-compressed, and each is read by as many tasks as it has parts of `split` bytes.
    """
    lines = read_bgzf(spark, path, split) if blocks else spark.read.text(path).withColumn("file", file_name())
    lines = lines.filter(~F.col("value").startswith("##"))
    names = lines.filter(F.col("value").startswith("#CHROM")).select("file", F.split("value", "\t").alias("names"))
    rows = lines.filter(~F.col("value").startswith("#")).withColumn("c", F.split("value", "\t")).join(F.broadcast(names), "file")  # one row for each file
    fixed = [F.col("c")[i].alias(n) for i, n in ((2, "variant_id"), (0, "chrom"), (3, "ref"), (4, "alt"), (5, "qual"), (6, "filter"), (7, "info"))]
    pairs = F.arrays_zip(F.slice("names", 10, F.greatest(F.size("names") - 9, F.lit(0))).alias("sample"), F.slice("c", 10, F.greatest(F.size("c") - 9, F.lit(0))).alias("cell"))
    long = rows.select(*fixed, F.col("c")[1].cast("long").alias("pos"), F.explode_outer(pairs).alias("s"))
    return long.select("variant_id", "chrom", "pos", "ref", "alt", null_marker("qual").alias("qual"), null_marker("filter").alias("filter"), "info", F.col("s.sample").alias("sample"), F.split_part("s.cell", F.lit(":"), F.lit(1)).alias("gt"))


def write_vcf(genotypes: DataFrame, samples: list[str], path: str) -> None:
    """A population VCF from the long form, the samples' columns in the given order.

    One file for each range of places, each with the header, so that every file is a whole one.
    """
    spark = genotypes.sparkSession
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "gt"))), lambda x: x["gt"]), "\t")
    order = spark.createDataFrame(list(enumerate(samples)), "k int, sample string")
    grid = genotypes.select("variant_id", "chrom", "pos", "ref", "alt", "info").distinct().crossJoin(F.broadcast(order))
    full = grid.join(genotypes.select("variant_id", "sample", "gt"), ["variant_id", "sample"], "left").withColumn("gt", F.coalesce("gt", F.lit(".|.")))
    lines = full.groupBy("chrom", "pos", "variant_id", "ref", "alt", "info").agg(cells.alias("cells"))
    body = lines.select("chrom", "pos", "variant_id", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "variant_id", "ref", "alt", F.lit("."), F.lit("."), "info", F.lit("GT"), "cells").alias("value"))
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(samples)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        schema = pa.schema([("value", pa.string())]) if first is None else first.schema
        yield pa.RecordBatch.from_arrays([pa.array([head])], schema=schema)
        if first is not None:
            yield first
            yield from batches

    order = ["chrom", "pos", "variant_id", "value"]
    body.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).select("value").mapInArrow(headed, "value string").write.text(path)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 with 0-based lo, hi and an attribute map."""
    rows = read_table(spark, path, schemas.GFF, comment="#")
    return rows.withColumns({"lo": F.col("start") - 1, "hi": F.col("stop"), "attr": F.str_to_map("attributes", F.lit(";"), F.lit("="))})


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments (id, seq) and links (id1, dir1, id2, dir2, overlap)."""
    c = F.split("value", "\t")
    lines = spark.read.text(path)
    segments = lines.filter(F.col("value").startswith("S\t")).select(c[1].alias("id"), c[2].alias("seq"))
    links = lines.filter(F.col("value").startswith("L\t")).select(*(c[i + 1].alias(n) for i, n in enumerate(("id1", "dir1", "id2", "dir2", "overlap"))))
    return segments, links


def write_gfa(segments: DataFrame, links: DataFrame, path: str) -> None:
    head = segments.sparkSession.createDataFrame([(0, "H\tVN:Z:1.0")], "k int, value string")
    s = segments.select(F.lit(1).alias("k"), F.concat_ws("\t", F.lit("S"), "id", "seq").alias("value"))
    l = links.select(F.lit(2).alias("k"), F.concat_ws("\t", F.lit("L"), "id1", "dir1", "id2", "dir2", F.lit("0M")).alias("value"))
    head.unionByName(s).unionByName(l).repartitionByRange("k", "value").sortWithinPartitions("k", "value").select("value").write.text(path)


def read_hits(spark: SparkSession, path: str, schema: str = schemas.HITS_15) -> DataFrame:
    """Hit tables with ord, the order of the lines in the files."""
    return read_table(spark, path, schema).withColumn("ord", F.monotonically_increasing_id())


def read_coords(spark: SparkSession, path: str, asm_pattern: str = r"^(.*?)\.") -> DataFrame:
    return read_table(spark, path, schemas.COORDS, strain_pattern=asm_pattern).withColumnRenamed("strain", "asm")


def read_depth(spark: SparkSession, path: str, strain_pattern: str = r"^(.*?)\.") -> DataFrame:
    return read_table(spark, path, schemas.DEPTH, strain_pattern=strain_pattern)


def write_lines(df: DataFrame, column: str, path: str, order: list[str]) -> None:
    """One ordered text file, for small results that another tool reads."""
    df.repartitionByRange(1, *order).sortWithinPartitions(*order).select(column).write.text(path)


def write_table(df: DataFrame, path: str, schema: str, order: list[str], by: str | None = None, null: str = "") -> None:
    """The schema's columns, tab-separated, in ordered files; one folder for each value of `by`.

    read_table reads it back with the same schema, and with `by` as one more column of it.
    """
    columns = [part.split()[0] for part in schema.split(", ")]
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns)).alias("value")
    sort = [by, *order] if by else order
    out = df.repartitionByRange(*sort).sortWithinPartitions(*sort).select(line, *([by] if by else [])).write
    (out.partitionBy(by) if by else out).text(path)


def write_gff(rows: DataFrame, path: str) -> None:
    """GFF3 from seqid, source, type, lo, hi (0-based half-open), score, strand, phase and the attribute map."""
    pairs = F.transform(F.array_sort(F.map_entries("attr")), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit(""))))
    places = {"start": F.col("lo") + 1, "stop": F.col("hi"), "attributes": F.when(F.size("attr") > 0, F.array_join(pairs, ";"))}
    write_table(rows.withColumns(places), path, schemas.GFF, ["seqid", "start", "stop", "type", "attributes"], null=".")


def write_hits(hits: DataFrame, path: str, schema: str = schemas.HITS_15) -> None:
    """Hit tables, their lines in the order of ord."""
    write_table(hits, path, schema, ["ord"])


def write_coords(coords: DataFrame, path: str, by: str | None = "asm") -> None:
    write_table(coords, path, schemas.COORDS, ["ref", "ref_start", "ref_end", "qry", "qry_start"], by)


def write_depth(depth: DataFrame, path: str, by: str | None = "strain") -> None:
    write_table(depth, path, schemas.DEPTH, ["gene", "pos"], by)
