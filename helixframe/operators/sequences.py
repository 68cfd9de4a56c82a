"""Sequence operators on rows (id, description, seq, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The IUPAC codes and their complements.
IUPAC = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
COMPLEMENT = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
GENOME_BASES = 12_000_000


def lengths(seqs: DataFrame) -> DataFrame:
    return seqs.select("id", F.length("seq").cast("long").alias("length"))


def at_least(seqs: DataFrame, kilobases: float) -> DataFrame:
    return seqs.filter(F.length("seq") >= kilobases * 1000)


def _require(seqs: DataFrame, wanted: DataFrame, condition: Column, what: str) -> DataFrame:
    """wanted, or an error if one of its rows matches no sequence."""
    missing = wanted.join(seqs.select("id"), condition, "left_anti")
    bad = missing.groupBy().agg(F.concat_ws(",", F.collect_list("w")).alias("m"))
    return wanted.crossJoin(F.broadcast(bad)).filter(F.when(F.col("m") != "", F.raise_error(F.concat(F.lit(what), F.col("m"))).cast("boolean")).otherwise(True)).drop("m")


def extract(seqs: DataFrame, ids: DataFrame | None = None, prefixes: list[str] | None = None, start: int | None = None, end: int | None = None, strict: bool = True) -> DataFrame:
    """Sequences by id and by prefix (all without either), optionally the 1-based inclusive range."""
    chosen = seqs
    if ids is not None:
        wanted = ids.select(F.col(ids.columns[0]).alias("w")).distinct()
        if strict:
            wanted = _require(seqs, wanted, F.col("w") == F.col("id"), "unknown sequence ")
        chosen = seqs.join(wanted, seqs["id"] == F.col("w"), "left_semi")
    elif prefixes:
        keep = F.lit(False)
        for p in prefixes:
            keep = keep | F.col("id").startswith(p)
        chosen = seqs.filter(keep)
    if start is None:
        return chosen
    size = F.length("seq")
    last = F.least(F.lit(end), size) if end is not None else size
    cut = F.expr(f"substring(seq, {start}, {2**31 - 1 if end is None else end - start + 1})")
    return chosen.filter(size >= start).withColumn("id", F.concat("id", F.lit(f"_{start}.."), last)).withColumn("seq", cut)


def extract_invert(seqs: DataFrame, prefixes: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """What `extract` leaves: other sequences whole, and of the selected ones the pieces outside the range."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("id").startswith(p)
    rest = seqs.filter(~hit)
    if start is None:
        return rest
    size = F.length("seq")
    left = F.struct(F.concat("id", F.lit(f"_1..{start - 1}")).alias("id"), F.expr(f"substring(seq, 1, {start - 1})").alias("seq"))
    right = F.struct(F.concat("id", F.lit(f"_{end + 1}.."), size).alias("id"), F.expr(f"substring(seq, {end + 1})").alias("seq"))
    pieces = F.array_compact(F.array(F.when(F.lit(start > 1), left), F.when(size > end, right)))
    cut = seqs.filter(hit).withColumn("p", F.explode(pieces))
    return rest.unionByName(cut.withColumn("id", F.col("p.id")).withColumn("seq", F.col("p.seq")).drop("p"))


def mask_ends(seqs: DataFrame, k: int, clamp: bool = True) -> DataFrame:
    """N over k bases at both ends; without clamp, sequences under 2k grow."""
    size = F.length("seq")
    grown = F.concat(F.repeat(F.lit("N"), k), F.expr(f"substring(seq, {k + 1}, greatest(length(seq) - {2 * k}, 0))"), F.repeat(F.lit("N"), k))
    return seqs.withColumn("seq", F.when(size < 2 * k, F.expr("repeat('N', length(seq))")).otherwise(grown) if clamp else grown)


def reverse_complement(seq: Column) -> Column:
    """IUPAC complement read backwards; any other character is an error."""
    bad = F.raise_error(F.lit("not a nucleotide code")).cast("string")
    return F.when(seq.rlike(f"^[{IUPAC}]*$"), F.reverse(F.translate(seq, IUPAC, COMPLEMENT))).otherwise(bad)


def concatenate(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out


def rename_sequential(seqs: DataFrame, prefix: str, group: str | None = None) -> DataFrame:
    """id = prefix_i in file order, the old header as description. `group` numbers each file apart."""
    order = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy("ord")
    return seqs.withColumn("description", F.col("id")).withColumn("id", F.concat(F.lit(f"{prefix}_"), F.row_number().over(order)))


def rename_map(seqs: DataFrame, names: DataFrame) -> DataFrame:
    """New ids where the map (old_id, new_id) has one, also inside the description, literally."""
    joined = seqs.join(names, seqs["id"] == F.col("old_id"), "left")
    described = F.when(F.col("new_id").isNotNull(), F.replace("description", "old_id", "new_id")).otherwise(F.col("description"))
    return joined.withColumn("description", described).withColumn("id", F.coalesce("new_id", "id")).drop("old_id", "new_id")


def first_token(text: Column, delimiter: str = "|") -> Column:
    return F.split_part(text, F.lit(delimiter), F.lit(1))


def replace_token(text: Column, n: int, value: Column, delimiter: str = "|") -> Column:
    """The n-th token (from 1) of a delimited text replaced."""
    return F.array_join(F.transform(F.split(text, "\\" + delimiter), lambda t, i: F.when(i == n - 1, value).otherwise(t)), delimiter)


def total_bases(seqs: DataFrame, genome: int = GENOME_BASES) -> DataFrame:
    total = F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long")
    return seqs.agg(total.alias("bases")).withColumn("depth", F.expr(f"bases div {genome}"))


def route_by_depth(samples: DataFrame, depth: str = "depth") -> DataFrame:
    """Branches of each sample: always 30X and all, 40X from depth 40."""
    branches = F.array_compact(F.array(F.when(F.col(depth) >= 40, F.lit("40X")), F.lit("30X"), F.lit("all")))
    return samples.withColumn("branch", F.explode(branches))


def strip_stop(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("seq", F.replace("seq", F.lit("*"), F.lit("")))


def wrapped(seqs: DataFrame, width: int = 80) -> DataFrame:
    """FASTA text of each sequence: header, then lines of `width`."""
    body = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n")) if width else F.col("seq")
    return seqs.withColumn("fasta", F.concat(F.lit(">"), F.col("description"), F.lit("\n"), body))
