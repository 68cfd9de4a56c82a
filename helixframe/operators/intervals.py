"""Interval algebra on rows (key columns, lo, hi), half-open; void rows (lo = hi) contribute nothing.

A set of intervals is any number of rows per key. Canonical sets are disjoint, joined where they
touch, and come from `union`. Overlaps are an equi-join on the keys and position bins with a residual range.
Sweeps go in two levels: each cell of WIDTH positions is swept by itself, one row a cell says what it
hands on (its greatest end, its sums), a scan over a key's cells gives each the state it starts from, and
the cells are stitched. Rows of one place are summed first, so no cell has over WIDTH rows, and
a key with very many rows, such as a chromosome, is dealt over its cells; only a key's cells meet in one place.
Null keys are a key of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]
WIDTH = 1 << 16


def checked(df: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Raise on an inverted interval, drop void ones."""
    bad = F.raise_error(F.concat(F.lit("inverted interval "), F.col(lo), F.lit(" > "), F.col(hi))).cast("boolean")
    return df.filter(F.when(F.col(lo) > F.col(hi), bad).otherwise(F.col(lo) < F.col(hi)))


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """True iff two half-open ranges share a base; touching or void ranges don't."""
    return (a_lo < b_hi) & (b_lo < a_hi) & (a_lo < a_hi) & (b_lo < b_hi)


def overlap_length(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))


def in_cell(at: str, width: int) -> Column:
    """The cell of a place; never falls as places rise."""
    return F.expr(f"`{at}` div {width}").alias("_cell")


def stitched(rows: DataFrame, states: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows with the columns of the state of their key and cell, null keys too."""
    right = states.withColumnsRenamed({c: f"{c}_of" for c in on})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in on))
    return rows.join(right, same).drop(*(f"{c}_of" for c in on))


def _islands(rows: DataFrame, keys: Keys, touching: bool, lo: str, hi: str) -> DataFrame:
    """Disjoint intervals of each key by one window."""
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("_reach").isNull() | _apart(F.col(lo), F.col("_reach"), touching)
    numbered = rows.withColumn("_reach", reach).withColumn("_island", F.sum(gap.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def _apart(lo: Column, reach: Column, touching: bool) -> Column:
    return lo > reach if touching else lo >= reach


def union(df: DataFrame, keys: Keys = ("id",), touching: bool = True, lo: str = "lo", hi: str = "hi", width: int | None = WIDTH) -> DataFrame:
    """Coalesce overlapping (and, if asked, touching) intervals of each key.

    An island of a cell that what lies before reaches belongs to the last island that began before its cell. For
    keys with few rows each, width None does it by one window.
    """
    if width is None:
        return _islands(checked(df, lo, hi), keys, touching, lo, hi)
    own = [*keys, "_cell"]
    farthest = checked(df, lo, hi).groupBy(*keys, lo).agg(F.max(hi).alias(hi)).withColumn("_cell", in_cell(lo, width))
    islands = _islands(farthest, own, touching, lo, hi)
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = islands.groupBy(*own).agg(F.max(hi).alias("_end"), F.max(lo).alias("_last")).withColumn("_carry", F.max("_end").over(before))
    begins = lambda at: F.col("_carry").isNull() | _apart(F.col(at), F.col("_carry"), touching)
    states = cells.withColumn("_home", F.max(F.when(begins("_last"), F.col("_last"))).over(before)).select(*own, "_carry", "_home")
    begun = F.when(begins(lo), F.col(lo)).otherwise(F.col("_home")).alias("_begun")
    return stitched(islands, states, own).groupBy(*keys, begun).agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_begun")


def running(events: DataFrame, keys: Keys, at: str, sums: Sequence[str], width: int = WIDTH) -> DataFrame:
    """keys, at, the place `next` of the key's next event (null at the last), and each sum over all events up to here."""
    own = [*keys, "_cell"]
    net = events.groupBy(*keys, at).agg(*(F.sum(c).alias(c) for c in sums)).withColumn("_cell", in_cell(at, width))
    order = Window.partitionBy(*own).orderBy(at)
    inside = net.select(*own, at, F.lead(at).over(order).alias("_next"), *(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in sums))
    cells = Window.partitionBy(*keys).orderBy("_cell")
    before = cells.rowsBetween(Window.unboundedPreceding, -1)
    totals = net.groupBy(*own).agg(F.min(at).alias("_first"), *(F.sum(c).alias(f"_{c}") for c in sums))
    states = totals.select(*own, F.lead("_first").over(cells).alias("_after"), *(F.sum(f"_{c}").over(before).alias(f"_{c}") for c in sums))
    carried = [(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums]
    return stitched(inside, states, own).select(*keys, at, F.coalesce("_next", "_after").alias("next"), *carried)


def add_sets(a: DataFrame, b: DataFrame, keys: Keys = ("id",)) -> DataFrame:
    columns = [*keys, "lo", "hi"]
    return union(a.select(columns).unionByName(b.select(columns)), keys)


def insert(base: DataFrame, new: DataFrame, keys: Keys = ("id",)) -> DataFrame:
    """Add intervals to a set, merging what they overlap; touching stays apart."""
    columns = [*keys, "lo", "hi"]
    return union(base.select(columns).unionByName(new.select(columns)), keys, touching=False)


def length(df: DataFrame, keys: Keys = ("id",)) -> DataFrame:
    return union(df, keys).groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("length"))


def subtract(a: DataFrame, b: DataFrame, keys: Keys = ("id",), width: int = WIDTH) -> DataFrame:
    """A - B by a sweep over end points: segments where A covers and B doesn't, joined again."""

    def events(df: DataFrame, da: int, db: int) -> DataFrame:
        rows = checked(df).select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d")))).alias("e"))
        return rows.select(*keys, F.col("e.at").alias("lo"), (F.col("e.d") * da).alias("in_a"), (F.col("e.d") * db).alias("in_b"))

    swept = running(events(a, 1, 0).unionByName(events(b, 0, 1)), keys, "lo", ["in_a", "in_b"], width).withColumnRenamed("next", "hi")
    return union(swept.filter("in_a > 0 and in_b = 0 and hi is not null").select(*keys, "lo", "hi"), keys, width=width)


def complement(genome: DataFrame, regions: DataFrame, keys: Keys = ("id",)) -> DataFrame:
    return subtract(genome, regions, keys)


def overlapping(a: DataFrame, b: DataFrame, keys: Keys = ("id",)) -> DataFrame:
    """Pairs of rows of a and b that overlap; b's columns get the prefix b_. For keys with few rows each."""
    other = b.select([F.col(c).alias(c if c in keys else f"b_{c}") for c in b.columns])
    return a.join(other, list(keys)).filter(overlaps(F.col("lo"), F.col("hi"), F.col("b_lo"), F.col("b_hi")))


def binned_overlaps(a: DataFrame, b: DataFrame, keys: Keys = ("id",), width: int = 10_000) -> DataFrame:
    """The same pairs through position bins, for keys of any number of rows. Each pair comes from one bin."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    left = checked(a).withColumn("_bin", bins("lo", "hi"))
    right = checked(b).select([F.col(c).alias(c if c in keys else f"b_{c}") for c in b.columns]).withColumn("_bin", bins("b_lo", "b_hi"))
    pairs = left.join(right, [*keys, "_bin"]).filter(overlaps(F.col("lo"), F.col("hi"), F.col("b_lo"), F.col("b_hi")))
    return pairs.filter(F.col("_bin") == F.floor(F.greatest("lo", "b_lo") / width)).drop("_bin")


def set_overlap_length(a: DataFrame, b: DataFrame, keys: Keys = ("id",), binned: bool = True) -> DataFrame:
    """Bases that two sets share, per key of a (0 where they share none)."""
    pairs = (binned_overlaps if binned else overlapping)(union(a, keys), union(b, keys), keys)
    shared = pairs.groupBy(*keys).agg(F.sum(overlap_length(F.col("lo"), F.col("hi"), F.col("b_lo"), F.col("b_hi"))).alias("overlap"))
    return a.select(*keys).distinct().join(shared, list(keys), "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))


def coverage_percent(a: DataFrame, b: DataFrame, keys: Keys = ("id",)) -> DataFrame:
    """100 * shared bases / bases of a; an empty a is an error."""
    whole = length(a, keys)
    share = F.col("overlap") * F.lit(100).cast("double") / F.col("length")
    return set_overlap_length(a, b, keys).join(whole, list(keys)).select(*keys, "overlap", "length", F.when(F.col("length") > 0, share).otherwise(F.raise_error(F.lit("empty set")).cast("double")).alias("coverage"))


def any_overlap(df: DataFrame, keys: Keys = ("id",), width: int = WIDTH) -> DataFrame:
    """Per key, whether two of its intervals overlap: two of one start, or one that starts before the farthest end so far."""
    own = [*keys, "_cell"]
    places = checked(df).groupBy(*keys, "lo").agg(F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n")).withColumn("_cell", in_cell("lo", width))
    inside = Window.partitionBy(*own).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    met = (F.col("n") > 1) | F.coalesce(F.col("lo") < F.max("hi").over(inside), F.lit(False))
    cells = places.withColumn("_met", met).groupBy(*own).agg(F.bool_or("_met").alias("_met"), F.min("lo").alias("_first"), F.max("hi").alias("_end"))
    carry = F.max("_end").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    return cells.withColumn("_met", F.col("_met") | F.coalesce(F.col("_first") < carry, F.lit(False))).groupBy(*keys).agg(F.bool_or("_met").alias("overlaps"))


def center(df: DataFrame, keys: Keys = ("id",)) -> DataFrame:
    """Length-weighted mean of the midpoints (lo + hi - 1) / 2 of the set."""
    size = F.col("hi") - F.col("lo")
    middle = (F.col("lo") + F.col("hi") - 1) * F.lit(0.5).cast("double")
    return union(df, keys).groupBy(*keys).agg((F.sum(middle * size) / F.sum(size)).alias("center"))


def merge_adjacent_windows(df: DataFrame, keys: Keys = ("id",)) -> DataFrame:
    """Join 1-based inclusive windows where lo <= previous hi, then make them 0-based half-open."""
    return union(df, keys).withColumn("lo", F.col("lo") - 1)


def non_n(seqs: DataFrame, id_col: str = "id", seq: str = "seq") -> DataFrame:
    """Stretches without N or n, 1-based half-open, from the lengths of the runs between."""
    gaps = F.regexp_extract_all(F.col(seq), F.lit("([Nn]+)"), F.lit(0))
    parts = F.split(F.col(seq), "[Nn]+", -1)
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<lo: int, hi: int>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        end = acc["at"] + row["size"]
        here = F.array(F.struct(acc["at"].alias("lo"), end.alias("hi")))
        return F.struct((end + row["gap"]).alias("at"), F.when(row["size"] > 0, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    rows = F.zip_with(parts, gaps, lambda p, g: F.struct(F.length(p).alias("size"), F.coalesce(F.length(g), F.lit(0)).alias("gap")))
    found = F.aggregate(rows, state, step, lambda acc: acc["out"])
    return seqs.select(id_col, F.explode(found).alias("r")).select(id_col, F.col("r.lo").cast("long").alias("lo"), F.col("r.hi").cast("long").alias("hi"))


def rank(df: DataFrame, value: str, order: str, keys: Keys = ("id",), descending: bool = False) -> DataFrame:
    """Rank from 1 by value; ties by order, and reversed with a descending rank."""
    by = [F.col(value).desc(), F.col(order).desc()] if descending else [F.col(value), F.col(order)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long"))
