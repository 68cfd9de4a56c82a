"""Operator 12, personal data: bootstrapped contextual extraction, with DataFrame functions only.

Base spans are the matches of four expressions that pass their checks (parts of an address, digits of a
number, the Luhn sum). They are the seeds: what stands before them, the last word and the last two words, are lexical
patterns. Every mention of an identifier-like string, whether a seed or not, is an edge between its
patterns and its value. Patterns and values are scored in turn, ROUNDS times at most: a pattern trusts a kind
by the distinct known values of that kind among all known values that it precedes, an unknown value of the
kind's wider shape by all trusted patterns that precede it (noisy or). Values that reach LEAST_TRUST are
known from then on, and may make further patterns trusted. All mentions of values found so are added to the
base spans; base spans stay.

A pattern is trusted from LEAST_VALUES distinct known values of its kind on, if these are LEAST_PURE of all
known values there (one foe is always assumed) and at least LEAST_SHARE of all values, so words that stand
before anything, such as articles, or before junk are not. Copies of a text count once, since values are
distinct. The graph's tables grow with the mentions, are shuffled by pattern and value, and are written each round;
only a count of the round's new values comes to the driver.

Expressions run in linear time: starts inside a run are refused by a look behind, repeats are possessive.
Spans are code points, end exclusive, leftmost and non-overlapping per kind.

Defined results: null text is empty and has no spans; a text of any length is scanned whole; repeated
rows are judged alike; spans that start together are listed in the kinds' order, found ones after base ones;
a value that two kinds trust alike belongs to the kind listed first; a null doc_id is kept; an empty table
gives an empty result; other columns, whatever their names, pass through `with_personal_data`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .secret_scan import bound, folded_before, listed
from .shared import free_name, table, written

LEAST_VALUES = 5
LEAST_PURE = 0.8
LEAST_SHARE = 0.5
LEAST_TRUST = 0.8
ROUNDS = 3
BEFORE = 64
_SPANS = "array<struct<start: int, end: int, kind: string>>"
_MENTIONS = "array<struct<start: int, end: int, value: string, before: string>>"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: what a text must hold, its expression, the check of a match, and the shape of unseen ones."""

    name: str
    sign: str
    pattern: str
    passes: Callable[[Column], Column]
    shape: Callable[[Column], Column]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def n_digits(value: Column, low: int, high: int) -> Column:
    return F.length(digits(value)).between(low, high)


def luhn(value: Column) -> Column:
    """Whether the digits, every second one from the right doubled, add up to a multiple of ten."""
    from_right = F.split(F.reverse(digits(value)), "")
    number = lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * (1 + i % 2)
    one_digit = F.transform(F.transform(from_right, number), lambda d: F.when(d > 9, d - 9).otherwise(d))
    return F.aggregate(one_digit, F.lit(0), lambda a, d: a + d) % 10 == 0


# The four base expressions, written so that each start in a run is tried once.
KINDS = (
    Kind(
        "email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda v: F.lit(True), lambda v: F.rlike(v, F.lit(r"^[^@]+@[^@]+$")),
    ),
    Kind(
        "ip", ".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        lambda v: F.rlike(v, F.lit(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?){3}$")),
        lambda v: F.rlike(v, F.lit(r"^[0-9]++(?:\.[0-9]++){3,}+$|^[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}$")),
    ),
    Kind(
        "card", "", r"[0-9]++(?:[\x20-][0-9]++)*+",
        lambda v: n_digits(v, 14, 19) & luhn(v), lambda v: F.rlike(v, F.lit("^[0-9][0-9 -]*$")) & n_digits(v, 12, 19),
    ),
    Kind(
        "phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda v: n_digits(v, 10, 15), lambda v: F.rlike(v, F.lit(r"^\+?[0-9(][0-9 ().-]*$")) & n_digits(v, 7, 15),
    ),
)
NAMES = [kind.name for kind in KINDS]
# A mention: an IPv6-like run, or a run of identifier characters with a digit or an at sign and the groups of digits after it.
_OF_RUN = r"A-Za-z0-9@._%+()-"
MENTION = rf"(?<![{_OF_RUN}:])[0-9A-Fa-f]{{0,4}}(?::[0-9A-Fa-f]{{0,4}}){{2,7}}(?![{_OF_RUN}:])|(?:\G|(?<![{_OF_RUN}]))[{_OF_RUN}]*?[0-9@][{_OF_RUN}]*+(?:\x20[0-9().-]++)*+"


def placed(text: Column, pattern: str, make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(end, value, gap) of each match: where it ends, what it is, and the text between it and the one before."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def of(values: Column, gaps: Column) -> Column:
        whole = F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda v, g: F.length(v) + F.length(g))
        ends = bound(whole, lambda w: F.zip_with(folded_before(w, lambda at, n: at + n), w, lambda at, n: at + n))
        pairs = F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda v, g: F.struct(v.alias("v"), g.alias("g")))
        return F.zip_with(ends, pairs, lambda end, p: make(end, p["v"], p["g"]))

    return bound(values, lambda v: bound(gaps, lambda g: of(v, g)))


def base_spans(text: Column, kind: Kind) -> Column:
    """The kind's matches that pass its check; one pass over texts without any."""
    found = placed(text, kind.pattern, lambda end, v, g: F.struct((end - F.length(v)).alias("start"), end.alias("end"), F.lit(kind.name).alias("kind"), kind.passes(v).alias("passes")))
    kept = F.transform(F.filter(found, lambda s: s["passes"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    here = F.rlike(text, F.lit(kind.pattern if kind.name != "card" else "[0-9](?:[\\x20-]?[0-9]){13}"))
    return F.when((F.contains(text, F.lit(kind.sign)) & here) if kind.sign else here, kept.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def mention_spans(text: Column) -> Column:
    """array<struct<start, end, value, before>>: identifier-like strings, and the end of the text before each."""
    trimmed = lambda v: F.rtrim(v, F.lit("@._%+()-: "))
    found = placed(text, MENTION, lambda end, v, g: F.struct((end - F.length(v)).alias("start"), trimmed(v).alias("value"), F.substring(g, F.greatest(F.length(g) - BEFORE + 1, F.lit(1)), F.lit(BEFORE)).alias("before")))
    full = F.transform(found, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"), m["before"].alias("before")))
    some = F.filter(full, lambda m: reduce(Column.__or__, (k.shape(m["value"]) for k in KINDS)))
    return F.when(F.rlike(text, F.lit("[0-9@]|:[0-9A-Fa-f]{0,4}:")), some.cast(_MENTIONS)).otherwise(F.array().cast(_MENTIONS))


def known_kind(value: Column) -> Column:
    """The kind of which a whole value is a base match; null for an unseen one."""
    exact = lambda kind: F.rlike(value, F.lit(f"^(?:{kind.pattern})$")) & kind.passes(value)
    return F.coalesce(*(F.when(exact(kind), F.lit(kind.name)) for kind in KINDS))


def patterns(before: Column) -> Column:
    """The last word, and the last two words, letters folded and digits as 0."""
    plain = F.regexp_replace(F.lower(before), "[0-9]", "0")
    words = F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    last = lambda ws, n: F.when(F.size(ws) >= n, F.array_join(F.slice(ws, -n, n), " "))
    return bound(words, lambda ws: F.array_compact(F.array(last(ws, 1), last(ws, 2))))


def mentions_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """key of the text, start, end, value and before of every mention, one row for all copies of a text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.md5(body).alias("key"), F.explode(mention_spans(body)).alias("m"))
    return written(rows.select("key", "m.start", "m.end", "m.value", "m.before").distinct(), "mentions")


def trusted(edges: DataFrame, least_values: int = LEAST_VALUES) -> DataFrame:
    """pattern, kind and trust of the patterns that may extract, from (pattern, value, known) rows."""
    counts = [F.count(F.when(F.col("known") == k, 1)).alias(k) for k in NAMES]
    sums = edges.groupBy("pattern").agg(F.count("known").alias("all_known"), F.count(F.lit(1)).alias("all_values"), *counts)
    rivals = F.array(*(F.struct(F.col(k).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(NAMES)))
    best = sums.select("pattern", "all_known", "all_values", F.array_max(rivals).alias("b")).select("pattern", "b.kind", "b.n", "all_known", "all_values")
    trust = F.col("n") / (F.col("all_known") + 1)
    return best.filter((F.col("n") >= least_values) & (trust >= LEAST_PURE) & (F.col("n") >= LEAST_SHARE * F.col("all_values"))).select("pattern", "kind", trust.alias("trust"))


def bootstrapped(mentions: DataFrame, rounds: int = ROUNDS, least_values: int = LEAST_VALUES) -> DataFrame:
    """value and kind of the values that patterns discover, over all rounds."""
    values = mentions.select("value").distinct()
    shapes = F.array_compact(F.array(*(F.when(k.shape(F.col("value")), F.lit(k.name)) for k in KINDS)))
    classed = values.select("value", known_kind(F.col("value")).alias("known"), shapes.alias("shapes"))
    links = mentions.select("value", F.explode(patterns(F.col("before"))).alias("pattern")).distinct()
    edges = written(links.join(classed, "value"), "edges")
    found = edges.sparkSession.createDataFrame([], "value string, kind string")
    for _ in range(rounds):
        rules = written(trusted(edges.select("pattern", "value", "known"), least_values), "patterns")
        asked = edges.filter("known is null").join(rules, "pattern").filter(F.array_contains("shapes", F.col("kind")))
        doubt = F.round(F.sum(F.log1p(-F.col("trust"))), 9)
        scored = asked.groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"))
        rank = reduce(lambda c, k: c.when(F.col("kind") == k, -NAMES.index(k)), NAMES[1:], F.when(F.col("kind") == NAMES[0], 0))
        chosen = scored.filter(F.col("score") >= LEAST_TRUST).groupBy("value").agg(F.max(F.struct(F.col("score"), rank.alias("rank"), "kind"))["kind"].alias("kind"))
        new = written(chosen, "found")
        if not new.count():
            break
        found = found.unionByName(new)
        edges = written(edges.join(new, "value", "left").withColumn("known", F.coalesce("known", "kind")).drop("kind"), "edges")
    return found


def with_personal_data(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, least_values: int = LEAST_VALUES) -> DataFrame:
    """docs with one more, last column: all spans by start, base kinds first; found ones have kinds context_email and so on.

    It is named personal, or personal_1 and so on where docs has that name already.
    """
    name, own, base, more = (free_name(docs, n) for n in ("personal", "_key", "_base", "_found"))
    body = F.coalesce(F.col(text), F.lit(""))
    mentions = mentions_of(docs, text)
    values = bootstrapped(mentions, rounds, least_values)
    hits = mentions.join(values, "value").groupBy("key").agg(F.collect_list(F.struct("start", "end", F.concat(F.lit("context_"), "kind").alias("kind"))).alias(more))
    hits = written(hits.withColumnRenamed("key", own), "hits")
    empty = F.array().cast(_SPANS)
    marked = docs.withColumn(own, F.md5(body)).withColumn(base, F.concat(empty, *(base_spans(body, k) for k in KINDS)))
    joined = marked.join(hits, own, "left")
    place = F.create_map(*(F.lit(x) for i, k in enumerate([*NAMES, *(f"context_{k}" for k in NAMES)]) for x in (k, i)))
    every = F.transform(F.concat(base, F.coalesce(more, empty)), lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(every), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return joined.select(*docs.columns, ordered.alias(name))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("personal", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("personal", lambda s: s["kind"].isin(NAMES))
    return found.select("doc_id", *(count(k) for k in NAMES), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("personal")).alias("spans"))
