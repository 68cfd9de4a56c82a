"""Operator 3, secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is parsed by Python's own public regex parser into a Boolean trigram
query: a concatenation asks for the trigrams of its fixed runs and for its parts' queries, an
alternation for one of its branches, anything else for nothing. The index is the table of postings
(trigram, text key) of the queries' trigrams; a text's key is a hash of the text, so copies share
their postings, and a collision could only add a candidate. Postings are intersected per
(rule, alternative) by counting distinct trigrams, and the texts of candidate keys are verified with
the rules that they are candidates for. Rules without a mandatory trigram scan every text. Each
alternative's rarest trigram is its anchor: a text without any anchor can't be a candidate and skips
the join, so few texts are shuffled.

An alternative's query asks for at most MOST_TERMS of its mandatory trigrams, those that most
alternatives share, and a pattern's expansion stops at MOST_ALTERNATIVES: a query may only get weaker by
that and let more texts through to be verified, so no match is lost.

Spans are code points, end exclusive, leftmost and non-overlapping per rule: the pieces between
matches and the matches give the places. Rules with `least` keep matches whose group is long enough.
Running sums go chunk by chunk (`folded_before`), so a text with very many matches costs little more
for each than one with few.

Defined results: null text is empty and has no secrets; a text of any length is scanned whole; repeated
rows are judged alike; spans that start together are listed in the rules' order; a null doc_id is kept; an
empty table gives an empty result; other columns, whatever their names, pass through `with_secrets`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C, _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, local_rows, table, written

MOST_ALTERNATIVES = 64
MOST_TERMS = 4
CHUNK = 64
_SPANS = "array<struct<start: int, end: int, kind: string>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base rules, then well-known public token formats.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # a run's first AKIA has its longest match, so the least length can be in the pattern
    Rule("hex", r"[0-9a-f]{24,}"),  # likewise: whole runs
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z]{2,10}://[A-Za-z0-9._-]{1,64}:[^\s:@/]{3,64}@"),
)
RULES = BASE + ADDED


def _trigrams(run: str) -> frozenset[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def _walk(parsed) -> list[list]:
    """Alternatives of a parsed expression, each a list of fixed characters and None for anything else."""
    out: list[list] = [[]]
    for op, arg in parsed:
        if op is C.LITERAL:
            parts = [[chr(arg)]]
        elif op is C.SUBPATTERN:
            parts = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [alternative for branch in arg[1] for alternative in _walk(branch)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            if high == 1 and low == 0:
                parts = [[], *_walk(inner)]
            elif low == 0:
                parts = [[None]]
            else:
                parts = [a * int(low) + ([] if high == low else [None]) if len(_walk(inner)) == 1 else [None] for a in _walk(inner)[:1]]
        elif op is C.IN and len(arg) <= 6 and all(o is C.LITERAL for o, _ in arg):
            parts = [[chr(v)] for _, v in arg]
        else:
            parts = [[None]]
        if len(out) * len(parts) > MOST_ALTERNATIVES:
            parts = [[None]]
        out = [a + b for a, b in product(out, parts)]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The pattern's Boolean query as alternatives, each a set of lower-cased trigrams that must all occur.

    Empty if some alternative lacks a mandatory trigram: the rule then scans every text.
    """
    found = set()
    for alternative in _walk(_parser.parse(pattern)):
        runs = "".join("\0" if c is None else c for c in alternative).split("\0")
        found.add(frozenset().union(*(_trigrams(run) for run in runs)))
    if not all(found):
        return []
    return sorted((q for q in found if not any(other < q for other in found)), key=sorted)


def fewer(queries: dict[str, list[frozenset[str]]], most: int = MOST_TERMS) -> dict[str, list[frozenset[str]]]:
    """The queries with at most `most` trigrams in each alternative: those that most alternatives share."""
    uses: dict[str, int] = {}
    for t in (t for qs in queries.values() for q in qs for t in q):
        uses[t] = uses.get(t, 0) + 1
    return {k: [frozenset(sorted(q, key=lambda t: (-uses[t], t))[:most]) for q in qs] for k, qs in queries.items()}


def queries_of(rules: Sequence[Rule]) -> dict[str, list[frozenset[str]]]:
    return {rule.kind: trigram_query(rule.pattern) for rule in rules}


def postings(text: Column, wanted: Sequence[str]) -> Column:
    """Those of the wanted trigrams that the text holds, letters in either case."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in wanted)))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Text key and the kinds of the rules whose query its postings satisfy, from (key, trigram) rows."""
    spark = index.sparkSession
    rows = [(t, kind, n, len(q)) for kind, qs in queries.items() for n, q in enumerate(qs) for t in q]
    terms = F.broadcast(local_rows(spark, rows, "trigram string, kind string, alternative int, terms int"))  # as large as the rules
    met = index.join(terms, "trigram").groupBy("_key", "kind", "alternative").agg(F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms"))
    return met.filter("n = terms").groupBy("_key").agg(F.collect_set("kind").alias("_kinds"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunked(values: Column, size: int = CHUNK) -> Column:
    """An array cut into arrays of `size`."""
    last = F.floor((F.size(values) - 1) / size).cast("int")
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda c: F.slice(values, c * size + 1, F.lit(size)))


def folded_before(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array the fold, from 0, of all before it, chunk by chunk.

    An array in a fold's state is copied at every step, so each state holds a chunk or one value a chunk.
    """

    def running(part: Column, start: Column) -> Column:
        state = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, state, lambda s, v: F.struct(step(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def whole(parts: Column) -> Column:
        sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), step))
        return bound(running(sums, F.lit(0)), lambda bases: F.flatten(F.transform(parts, lambda part, i: running(part, F.get(bases, i)))))

    return bound(values, lambda given: bound(chunked(given), whole))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's matches; one pass over texts without any."""
    pattern = F.lit(rule.pattern)
    lengths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    size = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else None
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)

    def placed(n: Column) -> Column:
        whole = F.zip_with(n, F.slice(gaps, 1, F.size(n)), lambda x, gap: x + gap)
        ends = bound(whole, lambda w: F.zip_with(folded_before(w, lambda at, v: at + v), w, lambda at, v: at + v))
        both = F.zip_with(ends, n, lambda end, x: F.struct((end - x).alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        if size is None:
            return both
        long = F.zip_with(both, size, lambda s, x: F.struct(s.alias("s"), (x >= rule.least).alias("long")))
        return F.transform(F.filter(long, lambda p: p["long"]), lambda p: p["s"])

    return F.when(F.rlike(text, pattern), bound(lengths, placed).cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def with_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """docs with one more, last column: all spans by start, then in the rules' order.

    It is named secrets, or secrets_1 and so on where docs has that name already.
    """
    name, maybe, kinds, own = (free_name(docs, n) for n in ("secrets", "_maybe", "_kinds", "_key"))
    queries = fewer({k: q for k, q in queries_of(rules).items() if q})
    wanted = sorted({t for qs in queries.values() for q in qs for t in q})
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.xxhash64(body)
    index = written(docs.select(key.alias("_key"), F.explode(postings(body, wanted)).alias("trigram")).distinct(), "postings")
    seen = {r.trigram: r["count"] for r in index.groupBy("trigram").count().collect()}  # at most one row for each query trigram
    anchors = sorted({min(q, key=lambda t: (seen.get(t, 0), t)) for qs in queries.values() for q in qs})
    keyed = docs.withColumn(maybe, reduce(Column.__or__, (F.contains(F.lower(body), F.lit(t)) for t in anchors), F.lit(False)))
    found = candidates(index, queries).withColumnsRenamed({"_key": own, "_kinds": kinds})
    some = keyed.filter(F.col(maybe)).withColumn(own, key).join(found, own, "left")
    none = keyed.filter(~F.col(maybe)).withColumn(kinds, F.lit(None).cast("array<string>"))
    rank = {rule.kind: i for i, rule in enumerate(rules)}

    def verified(frame: DataFrame, chosen: Sequence[Rule]) -> DataFrame:
        empty = F.array().cast(_SPANS)
        parts = [spans(body, r) if r.kind not in queries else F.when(F.array_contains(kinds, r.kind), spans(body, r)).otherwise(empty) for r in chosen]
        place = F.create_map(*(F.lit(x) for kind in rank.items() for x in kind))
        every = F.transform(F.concat(empty, *parts), lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
        ordered = F.transform(F.array_sort(every), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        return frame.select(*docs.columns, ordered.alias(name))

    return verified(some, rules).unionByName(verified(none, [r for r in rules if r.kind not in queries]))


def redacted(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every secret in the text replaced by a mark; overlapping spans become one."""
    found = with_secrets(docs, rules, text)
    secrets = found.columns[-1]
    body, last = F.col(text), F.array_max(F.col(secrets)["end"])

    def pieces(rows: Column) -> Column:
        """What the spans of a chunk leave and put, from the text between the places reached before and after it."""
        first = F.element_at(rows, 1)["at"]
        region = F.substring(body, first + 1, F.array_max(rows["end"]) - first)
        cut = lambda part: F.transform(
            rows, lambda r: F.when(r["start"] >= r["at"], F.concat(F.substring(part, r["at"] - first + 1, r["start"] - r["at"]), F.lit(mark))).otherwise("")
        )
        return F.array_join(bound(region, cut), "")

    reached = folded_before(F.transform(F.col(secrets), lambda s: s["end"]), lambda at, end: F.greatest(at, end))
    rows = F.zip_with(reached, F.col(secrets), lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end")))
    clean = F.concat(F.array_join(bound(rows, lambda r: F.transform(chunked(r), pieces)), ""), F.substring(body, last + 1, F.length(body)))
    return found.withColumn(text, F.when(F.size(secrets) > 0, clean).otherwise(body)).drop(secrets)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
