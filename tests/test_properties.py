"""Interval and graph operators against per-base sets and plain searches on random input."""

import random

import pytest

from helixframe.operators import graph, intervals


def random_set(draw, ids):
    return [(i, k, a, a + draw.randint(0, 12)) for i in range(ids) for k in "ab" for a in (draw.randint(0, 60) for _ in range(draw.randint(1, 6)))]


def bases(rows):
    out = {}
    for i, k, a, b in rows:
        out.setdefault((i, k), set()).update(range(a, b))
    return out


@pytest.fixture(scope="module")
def cases(spark):
    draw = random.Random(11)
    a, b = random_set(draw, 150), random_set(draw, 150)
    schema = "case int, id string, lo long, hi long"
    return a, b, spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


def collected(df):
    return [tuple(r) for r in df.select("case", "id", "lo", "hi").collect()]


KEYS = ("case", "id")


def disjoint(rows):
    rows = sorted(rows)
    return all(x[:2] != y[:2] or x[3] < y[2] for x, y in zip(rows, rows[1:]))


def test_union(cases):
    a, _, da, _ = cases
    got = collected(intervals.union(da, KEYS))
    assert bases(got) == {k: v for k, v in bases(a).items() if v} and disjoint(got)


def test_subtract(cases):
    a, b, da, db = cases
    got = collected(intervals.subtract(da, db, KEYS))
    want = {k: v - bases(b).get(k, set()) for k, v in bases(a).items()}
    assert bases(got) == {k: v for k, v in want.items() if v} and disjoint(got)


@pytest.mark.parametrize("binned", [False, True])
def test_overlap_length(cases, binned):
    a, b, da, db = cases
    got = {(r.case, r.id): r.overlap for r in intervals.set_overlap_length(da, db, KEYS, binned).collect()}
    assert got == {k: len(v & bases(b).get(k, set())) for k, v in bases(a).items()}


def test_binned_join_equals_the_plain_one(cases):
    _, _, da, db = cases
    plain = sorted(map(tuple, intervals.overlapping(da, db, KEYS).collect()))
    assert plain == sorted(map(tuple, intervals.binned_overlaps(da, db, KEYS, 7).select("case", "id", "lo", "hi", "b_lo", "b_hi").collect()))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        if v not in want:
            stack = [v]
            while stack:
                u = stack.pop()
                if u not in want:
                    want[u] = v
                    stack += near[u]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want


def test_trimming(spark):
    draw = random.Random(8)
    n = 40
    links = {(i, "+", draw.randint(0, n - 1), draw.choice("+-")) for i in range(n) for _ in range(2)}
    links = {x for x in links if x[0] != x[2]}
    drop = sorted(draw.sample(range(n), 14))
    want = set(links)
    for x in drop:
        into, out = [k for k in want if k[2] == x and k[0] != x], [k for k in want if k[0] == x and k[2] != x]
        want = {k for k in want if x not in (k[0], k[2])} | {(a[0], a[1], b[2], b[3]) for a in into for b in out}
    segments = spark.createDataFrame([(i,) for i in range(n)], "id long")
    _, got = graph.trim_segments(segments, spark.createDataFrame(sorted(links), "id1 long, dir1 string, id2 long, dir2 string"), spark.createDataFrame([(i,) for i in drop], "id long"))
    assert {tuple(r) for r in got.select("id1", "dir1", "id2", "dir2").collect()} == want
