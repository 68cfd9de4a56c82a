"""Two-level sweeps, sliding diversity, sparse links, tiles of samples, trees and communities against brute force."""

import math
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import graph, gwas, samples, trees, variants
from helixframe.operators import intervals as iv
from helixframe.stages import Stage, run_stages

IVL = "id string, lo long, hi long"


def pieces(bases):
    """Maximal runs of a set of bases."""
    out = []
    for b in sorted(bases):
        if out and out[-1][1] == b:
            out[-1][1] = b + 1
        else:
            out.append([b, b + 1])
    return [tuple(p) for p in out]


def some_intervals(draw, n, top, longest):
    rows = []
    for _ in range(n):
        lo = draw.randrange(top)
        rows.append((draw.choice(["a", "b", None]), lo, lo + draw.choice([0, 1, 3, longest])))
    return rows + [r for r in rows if draw.random() < 0.3]


@pytest.mark.parametrize(("seed", "width", "longest"), [(0, 4, 6), (1, 10, 45), (2, 7, 200), (3, 1000, 9)])
def test_sweeps_over_cells_equal_sets_of_bases(spark, seed, width, longest):
    """Cells narrower than intervals, so states are carried over many of them; null keys, void and repeated rows."""
    draw = random.Random(seed)
    one, two = some_intervals(draw, 40, 300, longest), some_intervals(draw, 25, 300, longest)
    a, b = spark.createDataFrame(one, IVL), spark.createDataFrame(two, IVL)
    bases = lambda rows, k: {x for i, lo, hi in rows if i == k for x in range(lo, hi)}
    keys = {r[0] for r in one}
    got = lambda df: sorted(((r.id, r.lo, r.hi) for r in df.collect()), key=str)
    assert got(iv.union(a, width=width)) == sorted(((k, *p) for k in keys for p in pieces(bases(one, k))), key=str)
    assert got(iv.subtract(a, b, width=width)) == sorted(((k, *p) for k in keys for p in pieces(bases(one, k) - bases(two, k))), key=str)
    assert got(iv.union(a, touching=False, width=width)) == got(iv.union(a, touching=False, width=None))
    whole = {k: [(lo, hi) for i, lo, hi in one if i == k and lo < hi] for k in keys}
    met = {k: any(x[0] < y[1] and y[0] < x[1] for n, x in enumerate(v) for y in v[:n]) for k, v in whole.items() if v}
    assert {r.id: r.overlaps for r in iv.any_overlap(a, width=width).collect()} == met


def test_running_sums_tell_the_next_place(spark):
    draw = random.Random(4)
    events = [(draw.choice("xy"), draw.randrange(80), draw.randint(-3, 3)) for _ in range(120)]
    got = {(r.k, r.at): (r.next, r.n) for r in iv.running(spark.createDataFrame(events, "k string, at long, n long"), ["k"], "at", ["n"], 9).collect()}
    want = {}
    for k in "xy":
        places = sorted({at for key, at, _ in events if key == k})
        for at, after in zip(places, [*places[1:], None]):
            want[k, at] = after, sum(n for key, place, n in events if key == k and place <= at)
    assert got == want


def test_no_window_is_dealt_by_key_alone(spark):
    frame = spark.range(10).selectExpr("'k' AS id", "id * 3 AS lo", "id * 3 + 2 AS hi")
    plan = iv.union(frame)._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "Window" in line and "row_number" not in line]
    assert rows and all("_cell" in line for line in rows)


# --- diversity over sliding windows


def some_variants(draw, n, size):
    rows = []
    for v in range(n):
        kind = draw.choice(["DEL", "INS", "INV", "TRA", "TRA"])
        chrom, pos = draw.choice(["c1", "c2"]), draw.randrange(size + 15)
        length = draw.choice([1, 20, 90])
        chrom2, pos2 = (draw.choice(["c1", "c2", "c3"]), draw.randrange(size)) if kind == "TRA" else (chrom, pos if kind == "INS" else pos + length)
        rows.append((v, kind, chrom, pos, chrom2, pos2))
    return rows


@pytest.mark.parametrize(("seed", "window", "step"), [(0, 30, 10), (1, 50, 7), (2, 10, 10), (3, 10, 25), (4, 400, 3)])
def test_sliding_diversity_equals_the_windows_one_by_one(spark, seed, window, step):
    draw = random.Random(seed)
    svs = spark.createDataFrame(some_variants(draw, 40, 200), "variant long, type string, chrom string, pos long, chrom2 string, pos2 long")
    sizes = spark.createDataFrame([("c1", 200), ("c2", 120)], "chrom string, size long")
    calls = [(v, s, h, draw.choice("0012")) for v in range(40) for s in ("s1", "s2", "s3") for h in (1, 2) if v != 7]
    gt = spark.createDataFrame(calls + [(7, "s1", 1, "0")], "variant long, sample string, hap int, allele string")
    grid = variants.window_grid(sizes, window, step)
    where = variants.window_assign(svs, grid, window, step).distinct()
    plain = lambda df: {(r.chrom, r.start, r.end): pytest.approx(r.value, abs=1e-12) for r in df.collect()}
    swept = lambda df: {(r.chrom, r.start, r.end): r.value for r in df.collect()}
    assert swept(variants.sliding_theta_pi(svs, gt, sizes, window, step)) == plain(variants.theta_pi(where, gt, window))
    assert swept(variants.sliding_theta_s(svs, 6, sizes, window, step)) == plain(variants.theta_s(where, 6, window))
    assert swept(variants.sliding_gene_diversity(svs, gt, sizes, window, step)) == plain(sets_diversity(spark, where, calls + [(7, "s1", 1, "0")], grid))


def sets_diversity(spark, where, calls, grid):
    """Distinct sets of (variant, allele) in every window, haplotype by haplotype."""
    held = {}
    for r in where.collect():
        held.setdefault((r.chrom, r.start, r.end), set()).add(r.variant)
    rows = []
    for r in grid.collect():
        of = {}
        for v, s, h, allele in calls:
            if v in held.get((r.chrom, r.start, r.end), ()):
                of.setdefault((s, h), set()).add((v, allele))
        n, kinds = len(of), {}
        for x in of.values():
            kinds[frozenset(x)] = kinds.get(frozenset(x), 0) + 1
        rows.append((r.chrom, r.start, r.end, n / (n - 1) * (1 - sum(k * k for k in kinds.values()) / n**2) if n > 1 else 0.0))
    return spark.createDataFrame(rows, "chrom string, start long, end long, value double")


def test_steps_do_not_multiply_the_rows(spark):
    svs = spark.createDataFrame([(v, "DEL", "c1", v * 50, "c1", v * 50 + 30) for v in range(20)], "variant long, type string, chrom string, pos long, chrom2 string, pos2 long")
    sizes = spark.createDataFrame([("c1", 1100)], "chrom string, size long")
    runs = [variants.window_ranges(svs, sizes, 100, step).count() for step in (100, 1)]
    assert runs == [20, 20] and variants.window_ranges(svs, sizes, 100, 1).agg(F.sum(F.col("hi") - F.col("lo"))).first()[0] > 2000


def test_loh_blocks_overlap(spark):
    draw = random.Random(9)
    places = [draw.randrange(9000) for _ in range(700)]
    snps = spark.createDataFrame([("c", p) for p in places], "chrom string, pos long")
    got = variants.loh_windows(snps, spark.createDataFrame([("c", 9001)], "chrom string, size long"), 1, 50, 3)
    want = {(s, min(s + 50, 9001)) for s in range(9001) if s + 50 <= 9001 and sum(s <= p < s + 50 for p in places) < 3}
    assert {(r.start, r.end) for r in got.collect()} == want


# --- translocations


@pytest.mark.parametrize("seed", range(4))
def test_few_links_span_the_same_components(spark, seed):
    draw = random.Random(seed)
    rows = [(i, "c1", draw.choice(["c2", "c3"]), draw.randrange(160), draw.randrange(160)) for i in range(150)]
    rows += [(1000 + i, "c1", "c9", 55, 55) for i in range(60)] + [(2000 + i, "c1", "c9", 59 + 10 * i, 64 - 10 * i) for i in range(4)]
    tra = spark.createDataFrame(rows, "id long, chrom string, chrom2 string, pos long, pos2 long")
    links = [(r.src, r.dst) for r in variants.spanning_links(tra, 10).collect()]

    def roots(pairs):
        at = {r[0]: r[0] for r in rows}

        def find(x):
            while at[x] != x:
                x = at[x]
            return x

        for a, b in pairs:
            at[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in at}

    near = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1:3] == b[1:3] and abs(a[3] - b[3]) < 10 and abs(a[4] - b[4]) < 10]
    assert roots(links) == roots(near) and len(links) <= 5 * len(rows)
    assert {frozenset(p) for p in links} <= {frozenset(p) for p in near}


# --- linkage


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_pruning_hands_its_state_over_borders(spark, size):
    """A chain through the whole chromosome, and links at random, in ranges of a few variants."""
    draw = random.Random(size)
    sites = [(v, 1, v // 2) for v in range(40)]
    pairs = [(v, v + 1) for v in range(15)] + [tuple(draw.sample(range(15, 40), 2)) for _ in range(25)]
    kept = set()
    for v, _, _ in sorted(sites, key=lambda s: (s[2], s[0])):
        if not any(u in kept for a, b in pairs if v in (a, b) for u in (a, b)):
            kept.add(v)
    got = gwas.ld_prune(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(sites, "variant long, chrom long, pos long"), size)
    assert {r.variant: r.kept for r in got.collect()} == {v: v in kept for v in range(40)}


def test_linkage_of_every_pair_in_reach(spark):
    draw = random.Random(8)
    dose = {(v, s): draw.choice([0, 1, 2, 3, 4, None]) for v in range(25) for s in range(70)}
    place = {v: draw.randrange(90) for v in range(25)}
    frame = spark.createDataFrame([(f"v{v:02}", v % 2, place[v], f"s{s}", d) for (v, s), d in dose.items()], "variant string, chrom int, pos int, sample string, dose int")
    got = {(r.a, r.b): r.r2 for r in gwas.ld_pairs(frame, 20, 0.0, ploidy=4).collect()}
    want = {}
    for a in range(25):
        for b in range(25):
            if a % 2 == b % 2 and (place[a], a) < (place[b], b) and place[b] - place[a] <= 20:
                x, y = zip(*((dose[a, s], dose[b, s]) for s in range(70) if dose[a, s] is not None and dose[b, s] is not None))
                want[f"v{a:02}", f"v{b:02}"] = pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, abs=1e-9)
    assert got == want
    with pytest.raises(Exception, match="beyond the ploidy"):
        gwas.ld_pairs(frame, 20, 0.0).collect()


# --- samples against samples


def test_dissimilarity_counts_bits(spark, monkeypatch):
    monkeypatch.setattr(samples, "CHUNK", 16)
    monkeypatch.setattr(samples, "PART", 2)
    draw = random.Random(6)
    dose = {(v, s): draw.choice([0, 1, 2, None]) for v in range(70) for s in range(11)}
    dose |= {(v, 10): None for v in range(70)} | {(v, 9): 1 if v < 3 else None for v in range(70)} | {(v, 8): None if v < 3 else 2 for v in range(70)}
    frame = spark.createDataFrame([(v, s, d) for (v, s), d in dose.items()], "variant long, sample long, dose int")
    got = {(r.a, r.b): r.d for r in samples.dissimilarity(frame, width=4).collect()}
    want = {}
    for a in range(11):
        for b in range(a + 1, 11):
            both = [abs(dose[v, a] - dose[v, b]) / 2 for v in range(70) if dose[v, a] is not None and dose[v, b] is not None]
            if both:
                want[a, b] = pytest.approx(sum(both) / len(both))
    assert got == want and (8, 9) not in got


def centred_top(m, n):
    m = m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    top = np.linalg.eigh(m)[1][:, ::-1][:, :n]
    return top * np.sign(top[np.abs(top).argmax(0), np.arange(n)])


@pytest.mark.parametrize("size", [1, 30, 200])
def test_components_equal_the_whole_decomposition(spark, size):
    draw = np.random.default_rng(size)
    doses = draw.binomial(2, np.clip(draw.uniform(0.1, 0.9, (4, 300))[np.arange(size) % 4] + draw.normal(0, 0.02, (size, 300)), 0, 1)).astype(float)
    m = doses @ doses.T / 300
    rows = [(f"s{i:03}", f"s{j:03}", float(m[i, j])) if (i + j) % 2 else (f"s{j:03}", f"s{i:03}", float(m[i, j])) for i in range(size) for j in range(i, size)]
    got = samples.principal_components(spark.createDataFrame(rows, "a string, b string, k double"), 3, width=64)
    found = {r[0]: r[1:] for r in got.collect()}
    n = min(3, size)
    assert len(found) == size and got.columns == ["sample", *(f"pc{i + 1}" for i in range(n))]
    if size > 1:
        assert np.abs(np.array([found[f"s{i:03}"] for i in range(size)]) - centred_top(m, n)).max() < 1e-6


@pytest.mark.parametrize("kind", ["gap", "flat", "negative"])
def test_leading_vectors_of_five_hundred_rows(kind):
    """Spectra with a gap, without one, and with the largest values below zero."""
    draw = np.random.default_rng(1)
    turn = np.linalg.qr(draw.standard_normal((500, 500)))[0]
    values = {"gap": np.r_[50, 40, 30, 20, draw.uniform(0, 1, 496)], "flat": np.linspace(1, 2, 500), "negative": np.r_[3, 2, 1.5, 1, -draw.uniform(0, 90, 496)]}[kind]
    m = (turn * values) @ turn.T
    calls = []
    got = samples.leading_vectors(lambda x: calls.append(1) or m @ x, 500, 4)
    want = turn[:, np.argsort(-values)[:4]]
    assert np.abs(np.abs(got.T @ want) - np.eye(4)).max() < 1e-6 and len(calls) < 200


# --- trees


def random_tree(draw, leaves, across=None):
    """Path lengths between the leaves of a random tree; across gets a pair of leaves over each of its forks."""
    ends = {i: {i: 0.0} for i in range(leaves)}
    d = np.zeros((leaves, leaves))
    across = [] if across is None else across
    while len(ends) > 1:
        a, b = draw.sample(sorted(ends), 2)
        x, y = draw.uniform(0.5, 3), draw.uniform(0.5, 3)
        across.append((draw.choice(sorted(ends[a])), draw.choice(sorted(ends[b]))))
        for i, p in ends[a].items():
            for j, q in ends[b].items():
                d[i, j] = d[j, i] = p + q + x + y
        ends[a] = {**{i: p + x for i, p in ends.pop(a).items()}, **{j: q + y for j, q in ends.pop(b).items()}}
    return d


def paths(joins, leaves):
    """Path lengths between the leaves of the joined tree."""
    near, new = {}, leaves
    for k, (a, b, x, y) in enumerate(joins):
        if k < len(joins) - 1:
            near.setdefault(new, []).extend([(a, x), (b, y)])
            near.setdefault(a, []).append((new, x))
            near.setdefault(b, []).append((new, y))
            new += 1
        else:
            near.setdefault(a, []).append((b, x + y))
            near.setdefault(b, []).append((a, x + y))
    d = np.zeros((leaves, leaves))
    for i in range(leaves):
        seen, stack = {i}, [(i, 0.0)]
        while stack:
            v, far = stack.pop()
            if v < leaves:
                d[i, v] = far
            for u, x in near.get(v, ()):
                if u not in seen:
                    seen.add(u)
                    stack.append((u, far + x))
    return d


@pytest.mark.parametrize("weighted", [False, True])
def test_additive_trees_come_back_with_missing_pairs(weighted):
    """A fifth of the pairs missing: the distances that were missing are read off the tree.

    One pair over each fork stays: how far two sister groups are apart is not to be known from other pairs.
    """
    right = 0
    for seed in range(40):
        draw, across = random.Random(seed), []
        leaves = draw.randint(8, 20)
        d = random_tree(draw, leaves, across)
        cut = d.copy()
        pairs = [(i, j) for i in range(leaves) for j in range(i)]
        for i, j in draw.sample([p for p in pairs if p not in across and p[::-1] not in across], len(pairs) // 5):
            cut[i, j] = cut[j, i] = np.nan
        right += np.allclose(paths(trees.joined(cut, range(leaves), weighted), leaves), d)
    assert right == 40


def test_four_samples_without_one_distance():
    """Branches of 1 each and an inner one of 2; the missing pair counts as missing, not as 0."""
    d = np.array([[0, 2, 4, np.nan], [2, 0, 4, 4], [4, 4, 0, 2], [np.nan, 4, 2, 0]], float)
    want = np.array([[0, 2, 4, 4], [2, 0, 4, 4], [4, 4, 0, 2], [4, 4, 2, 0]], float)
    assert np.allclose(paths(trees.joined(d, range(4)), 4), want)
    with pytest.raises(ValueError, match="missing"):
        trees.joined(np.where(np.eye(4) > 0, 0, np.nan), range(4))


@pytest.mark.parametrize("leaves", [1, 2, 3, 9])
def test_newick_round_trip(spark, tmp_path, leaves):
    d = random_tree(random.Random(leaves), leaves)
    joins = trees.joined(d, range(leaves))
    names = {i: ["plain", "with blank", "it's", "(a,b):c[d]", "under_score", "x.5"][i % 6] + str(i) for i in range(leaves)}
    text = trees.newick(joins, names)
    trees.write_newick(spark, [text, "((A:1,B:2)inner[a comment]:0.5,\n C);"], f"{tmp_path}/trees")
    rows = trees.read_newick(spark, f"{tmp_path}/trees").collect()
    by = {}
    for r in rows:
        by.setdefault(r.tree, {})[r.node] = r
    own = next(t for t in by.values() if any(r.name == names[0] for r in t.values()))
    other = next(t for t in by.values() if t is not own)
    assert [(r.parent, r.name, r.length) for _, r in sorted(other.items())] == [(None, None, None), (0, "inner", 0.5), (1, "A", 1.0), (1, "B", 2.0), (0, "C", None)]

    def up(node):
        out, far = {node: 0.0}, 0.0
        while own[node].parent is not None:
            far += own[node].length or 0.0
            node = own[node].parent
            out[node] = far
        return out

    at = {r.name: n for n, r in own.items() if r.name}
    assert set(at) == set(names.values())
    for i in range(leaves):
        for j in range(leaves):
            a, b = up(at[names[i]]), up(at[names[j]])
            assert math.isclose(min(a[v] + b[v] for v in a if v in b), d[i, j], abs_tol=1e-8)


@pytest.mark.parametrize("text", ["(a,b", "(a,b));", "a,b;", "(a);b;", ""])
def test_newick_that_is_no_tree(text):
    with pytest.raises(ValueError):
        list(trees.newick_nodes(text))


# --- communities


def modularity(links, home):
    m = len(links)
    degree, inside = {}, {}
    for a, b in links:
        for v in (a, b):
            degree[home[v]] = degree.get(home[v], 0) + 1
        if home[a] == home[b]:
            inside[home[a]] = inside.get(home[a], 0) + 1
    return sum(inside.get(c, 0) / m - (k / 2 / m) ** 2 for c, k in degree.items())


def plain_louvain(links):
    """Levels of greedy moves written out with the modularity itself."""
    home = {v: v for v in sorted({v for pair in links for v in pair})}
    while True:
        groups = sorted(set(home.values()))
        at = {g: g for g in groups}
        moved = True
        score = lambda: modularity(links, {v: at[g] for v, g in home.items()})
        now, any_ = score(), False
        while moved:
            moved = False
            for g in groups:
                near = sorted({at[home[b if home[a] == g else a]] for a, b in links if (home[a] == g) != (home[b] == g)})
                best, own = now, at[g]
                for c in near:
                    old, at[g] = at[g], c
                    new = score()
                    at[g] = old
                    if new > best + 1e-12:
                        best, own = new, c
                if own != at[g]:
                    at[g], now, moved, any_ = own, best, True, True
        home = {v: at[g] for v, g in home.items()}
        if not any_:
            return home


def blobs(draw, n, k, inside, across):
    return sorted({(a, b) for a in range(n) for b in range(a + 1, n) if draw.random() < (inside if a % k == b % k else across)})


def test_levels_reach_the_modularity_of_plain_louvain():
    for seed in range(10):
        draw = random.Random(seed)
        links = blobs(draw, 36, 4, 0.5, 0.06)
        home = graph.louvain([a for a, _ in links], [b for _, b in links], [1] * len(links))
        assert modularity(links, home) >= modularity(links, plain_louvain(links)) - 1e-9


@pytest.mark.parametrize("local_links", [graph.LOCAL_LINKS, 20])
def test_sparse_components_are_split(spark, local_links):
    draw = random.Random(3)
    links = blobs(draw, 40, 4, 0.45, 0.02) + [(100, 101), (101, 102), (100, 102), (200, 201)]
    nodes = spark.createDataFrame([(v,) for v in [*range(40), 100, 101, 102, 200, 201, 300]], "id long")
    got = {r.id: r.grp for r in graph.communities(nodes, spark.createDataFrame(links, "src long, dst long"), local_links=local_links).collect()}
    assert {v: got[v] for v in (100, 101, 102, 200, 201, 300)} == {100: 100, 101: 100, 102: 100, 200: 200, 201: 200, 300: 300}
    assert all(got[g] == g <= v for v, g in got.items())
    big = [p for p in links if p[1] < 40]
    best = modularity(big, plain_louvain(big))
    assert modularity(big, got) >= (best - 1e-9 if local_links > 1000 else 0.9 * best)


# --- stages at once


def test_stages_run_together_and_fail_alone(spark, tmp_path):
    met, order = threading.Barrier(2, timeout=60), []

    def slow(name):
        def make(s, values, seen):
            met.wait()
            order.append((name, sorted(seen)))
            return s.range(3).withColumn("of", F.lit(s.sparkContext.getLocalProperty("spark.scheduler.pool")))

        return make

    def after(name, column="id"):
        def make(s, values, seen):
            order.append((name, sorted(seen)))
            return s.range(2).select(column)

        return make

    stages = [
        Stage("one", slow("one"), needs=()), Stage("two", slow("two"), needs=()), Stage("both", after("both"), needs=("one", "two")),
        Stage("bad", after("bad", "none"), needs=("two",)), Stage("below", after("below"), needs=("bad",)), Stage("aside", after("aside"), needs=("one",)),
    ]
    with pytest.raises(Exception, match="none"):
        run_stages(spark, stages, str(tmp_path), at_once=3)
    ran = dict(order)
    assert ran["both"] == ["one", "two"] and ran["aside"] == ["one"] and ran["one"] == [] and "below" not in ran
    good = [s for s in stages if s.name not in ("bad", "below")]
    tables = run_stages(spark, good, str(tmp_path), at_once=3)
    assert [t for t in tables] == ["one", "two", "both", "aside"] and {r.of for r in tables["two"].collect()} == {"two"}
    with pytest.raises(ValueError, match="before they stand"):
        run_stages(spark, [Stage("a", after("a"), needs=("b",)), Stage("b", after("b"))], str(tmp_path))


def test_the_first_error_waits_for_the_others(spark, tmp_path):
    def late(s, values, seen):
        time.sleep(0.5)
        return s.range(1)

    def broken(s, values, seen):
        raise KeyError("broken")

    with pytest.raises(KeyError):
        run_stages(spark, [Stage("broken", broken, needs=()), Stage("late", late, needs=())], str(tmp_path), at_once=2)
    assert spark.read.parquet(f"{tmp_path}/late").count() == 1


# --- variance components


def restricted_likelihood(y, fixed, parts, variances):
    v = sum(s * k for s, k in zip(variances, [*parts, np.eye(len(y))]))
    inverse = np.linalg.inv(v)
    inner = fixed.T @ inverse @ fixed
    p = inverse - inverse @ fixed @ np.linalg.solve(inner, fixed.T @ inverse)
    return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(inner)[1] + y @ p @ y)


def simulated(n, seed):
    draw = np.random.default_rng(seed)
    parts = []
    for m in (2 * n, 3 * n):
        z = draw.standard_normal((n, m))
        z[: n // 3] += draw.standard_normal(m) * 0.8
        parts.append(z @ z.T / m)
    y = sum(np.linalg.cholesky(k + 1e-9 * np.eye(n)) @ draw.standard_normal(n) * s for k, s in zip(parts, (1.5, 0.7))) + draw.standard_normal(n)
    age = draw.standard_normal(n)
    return parts, y + 2 * age + 5, age


def as_tables(spark, parts, y, age):
    n = len(y)
    rows = [[(f"s{i:03}", f"s{j:03}", float(k[i, j])) for i in range(n) for j in range(i, n)] for k in parts]
    kinships = {name: spark.createDataFrame(r, "a string, b string, k double") for name, r in zip(("snp", "sv"), rows)}
    values = [(f"s{i:03}", float(v)) for i, v in enumerate(y)] + [("s999", 3.0), ("unknown", None)]
    return kinships, spark.createDataFrame(values, "sample string, value double"), spark.createDataFrame([(f"s{i:03}", float(a)) for i, a in enumerate(age)] + [("s999", 0.0)], "sample string, age double")


def test_variances_are_at_the_top_of_the_likelihood(spark):
    parts, y, age = simulated(90, 3)
    found = {r.name: (r.variance, r.share) for r in samples.reml(*as_tables(spark, parts, y, age), width=32).collect()}
    assert list(found) == ["snp", "sv", "residual"] and abs(sum(s for _, s in found.values()) - 1) < 1e-9
    variances, fixed = np.array([v for v, _ in found.values()]), np.stack([np.ones(90), age], 1)
    best = restricted_likelihood(y, fixed, parts, variances)
    for i in range(3):
        for factor in (0.97, 1.03):
            other = variances.copy()
            other[i] *= factor
            assert restricted_likelihood(y, fixed, parts, other) < best or variances[i] <= 1e-6 * y.var()
    weight = [*(np.trace(k) / 90 for k in parts), 1.0]
    assert np.allclose([s for _, s in found.values()], variances * weight / (variances * weight).sum())


def test_traces_over_random_signs_come_close(spark):
    parts, y, age = simulated(80, 5)
    tables = as_tables(spark, parts, y, age)
    exact, drawn = ({r.name: r.share for r in samples.reml(*tables, probes=p, tolerance=1e-4, width=40).collect()} for p in (512, 79))
    assert all(abs(exact[k] - drawn[k]) < 0.05 for k in exact)


def test_conjugate_gradients_solve_all_sides():
    draw = np.random.default_rng(2)
    m = draw.standard_normal((60, 60))
    m = m @ m.T + 5 * np.eye(60)
    right = np.hstack([draw.standard_normal((60, 4)), np.zeros((60, 1))])
    assert np.allclose(samples.conjugate_gradients(lambda x: m @ x, right), np.linalg.solve(m, right))


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_genes_are_judged_over_borders_as_one_at_a_time(spark, size):
    """Runs of neighbours with rising and falling ids, and links at random, in ranges of a few genes."""
    from test_scaled import peeled

    draw = random.Random(size)
    genes = [(i, draw.randint(60, 160)) for i in range(30)]
    links = [(i, i + 1) for i in range(12)] + [tuple(draw.sample(range(30), 2)) for _ in range(30)]
    regions = []
    for a, b in links:
        lo = draw.randint(0, 40)
        regions += [(a, b, lo, lo + draw.randint(20, 90)), (b, a, lo, lo + draw.randint(20, 90))]
    got = graph.redundancy_peel(spark.createDataFrame(genes, "id long, len long"), spark.createDataFrame(regions, "id long, other long, lo int, hi int"), 100, size)
    want = peeled(genes, regions, 100)
    assert {r.id for r in got.collect()} == want and 0 < len(want) < 30
