"""Operators whose values SQL doesn't check, or that must not depend on the size of one group, by brute force."""

import itertools
import random

import numpy as np
import pytest

from helixframe.functions.numbering import numbered
from helixframe.operators import assembly, graph, gwas, variants


def test_numbers_follow_the_order(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice([None, 1, 2, 3]), draw.random()) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "id long, a int, b double").repartition(7), ["a", "b"]).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert [r.id for r in sorted(got, key=lambda r: r.number)] == [r[0] for r in want]
    assert sorted(r.number for r in got) == list(range(1, 501))


def path_lengths(branches):
    near = {}
    for a, b, n in branches:
        near.setdefault(a, []).append((b, n))
        near.setdefault(b, []).append((a, n))
    out = {}
    for start in near:
        stack = [(start, None, 0.0)]
        while stack:
            at, before, far = stack.pop()
            out[start, at] = far
            stack += [(b, at, far + n) for b, n in near[at] if b != before]
    return out


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("leaves", [2, 3, 4, 9, 20])
def test_neighbour_joining_gives_back_an_additive_tree(spark, leaves, weighted):
    draw = random.Random(leaves)
    ids, branches, new = list(range(1, leaves + 1)), [], 1000
    while len(ids) > 2:
        a, b = draw.sample(ids, 2)
        branches += [(a, new, draw.uniform(0.5, 3)), (b, new, draw.uniform(0.5, 3))]
        ids, new = [i for i in ids if i not in (a, b)] + [new], new + 1
    branches.append((*ids, draw.uniform(0.5, 3)))
    want = path_lengths(branches)
    rows = [(a, b, want[a, b]) for a, b in itertools.combinations(range(1, leaves + 1), 2)]
    joins = gwas.neighbour_joining(spark.createDataFrame(rows, "a long, b long, d double"), weighted=weighted)
    found, node = [], leaves + 1
    for a, b, x, y in joins[:-1]:
        found += [(a, node, x), (b, node, y)]
        node += 1
    found.append(joins[-1][:3])
    got = path_lengths(found)
    assert all(got[a, b] == pytest.approx(want[a, b]) for a, b in itertools.combinations(range(1, leaves + 1), 2))


def test_kinship_of_power_minus_one_is_of_standardised_doses(spark, monkeypatch):
    monkeypatch.setattr(gwas, "BLOCK", 4)
    draw = np.random.default_rng(2)
    f = draw.uniform(0.1, 0.9, 60)
    dose = draw.binomial(2, f, (11, 60))
    rows = [(v, s, int(dose[s, v])) for s in range(11) for v in range(60)]
    got = {(r.a, r.b): r.k for r in gwas.kinship(spark.createDataFrame(rows, "variant long, sample long, dose int"), -1.0).collect()}
    p = dose.mean(0) / 2
    some = (p > 0) & (p < 1)
    z = ((dose - 2 * p) / np.sqrt(np.where(some, 2 * p * (1 - p), 1)))[:, some]
    want = z @ z.T / some.sum()
    assert got == {(i, j): pytest.approx(want[i, j]) for i in range(11) for j in range(i, 11)}


def test_linkage_prunes_by_components(spark):
    draw = random.Random(3)
    sites = [(v, v % 2, draw.randrange(100)) for v in range(40)]
    pairs = sorted({tuple(sorted(draw.sample(range(40), 2))) for _ in range(30)})
    kept = set()
    for v, _, _ in sorted(sites, key=lambda s: (s[2], s[0])):
        if not any(u in kept for a, b in pairs if v in (a, b) for u in (a, b)):
            kept.add(v)
    got = gwas.ld_prune(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(sites, "variant long, chrom long, pos long"))
    assert {r.variant: r.kept for r in got.collect()} == {v: v in kept for v in range(40)}


def test_permutations_shuffle(spark):
    pheno = spark.createDataFrame([(f"s{i}", float(i)) for i in range(300)], "strain string, value double")
    got = gwas.permute(pheno, 2, 7).collect()
    by = {p: {r.strain: r.value for r in got if r.perm == p} for p in (1, 2)}
    for shuffled in by.values():
        assert sorted(shuffled.values()) == [float(i) for i in range(300)]
        assert sum(v == float(k[1:]) for k, v in shuffled.items()) < 15
    assert by[1] != by[2]


def test_long_runs_are_trimmed_in_few_rounds(spark, monkeypatch):
    rounds = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, name="step": rounds.append(name) or cut(df, name))
    n = 300
    segments = spark.createDataFrame([(i,) for i in range(n)], "id long")
    links = spark.createDataFrame([(i, "+", i + 1, "+") for i in range(n - 1)], "id1 long, dir1 string, id2 long, dir2 string")
    kept, left = graph.trim_segments(segments, links, segments.filter(f"id > 0 and id < {n - 1}"))
    assert sorted(r.id for r in kept.collect()) == [0, n - 1]
    assert [tuple(r) for r in left.collect()] == [(0, "+", n - 1, "+")]
    assert rounds.count("now") < 25


def peeled(genes, regions, least):
    """One gene at a time per component of low genes, the last first."""
    alive = dict(genes)
    while True:
        own = {}
        for g, size in alive.items():
            held = {b for a, o, lo, hi in regions if a == g and o in alive and o != g for b in range(lo, hi)}
            own[g] = size - len(held)
        low = {g for g in alive if own[g] < least and any(a == g and o in alive and o != g for a, o, _, _ in regions)}
        if not low:
            return set(alive)
        seen, drop = set(), set()
        for g in sorted(low):
            if g not in seen:
                part, stack = set(), [g]
                while stack:
                    x = stack.pop()
                    if x not in part:
                        part.add(x)
                        stack += [o for a, o, _, _ in regions if a == x and o in low] + [a for a, o, _, _ in regions if o == x and a in low]
                seen |= part
                drop.add(max(part))
        for g in drop:
            del alive[g]


@pytest.mark.parametrize("seed", range(3))
def test_redundancy_peels_as_one_at_a_time(spark, seed):
    draw = random.Random(seed)
    genes = [(i, draw.randint(60, 200)) for i in range(25)]
    regions = []
    for _ in range(35):
        a, b = draw.sample(range(25), 2)
        lo = draw.randint(0, 40)
        regions += [(a, b, lo, lo + draw.randint(1, 60)), (b, a, lo, lo + draw.randint(1, 60))]
    got = graph.redundancy_peel(spark.createDataFrame(genes, "id long, len long"), spark.createDataFrame(regions, "id long, other long, lo int, hi int"))
    assert {r.id for r in got.collect()} == peeled(genes, regions, 100)


def test_cover_takes_the_best_haplotype_each_step(spark):
    draw = random.Random(4)
    presence = sorted({(f"h{h}", h, draw.randrange(30)) for h in range(12) for _ in range(6)})
    good = {"h3", "h7", "h9"}
    left, want = {}, []
    for name, place, v in presence:
        left.setdefault((place, name), set()).add(v)
    while any(left.values()):
        (place, name), held = min(((k, v) for k, v in left.items() if v), key=lambda x: (x[0][1] not in good, -len(x[1]), x[0][0]))
        want.append((len(want) + 1, name, len(held)))
        left = {k: v - held for k, v in left.items()}
    rows = spark.createDataFrame(presence, "haplotype string, ord int, variant long")
    got = variants.greedy_cover(rows, spark.createDataFrame([(h,) for h in good], "haplotype string"))
    assert [tuple(r) for r in got.orderBy("step").collect()] == want


def test_redundant_contigs_go_by_the_largest_share(spark):
    draw = random.Random(5)
    contigs = [(asm, f"c{i}", i, draw.randint(40, 90)) for asm in ("x", "y") for i in range(10)]
    hits = []
    for asm, name, _, size in contigs:
        for _ in range(4):
            lo = draw.choice([0, draw.randrange(size)])
            hits.append((asm, name, f"c{draw.randrange(10)}", lo, draw.choice([size, draw.randint(lo + 1, size)])))
    want = {}
    for asm in ("x", "y"):
        alive = {name: size for a, name, _, size in contigs if a == asm}
        while alive:
            held = {q: {b for a, n, o, lo, hi in hits if (a, n) == (asm, q) and o != q and o in alive for b in range(lo, hi)} for q in alive}
            worst = max(alive, key=lambda q: len(held[q]) / alive[q])
            if 100 * len(held[worst]) < 95 * alive[worst]:
                break
            del alive[worst]
        want |= {(asm, f"c{i}"): f"c{i}" in alive for i in range(10)}
    hit_rows = spark.createDataFrame(hits, "asm string, qry string, other string, lo long, hi long")
    got = assembly.remove_redundant(hit_rows, spark.createDataFrame(contigs, "asm string, qry string, ord long, len long"))
    assert {(r.asm, r.qry): r.kept for r in got.collect()} == want and len(set(want.values())) == 2


def test_missing_doses_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(gwas, "BLOCK", 4)
    draw = random.Random(3)
    dose = {(v, s): draw.choice([0, 1, 2, 2, None]) for v in range(1, 13) for s in range(1, 11)}
    frame = spark.createDataFrame([(v, 1, v, s, d) for (v, s), d in dose.items()], "variant long, chrom long, pos long, sample long, dose long")
    z = {}
    for v in range(1, 13):
        seen = {s: dose[v, s] for s in range(1, 11) if dose[v, s] is not None}
        f = sum(seen.values()) / len(seen) / 2
        z |= {(v, s): (d - 2 * f) * (2 * f * (1 - f)) ** -0.125 for s, d in seen.items()} if 0 < f < 1 else {}
    for r in gwas.kinship(frame).collect():
        both = [z[v, r.a] * z[v, r.b] for v in range(1, 13) if (v, r.a) in z and (v, r.b) in z]
        assert r.k == pytest.approx(sum(both) / len(both))
    pairs = {(r.a, r.b): r.r2 for r in gwas.ld_pairs(frame, 20, 0.0).collect()}
    assert len(pairs) > 30
    for (a, b), r2 in pairs.items():
        x, y = zip(*((dose[a, s], dose[b, s]) for s in range(1, 11) if dose[a, s] is not None and dose[b, s] is not None))
        assert r2 == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, abs=1e-9)


def test_lone_samples_have_no_diversity(spark):
    windows = spark.createDataFrame([(1, "c", 0, 100), (2, "c", 0, 100)], "variant long, chrom string, start long, end long")
    calls = spark.createDataFrame([(1, "s1", 0, "0"), (2, "s1", 0, "0"), (2, "s2", 0, "1")], "variant long, sample string, hap int, allele string")
    assert [r.value for r in variants.theta_pi(windows, calls, 100).collect()] == [pytest.approx(0.01)]
    grid = windows.select("chrom", "start", "end").distinct()
    assert [r.value for r in variants.gene_diversity(windows, calls.filter("sample = 's1'"), grid).collect()] == [0.0]
    assert [r.value for r in variants.theta_s(windows, 1, 100).collect()] == [None]
    assert [r.value for r in variants.theta_s(windows, 3, 100).collect()] == [pytest.approx(2 / 1.5 / 100)]
    assert gwas.principal_components(spark.createDataFrame([], "a long, b long, k double")).collect() == []
