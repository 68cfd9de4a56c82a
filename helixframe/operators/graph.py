"""Graph operators over edge tables: components, density, degree, representatives, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..storage import written as cut_lineage

LOCAL_LINKS = 1_000_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every endpoint; component is the smallest id it reaches.

    Large-star / small-star rounds: each keeps at most as many edges as there were, aggregates with
    map-side combine, and ends when the edge set is a fixed point of both.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    loops = e.filter("a = b").select("a", "b")
    e = cut_lineage(e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        e = cut_lineage(small, "edges")
        state = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component"))
    alone = loops.select(F.col("a").alias("id"), F.col("a").alias("component"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots).unionByName(alone).groupBy("id").agg(F.min("component").alias("component"))


def components_with_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every node, isolated ones included."""
    found = connected_components(edges)
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges once, src < dst, no loops."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def density(components: DataFrame, edges: DataFrame) -> DataFrame:
    """component, n, m, density = 2m / (n (n - 1)); null for one node."""
    n = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    m = simple_edges(edges).join(components, F.col("src") == F.col("id")).groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    both = n.join(m, "component", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return both.withColumn("density", F.when(F.col("n") > 1, F.lit(2).cast("double") * F.col("m") / (F.col("n") * (F.col("n") - 1))))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = simple_edges(edges)
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def representative(grouped: DataFrame) -> DataFrame:
    """One node of each group: reference first, then degree, length, and order (id, is_ref, degree, len, grp)."""
    best = F.max(F.struct(F.col("is_ref"), F.col("degree"), F.col("len"), (-F.col("id")).alias("o"))).alias("b")
    return grouped.groupBy("grp").agg(best).select("grp", (-F.col("b.o")).alias("id"))


def label_components(components: DataFrame, prefix: str = "LD_") -> DataFrame:
    """Labels numbered by the order of the components' least nodes."""
    roots = numbered(components.select("component").distinct(), ["component"])
    return components.join(roots, "component").select("id", F.concat(F.lit(prefix), "number").alias("label"))


def communities(nodes: DataFrame, edges: DataFrame, least_density: float = 0.4, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(id, grp): dense components whole, sparse ones split into communities of high modularity; grp is the least member.

    Levels of local moves and of aggregation (Louvain). A component of up to `local_links` links is split in
    one task; of a larger one, rounds of moves on the whole graph make communities whose graph, a node
    each, is smaller, until it is small enough. Every step is deterministic.
    """
    comp = components_with_nodes(nodes, edges)
    dense = density(comp, edges).select("component", F.coalesce(F.col("density") >= least_density, F.lit(True)).alias("whole"))
    marked = comp.join(dense, "component")
    whole = marked.filter("whole").select("id", F.col("component").alias("grp"))
    links = simple_edges(edges).join(marked.filter("not whole").select(F.col("id").alias("src"), "component"), "src").select("component", "src", "dst", F.lit(1).cast("long").alias("w"))
    home, links = coarsened(cut_lineage(links, "links"), local_links)

    def split(key: tuple, part):
        import pandas as pd

        found = louvain(part["src"].tolist(), part["dst"].tolist(), part["w"].tolist())
        return pd.DataFrame({"node": list(found), "grp": list(found.values())})

    local = links.groupBy("component").applyInPandas(split, "node long, grp long")
    split_ids = home.join(local, "node").select("id", "grp")
    least = split_ids.groupBy("grp").agg(F.min("id").alias("least"))
    return whole.unionByName(split_ids.join(least, "grp").select("id", F.col("least").alias("grp")))


def louvain(src: list[int], dst: list[int], weight: list[int]) -> dict[int, int]:
    """The community of each node of a weighted graph (each link once, src = dst for what a node holds inside).

    Nodes move in order of their ids to the neighbouring community of the greatest gain (ties to the least
    community) until none gains; then communities are nodes, and so on until nothing is joined. Gains are
    compared as integers.
    """
    home = {v: v for v in sorted({*src, *dst})}
    links: dict[tuple[int, int], int] = {}
    for a, b, w in zip(src, dst, weight):
        links[min(a, b), max(a, b)] = links.get((min(a, b), max(a, b)), 0) + w
    total = 2 * sum(links.values())
    while True:
        near: dict[int, dict[int, int]] = {v: {} for v in sorted({v for pair in links for v in pair})}
        strength = dict.fromkeys(near, 0)
        for (a, b), w in links.items():
            strength[a] += w
            strength[b] += w
            if a != b:
                near[a][b] = near[b][a] = w
        at, held = {v: v for v in near}, dict(strength)
        changed, moved = False, True
        while moved:
            moved = False
            for v in near:
                own, k = at[v], strength[v]
                held[own] -= k
                into: dict[int, int] = {own: 0}
                for u, w in near[v].items():
                    into[at[u]] = into.get(at[u], 0) + w
                best = min(into, key=lambda c: (k * held[c] - total * into[c], c != own, c))
                held[best] += k
                if best != own:
                    at[v], moved, changed = best, True, True
        if not changed:
            return home
        home = {v: at[c] for v, c in home.items()}
        merged: dict[tuple[int, int], int] = {}
        for (a, b), w in links.items():
            pair = min(at[a], at[b]), max(at[a], at[b])
            merged[pair] = merged.get(pair, 0) + w
        links = merged


def coarsened(links: DataFrame, local_links: int, max_levels: int = 30, max_rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """(id, node) and the links between nodes, after merging nodes of components with more than `local_links` links.

    links (component, src, dst, w), each once. At each level, rounds of moves: a node that is first among its
    neighbours by a hash drawn anew each round, so that no two neighbours move at once, goes to the neighbouring
    community of the greatest gain. Then communities become nodes. A level that joins nothing ends it.
    """
    ends = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
    home = cut_lineage(ends.withColumn("node", F.col("id")), "home")
    for level in range(max_levels):
        large = links.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("m")).filter(F.col("n") > local_links)
        large = cut_lineage(large.select("component", (2 * F.col("m")).alias("total")), "large")
        if large.isEmpty():
            break
        here = links.join(large, "component")
        both = here.select("component", "total", F.col("src").alias("v"), F.col("dst").alias("u"), "w").unionByName(here.select("component", "total", F.col("dst").alias("v"), F.col("src").alias("u"), "w"))
        near = cut_lineage(both.filter("u <> v"), "near")
        at = cut_lineage(both.groupBy("v", "component", "total").agg(F.sum("w").alias("k")).withColumn("c", F.col("v")), "at")
        for turn in range(max_rounds):
            rank = lambda c: F.xxhash64(c, F.lit(level), F.lit(turn))
            beaten = near.filter((rank("u") < rank("v")) | ((rank("u") == rank("v")) & (F.col("u") < F.col("v")))).select("v").distinct()
            movers = at.join(beaten, "v", "left_anti")
            held = at.groupBy("c").agg(F.sum("k").alias("held"))
            into = near.join(movers.select("v", "k", F.col("c").alias("own")), "v").join(at.select(F.col("v").alias("u"), "c"), "u").groupBy("v", "k", "own", "total", "c").agg(F.sum("w").alias("w"))
            stay = movers.select("v", "k", F.col("c").alias("own"), "total", "c", F.lit(0).cast("long").alias("w"))
            offers = into.unionByName(stay).groupBy("v", "k", "own", "total", "c").agg(F.sum("w").alias("w")).join(held, "c")
            others = F.col("held") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0)
            cost = F.col("k").cast("decimal(19,0)") * others.cast("decimal(19,0)") - F.col("total").cast("decimal(19,0)") * F.col("w").cast("decimal(19,0)")
            best = offers.groupBy("v", "own").agg(F.min(F.struct(cost.alias("cost"), (F.col("c") != F.col("own")).alias("moves"), "c"))["c"].alias("to"))
            moves = cut_lineage(best.filter(F.col("to") != F.col("own")).select("v", "to"), "moves")
            if moves.isEmpty() and turn > 1:
                break
            at = cut_lineage(at.join(moves, "v", "left").withColumn("c", F.coalesce("to", "c")).drop("to"), "at")
        if at.filter("c <> v").isEmpty():
            break
        moved = at.select("v", "c")
        home = cut_lineage(home.join(moved, home["node"] == moved["v"], "left").select("id", F.coalesce("c", "node").alias("node")), "home")
        named = links.join(moved.select(F.col("v").alias("src"), F.col("c").alias("a")), "src", "left").join(moved.select(F.col("v").alias("dst"), F.col("c").alias("b")), "dst", "left")
        a, b = F.coalesce("a", "src"), F.coalesce("b", "dst")
        links = cut_lineage(named.select("component", F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "w").groupBy("component", "src", "dst").agg(F.sum("w").alias("w")), "links")
    return home, links


def longest_per_component(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """component, id of the longest node, and _InRef or _OutRef by whether any member is a reference."""
    joined = components.join(nodes, "id")
    best = joined.groupBy("component").agg(F.max(F.struct("len", (-F.col("id")).alias("o"))).alias("b"), F.bool_or("is_ref").alias("ref"))
    return best.select("component", (-F.col("b.o")).alias("id"), F.when(F.col("ref"), "_InRef").otherwise("_OutRef").alias("tag"))


def redundancy_peel(genes: DataFrame, regions: DataFrame, least: int = 100, size: int = 1 << 14) -> DataFrame:
    """Genes left after dropping, per component and round, the last gene with under `least` own bases.

    genes (id, len); regions (id, other, lo, hi): stretches of id identical to stretches of other. A gene
    gains own bases by its neighbours' going, and only genes of larger id go before it; so genes are judged from
    the last to the first, each by those of its neighbours that are still there, and one with enough own
    bases at the start, or without any neighbour left, stays. Low genes are dealt to ranges of `size`; in a round each range judges whatever its
    neighbours in other ranges, judged or not, can't change, and the first open range is always settled.
    """
    from .intervals import union

    ids = genes.select("id")
    here = regions.join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("other")), "other", "left_semi").filter("id <> other and lo < hi").select("id", "other", "lo", "hi")
    shared = union(here, ["id"], width=None).groupBy("id").agg(F.sum(F.col("hi") - F.col("lo")).alias("b"))
    low = numbered(genes.join(shared, "id").filter(F.col("len") - F.col("b") < least).select("id", "len"), [-F.col("id")], "place")
    low = cut_lineage(low.withColumn("part", F.expr(f"place div {size}")), "low")
    fates = low.select(F.col("id").alias("other"), F.lit(True).alias("other_low"))
    rows = here.join(low.select("id", "len", "part"), "id").join(fates, "other", "left").withColumn("gone", F.when(F.col("other_low").isNull() | (F.col("other") < F.col("id")), F.lit(False)))
    open_ = cut_lineage(rows.drop("other_low"), "open")

    def judge(part):
        import pandas as pd

        fate: dict[int, bool | None] = {}
        for gene, own in sorted(part.groupby("id"), key=lambda g: -g[0]):
            spans = sorted(zip(own["lo"].tolist(), own["hi"].tolist(), own["other"].tolist(), own["gone"].tolist()))
            bases = []
            for unknown_goes in (True, False):
                total, end = 0, None
                for lo, hi, other, gone in spans:
                    gone = fate.get(other) if gone is None else gone
                    if not (unknown_goes if gone is None else gone):
                        total += max(0, hi - (lo if end is None else max(lo, end)))
                        end = hi if end is None else max(end, hi)
                bases.append(own["len"].iloc[0] - total if total else float("inf"))  # without a neighbour left a gene stays
            fate[gene] = True if bases[0] < least else False if bases[1] >= least else None
        return pd.DataFrame({"id": list(fate), "gone": pd.array(list(fate.values()), dtype="boolean")})

    dropped = None
    while True:
        out = cut_lineage(open_.groupBy("part").applyInPandas(judge, "id long, gone boolean"), "round")
        news = out.filter("gone is not null")
        lost = news.filter("gone").select("id")
        dropped = lost if dropped is None else dropped.unionByName(lost)
        if out.filter("gone is null").isEmpty():
            return genes.join(dropped, "id", "left_anti")
        told = news.select(F.col("id").alias("other"), F.col("gone").alias("_news"))
        left = open_.join(news.select("id"), "id", "left_anti").join(told, "other", "left")
        open_ = cut_lineage(left.withColumn("gone", F.coalesce("gone", "_news")).drop("_news"), "open")


def trim_segments(segments: DataFrame, links: DataFrame, drop: DataFrame, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """Contract the dropped segments: every predecessor linked to every successor, orientations kept.

    links (id1, dir1, id2, dir2). Each round contracts an independent set, the dropped segments that
    have no dropped neighbour of smaller priority, which leaves the same links as one at a time. The
    priorities are hashes drawn anew each round, so rounds grow with the logarithm of a run's length.
    """
    names = ["id1", "dir1", "id2", "dir2"]
    left = drop.select("id").distinct()
    links = cut_lineage(links.select(names).distinct(), "links")
    for number in range(max_rounds):
        if left.isEmpty():
            return segments.join(drop.select("id"), "id", "left_anti"), links
        a, b = left.select(F.col("id").alias("id1")), left.select(F.col("id").alias("id2"))
        between = links.join(a, "id1", "left_semi").join(b, "id2", "left_semi").filter("id1 <> id2")
        place = lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("h"), F.col(c).alias("id"))
        larger = between.select(F.greatest(place("id1"), place("id2"))["id"].alias("id")).distinct()
        now = cut_lineage(left.join(larger, "id", "left_anti"), "now")
        gone1, gone2 = now.select(F.col("id").alias("id1")), now.select(F.col("id").alias("id2"))
        into = links.join(gone2, "id2", "left_semi").filter("id1 <> id2").select(F.col("id1").alias("u"), F.col("dir1").alias("du"), F.col("id2").alias("x"))
        out = links.join(gone1, "id1", "left_semi").filter("id1 <> id2").select(F.col("id1").alias("x"), F.col("id2").alias("w"), F.col("dir2").alias("dw"))
        made = into.join(out, "x").select(F.col("u").alias("id1"), F.col("du").alias("dir1"), F.col("w").alias("id2"), F.col("dw").alias("dir2"))
        kept = links.join(gone1, "id1", "left_anti").join(gone2, "id2", "left_anti").select(names)
        links = cut_lineage(kept.unionByName(made).distinct(), "links")
        left = cut_lineage(left.join(now, "id", "left_anti"), "left")
    raise RuntimeError("trimming did not settle")


def links_from_walks(walks: DataFrame, column: str = "walk") -> DataFrame:
    """Distinct oriented links of walks like >1>2<3."""
    steps = F.regexp_extract_all(F.col(column), F.lit("([<>][^<>,]+)"), F.lit(1))
    pairs = F.arrays_zip(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))).alias("a"), F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))).alias("b"))
    sign = lambda c: F.when(F.substring(c, 1, 1) == ">", "+").otherwise("-")
    name = lambda c: F.expr(f"substring({c}, 2)")
    rows = walks.select(F.explode(F.split(F.col(column), ",")).alias(column)).select(F.explode(pairs).alias("p"))
    return rows.select(name("p.a").alias("id1"), sign(F.col("p.a")).alias("dir1"), name("p.b").alias("id2"), sign(F.col("p.b")).alias("dir2")).distinct()


def segments_from_walks(walks: DataFrame, segments: DataFrame, column: str = "walk") -> DataFrame:
    ids = walks.select(F.explode(F.regexp_extract_all(F.col(column), F.lit("[<>]([^<>,]+)"), F.lit(1))).alias("id")).distinct()
    return segments.join(ids, "id", "left_semi")
