"""Operator 2, n-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersection.

A document's set is its distinct 5-word shingles; equal sets form a class, and only classes are
compared. Sets are ordered by a bounded sketch of shingle frequencies (rare first, then by hash); two
sets with Jaccard >= 4/5 share a shingle among the first n - ceil(4n/5) + 1 of each, so only those
are posted. Classes that share a posted shingle form a group; groups with the same members are one.

Links are sought so that none between different components is lost and pairs inside one are not all
made. A group is dealt into tiles of about TILE classes. Round 1 compares each tile's bitmaps, by
size, and takes a forest over the pairs that may link, the likeliest first; round 2 does so with one
class of each component that a group still holds. Then groups that still span components are
searched whole: members outside the group's commonest component against all members of other
components, tile by tile and size band by size band. A bitmap is the parity of the shingles hashed to
each bit; its width follows the set's size and a wider one folds to a narrower. The differing bits
never exceed the symmetric difference, so they bound the overlap from above; survivors get an exact
sorted-array intersection, for which the compressed texts lie in a table bucketed by class.

A class is named by 64 bits of its set; a second 64 bits tell when unlike sets share a name, and those
few are named anew. The sketch's cells are hot by HOT_LEVEL or, where shingles are so many that each cell
is several shingles', by eight times the mean cell; a hot shingle's postings are dealt to several buckets.

Defined results: null or empty text has no shingles and stands alone; a text of any length is taken
whole; repeated rows share a class; a null doc_id never is a component_id unless all of its component's
are null; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.graph import connected_components
from .kernel import Chunk, mixed, per_document_sets
from .kernel import chunks as cut_in_chunks
from .shared import dense_sum, free_name, note_table, table, texts, written

WIDTH = 5
CHUNK_BYTES = 1 << 18  # a worker's arrays are some dozens of bytes for each of these
TILE = 256
FLUSH = 1 << 19
HOT_LEVEL = 13
PARTITION_POSTINGS = 2_000_000
BITS_EACH = 2
SALTS = 32
_POSTED = "bucket int, payload binary"


def chunks(column: pa.Array) -> Iterator[Chunk]:
    return cut_in_chunks(column, CHUNK_BYTES)


def sets_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    values, bounds = chunk.lower.shingles(WIDTH)
    return per_document_sets(values, bounds)


def names_of(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names for each set, the same for equal sets."""
    sizes = np.diff(bounds).astype(np.uint64)
    out = []
    for factor in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values * np.uint64(factor)))])
        out.append(mixed(sums[bounds[1:]] - sums[bounds[:-1]] + sizes))
    return out[0], out[1]


def classes_of(values: np.ndarray, bounds: np.ndarray, clashes: np.ndarray) -> np.ndarray:
    """The class of each set: its first name, or a mix of both where unlike sets share the first (clashes)."""
    one, two = names_of(values, bounds)
    if len(clashes):
        one = np.where(np.isin(one, clashes), mixed(one ^ mixed(two)), one)
    return one.view(np.int64)


def named_sets(docs: DataFrame, key: str, clashes: np.ndarray) -> DataFrame:
    """key, n_shingles, class and second name of every row."""
    source = texts(docs, key)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                values, bounds = sets_of(chunk)
                second = names_of(values, bounds)[1].view(np.int64)
                arrays = [pa.array(np.diff(bounds)), pa.array(classes_of(values, bounds, clashes)), pa.array(second)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), *arrays], names=[key, "n_shingles", "cls", "second"])

    return source.mapInArrow(name, f"`{key}` {source.schema[0].dataType.simpleString()}, n_shingles long, cls long, second long")


def named_apart(docs: DataFrame, key: str) -> tuple[DataFrame, np.ndarray]:
    """Names of all rows by 128 bits: first names that unlike sets share (some n**2 / 2**65) are named anew."""
    clashes = np.zeros(0, np.uint64)
    while True:
        named = written(named_sets(docs, key, clashes), "named")
        twice = named.groupBy("cls").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a <> b").select("cls").toArrow()
        if not twice.num_rows:
            return named.drop("second"), clashes
        more = np.array(twice.column(0).combine_chunks()).astype(np.int64).view(np.uint64)
        clashes = np.union1d(clashes, more)


def with_class(docs: DataFrame, name: str, clashes: np.ndarray) -> DataFrame:
    """docs with one more, last column of that name: the text's class, null without shingles."""
    where = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(where).fill_null("")):
                values, bounds = sets_of(chunk)
                found = pa.array(classes_of(values, bounds, clashes), mask=np.diff(bounds) == 0)
                yield pa.RecordBatch.from_arrays([*batch.slice(chunk.first, chunk.n).columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(name, LongType())]))


def frequency_levels(docs: DataFrame, bits: int) -> np.ndarray:
    """Binary logarithm of how many documents hold a shingle of each of 2**bits cells."""

    def update(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for chunk in chunks(batch.column(0)):
            values, _ = sets_of(chunk)
            total += np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)

    return np.log2(dense_sum(texts(docs), 1 << bits, update) + 1).astype(np.uint8)


def posted(docs: DataFrame, levels: np.ndarray, bits: int, buckets: int, clashes: np.ndarray, hot_level: int = HOT_LEVEL) -> DataFrame:
    """The first shingles of each set with its class and size, packed by bucket; copies once per flush."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def pack(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["cls"], rows["h"]))]
        again = (rows["h"][1:] == rows["h"][:-1]) & (rows["cls"][1:] == rows["cls"][:-1])
        rows = rows[np.concatenate([[True], ~again])]
        level = shared.value[(rows["h"] >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64)
        salts = np.left_shift(1, np.maximum(level - hot_level, 0)).astype(np.uint64)
        bucket = (mixed(rows["h"] + mixed(rows["cls"]) % salts) % np.uint64(buckets)).astype(np.int64)
        rows["hot"] = salts > 1
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(heads[1:], len(rows))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[heads], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(heads, ends)], pa.binary())], names=["bucket", "payload"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                values, bounds = sets_of(chunk)
                sizes = np.diff(bounds)
                owner = np.repeat(np.arange(chunk.n), sizes)
                order = np.lexsort((values, shared.value[(values >> np.uint64(64 - bits)).astype(np.int64)], owner))
                first = sizes - (4 * sizes + 4) // 5 + (sizes > 0)
                place = np.arange(len(values)) - bounds[owner]
                chosen = place < first[owner]
                rows = np.empty(int(chosen.sum()), _ROW)
                rows["h"], rows["hot"] = values[order][chosen], False
                rows["cls"] = classes_of(values, bounds, clashes)[owner[chosen]].view(np.uint64)
                rows["n"] = sizes[owner[chosen]]
                held.append(rows)
                count += len(rows)
                if count >= FLUSH:
                    yield from pack(held)
                    held, count = [], 0
        if count:
            yield from pack(held)

    return texts(docs).mapInArrow(post, _POSTED)


_ROW = np.dtype([("h", "<u8"), ("cls", "<u8"), ("n", "<u4"), ("hot", "?")])


def groups(postings: DataFrame, partitions: int) -> DataFrame:
    """gid, tile, cls, n: classes that share a posted shingle; one gid for each distinct member list.

    A hot shingle's members are dealt to several buckets; one that is alone in its bucket stays only if
    another bucket holds a member.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x.as_buffer(), _ROW) for batch in batches for x in batch.column(1)]
        if not parts:
            return
        rows = np.concatenate(parts)
        del parts
        rows = rows[np.lexsort((rows["cls"], rows["h"]))]
        same = (rows["h"][1:] == rows["h"][:-1]) & (rows["cls"][1:] == rows["cls"][:-1])
        rows = rows[np.concatenate([[True], ~same])]
        heads = np.flatnonzero(np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]]))
        counts = np.diff(np.append(heads, len(rows)))
        names = mixed(np.add.reduceat(mixed(rows["cls"]), heads) + counts.astype(np.uint64))
        hot = rows["hot"][heads]
        names[hot] = rows["h"][heads][hot]  # a hot shingle's members are dealt to several buckets
        wanted = hot | (counts > 1)
        first = np.zeros(len(heads), bool)
        first[np.unique(names, return_index=True)[1]] = True
        keep = np.repeat(wanted & (first | hot), counts)
        gid = np.repeat(names, counts)[keep].view(np.int64)
        # tiles of a group; those of a hot shingle's buckets must differ
        tiles = np.repeat(-(-counts // TILE), counts).astype(np.uint64)
        apart = np.repeat(np.where(hot, (mixed(rows["cls"][heads]) >> np.uint64(34)) + np.uint64(1), np.uint64(0)), counts)
        tile = (mixed(rows["cls"]) % tiles + apart)[keep].astype(np.int64)
        out = rows[keep]
        alone = np.repeat(counts == 1, counts)[keep]
        for a in range(0, len(out), 100_000):
            part = out[a : a + 100_000]
            columns = [gid[a : a + 100_000], tile[a : a + 100_000], part["cls"].view(np.int64), part["n"].astype(np.int64), part["hot"], alone[a : a + 100_000]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gid", "tile", "cls", "n", "hot", "alone"])

    found = written(postings.repartition(partitions, "bucket").mapInArrow(gather, "gid long, tile long, cls long, n long, hot boolean, alone boolean"), "gathered")
    names = ["gid", "tile", "cls", "n"]
    met = found.filter("not alone").select(names)
    if not found.filter("alone").isEmpty():
        several = found.filter("hot").groupBy("gid").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("gid")
        met = met.unionByName(found.filter("alone").select(names).join(several, "gid", "left_semi").select(names))
    return met.distinct()


def bitmap(values: np.ndarray) -> bytes:
    """Parity of the shingles at each bit; the least power-of-two width of BITS_EACH bits a shingle or more."""
    words = 1
    while words * 64 < BITS_EACH * len(values):
        words *= 2
    bit = mixed(values) & np.uint64(words * 64 - 1)
    odd = np.bincount(bit.astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps folded to a width of `words` 64-bit words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(n1: np.ndarray, n2: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Whether the overlap that the differing bits leave possible reaches 4/5 of the union."""
    return 9 * ((n1 + n2 - differing) // 2) >= 4 * (n1 + n2)


def stored_sets(docs: DataFrame, named: DataFrame, wanted: DataFrame, key: str, buckets: int, clashes: np.ndarray) -> DataFrame:
    """cls, n, bitmap and the compressed text of one row of each wanted class, dealt by class."""
    source = texts(docs, key)
    kind = source.schema[0].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                values, bounds = sets_of(chunk)
                raw = [squeeze(chunk.text(i)) for i in range(chunk.n)]
                maps = [bitmap(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array(classes_of(values, bounds, clashes)), pa.array(np.diff(bounds)), pa.array(maps, pa.binary()), pa.array(raw, pa.binary())], names=[key, "cls", "n", "bits", "packed"])

    rows = source.mapInArrow(pack, f"`{key}` {kind}, cls long, n long, bits binary, packed binary").withColumnRenamed(key, "_row")
    chosen = named.groupBy("cls").agg(F.min(key).alias("_first")).join(wanted.hint("merge"), "cls", "left_semi")
    both = rows.join(chosen.withColumnRenamed("cls", "_cls").hint("merge"), (F.col("cls") == F.col("_cls")) & F.col("_row").eqNullSafe(F.col("_first")))
    return both.select("cls", "n", "bits", "packed").repartition(buckets, "cls").dropDuplicates(["cls"])


def bucketed(df: DataFrame, column: str, buckets: int) -> tuple[DataFrame, str]:
    """df, dealt by a column, as a table bucketed by it, so that joins on it don't shuffle it; and the table's name."""
    name = f"helixframe_{uuid.uuid4().hex}"
    note_table(name)
    df.write.bucketBy(buckets, column).sortBy(column).option("compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name), name


def _decoded(batch_ids: list, batch_raw: list, cache: dict[int, np.ndarray]) -> None:
    new = {c: r for c, r in zip(batch_ids, batch_raw) if c not in cache}
    if not new:
        return
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [unpack(r) for r in new.values()]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    values, bounds = sets_of(Chunk(0, np.frombuffer(b"".join(raw), np.uint8), offsets))
    cache.update(zip(new, (values[a:b] for a, b in zip(bounds[:-1], bounds[1:]))))


def exact(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """(a, b) of those pairs whose exact intersection is large enough."""
    body = stored.select("cls", "packed")
    rows = pairs.join(body.select(F.col("cls").alias("a"), F.col("packed").alias("pa")), "a").join(body.select(F.col("cls").alias("b"), F.col("packed").alias("pb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                a, b, raw_a, raw_b = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("a", "b", "pa", "pb"))
                _decoded(a + b, raw_a + raw_b, cache)
                good = []
                for i, (x, y) in enumerate(zip(a, b)):
                    u, v = cache[x], cache[y]
                    common = len(np.intersect1d(u, v, assume_unique=True))
                    if 100 * common >= 80 * (len(u) + len(v) - common):
                        good.append(i)
                if sum(map(len, cache.values())) > 2_000_000:
                    cache.clear()
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(verify, "a long, b long")


def _side(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, sizes, components and bitmaps of a tile, by size, folded to its narrowest bitmap's width."""
    rows.sort(key=lambda r: (r["n"], r["cls"]))
    narrow = min(len(r["bits"]) for r in rows) // 8
    maps = np.concatenate([folded(np.frombuffer(r["bits"], np.uint64)[None], narrow) for r in rows])
    return np.array([r["cls"] for r in rows]), np.array([r["n"] for r in rows]), np.array([r["comp"] for r in rows]), maps


def _by_width(rows: list[dict]) -> list[list[dict]]:
    """A tile's rows in runs that a link can't leave downwards, so that bitmaps are folded little."""
    rows.sort(key=lambda r: (r["n"], r["cls"]))
    runs: list[list[dict]] = []
    for r in rows:
        if not runs or 5 * runs[-1][-1]["n"] < 4 * r["n"]:
            runs.append([])
        runs[-1].append(r)
    return runs


def forest(rows: list[dict]) -> tuple[list[tuple[int, int]], bool]:
    """A forest over the pairs of a tile that may link and aren't in one component, least differing bits first.

    And whether it holds all such pairs.
    """
    out: list[tuple[int, int]] = []
    every = 0
    for run in _by_width(rows):
        if len(run) < 2:
            continue
        cls, n, comp, maps = _side(run)
        top = np.searchsorted(n, n * 5 // 4, "right")
        found = []
        for i in range(len(cls) - 1):
            if top[i] > i + 1:
                j = np.arange(i + 1, top[i])
                differing = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)
                keep = may_link(n[i], n[j], differing) & (comp[j] != comp[i])
                if keep.any():
                    found.append(np.stack([np.full(int(keep.sum()), i), j[keep], differing[keep] * 10_000 // (n[i] + n[j[keep]])], 1))
        if not found:
            continue
        parent = {c: c for c in comp.tolist()}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges = np.concatenate(found)
        every += len(edges)
        for i, j, _ in edges[np.argsort(edges[:, 2], kind="stable")].tolist():
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((min(int(cls[i]), int(cls[j])), max(int(cls[i]), int(cls[j]))))
    return out, every == len(out)


def forest_pairs(members: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs to verify, from gid, tile, cls, n, comp: a forest of each tile; and gids (a, b null) that need more."""
    rows = F.collect_list(F.struct("cls", "n", "comp", "bits"))
    tiles = members.join(stored.select("cls", "bits"), "cls").groupBy("gid", "tile").agg(rows.alias("rows"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: set[tuple[int, int]] = set()
            open_: set[int] = set()
            for gid, tile, rows in zip(*(batch.column(i) for i in range(3))):
                found, whole = forest(rows.as_py())
                pairs.update(found)
                if tile.as_py() or not whole:
                    open_.add(gid.as_py())
            gids = [None] * len(pairs) + sorted(open_)
            ends = [[*(p[k] for p in sorted(pairs)), *[None] * len(open_)] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (gids, *ends)], names=["gid", "a", "b"])

    return tiles.mapInArrow(compare, "gid long, a long, b long").distinct()


def representatives(members: DataFrame) -> DataFrame:
    """One class of each component of the groups that hold several, dealt into tiles anew."""
    each = members.groupBy("gid", "comp").agg(F.min(F.struct(F.xxhash64("cls"), "cls", "n")).alias("r"))
    each = written(each, "each")
    counts = written(each.groupBy("gid").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "counts")  # written, so that a large group's side of the join can be split
    tile = F.pmod(F.xxhash64("r.cls", F.lit(2)), F.ceil(F.col("k") / TILE))
    return each.join(counts, "gid").select("gid", tile.alias("tile"), F.col("r.cls").alias("cls"), F.col("r.n").alias("n"), "comp")


def tile_pairs(members: DataFrame, stored: DataFrame) -> DataFrame:
    """All pairs across components that some group holds and that the bitmaps leave possible, from gid, cls, n, comp."""
    sizes = members.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("k"))
    spread = sizes.groupBy("gid").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("k").alias("total")).filter("comps > 1")
    spread = written(spread, "spread")  # likewise
    open_ = members.join(spread, "gid").join(stored.select("cls", "bits"), "cls")
    tiles_ = F.ceil(F.col("total") / TILE)
    banded = open_.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.3)))).withColumn("tiles", tiles_).withColumn("tile", F.pmod(F.xxhash64("cls"), tiles_))
    packed = F.collect_list(F.struct("cls", "n", "comp", "bits"))
    every = banded.groupBy("gid", "band", "tile").agg(packed.alias("right"))
    odd = banded.filter("comp <> main").groupBy("gid", "band", "tile", "tiles").agg(packed.alias("left"))
    # each pair of tiles has a key of its own, so a large group is dealt over all tasks
    bands = odd.select("gid", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "tiles", "left")
    reach = bands.select("gid", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), "left")
    tiles = reach.join(every, ["gid", "band", "tile"]).select("left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((0, 2), np.int64)]
            for x, y in zip(batch.column(0), batch.column(1)):
                c1, n1, k1, m1 = _side(x.as_py())
                c2, n2, k2, m2 = _side(y.as_py())
                words = min(m1.shape[1], m2.shape[1])
                m1, m2 = folded(m1, words), folded(m2, words)
                for i in range(len(c1)):
                    fits = np.flatnonzero((k2 != k1[i]) & (5 * np.minimum(n2, n1[i]) >= 4 * np.maximum(n2, n1[i])))
                    if len(fits):
                        differing = np.bitwise_count(m2[fits] ^ m1[i]).sum(1, dtype=np.int64)
                        fits = fits[may_link(n1[i], n2[fits], differing)]
                        out.append(np.stack([np.minimum(c2[fits], c1[i]), np.maximum(c2[fits], c1[i])], 1))
            pairs = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return tiles.mapInArrow(compare, "a long, b long").distinct()


def with_components(members: DataFrame, links: list[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """members with each class' component so far, and the components."""
    if not links:
        return members.withColumn("comp", F.col("cls")), None
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    found = connected_components(edges, "a", "b")
    joined = members.join(found.withColumnRenamed("id", "cls"), "cls", "left")
    return joined.select("gid", "tile", "cls", "n", F.coalesce("component", "cls").alias("comp")), found


def jaccard_components(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_shingles and component_id, one row per row of docs."""
    named, of_class, _ = jaccard_classes(docs, key)
    own = F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.col("_component_id"))
    return named.join(of_class, "cls").select(key, "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: one of each component, of its least key, and each row without shingles.

    A null key comes after all others. Rows that share a key but not a component all stay.
    """
    named, of_class, clashes = jaccard_classes(docs, key)
    first = F.min(F.struct(F.col(key).isNull(), key, "cls")).alias("first")
    chosen = named.filter("n_shingles > 0").join(of_class.select("cls", "component"), "cls").groupBy("component").agg(first)
    kept = written(chosen.select(F.col("first").getField(key).alias(key), "first.cls"), "kept")
    name, cls = free_name(docs, "_kept"), free_name(docs, "_class")
    if named.groupBy(key).count().filter("count > 1").isEmpty():  # then the key alone names a row
        ids = kept.select(key).unionByName(named.filter("n_shingles = 0").select(key)).withColumnRenamed(key, name)
        return docs.join(ids.hint("merge"), docs[key].eqNullSafe(F.col(name)), "left_semi")
    classed = with_class(docs, cls, clashes)
    ids = kept.select(F.col(key).alias(name), F.col("cls").alias(f"{name}_class"))
    same = (F.col(cls) == F.col(f"{name}_class")) & F.col(key).eqNullSafe(F.col(name))
    stay = classed.join(ids.hint("merge"), same, "left_semi").dropDuplicates([key, cls])
    return stay.unionByName(classed.filter(F.col(cls).isNull())).select(docs.columns)


def jaccard_classes(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, np.ndarray]:
    """key, n_shingles and cls of every row; cls, component (a class of it) and _component_id of every class; clashes of names."""
    spark = docs.sparkSession
    named, clashes = named_apart(docs, key)
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    bits = min(max(int(total).bit_length() - 7, 12), 22)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(width, -(-(total // 5) // PARTITION_POSTINGS))
    levels = frequency_levels(docs, bits)
    load = max(int(total) >> bits, 1).bit_length()  # of a mean cell: where cells are many shingles' the sketch is coarse, not hot
    postings = posted(docs, levels, bits, 8 * partitions, clashes, max(HOT_LEVEL, load + 2))
    members = written(groups(postings, partitions), "groups")
    stored, name = bucketed(stored_sets(docs, named, members.select("cls").distinct(), key, partitions, clashes), "cls", partitions)
    links: list[DataFrame] = []
    tried: list[DataFrame] = []

    def verify(pairs: DataFrame) -> None:
        for done in tried:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        tried.append(written(pairs, "pairs"))
        links.append(written(exact(tried[-1], stored), "links"))

    # a group of one tile (0) whose forest holds all its possible links is settled by verifying those
    first = written(forest_pairs(with_components(members, links)[0], stored), "forest")
    verify(first.filter("gid is null").select("a", "b"))
    members = written(members.join(first.filter("gid is not null").select("gid"), "gid", "left_semi"), "open")
    current = written(with_components(members, links)[0], "members")
    verify(forest_pairs(representatives(current), stored).filter("gid is null").select("a", "b"))
    current = written(with_components(members, links)[0], "members")
    verify(tile_pairs(current, stored))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    _, found = with_components(members, links)
    least = named.groupBy("cls").agg(F.min(key).alias("_least"))
    linked = written(least.join(found.withColumnRenamed("id", "cls"), "cls"), "linked")
    # a component may hold very many classes: its least key goes to SALTS places, its classes to one of them each
    salt = F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")
    by_component = linked.groupBy("component").agg(F.min("_least").alias("_component_id")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = linked.withColumn("_salt", salt).join(by_component, ["component", "_salt"]).select("cls", "component", "_component_id")
    alone = least.join(linked.select("cls"), "cls", "left_anti").select("cls", F.col("cls").alias("component"), F.col("_least").alias("_component_id"))
    return named, met.unionByName(alone), clashes


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
