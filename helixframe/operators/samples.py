"""Samples against samples: packed blocks of samples by variants, summed tile by tile, and leading components.

Variants are dealt to chunks, samples to blocks, so one chunk of one block is a matrix of bounded size. Two
blocks meet once in each chunk; a task holds PART chunks of one pair of blocks and hands on their sums. Neither all
samples nor all variants are ever in one place; what grows with the pairs of samples is the result's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..storage import written

CHUNK = 1024
PART = 16
TILE = 256
SMALL = 64
Block = dict[str, np.ndarray]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def sample_order(df: DataFrame, *columns: str) -> DataFrame:
    """sample and its place, 0 .. n - 1 in their order."""
    names = df.select(F.col(columns[0]).alias("sample"))
    for c in columns[1:]:
        names = names.unionByName(df.select(F.col(c).alias("sample")))
    return numbered(names.distinct(), ["sample"], "place").withColumn("place", F.col("place") - 1)


def packed_blocks(cells: DataFrame, order: DataFrame, pack: Callable[[np.ndarray], bytes], width: int) -> DataFrame:
    """chunk, block, payload: `width` samples by CHUNK variants packed, from rows of variant, sample and value; what is absent is nan."""
    rows = numbered(cells.select("variant").distinct(), ["variant"], "row").withColumn("row", F.col("row") - 1)
    placed = cells.select("variant", "sample", F.col("value").cast("double").alias("value")).join(rows, "variant").join(order, "sample")
    dealt = placed.select(F.floor(F.col("row") / CHUNK).alias("chunk"), F.floor(F.col("place") / width).alias("block"), (F.col("place") % width).alias("i"), (F.col("row") % CHUNK).alias("j"), "value")

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        matrix = np.full((width, CHUNK), np.nan)
        matrix[group.column("i").to_numpy(), group.column("j").to_numpy()] = group.column("value").to_numpy()
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()), "payload": pa.array([pack(matrix)], pa.binary())})

    return dealt.groupBy("chunk", "block").applyInArrow(fill, "chunk long, block long, payload binary")


def summed_pairs(blocks: DataFrame, unpack: Callable[[bytes], Block], product: Callable[[Block, Block], tuple[np.ndarray, np.ndarray]], width: int) -> DataFrame:
    """i, j, s, n for places i <= j that share a variant: the products of all chunks and the numbers of variants, summed."""
    one, two = (blocks.select("chunk", F.col("block").alias(b), F.col("payload").alias(c)) for b, c in (("p", "x"), ("q", "y")))
    met = one.join(two, "chunk").filter("p <= q").withColumn("part", F.floor(F.col("chunk") / PART))

    def add(key: tuple, group: pa.Table) -> pa.Table:
        p, q = key[0].as_py(), key[1].as_py()
        group = group.sort_by("chunk")
        total, n = np.zeros((width, width)), np.zeros((width, width))
        for x, y in zip(group.column("x"), group.column("y")):
            s, k = product(unpack(x.as_py()), unpack(y.as_py()))
            total, n = total + s, n + k
        i, j = np.nonzero(n)
        keep = p * width + i <= q * width + j
        i, j = i[keep], j[keep]
        return pa.table({"i": p * width + i, "j": q * width + j, "s": total[i, j], "n": n[i, j]})

    sums = met.groupBy("p", "q", "part").applyInArrow(add, "i long, j long, s double, n double")
    return sums.groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def named_pairs(sums: DataFrame, order: DataFrame, name: str) -> DataFrame:
    """a, b and `name` (s / n) with the samples' names."""
    left, right = (order.select(F.col("place").alias(i), F.col("sample").alias(s)) for i, s in (("i", "a"), ("j", "b")))
    return sums.join(left, "i").join(right, "j").select("a", "b", (F.col("s") / F.col("n")).alias(name))


def mean_products(cells: DataFrame, width: int = TILE) -> DataFrame:
    """a, b, k (a <= b): mean of the products of two samples' values over the variants that both have."""
    order = sample_order(cells, "sample")

    def unpack(raw: bytes) -> Block:
        values = _unpack(raw, np.float64).reshape(width, CHUNK)
        there = ~np.isnan(values)
        return {"z": np.where(there, values, 0.0), "there": there.astype(np.float64)}

    def product(x: Block, y: Block) -> tuple[np.ndarray, np.ndarray]:
        return x["z"] @ y["z"].T, x["there"] @ y["there"].T

    return named_pairs(summed_pairs(packed_blocks(cells, order, _pack, width), unpack, product, width), order, "k")


def dose_planes(doses: np.ndarray, ploidy: int) -> np.ndarray:
    """Bit planes of rows of doses (nan: missing): called, then dose >= 1, ..., dose >= ploidy; 64 to a word."""
    planes = [~np.isnan(doses), *(np.nan_to_num(doses, nan=0.0) >= k for k in range(1, ploidy + 1))]
    bits = np.packbits(np.stack(planes), axis=-1)
    return np.pad(bits, [(0, 0), (0, 0), (0, -bits.shape[-1] % 8)]).view(np.uint64)


def dissimilarity(dosage: DataFrame, ploidy: int = 2, width: int = TILE) -> DataFrame:
    """a, b, d (a < b): mean difference of two samples' doses over the variants called in both, in parts of the ploidy.

    Doses 0 .. ploidy, null where missing; a pair with no variant called in both has no row. Differences
    are bits that differ between planes of doses, counted 64 variants at a time.
    """
    called = dosage.filter(F.col("dose").isNotNull())
    bad = F.raise_error(F.concat(F.lit("a dose beyond the ploidy: "), F.col("dose").cast("string"))).cast("double")
    cells = called.select("variant", "sample", F.when(F.col("dose").between(0, ploidy), F.col("dose").cast("double")).otherwise(bad).alias("value"))
    order = sample_order(dosage, "sample")

    def unpack(raw: bytes) -> Block:
        return {"planes": _unpack(raw, np.uint64).reshape(ploidy + 1, width, -1)}

    def product(x: Block, y: Block) -> tuple[np.ndarray, np.ndarray]:
        a, b = x["planes"], y["planes"]
        total, n = np.zeros((width, width)), np.zeros((width, width))
        for i in range(width):
            both = a[0, i] & b[0]
            n[i] = np.bitwise_count(both).sum(-1)
            total[i] = sum(np.bitwise_count((a[k, i] ^ b[k]) & both).sum(-1) for k in range(1, ploidy + 1))
        return total, n

    sums = summed_pairs(packed_blocks(cells, order, lambda m: _pack(dose_planes(m, ploidy)), width), unpack, product, width)
    return named_pairs(sums.filter("i < j"), order, "d").withColumn("d", F.col("d") / ploidy)


class Tiled:
    """Symmetric matrices over one order of samples, in written tiles of `width` samples; they never leave Spark.

    rows of (a, b, k), each pair given once or both ways; samples are those of `order`, or all if not given.
    """

    def __init__(self, matrices: Sequence[DataFrame], order: DataFrame | None = None, width: int = TILE) -> None:
        ends = matrices[0].select("a", "b")
        for m in matrices[1:]:
            ends = ends.unionByName(m.select("a", "b"))
        self.spark, self.width = ends.sparkSession, width
        self.order = written(sample_order(ends, "a", "b") if order is None else order, "samples")
        self.size = self.order.count()
        left, right = (self.order.select(F.col("sample").alias(s), F.col("place").alias(p)) for s, p in (("a", "pa"), ("b", "pb")))
        given = [m.select(F.lit(n).alias("m"), "a", "b", F.col("k").cast("double").alias("k")) for n, m in enumerate(matrices)]
        every = given[0]
        for g in given[1:]:
            every = every.unionByName(g)
        cells = every.join(left, "a").join(right, "b").select("m", F.least("pa", "pb").alias("i"), F.greatest("pa", "pb").alias("j"), "k")
        dealt = cells.withColumn("p", F.floor(F.col("i") / width)).withColumn("q", F.floor(F.col("j") / width))

        def fill(key: tuple, group: pa.Table) -> pa.Table:
            m, p, q = (x.as_py() for x in key)
            tile = np.zeros((width, width))
            i, j, k = (group.column(c).to_numpy() for c in ("i", "j", "k"))
            tile[i - p * width, j - q * width] = k
            if p == q:
                tile[j - q * width, i - p * width] = k
            return pa.table({"m": pa.array([m], pa.int32()), "p": pa.array([p], pa.int64()), "q": pa.array([q], pa.int64()), "tile": pa.array([_pack(tile)], pa.binary())})

        self.tiles = written(dealt.groupBy("m", "p", "q").applyInArrow(fill, "m int, p long, q long, tile binary"), "tiles")

    def times(self, vectors: np.ndarray, weights: Sequence[float] = (1.0,)) -> np.ndarray:
        """The weighted sum of the matrices times a few vectors, which go to all tasks and come back summed by blocks."""
        shared, width, r = self.spark.sparkContext.broadcast(vectors), self.width, vectors.shape[1]
        used = dict(enumerate(float(w) for w in weights))

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for m, p, q, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    tile = used[m] * _unpack(raw, np.float64).reshape(width, width)
                    for row, column, t in ((p, q, tile), (q, p, tile.T))[: 1 + (p != q)]:
                        x = shared.value[column * width : (column + 1) * width]
                        sums[row] = sums.get(row, 0) + t[:, : len(x)] @ x
            if sums:
                yield pa.RecordBatch.from_pydict({"block": list(sums), "part": [s.tobytes() for s in sums.values()]})

        def add(key: tuple, group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), np.float64) for x in group.column("part"))
            return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})

        asked = self.tiles.filter(F.col("m").isin([m for m, w in used.items() if w]))
        out = np.zeros((-(-self.size // width) * width, r))
        for row in asked.mapInArrow(parts, "block long, part binary").groupBy("block").applyInArrow(add, "block long, part binary").collect():
            out[row.block * width : (row.block + 1) * width] = np.frombuffer(bytes(row.part), np.float64).reshape(width, r)
        shared.destroy()
        return out[: self.size]


def principal_components(similarity: DataFrame, n: int = 4, tolerance: float = 1e-9, width: int = TILE) -> DataFrame:
    """sample, pc1 .. pcn: leading eigenvectors of the doubly centred similarity (a, b, k), each pair given once or both ways.

    The matrix stays in Spark; each step multiplies it by a few vectors, which with their images (samples by
    some dozens of columns) are all that the driver holds. Components are refined until what they leave over is
    under `tolerance` of the largest eigenvalue. Each vector's largest entry is positive.
    """
    whole = Tiled([similarity], width=width)
    spark, size = whole.spark, whole.size
    columns = ", ".join(f"pc{i + 1} double" for i in range(min(n, size) if size else n))
    if not size:
        return spark.createDataFrame([], f"sample {whole.order.schema['sample'].dataType.simpleString()}, {columns}")
    means = whole.times(np.full((size, 1), 1 / size))
    grand = float(means.mean())

    def centred(vectors: np.ndarray) -> np.ndarray:
        sums = vectors.sum(0)
        return whole.times(vectors) - means @ sums[None] - means.T @ vectors + grand * sums

    top = leading_vectors(centred, size, min(n, size), tolerance)
    top = top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])
    rows = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(top)], f"place long, {columns}")
    return rows.join(whole.order, "place").select("sample", *(f"pc{i + 1}" for i in range(top.shape[1])))


def leading_vectors(multiply: Callable[[np.ndarray], np.ndarray], size: int, n: int, tolerance: float = 1e-9, guard: int = 6, rounds: int = 500) -> np.ndarray:
    """Eigenvectors of a symmetric matrix's n largest eigenvalues, by its products with a few vectors at a time.

    A search space grows by what the best vectors in it leave over, and starts anew from them when it holds
    eight times as many; a matrix of up to SMALL rows is multiplied out.
    """
    if size <= SMALL:
        whole = multiply(np.eye(size))
        return np.linalg.eigh((whole + whole.T) / 2)[1][:, ::-1][:, :n]
    r = min(size, n + guard)
    space = np.linalg.qr(np.random.default_rng(0).standard_normal((size, r)))[0]
    image = multiply(space)
    for _ in range(rounds):
        projected = space.T @ image
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1][:r], turn[:, ::-1][:, :r]
        best, moved = space @ turn, image @ turn
        left = moved - best * values
        if np.linalg.norm(left[:, :n], axis=0).max() <= tolerance * max(np.abs(values).max(), 1e-300):
            return best[:, :n]
        if space.shape[1] + r > min(size, 8 * r):
            wide = np.linalg.eigh((projected + projected.T) / 2)[1][:, ::-1][:, : 2 * r]
            space, image = space @ wide, image @ wide
        for _ in range(2):
            left = left - space @ (space.T @ left)
        fresh, weights, _ = np.linalg.svd(left, full_matrices=False)
        fresh = fresh[:, weights > 1e-12 * max(np.abs(values).max(), 1e-300)]
        fresh = np.linalg.qr(fresh - space @ (space.T @ fresh))[0]
        if not fresh.shape[1]:
            return best[:, :n]
        space, image = np.hstack([space, fresh]), np.hstack([image, multiply(fresh)])
    raise ValueError(f"no convergence in {rounds} rounds")


def reml(kinships: dict[str, DataFrame], phenotypes: DataFrame, covariates: DataFrame | None = None, probes: int = 512, tolerance: float = 1e-7, rounds: int = 60, width: int = TILE) -> DataFrame:
    """name, variance, share: variance components of a phenotype by restricted maximum likelihood, the residual last.

    kinships by name, each (a, b, k); phenotypes (sample, value), null where missing; covariates (sample and columns)
    are fixed effects beside the mean. A share is a component's variance times its kinship's mean diagonal, of
    all. Average-information steps from equal parts; a component that would fall below zero is held at a millionth.

    Kinships stay in tiles. Up to `probes` samples their products with the unit vectors are the matrices
    themselves; beyond that, inverses are taken by conjugate gradients on all right-hand sides at once, and traces
    over `probes` vectors of random signs, whose error is about sqrt(2 / (probes * samples)). The driver holds samples by probes.
    """
    spark = phenotypes.sparkSession
    known = phenotypes.filter(F.col("value").isNotNull())
    if covariates is not None:
        known = known.join(covariates, "sample")
    for k in kinships.values():
        known = known.join(k.filter("a = b").select(F.col("a").alias("sample")), "sample", "left_semi")
    rows = sorted(known.collect(), key=lambda r: r["sample"])  # one row a sample
    order = written(sample_order(known, "sample"), "order")
    whole = Tiled(list(kinships.values()), order, width)
    n, m = len(rows), len(kinships)
    names = [c for c in (covariates.columns if covariates is not None else []) if c != "sample"]
    y = np.array([r["value"] for r in rows], float)
    fixed = np.array([[1.0, *(float(r[c]) for c in names)] for r in rows]).reshape(n, 1 + len(names))
    if n <= fixed.shape[1]:
        raise ValueError("fewer samples than effects")
    unit = [np.eye(m)[i] for i in range(m)]
    exact = n <= probes
    signs = np.eye(n) if exact else np.random.default_rng(0).choice([-1.0, 1.0], (n, probes))
    images = [whole.times(signs, w) for w in unit]  # K z for every probe; the kinships themselves if exact
    diagonal = [float((signs * k).sum() / signs.shape[1] / (1 if exact else n)) for k in images]
    apply = (lambda x, w: sum(v * (k @ x) for v, k in zip(w, images))) if exact else whole.times

    def solved(right: np.ndarray, variances: np.ndarray) -> np.ndarray:
        if exact:
            return np.linalg.solve(sum(v * k for v, k in zip(variances, images)) + variances[-1] * np.eye(n), right)
        return conjugate_gradients(lambda x: apply(x, variances[:-1]) + variances[-1] * x, right)

    variances = np.full(m + 1, y.var() / (m + 1))
    floor = 1e-6 * y.var()
    for _ in range(rounds):
        inverse = solved(np.hstack([y[:, None], fixed, signs]), variances)
        iy, ix, iz = inverse[:, :1], inverse[:, 1 : 1 + fixed.shape[1]], inverse[:, 1 + fixed.shape[1] :]
        inner = np.linalg.inv(fixed.T @ ix)
        project = lambda v: v - ix @ (inner @ (fixed.T @ v))
        py, pz = project(iy)[:, 0], iz - ix @ (inner @ (ix.T @ signs))
        scaled = np.stack([*(apply(py[:, None], w)[:, 0] for w in unit), py], 1)
        traces = np.array([*((pz * k).sum() for k in images), (pz * signs).sum()]) / (1 if exact else signs.shape[1])
        back = solved(scaled, variances)
        back = back - ix @ (inner @ (ix.T @ scaled))
        score = (py @ scaled - traces) / 2
        information = scaled.T @ back / 2
        free = (variances > floor) | (score > 0)
        step = np.zeros(m + 1)
        step[free] = np.linalg.lstsq(information[np.ix_(free, free)], score[free], rcond=None)[0]
        reach = min(1.0, *(0.9 * variances[i] / -step[i] for i in np.flatnonzero(step < 0) if variances[i] > 10 * floor and step[i] < -variances[i]), 1.0)
        new = np.maximum(variances + reach * step, floor)
        moved, variances = np.abs(new - variances).max(), new
        if moved <= tolerance * variances.sum():
            break
    else:
        raise ValueError(f"no convergence in {rounds} rounds")
    parts = variances * np.array([*diagonal, 1.0])
    found = zip([*kinships, "residual"], variances, parts / parts.sum())
    return spark.createDataFrame([(name, float(v), float(s)) for name, v, s in found], "name string, variance double, share double")


def conjugate_gradients(multiply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, tolerance: float = 1e-10, rounds: int = 1000) -> np.ndarray:
    """Solutions for all right-hand sides of a positive definite matrix, known by its products; each has its own step lengths."""
    x, r = np.zeros_like(right), right.copy()
    p, rr = r.copy(), (r * r).sum(0)
    least = tolerance**2 * np.maximum(rr, 1e-300)
    for _ in range(rounds):
        live = rr > least
        if not live.any():
            return x
        q = multiply(p[:, live])
        a = rr[live] / (p[:, live] * q).sum(0)
        x[:, live] += a * p[:, live]
        r[:, live] -= a * q
        new = (r[:, live] * r[:, live]).sum(0)
        p[:, live] = r[:, live] + new / rr[live] * p[:, live]
        rr[live] = new
    raise ValueError(f"no convergence in {rounds} rounds")
