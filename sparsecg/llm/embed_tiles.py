"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors are one class from the start. A class's unit vector is turned so that leading dimensions hold most of
the second moment of all; by splits of these dimensions classes are dealt into cells, and a cell into tiles by hash.
Two unit vectors of cosine t or more are at most sqrt(2 - 2 t) apart, and no nearer in leading dimensions alone, so
pairs of cells whose boxes are farther apart than that are never compared; every other pair of tiles is compared by
one task. A comparison adds up the products of leading dimensions first; what the rest can add is at most the product
of the suffix norms, so pairs that cannot reach the threshold stop there and the others go on to the next block.

Turned vectors only discard, with SLACK for rounding: a unit vector of d dimensions, its turned form and their
products are off by some d * 2**-52 each, which stays under SLACK up to a million dimensions. What is left is decided
on the vectors as given: a.b / sqrt(a.a * b.b) in double precision, and within TIE of the threshold with sums that
round once, so the order of dimensions decides nothing. Vectors are only scaled by powers of two before, which is exact.

Tasks return counts of links by class and a spanning forest of them, never all pairs, so a group of near copies of
any size stays small in what it returns. Tiles hold about TILE_BYTES whatever the data hold. Where boxes tell nothing
(vectors spread evenly over all directions) every pair of classes is decided: comparisons then grow with the square
of the number of classes, and a class is copied once for every tile that may hold a partner.

Defined results: null vectors, zero vectors and those with null or non-finite components link with nothing and are
their own component; vectors of different length never link; repeated rows link with each other when valid; an
empty table gives an empty result; other columns are ignored. A row without vec_id is compared like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, drop, written
from .simhash_gray import forest

THRESHOLD = 0.9
SLACK, TIE = 1e-9, 1e-12
#: Bytes of a tile's vectors in double precision.
TILE_BYTES = 8 << 20
#: Products held at once inside a comparison.
STRIP = 1 << 22
#: Leading dimensions after which pairs are given up; the last block always runs to the end.
BLOCKS = (16, 32)
#: Lengths get a basis, the most frequent first, while the squares of their dimensions add up to this.
BASIS_CELLS = 1 << 20
#: Leading dimensions by which cells are split and boxed; cells of all lengths; classes that the splits are chosen from.
BOX, CELLS, SAMPLE = 8, 512, 20_000
#: A gap between coordinates that is worth a split wherever it is.
GAP = 0.1


def _vectors(kind: str):
    """vec_id, embedding (doubles) -> vec_id, n, v (the bytes of its numbers of that kind; null if it can't link)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            x = column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind) + 0.0  # -0 is 0
            ends = np.cumsum(sizes)
            v = []
            for lo, hi in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                own = x[lo:hi]
                v.append(own.tobytes() if hi > lo and np.isfinite(own).all() and own.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(v, pa.binary())], ["vec_id", "n", "v"])

    return run


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 0.5 or more and under 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)  # neither overflows nor vanishes when squared
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """Doubles of vectors of n single or double numbers each."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * n * len(column) else "<f8").reshape(-1, n).astype(np.float64)


def _by_size(b: pa.RecordBatch, n: int, v: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    sizes = b.column(n).to_numpy(zero_copy_only=False)
    kinds = np.unique(sizes)
    for k in kinds.tolist():
        part = b.filter(pa.array(sizes == k)) if len(kinds) > 1 else b
        yield k, part, _matrix(part.column(v), k)


def _moments(lengths: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, _, x in _by_size(b, 0, 1):
                if k in lengths:
                    u = unit(x)
                    sums[k] = sums.get(k, 0) + u.T @ u
        for k, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k * k, k, np.int64)), pa.array(np.arange(k * k)), pa.array(m.ravel())], ["n", "i", "m"])

    return run


def rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """For lengths, see BASIS_CELLS, an orthonormal basis by falling second moment of the unit vectors."""
    lengths, cells = [], 0
    for n, _ in classes.groupBy("n").count().orderBy(F.desc("count"), "n").limit(64).collect():
        if cells + n * n <= BASIS_CELLS:
            lengths.append(n)
            cells += n * n
    out: dict[int, np.ndarray] = {n: np.zeros(n * n) for n in lengths}
    sums = arrow_map(classes.select("n", "v"), _moments(frozenset(lengths)), "n long, i long, m double").groupBy("n", "i").agg(F.sum("m").alias("m"))
    got = sums.toArrow()  # BASIS_CELLS rows at most
    n, i, m = (got.column(c).to_numpy() for c in range(3))
    for k in out:
        out[k][i[n == k]] = m[n == k]
        square = out[k].reshape(k, k)
        out[k] = np.ascontiguousarray(np.linalg.eigh((square + square.T) / 2)[1][:, ::-1])
    return out


def _best_cut(rows: np.ndarray, leaves: int) -> tuple[int, float] | None:
    """Dimension and border: in the widest gap that leaves a cell's share on both sides, else in the middle of the widest."""
    ordered = np.sort(rows, 0)
    edge = max(1, len(rows) // leaves)
    gaps = np.diff(ordered, axis=0)[edge - 1 : len(rows) - edge]
    at, dim = np.unravel_index(int(gaps.argmax()), gaps.shape) if gaps.size else (0, 0)
    if gaps.size and gaps[at, dim] >= GAP:
        return int(dim), float(ordered[at + edge - 1, dim])
    dim = int(np.argmax(rows.std(0)))
    border = float(np.quantile(rows[:, dim], (leaves - leaves // 2) / leaves))
    low = rows[:, dim] <= border
    return (dim, border) if low.any() and not low.all() else None


class Cells:
    """A tree of splits of leading dimensions: cell() names the leaf of every row."""

    def __init__(self, rows: np.ndarray, leaves: int):
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, border, and the split on either side or ~cell
        self.count = 0
        self.root = self._split(rows, leaves)

    def _split(self, rows: np.ndarray, leaves: int) -> int:
        cut = _best_cut(rows, leaves) if leaves > 1 and len(rows) > 1 else None
        if cut is None:
            self.count += 1
            return ~(self.count - 1)
        dim, border = cut
        low = rows[:, dim] <= border
        share = min(leaves - 1, max(1, round(leaves * low.mean())))
        at = len(self.splits)
        self.splits.append((dim, border, 0, 0))
        self.splits[at] = (dim, border, self._split(rows[low], share), self._split(rows[~low], leaves - share))
        return at

    def cell(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        stack = [(self.root, np.arange(len(rows)))]
        while stack:
            at, own = stack.pop()
            if at < 0:
                out[own] = ~at
                continue
            dim, border, low, high = self.splits[at]
            is_low = rows[own, dim] <= border
            stack += [(low, own[is_low]), (high, own[~is_low])]
        return out


def _leading(basis: dict[int, np.ndarray]):
    """n, v -> n, the leading coordinates of the unit vector"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, part, x in _by_size(b, 0, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((unit(x) @ basis[k][:, :BOX]).tolist(), pa.list_(pa.float64()))], ["n", "p"])

    return run


def _celled(basis: dict[int, np.ndarray], cells: dict[int, Cells]):
    """cid, members, n, v -> with the cell and the leading coordinates, nulls beyond the last dimension"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, part, x in _by_size(b, 2, 3):
                m = len(x)
                p, cell = np.full((m, BOX), np.nan), np.zeros(m, np.int64)
                if k in cells:
                    lead = unit(x) @ basis[k][:, :BOX]
                    cell = cells[k].cell(lead)
                    p[:, : lead.shape[1]] = lead
                columns = [pa.array(p[:, d], pa.float64(), from_pandas=True) for d in range(BOX)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), *columns], [*part.schema.names, "cell", *(f"p{d}" for d in range(BOX))])

    return run


def cell_pairs(low: np.ndarray, high: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the boxes, each pair both ways round and with itself, that may hold vectors of that cosine."""
    near = []
    for k in range(len(low)):
        gap = np.maximum(0, np.maximum(low - high[k], low[k] - high))
        near.append(np.flatnonzero((gap * gap).sum(1) <= 2 - 2 * threshold + SLACK))
    return np.repeat(np.arange(len(low)), list(map(len, near))), np.concatenate(near) if near else np.empty(0, np.int64)


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, blocks: tuple[int, ...] = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose product may be threshold or more, all such pairs among them; both hold unit vectors."""
    d = a.shape[1]
    cuts = [c for c in blocks if c < d]
    slack = threshold - SLACK
    if not cuts:
        return np.nonzero(a @ b.T >= slack)
    c = cuts[0]
    rest_a, rest_b = (np.sqrt((x[:, c:] ** 2).sum(1)) for x in (a, b))
    part = a[:, :c] @ b[:, :c].T
    i, j = np.nonzero(part + rest_a[:, None] * rest_b[None, :] >= slack)
    part = part[i, j]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = part + _products(a[:, lo:hi], b[:, lo:hi], i, j)
        rest_a, rest_b = (np.sqrt((x[:, hi:] ** 2).sum(1)) for x in (a, b))
        near = part + rest_a[i] * rest_b[j] >= slack
        i, j, part = i[near], j[near], part[near]
    near = _products(a, b, i, j) >= slack
    return i[near], j[near]


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)] or [np.empty(0)])


def linked(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows i and j of x, scaled but else as given, have that cosine."""
    squares = np.einsum("ij,ij->i", x, x)
    cosine = _products(x, x, i, j) / np.sqrt(squares[i] * squares[j])
    for k in np.flatnonzero(np.abs(cosine - threshold) <= TIE):
        a, b = x[i[k]], x[j[k]]
        cosine[k] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))
    return cosine >= threshold


def _compare(threshold: float, basis: dict[int, np.ndarray]):
    def pair(i: int, j: int, own: np.ndarray, cid: np.ndarray, members: np.ndarray, x: np.ndarray) -> pa.RecordBatch | None:
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        u = unit(x)
        u = u @ basis[x.shape[1]] if x.shape[1] in basis else u
        x = scaled(x)
        count = np.zeros(len(cid), np.int64)
        ea, eb = [], []
        held = 0
        strip = max(1, STRIP // max(1, len(right)))
        for lo in range(0, len(left), strip):
            rows = left[lo : lo + strip]
            cols = right[lo:] if i == j else right
            if not len(cols):
                continue
            a, b = close_pairs(u[rows], u[cols], threshold)
            a, b = rows[a], cols[b]
            if i == j:
                # inside a tile each pair once: places in `left` rise, so the later one is the column
                a, b = a[a < b], b[a < b]
            near = linked(x, a, b, threshold)
            a, b = a[near], b[near]
            np.add.at(count, a, members[b])
            np.add.at(count, b, members[a])
            ea.append(a)
            eb.append(b)
            held += len(a)
            if held > 1 << 20:
                lab = forest(len(cid), np.concatenate(ea), np.concatenate(eb))
                at = np.flatnonzero(lab != np.arange(len(cid)))
                ea, eb, held = [at], [lab[at]], len(at)
        if not held:
            return None
        lab = forest(len(cid), np.concatenate(ea), np.concatenate(eb))
        at = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[lab[at]]), pa.array(count[at])], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            n, i, j = key
            out = pair(i, j, *(t.column(c).to_numpy() for c in ("own", "cid", "members")), _matrix(t.column("v"), n))
            if out is not None:
                yield out

        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(3)], 1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                now = tuple(int(x) for x in keys[lo])
                if now != key and held:
                    yield from done()
                    held.clear()
                key = now
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from done()

    return run


def tiles(classes: DataFrame, basis: dict[int, np.ndarray], threshold: float, tile_bytes: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """classes with own (their tile, by length); n, cell, first, tiles: for each cell the tiles to compare it with; the tables behind both.

    A tile is named by its cell and its place in it. Lengths without a basis have one cell.
    """
    spark = classes.sparkSession
    known = classes.where(F.col("n").isin([*basis])) if basis else classes.where("false")
    counts = {r["n"]: r["count"] for r in known.groupBy("n").count().collect()}  # as many as there are bases
    total = max(1, sum(counts.values()))
    # the splits only balance the work: boxes and tiles come from all classes
    place = F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(1_000_000))
    sample = arrow_map(known.where(place < int(1_000_000 * min(1.0, SAMPLE / total))).select("n", "v"), _leading(basis), "n long, p array<double>").collect()
    cells = {}
    for n, c in counts.items():
        rows = np.array([r["p"] for r in sample if r["n"] == n], float).reshape(-1, min(n, BOX))
        cells[n] = Cells(rows, max(1, min(c * n * 8 // tile_bytes, CELLS * c // total)))
    box = ", ".join(f"p{d} double" for d in range(BOX))
    celled = written(arrow_map(classes, _celled(basis, cells), f"cid long, members long, n long, v binary, cell long, {box}"), "cells")
    edges = [f(f"p{d}").alias(f"{name}{d}") for d in range(BOX) for f, name in ((F.min, "low"), (F.max, "high"))]
    sizes = celled.groupBy("n", "cell").agg(F.count("*").alias("rows"), *edges)
    sizes = written(sizes.withColumn("tiles", F.ceil(F.col("rows") * F.col("n") * 8 / tile_bytes).cast("long")), "sizes")
    pairs = []
    boxes = [r for r in sizes.where(F.col("n").isin([*basis])).orderBy("n", "cell").collect()] if basis else []  # CELLS rows and one a basis at most
    for n in cells:
        own = [r for r in boxes if r["n"] == n]
        low, high = (np.array([[r[f"{k}{d}"] for d in range(min(n, BOX))] for r in own], float).reshape(len(own), -1) for k in ("low", "high"))
        pairs += [(n, own[a]["cell"], own[b]["cell"] << 32, own[b]["tiles"]) for a, b in zip(*(x.tolist() for x in cell_pairs(low, high, threshold)), strict=True)]
    meets = spark.createDataFrame(pairs, "n long, cell long, first long, tiles long")
    alone = sizes.where(~F.col("n").isin([*basis])) if basis else sizes
    meets = meets.unionByName(alone.select("n", "cell", F.lit(0).cast("long").alias("first"), "tiles"))
    own = celled.select("cid", "members", "n", "v", "cell").join(sizes.select("n", "cell", "tiles"), ["n", "cell"])
    own = own.withColumn("own", F.shiftleft("cell", 32) + F.pmod(F.xxhash64("cid"), F.col("tiles"))).drop("tiles")
    return own, meets, [celled, sizes]


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id for each row of df(vec_id, embedding)."""
    single = df.schema["embedding"].dataType.simpleString() == "array<float>"
    vectors = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = arrow_map(vectors, _vectors("<f4" if single else "<f8"), "vec_id long, n long, v binary")
    good = rows.where("v is not null")
    # a class is named by a number that tells vectors apart, so that rows without vec_id have one too
    classes = written(good.groupBy("v", "n").agg(F.count("*").alias("members"), F.min("vec_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    basis = rotations(classes)
    own, meets, scratch = tiles(classes.select("cid", "members", "n", "v"), basis, threshold, tile_bytes)
    dealt = own.join(meets, ["n", "cell"]).withColumn("other", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("tiles") - 1)))
    dealt = dealt.select("n", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "members", "v")
    dealt = dealt.repartition("n", "i", "j").sortWithinPartitions("n", "i", "j")
    found = written(arrow_map(dealt, _compare(threshold, basis), "a long, b long, links long"), "links")
    drop(*scratch)
    comp = written(components(found.where("a <> b").select("a", "b")), "components")
    sums = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
    rooted = classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    result = rooted.join(ids, "root").join(sums, "cid", "left").select("v", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked_rows = good.select("vec_id", "v").join(result, "v").select("vec_id", "n_links", "component_id")
    return linked_rows.unionByName(rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
