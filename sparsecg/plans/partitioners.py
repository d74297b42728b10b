"""Splitting a graph's nodes into parts, and orderings that separate it.

Contiguous and hashed labels need no graph. growing() spreads from seeds by joins, one level a round, kway() goes on to
balance such parts and to move border nodes to where most of their neighbours are; both suit any size. bisection() and
the dissections work on the adjacency inside one task and are refused beyond LOCAL_EDGES, as a breadth-first order is
sequential; kway() is the way beyond.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scan import row_rank
from ..functions.scratch import drop, written
from ..model import Code, EngineError
from ..operators.partition import bipartite, symmetrise

#: Edges up to which a graph is handled by one task: some 100 bytes each while its adjacency is sorted.
LOCAL_EDGES = 10_000_000
#: How far a part of kway() may be above the mean size.
IMBALANCE = 0.05


def contiguous(nodes: DataFrame, n: int, nparts: int) -> DataFrame:
    return nodes.select("i", F.floor(F.col("i") * nparts / F.lit(n)).cast("int").alias("p"))


def hashed(nodes: DataFrame, nparts: int) -> DataFrame:
    return nodes.select("i", F.pmod(F.xxhash64("i"), F.lit(nparts)).cast("int").alias("p"))


def growing(edges: DataFrame, nodes: DataFrame, n: int, nparts: int) -> DataFrame:
    """i, p: parts grown level by level from evenly spaced seeds; nodes that no seed reaches are dealt by range."""
    seeds = [(k * n) // nparts for k in range(nparts)]
    both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    spark = edges.sparkSession
    state = written(nodes.join(F.broadcast(spark.createDataFrame([(s, k) for k, s in enumerate(seeds)], "i long, p int").dropDuplicates(["i"])), "i", "left"), "grown")
    seen = -1
    while True:  # a round for each level, as many as the graph has; every one but the last reaches a node
        reached = both.join(state.where("p is not null").select(F.col("i").alias("u"), "p"), "u").groupBy(F.col("v").alias("i")).agg(F.min("p").alias("q"))
        new = written(state.join(reached, "i", "left").select("i", F.coalesce("p", "q").alias("p")), "grown")
        drop(state)
        state, labelled = new, new.where("p is not null").count()
        if labelled == seen:
            break
        seen = labelled
    return state.select("i", F.coalesce("p", F.floor(F.col("i") * nparts / F.lit(n)).cast("int")).alias("p"))


def _balanced(labels: DataFrame, n: int, nparts: int) -> DataFrame:
    """labels with the last nodes of parts that are too large moved to those that have room, by ranks on both sides."""
    most = math.ceil(n / nparts * (1 + IMBALANCE))
    sizes = {r.p: r["count"] for r in labels.groupBy("p").count().collect()}  # a row for each part
    over = {p: c - most for p, c in sizes.items() if c > most}
    if not over:
        return labels
    room, at = [], 0  # part, first place, end
    for p in range(nparts):
        free = most - sizes.get(p, 0)
        if free > 0:
            room.append((p, at, at + free))
            at += free
    spark = labels.sparkSession
    extra = labels.join(spark.createDataFrame(list(over.items()), "p int, surplus long"), "p")
    ranked = written(row_rank(extra, ["p", "i"], "r"), "surplus")
    first = {r.p: r.f for r in ranked.groupBy("p").agg(F.min("r").alias("f")).collect()}
    starts, before = [], 0
    for p, c in over.items():
        starts.append((p, first[p], before))
        before += c
    moved = ranked.join(spark.createDataFrame(starts, "p int, f long, before long"), "p").where("r - f < surplus")
    # the same buckets on both sides instead of a range join: room is dealt by stretches of one length
    width = max(1, math.ceil(at / max(1, 4 * nparts)))
    slots = [(p, a, z, b) for p, a, z in room for b in range(a // width, (z - 1) // width + 1)]
    place = F.col("r") - F.col("f") + F.col("before")
    moved = moved.select("i", place.alias("place"), F.floor(place / width).alias("b"))
    to = moved.join(spark.createDataFrame(slots, "q int, a long, z long, b long"), "b").where("place >= a and place < z").select("i", "q")
    return written(labels.join(to, "i", "left").select("i", F.coalesce("q", "p").alias("p")), "balanced")


def kway(edges: DataFrame, nodes: DataFrame, n: int, nparts: int, rounds: int = 8) -> DataFrame:
    """i, p: growing(), balanced, then rounds in which border nodes move to the part that most of their neighbours have.

    Half of the nodes, by a hash that changes each round, may move in a round, so that neighbours don't swap parts
    for ever. A round that cuts more edges, or that leaves a part too large, is undone; parts stay within IMBALANCE.
    """
    state = _balanced(written(growing(edges, nodes, n, nparts), "grown"), n, nparts)
    if nparts < 2:
        return state
    most = math.ceil(n / nparts * (1 + IMBALANCE))
    both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")

    def cut(labels: DataFrame) -> int:
        far = both.join(labels.select(F.col("i").alias("u"), F.col("p").alias("pu")), "u").join(labels.select(F.col("i").alias("v"), F.col("p").alias("pv")), "v")
        return far.where("pu <> pv").count() // 2

    best = cut(state)
    for k in range(rounds):
        near = both.join(state.select(F.col("i").alias("v"), "p"), "v").groupBy(F.col("u").alias("i"), F.col("p").alias("q")).agg(F.count("*").alias("c"))
        own = near.join(state, "i")
        choice = own.groupBy("i").agg(F.max_by("q", F.struct("c", (-F.col("q")).alias("o"))).alias("q"), F.max("c").alias("c"), F.coalesce(F.max(F.when(F.col("q") == F.col("p"), F.col("c"))), F.lit(0)).alias("here"))
        gain = choice.where((F.col("c") > F.col("here")) & (F.pmod(F.xxhash64("i", F.lit(k)), F.lit(2)) == 0)).select("i", "q")
        new = written(state.join(gain, "i", "left").select("i", F.coalesce("q", "p").alias("p")), "moved")
        largest = new.groupBy("p").count().agg(F.max("count")).first()[0]
        now = cut(new)
        if largest > most or now > best:
            drop(new)
            continue
        if now == best and not gain.limit(1).count():
            break
        state, best = new, now
    return state


def _adjacency(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = u != v
    a, b = np.concatenate([u[keep], v[keep]]), np.concatenate([v[keep], u[keep]])
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return np.searchsorted(pairs[:, 0], np.arange(n + 1)), pairs[:, 1]


def _levels(ptr: np.ndarray, adj: np.ndarray, inside: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Members in breadth-first order from an end of each connected piece."""

    def sweep(root: int, seen: set[int]) -> list[int]:
        out, queue = [], deque([root])
        seen.add(root)
        while queue:
            x = queue.popleft()
            out.append(x)
            for y in adj[ptr[x] : ptr[x + 1]].tolist():
                if inside[y] and y not in seen:
                    seen.add(y)
                    queue.append(y)
        return out

    order, done = [], set()
    for m in members.tolist():
        if m not in done:
            far = sweep(m, set())[-1]
            order += sweep(far, done)
    return np.array(order, np.int64)


def bisect_labels(n: int, u: np.ndarray, v: np.ndarray, nparts: int) -> np.ndarray:
    """Labels by recursive bisection of breadth-first orders, in proportion to the parts on each side."""
    ptr, adj = _adjacency(n, u, v)
    labels = np.zeros(n, np.int32)
    todo = [(np.arange(n), 0, nparts)]
    inside = np.zeros(n, bool)
    while todo:
        members, first, k = todo.pop()
        labels[members] = first
        if k < 2 or not len(members):
            continue
        inside[:] = False
        inside[members] = True
        order = _levels(ptr, adj, inside, members)
        half = k // 2
        cut = math.ceil(len(order) * half / k)
        todo += [(order[:cut], first, half), (order[cut:], first + half, k - half)]
    return labels


def dissect(n: int, u: np.ndarray, v: np.ndarray, least: int = 8) -> np.ndarray:
    """A nested-dissection ordering: perm[k] is the node in place k; separators come after both their sides."""
    ptr, adj = _adjacency(n, u, v)
    place = np.empty(n, np.int64)
    inside = np.zeros(n, bool)
    todo = [(np.arange(n), 0)]
    while todo:
        members, first = todo.pop()
        if len(members) <= least:
            place[members] = first + np.arange(len(members))
            continue
        inside[:] = False
        inside[members] = True
        order = _levels(ptr, adj, inside, members)
        left = np.zeros(n, bool)
        left[order[: len(order) // 2]] = True
        right = inside & ~left
        touch = np.array([left[x] and right[adj[ptr[x] : ptr[x + 1]]].any() for x in order.tolist()])
        sep, rest = order[touch], order[~touch]
        a, b = rest[left[rest]], rest[~left[rest]]
        if not len(a) and not len(b):
            place[members] = first + np.arange(len(members))
            continue
        place[sep] = first + len(members) - len(sep) + np.arange(len(sep))
        todo += [(a, first), (b, first + len(a))]
    perm = np.empty(n, np.int64)
    perm[place] = np.arange(n)
    return perm


def _in_one_task(edges: DataFrame, schema: str, f) -> DataFrame:
    import pyarrow as pa

    if edges.count() > LOCAL_EDGES:
        raise EngineError(Code.NOT_SUPPORTED, "the graph is too large for one task")

    def run(batches):
        t = pa.Table.from_batches(list(batches), schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        yield f(t.column("u").to_numpy(), t.column("v").to_numpy())

    # an empty graph still needs the one task
    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(run, schema)


def bisection(edges: DataFrame, n: int, nparts: int) -> DataFrame:
    """i, p by recursive bisection."""
    import pyarrow as pa

    return _in_one_task(edges, "i long, p int", lambda u, v: pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(bisect_labels(n, u, v, nparts))], ["i", "p"]))


def dissection_general(nz: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """i, place: dissection() of any matrix nz(i, j): of a square one with its transpose, else of rows and then columns as nodes."""
    if nrows == ncols:
        return dissection(symmetrise(nz), nrows)
    return dissection(bipartite(nz, nrows), nrows + ncols)


def dissection(edges: DataFrame, n: int) -> DataFrame:
    """i, place: each node's place in a nested-dissection ordering; swapping the columns inverts it."""
    import pyarrow as pa

    def f(u, v):
        perm = dissect(n, u, v)
        return pa.RecordBatch.from_arrays([pa.array(perm), pa.array(np.arange(n))], ["i", "place"])

    return _in_one_task(edges, "i long, place long", f)
