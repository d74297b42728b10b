"""Conjugate gradients, classic and pipelined, over relations and, where the matrix fits there, inside one task.

The state of an iteration is one relation (i, x, r, p, ...). The matrix product is the only join; everything else is
a column expression on the state. A state is stored once per iteration in the shared folder, which ends the lineage
and is read again by the iteration's reductions. Scalars are Python floats.

Up to BROADCAST_ROWS rows the vector is broadcast to the stored matrix. Beyond, the matrix is stored in buckets by
column and every state in as many by row, so that a product joins them where they lie and only partial sums of rows are
shuffled, neither the matrix nor the state.
"""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import bucketed, drop, written
from ..model import Code, EngineError, SolveOptions, SolveResult
from ..operators import matrix
from ..operators.matrix import expand, product

#: Entries of the full matrix, of 16 bytes each, up to which a solve lies inside one task; larger ones are solved over relations.
LOCAL_ENTRIES = 20_000_000
#: A row counts as so many entries there, for its places in the vectors of a solve.
ROW_ENTRIES = 5


class _Report:
    """What a solver has done: calls, flops, bytes and seconds of each operation."""

    def __init__(self, n: int, nnz_full: int) -> None:
        self.n, self.nnz = n, nnz_full
        self.counts: Counter = Counter()
        self.flops: Counter = Counter()
        self.bytes: Counter = Counter()
        self.seconds: Counter = Counter()

    def timed(self, op: str, f):
        t = time.perf_counter()
        out = f()
        self.seconds[op] += time.perf_counter() - t
        return out

    def did(self, *ops: str) -> None:
        """Counts a call of each, with 4-byte column numbers and 8-byte values."""
        n = self.n
        for op in ops:
            flops, size = {"gemv": (2 * (self.nnz + n), 12 * self.nnz + 24 * n), "scal": (0, 8 * n), "nrm2sqr": (2 * n, 8 * n)}.get(op, (2 * n, 16 * n))
            self.counts[op] += 1
            self.flops[op] += flops
            self.bytes[op] += size

    def rows(self) -> list[tuple[str, int, int, int]]:
        """op, calls, flops, bytes"""
        return [(op, self.counts[op], self.flops[op], self.bytes[op]) for op in self.counts]


class _Store:
    """Where the matrix and the states of one solve lie: plain tables, or buckets if a vector is too long to broadcast."""

    def __init__(self, spark: SparkSession, n: int):
        self.wide = n > matrix.BROADCAST_ROWS
        # as many buckets as a sum by row has partitions, so that sums and states meet without another exchange
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def matrix(self, a: DataFrame, epsilon: float) -> DataFrame:
        """Both triangles."""
        f = expand(a, epsilon)
        return bucketed(f, "full", "j", self.buckets) if self.wide else written(f, "full")

    def state(self, df: DataFrame, name: str, dealt: bool = True) -> DataFrame:
        return bucketed(df, name, "i", self.buckets, dealt) if self.wide else written(df, name)


def _start(b: DataFrame, x0: DataFrame | None) -> DataFrame:
    if x0 is None:
        return b.select("i", F.col("v").alias("b"), F.lit(0.0).alias("x"))
    out = b.select("i", F.col("v").alias("b")).join(x0.select("i", F.col("v").alias("x")), "i")
    if out.count() != b.count():
        raise EngineError(Code.INDEX_OUT_OF_BOUNDS, "vectors do not cover the rows of the matrix")
    return out


def _with_product(state: DataFrame, f: DataFrame, column: str, name: str, n: int) -> DataFrame:
    s = product(f, state.select("i", F.col(column).alias("v")), n).withColumnRenamed("s", name)
    return state.join(s, "i", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def _failed(code: Code, result: SolveResult) -> EngineError:
    """An error that holds what the solve has reached."""
    error = EngineError(code)
    error.result = result
    return error


def _sum(df: DataFrame, *exprs) -> Row:
    return df.agg(*[F.coalesce(F.sum(e), F.lit(0.0)).alias(f"s{k}") for k, e in enumerate(exprs)]).first()


def check_sizes(a: DataFrame, b: DataFrame, n: int) -> None:
    if b.count() != n:
        raise EngineError(Code.INDEX_OUT_OF_BOUNDS, "the right-hand side does not cover the rows of the matrix")
    if a.where((F.col("i") < 0) | (F.col("j") < 0) | (F.col("i") >= n) | (F.col("j") >= n)).limit(1).count():
        raise EngineError(Code.INDEX_OUT_OF_BOUNDS)


def classic(a: DataFrame, b: DataFrame, n: int, options: SolveOptions | None = None, x0: DataFrame | None = None) -> SolveResult:
    """Solves A x = b for a symmetric A given as one triangle, with two reductions and one product an iteration."""
    o = options or SolveOptions()
    check_sizes(a, b, n)
    store = _Store(a.sparkSession, n)
    f = store.matrix(a, o.epsilon)
    rep = _Report(n, f.count())
    r, p, t, x = (F.col(c) for c in ("r", "p", "t", "x"))
    diff = o.diff_atol > 0 or o.diff_rtol > 0
    state = _start(b, x0)
    if x0 is None:
        state = state.select("i", "b", "x", F.col("b").alias("r"))
        state = store.state(state, "start", False) if store.wide else state
    else:
        given = store.state(state, "given", False) if store.wide else state
        state = rep.timed("gemv", lambda: store.state(_with_product(given, f, "x", "t", n).select("i", "b", "x", (F.col("b") - t).alias("r")), "start"))
    sums = rep.timed("nrm2sqr", lambda: _sum(state, F.col("b") * F.col("b"), x * x, r * r))
    bnrm2, x0nrm2, g = math.sqrt(sums[0]), math.sqrt(sums[1]), sums[2]
    rnrm2 = r0nrm2 = math.sqrt(g)
    rtol, drtol = o.residual_rtol * r0nrm2, o.diff_rtol * x0nrm2
    res = SolveResult(None, 0, bnrm2, x0nrm2, r0nrm2, rnrm2, counts=rep.counts, seconds=rep.seconds, report=rep)
    state = state.select("i", "x", "r", r.alias("p"))

    def finish(state: DataFrame, status: str) -> SolveResult:
        res.x, res.rnrm2, res.status = state.select("i", x.alias("v")), rnrm2, status
        return res

    if o.residual_atol > 0 and rnrm2 < o.residual_atol or rtol > 0 and rnrm2 < rtol:
        return finish(state, "converged")
    free = not (o.residual_atol or o.residual_rtol or o.diff_atol or o.diff_rtol)
    old: list[DataFrame] = []
    for k in range(o.maxits):
        st = rep.timed("gemv", lambda s=state: store.state(_with_product(s, f, "p", "t", n), "state"))
        pt = rep.timed("dot", lambda st=st: _sum(st, p * t))[0]
        rep.did("scal", "gemv", "dot")
        if pt == 0:
            if free and g == 0:
                return finish(state, "exact")
            raise _failed(Code.NOT_CONVERGED_INDEFINITE_MATRIX, finish(state, "not converged"))
        alpha = g / pt
        new_r = r - F.lit(alpha) * t
        gprev = g
        sums = rep.timed("nrm2sqr", lambda st=st, new_r=new_r: _sum(st, new_r * new_r, *([p * p] if diff else [])))
        g, rnrm2 = sums[0], math.sqrt(sums[0])
        rep.did("axpy", "axpy", "nrm2sqr", "aypx")
        if diff:
            rep.did("nrm2sqr")
            res.dxnrm2 = abs(alpha) * math.sqrt(sums[1])
        res.iterations = k + 1
        beta = g / gprev if gprev else math.nan
        res.history.append((k, rnrm2, alpha, beta))
        moved = st.select("i", (x + F.lit(alpha) * p).alias("x"), new_r.alias("r"), "p")
        if o.residual_atol > 0 and rnrm2 < o.residual_atol or rtol > 0 and rnrm2 < rtol or o.diff_atol > 0 and res.dxnrm2 < o.diff_atol or drtol > 0 and res.dxnrm2 < drtol:
            return finish(moved, "converged")
        if gprev == 0:
            raise EngineError(Code.NOT_CONVERGED_INDEFINITE_MATRIX)
        state = moved.select("i", "x", "r", (F.lit(beta) * p + r).alias("p"))
        drop(*old)  # the state before the last is read no more
        old = [st]
    done = finish(state, "converged" if free else "not converged")
    if not free:
        raise _failed(Code.NOT_CONVERGED, done)
    return done


def pipelined(a: DataFrame, b: DataFrame, n: int, options: SolveOptions | None = None, x0: DataFrame | None = None) -> SolveResult:
    """As classic(), with one reduction of two values an iteration; the iteration that finds convergence isn't counted."""
    o = options or SolveOptions()
    if o.diff_atol or o.diff_rtol:
        raise EngineError(Code.NOT_SUPPORTED, "differences of solutions as a stopping rule")
    check_sizes(a, b, n)
    store = _Store(a.sparkSession, n)
    f = store.matrix(a, o.epsilon)
    rep = _Report(n, f.count())
    c = {k: F.col(k) for k in "xrwztpq"}
    state = _start(b, x0)
    if store.wide:
        state = store.state(state, "given", False)
    if x0 is None:
        state = state.select("i", "b", "x", F.col("b").alias("r"))
    else:
        state = _with_product(state, f, "x", "t", n).select("i", "b", "x", (F.col("b") - F.col("t")).alias("r"))
    start = store.state(_with_product(state, f, "r", "w", n), "start")
    sums = _sum(start, F.col("b") * F.col("b"), c["x"] * c["x"])
    zero = F.lit(0.0)
    state = start.select("i", "x", "r", "w", zero.alias("z"), zero.alias("t"), zero.alias("p"))
    res = SolveResult(None, 0, math.sqrt(sums[0]), math.sqrt(sums[1]), 0.0, 0.0, counts=rep.counts, seconds=rep.seconds, report=rep)
    free = not (o.residual_atol or o.residual_rtol)
    gamma_prev = alpha_prev = math.inf
    rtol, old = 0.0, []
    for k in range(o.maxits):
        st = rep.timed("gemv", lambda s=state: store.state(_with_product(s, f, "w", "q", n), "state"))
        gamma, delta = rep.timed("dot", lambda st=st: _sum(st, c["r"] * c["r"], c["w"] * c["r"]))
        rep.did("scal", "gemv", "dot", "dot")
        res.rnrm2 = math.sqrt(gamma)
        if k == 0:
            res.r0nrm2, rtol = res.rnrm2, o.residual_rtol * res.rnrm2
        if o.residual_atol > 0 and res.rnrm2 < o.residual_atol or rtol > 0 and res.rnrm2 < rtol:
            res.x, res.status = st.select("i", c["x"].alias("v")), "converged"
            return res
        if gamma == 0:
            res.x, res.status = st.select("i", c["x"].alias("v")), "exact"
            return res
        beta = 0.0 if k == 0 else gamma / gamma_prev
        below = delta if k == 0 else delta - beta * gamma / alpha_prev
        if below == 0:
            res.x, res.status = st.select("i", c["x"].alias("v")), "not converged"
            raise _failed(Code.NOT_CONVERGED_INDEFINITE_MATRIX, res)
        alpha = gamma / below
        z, t, p = c["q"] + F.lit(beta) * c["z"], c["w"] + F.lit(beta) * c["t"], c["r"] + F.lit(beta) * c["p"]
        state = st.select("i", (c["x"] + F.lit(alpha) * p).alias("x"), (c["r"] - F.lit(alpha) * t).alias("r"), (c["w"] - F.lit(alpha) * z).alias("w"), z.alias("z"), t.alias("t"), p.alias("p"))
        rep.did(*["aypx"] * 3, *["axpy"] * 3)
        res.iterations = k + 1
        res.history.append((k, res.rnrm2, alpha, beta))
        gamma_prev, alpha_prev = gamma, alpha
        drop(*old)
        old = [st]
    res.x, res.status = state.select("i", c["x"].alias("v")), "converged" if free else "not converged"
    if not free:
        raise _failed(Code.NOT_CONVERGED, res)
    return res


def _times(i: np.ndarray, j: np.ndarray, a: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """The product of the full matrix, in any order, with a vector; by blocks, as all products at once would take as much again as the values."""
    step = max(n, 1 << 20)

    def times(v: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for s in range(0, len(a), step):
            k = slice(s, s + step)
            out += np.bincount(i[k], a[k] * v[j[k]], n)
        return out

    return times


def local_solve(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, maxits: int, rtol: float, atol: float) -> tuple[np.ndarray, list[tuple[int, float]]]:
    """Classic iterations on arrays."""
    n = len(b)
    times = _times(i, j, a, n)
    x, r = np.zeros(n), b.astype(float).copy()
    p, g = r.copy(), float(r @ r)
    limit, history = rtol * math.sqrt(g), []
    if limit > 0 and math.sqrt(g) < limit or atol > 0 and math.sqrt(g) < atol:
        return x, history
    for k in range(maxits):
        t = times(p)
        pt = float(p @ t)
        if pt == 0:
            break
        alpha, gprev = g / pt, g
        x += alpha * p
        r -= alpha * t
        g = float(r @ r)
        history.append((k, math.sqrt(g)))
        if limit > 0 and math.sqrt(g) < limit or atol > 0 and math.sqrt(g) < atol:
            break
        p = r + g / gprev * p
    return x, history


def local_pipelined(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, maxits: int, rtol: float, atol: float) -> tuple[np.ndarray, list[tuple[int, float]]]:
    """Pipelined iterations on arrays: both dot products of an iteration are taken before its product."""
    n = len(b)
    times = _times(i, j, a, n)
    x, r = np.zeros(n), b.astype(float).copy()
    w = times(r)
    z, t, p = np.zeros(n), np.zeros(n), np.zeros(n)
    gamma_prev = alpha_prev = math.inf
    limit, history = 0.0, []
    for k in range(maxits):
        gamma, delta = float(r @ r), float(w @ r)
        norm = math.sqrt(gamma)
        limit = rtol * norm if k == 0 else limit
        if gamma == 0 or limit > 0 and norm < limit or atol > 0 and norm < atol:
            break
        q = times(w)
        beta = gamma / gamma_prev if k else 0.0
        below = delta - beta * gamma / alpha_prev if k else delta
        if below == 0:
            break
        alpha = gamma / below
        z, t, p = q + beta * z, w + beta * t, r + beta * p
        x += alpha * p
        r -= alpha * t
        w -= alpha * z
        history.append((k, norm))
        gamma_prev, alpha_prev = gamma, alpha
    return x, history


def one_task(a: DataFrame, b: DataFrame, n: int, options: SolveOptions | None = None, pipeline: bool = False) -> DataFrame:
    """i, v: the whole classic or pipelined solve inside one task if a count shows the matrix to fit there, else the same iterations over relations.

    The last iterate is returned even if no tolerance is met; differences of solutions are not looked at.
    """
    o = replace(options or SolveOptions(), diff_atol=0.0, diff_rtol=0.0)
    a = written(a.select("i", "j", "a"), "triangle")  # read by the checks and by the solve
    check_sizes(a, b, n)
    entries = int(_sum(a, F.when(F.col("i") == F.col("j"), 1).otherwise(2))[0])
    if entries + ROW_ENTRIES * n > LOCAL_ENTRIES:
        x = _reached(pipelined if pipeline else classic, a, b, n, o)
        drop(a)
        return x
    solve = local_pipelined if pipeline else local_solve
    rows = expand(a, o.epsilon).select("i", "j", "a").unionByName(b.select("i", F.lit(-1).cast("long").alias("j"), F.col("v").alias("a"))).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j, v = np.empty(entries, np.int32), np.empty(entries, np.int32), np.empty(entries)
        rhs, k = np.zeros(n), 0
        for batch in batches:
            bi, bj, bv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "a"))
            inside = bj >= 0
            rhs[bi[~inside]] = bv[~inside]
            to = k + int(inside.sum())
            i[k:to], j[k:to], v[k:to] = bi[inside], bj[inside], bv[inside]
            k = to
        x, _ = solve(i, j, v, rhs, o.maxits, o.residual_rtol, o.residual_atol)
        for s in range(0, n, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, min(n, s + (1 << 20)))), pa.array(x[s : s + (1 << 20)])], ["i", "v"])

    return rows.mapInArrow(run, "i long, v double")


def _reached(solve, a: DataFrame, b: DataFrame, n: int, o: SolveOptions) -> DataFrame:
    """i, v: the last iterate of a solve over relations, converged or not."""
    try:
        return solve(a, b, n, o).x
    except EngineError as e:
        if not hasattr(e, "result"):
            raise
        return e.result.x


def report(res: SolveResult) -> str:
    """A report of a solve: norms, totals and what each operation did."""
    rep, seconds = res.report, sum(res.seconds.values())
    lines = [
        f"iterations: {res.iterations}",
        f"status: {res.status}",
        f"right-hand side 2-norm: {res.bnrm2:.17g}",
        f"initial guess 2-norm: {res.x0nrm2:.17g}",
        f"initial residual 2-norm: {res.r0nrm2:.17g}",
        f"residual 2-norm: {res.rnrm2:.17g}",
        f"difference in solution iterates 2-norm: {res.dxnrm2:.17g}",
    ]
    total = sum(rep.flops.values()) / 1e9
    lines += [f"total flops: {total:.3f} Gflop", f"total flop rate: {total / seconds if seconds else 0:.3f} Gflop/s", f"total solver time: {seconds:.6f} seconds", "operations:"]
    for op, calls, _, size in rep.rows():
        took = res.seconds.get(op, 0.0)  # vector updates are part of the product that reads them
        lines.append(f"  {op}: {took:.6f} seconds {calls} times {size} B {size / 1e9 / took if took else 0:.3f} GB/s")
    return "\n".join(lines) + "\n"


def manufactured(a: DataFrame, x: DataFrame, n: int) -> DataFrame:
    """i, v: the right-hand side A x, without any shift of the diagonal."""
    s = product(expand(a), x, n)
    return x.join(s, "i", "left").select("i", F.coalesce("s", F.lit(0.0)).alias("v"))


def error_norm(x: DataFrame, exact: DataFrame) -> float:
    both = x.select("i", F.col("v").alias("x")).join(exact.select("i", F.col("v").alias("y")), "i")
    return math.sqrt(_sum(both, (F.col("x") - F.col("y")) ** 2)[0])
