"""Command line: solve, partition and convert Matrix Market files."""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scratch import scratch_base
from .model import Code, EngineError, Header, SolveOptions
from .operators import partition, vectors
from .plans import cg, partitioners
from .sources import matrix_market as mm

#: Names of solvers, and further spellings of them; the device variants run inside one task.
SOLVERS = {"classic": cg.classic, "pipelined": cg.pipelined, "cg": cg.classic, "cg-pipelined": cg.pipelined}
ONE_TASK = {"one-task": False, "one-task-pipelined": True, "device": False, "device-pipelined": True}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparsecg", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("solve", help="solve A x = b")
    s.add_argument("A")
    s.add_argument("b", nargs="?")
    s.add_argument("x0", nargs="?")
    s.add_argument("--solver", choices=[*SOLVERS, *ONE_TASK], default="classic")
    s.add_argument("--max-iterations", type=int, default=100)
    for name, default in (("residual-atol", 0.0), ("residual-rtol", 1e-9), ("diff-atol", 0.0), ("diff-rtol", 0.0), ("epsilon", 0.0)):
        s.add_argument(f"--{name}", type=float, default=default)
    s.add_argument("--manufactured-solution", action="store_true")
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--partition", help="file with the part of each row, from 1")
    s.add_argument("--output-comm-matrix", action="store_true")
    s.add_argument("--numfmt", default="%.15g")
    s.add_argument("-o", "--output", help="file for the solution")
    s.add_argument("-q", "--quiet", action="store_true")
    t = sub.add_parser("partition", help="label the rows of a symmetric matrix")
    t.add_argument("A")
    t.add_argument("output")
    t.add_argument("--parts", type=int, default=2)
    t.add_argument("--method", choices=["bisection", "kway", "growing", "contiguous", "hashed"], default="bisection")
    c = sub.add_parser("convert", help="write the binary twin of a text file")
    c.add_argument("A")
    c.add_argument("output")
    c.add_argument("--values", choices=["double", "integer"], default="double")
    c.add_argument("--index-bytes", type=int, choices=[4, 8], default=4)
    return p


def _given(spark: SparkSession, path: str) -> str:
    """The path, or that of a scratch file with what standard input holds if it is -."""
    if path != "-":
        return path
    path = f"{scratch_base(spark)}/sparsecg-stdin-{uuid.uuid4().hex}"
    source = getattr(sys.stdin, "buffer", sys.stdin)
    mm._put(spark, path, iter(lambda: source.read(1 << 20), b""))
    return path


def _solve(spark: SparkSession, o: argparse.Namespace) -> None:
    if o.b and o.manufactured_solution:
        raise EngineError(Code.EINVAL, "a right-hand side and a manufactured solution exclude each other")
    h, a = mm.solver_matrix(spark, _given(spark, o.A))
    n = h.nrows
    exact = None
    if o.manufactured_solution:
        raw = vectors.full(spark, n, (F.pmod(F.xxhash64("i", F.lit(o.seed)), F.lit(2_000_001)) - 1_000_000) / 1e6)
        exact = vectors.scal(1 / vectors.nrm2(raw).first().value, raw)
        b = cg.manufactured(a, exact, n)
    elif o.b:
        hb, b = mm.read(spark, _given(spark, o.b))
        if hb.format != "array" or hb.symmetry != "general" or hb.nrows != n or "v" not in b.columns:
            raise EngineError(Code.EINVAL, "the right-hand side must be an array vector with a value for each row")
    else:
        b = vectors.full(spark, n, F.lit(1.0))
    x0 = mm.read(spark, o.x0)[1] if o.x0 else None
    if o.output_comm_matrix and o.partition:
        parts = mm.read(spark, o.partition)[1].select("i", (F.col("v") - 1).cast("int").alias("p"))
        found = partition.comm_matrix(partition.halo_send(partition.edges(a), parts)).orderBy("p", "q").collect()  # the square of the number of parts
        count = int(parts.agg(F.max("p")).first()[0]) + 1
        print(f"%%MatrixMarket matrix coordinate integer general\n{count} {count} {len(found)}")
        for r in found:
            print(r.p + 1, r.q + 1, r.n)
    options = SolveOptions(o.max_iterations, o.residual_atol, o.residual_rtol, o.diff_atol, o.diff_rtol, o.epsilon)
    if o.solver in ONE_TASK:
        x = cg.one_task(a, b, n, options, ONE_TASK[o.solver])
    else:
        res = SOLVERS[o.solver](a, b, n, options, x0)
        x = res.x
        if not o.quiet:
            print(cg.report(res), file=sys.stderr, end="")
    if exact is not None:
        print(f"exact solution 2-norm: {vectors.nrm2(exact).first().value:.17g}\nerror 2-norm: {cg.error_norm(x, exact):.17g}", file=sys.stderr)
    if o.output:
        mm.write(x, o.output, Header("vector", "array", "real", "general", n, 1, n), o.numfmt)


def _partition(spark: SparkSession, o: argparse.Namespace) -> None:
    h, a = mm.solver_matrix(spark, _given(spark, o.A))
    nodes, e = spark.range(h.nrows).select(F.col("id").alias("i")), partition.edges(a)
    labels = {
        "bisection": lambda: partitioners.bisection(e, h.nrows, o.parts),
        "kway": lambda: partitioners.kway(e, nodes, h.nrows, o.parts),
        "growing": lambda: partitioners.growing(e, nodes, h.nrows, o.parts),
        "contiguous": lambda: partitioners.contiguous(nodes, h.nrows, o.parts),
        "hashed": lambda: partitioners.hashed(nodes, o.parts),
    }[o.method]()
    mm.write(labels.select("i", (F.col("p") + 1).cast("double").alias("v")), o.output, Header("vector", "array", "integer", "general", h.nrows, 1, h.nrows))
    print(f"edge cut: {partition.edge_cut(e, labels).first().edgecut}", file=sys.stderr)


def _convert(spark: SparkSession, o: argparse.Namespace) -> None:
    h, a = mm.read(spark, _given(spark, o.A))
    mm.write_binary(a, o.output, h, o.values, o.index_bytes)


def main(argv: list[str] | None = None) -> int:
    o = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        {"solve": _solve, "partition": _partition, "convert": _convert}[o.command](spark, o)
    except EngineError as e:
        print(f"sparsecg: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
