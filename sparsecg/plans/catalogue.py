"""The registered queries of the library and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import prefix_sum
from ..model import SolveOptions
from ..operators import coo, matrix, partition, vectors
from . import cg
from .derived import PARTS, SQL_BIP, SQL_CHAIN, SQL_ENTRIES, SQL_STAR, Bip, chain, entries, h, star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, prefix: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {prefix}\n{sql}"
        return f

    return add


def bip(name: str, sql: str | None):
    """Registers f(Bip)."""
    return lambda f: _query(name, SQL_BIP, sql)(lambda spark, d: f(Bip(spark, d)))


def coords(name: str, sql: str | None):
    """Registers f(entries)."""
    return lambda f: _query(name, SQL_ENTRIES, sql)(lambda spark, d: f(entries(spark, d)))


def rounded(column: str, digits: int = 6):
    """Without a sign on zero."""
    return (F.round(F.col(column), digits) + F.lit(0.0)).alias(column)


# --- matrices -------------------------------------------------------------------------------------------------

bip("mat_packed", "SELECT i, j, a FROM A")(lambda m: m.a)
bip("mat_expand", "SELECT i, j, a FROM F")(lambda m: matrix.expand(m.a))
bip("mat_expand_eps", "SELECT i, j, CASE WHEN i = j THEN a + 0.5 ELSE a END AS a FROM F")(lambda m: matrix.expand(m.a, 0.5))
bip("mat_rowptr",
    "SELECT i, CAST(SUM(c) OVER (ORDER BY i) - c AS BIGINT) AS start, c AS count FROM (SELECT n.i, COUNT(A.i) AS c FROM nodes n LEFT JOIN A ON "
    "A.i = n.i GROUP BY n.i)")(lambda m: coo.row_pointers(m.a, m.nodes))
bip("mat_degree", "SELECT i, COUNT(*) AS degree FROM F GROUP BY i")(lambda m: matrix.expand(m.a).groupBy("i").agg(F.count("*").alias("degree")))
bip("mat_zero", "SELECT i, j, CAST(0 AS DOUBLE) AS a FROM A")(lambda m: m.a.select("i", "j", F.lit(0.0).alias("a")))
bip("mat_split", "SELECT p, A.i, j, a FROM A JOIN rp ON rp.i = A.i")(lambda m: matrix.split(m.a, m.range_parts()))
bip("mat_from_rows",
    "SELECT i, j, a FROM A")(lambda m: matrix.from_rows(m.a.withColumn("slot", F.pmod("j", F.lit(16))).groupBy("i", "slot").agg(F.collect_list(F.struct("j", "a")).alias("e")).select("i", F.col("e.j").alias("cols"), F.col("e.a").alias("vals"))))
bip("spmv_ones", "SELECT F.i, SUM(a * v) AS s FROM F JOIN ones ON F.j = ones.i GROUP BY F.i")(lambda m: matrix.product(matrix.expand(m.a), m.ones(), m.n))
bip("spmv_h", "SELECT F.i, ROUND(SUM(a * v), 6) + 0.0 AS s FROM F JOIN h ON F.j = h.i GROUP BY F.i")(lambda m: matrix.product(matrix.expand(m.a), m.h(), m.n).select("i", rounded("s")))
bip("spmv_alpha_beta", "SELECT p.i, ROUND(0.5 * p.v + 2.0 * COALESCE(s, 0), 6) + 0.0 AS v FROM price p LEFT JOIN (SELECT F.i, SUM(a * v) AS s FROM F JOIN h ON F.j = h.i GROUP BY F.i) USING (i)")(
    lambda m: matrix.dsymv(2.0, matrix.expand(m.a), m.h(), 0.5, m.price(), m.n).select("i", rounded("v"))
)
bip("spmv_partial_final",
    "SELECT F.i, ROUND(SUM(a * v), 6) + 0.0 AS s FROM F JOIN h ON F.j = h.i GROUP BY F.i")(lambda m: matrix.product_salted(matrix.expand(m.a), m.h(), 8).select("i", rounded("s")))
bip("spmv_by_part",
    "SELECT p, F.i, ROUND(SUM(a * v), 6) + 0.0 AS s FROM F JOIN h ON F.j = h.i JOIN rp ON rp.i = F.i GROUP BY p, F.i")(lambda m: matrix.product_by_part(matrix.expand(m.a), m.h(), m.range_parts()).select("p", "i", rounded("s")))
_query("spmv_star", SQL_STAR,
    "SELECT F.i, ROUND(SUM(a * v), 6) + 0.0 AS s FROM F JOIN h ON F.j = h.i GROUP BY F.i")(lambda spark, d: (lambda a, n: matrix.product_salted(matrix.expand(a), h(spark.range(n).select(F.col("id").alias("i"))), 8).select("i", rounded("s")))(*star(spark, d)))

# --- vectors --------------------------------------------------------------------------------------------------

bip("vec_const", "SELECT i, CAST(2.5 AS DOUBLE) AS v FROM nodes")(lambda m: vectors.full(m.spark, m.n, F.lit(2.5)))
bip("vec_h", "SELECT i, v FROM h")(lambda m: m.h())
bip("vec_set_subset", "SELECT n.i, price.v FROM nodes n JOIN price USING (i)")(lambda m: vectors.assign(m.ones(), m.price()))
bip("blas_swap", "SELECT h.i, price.v AS x, h.v AS y FROM h JOIN price USING (i)")(lambda m: vectors.together(*vectors.swap(m.h(), m.price())))
bip("blas_copy", "SELECT i, v FROM price")(lambda m: m.price().select("i", "v"))
bip("blas_scal", "SELECT i, 2.5 * v AS v FROM price")(lambda m: vectors.scal(2.5, m.price()))
bip("blas_scal_zero", "SELECT i, CAST(0 AS DOUBLE) AS v FROM price")(lambda m: vectors.scal(0.0, m.price()))
bip("blas_axpy", "SELECT h.i, ROUND(2.0 * h.v + p.v, 6) + 0.0 AS v FROM h JOIN price p USING (i)")(lambda m: vectors.axpy(2.0, m.h(), m.price()).select("i", rounded("v")))
bip("blas_aypx", "SELECT h.i, ROUND(2.0 * p.v + h.v, 6) + 0.0 AS v FROM h JOIN price p USING (i)")(lambda m: vectors.aypx(2.0, m.price(), m.h()).select("i", rounded("v")))
bip("blas_dot", "SELECT ROUND(SUM(h.v * p.v), 6) + 0.0 AS value FROM h JOIN price p USING (i)")(lambda m: vectors.dot(m.h(), m.price()).select(rounded("value")))
bip("blas_nrm2", "SELECT ROUND(SQRT(SUM(v * v)), 4) + 0.0 AS value FROM price")(lambda m: vectors.nrm2(m.price()).select(rounded("value", 4)))
bip("blas_nrm2sqr", "SELECT ROUND(SUM(v * v), 6) + 0.0 AS value FROM h")(lambda m: vectors.nrm2sqr(m.h()).select(rounded("value")))
bip("blas_asum", "SELECT ROUND(SUM(ABS(v)), 4) + 0.0 AS value FROM price")(lambda m: vectors.asum(m.price()).select(rounded("value", 4)))
bip("blas_iamax", "SELECT i FROM price ORDER BY ABS(v) DESC, i LIMIT 1")(lambda m: vectors.iamax(m.price()))
bip("blas_nrm2sqr_parts", "SELECT p, ROUND(SUM(h.v * h.v), 6) + 0.0 AS value FROM h JOIN rp USING (i) GROUP BY p")(
    lambda m: vectors.nrm2sqr_by_part(m.h(), m.range_parts()).select("p", rounded("value"))
)
bip("blas_asum_parts", "SELECT p, ROUND(SUM(ABS(x.v)), 6) + 0.0 AS value FROM price x JOIN rp USING (i) GROUP BY p")(
    lambda m: vectors.asum_by_part(m.price(), m.range_parts()).select("p", rounded("value"))
)
bip("blas_dot_parts",
    "SELECT p, ROUND(SUM(h.v * x.v), 6) + 0.0 AS value FROM h JOIN price x USING (i) JOIN rp USING (i) GROUP BY p")(lambda m: vectors.dot_by_part(m.h(), m.price(), m.range_parts()).select("p", rounded("value")))
bip("sp_dot", "SELECT ROUND(SUM(px.v * h.v), 6) + 0.0 AS value FROM px JOIN h USING (i)")(lambda m: vectors.sparse_dot(m.packed(), m.h()).select(rounded("value")))
bip("sp_axpy",
    "SELECT h.i, ROUND(h.v + 2.0 * COALESCE(s, 0), 6) + 0.0 AS v FROM h LEFT JOIN (SELECT i, SUM(v) AS s FROM px GROUP BY i) USING (i)")(lambda m: vectors.sparse_axpy(2.0, m.packed(), m.h()).select("i", rounded("v")))
bip("sp_gather", "SELECT pos, px.i, h.v FROM px JOIN h USING (i)")(lambda m: vectors.gather(m.packed(), m.h()))
bip("sp_gather_zero_x",
    "SELECT pos, px.i, CASE WHEN ROW_NUMBER() OVER (PARTITION BY px.i ORDER BY pos) = 1 THEN x.v ELSE 0 END AS v FROM px JOIN price x USING (i)")(lambda m: vectors.gather_zero(m.packed(), m.price())[0])
bip("sp_gather_zero_y", "SELECT i, CASE WHEN i IN (SELECT i FROM px) THEN 0 ELSE v END AS v FROM price")(lambda m: vectors.gather_zero(m.packed(), m.price())[1])
bip("sp_scatter", "SELECT y.i, COALESCE(s, y.v) AS v FROM price y LEFT JOIN (SELECT i, arg_max(v, pos) AS s FROM px GROUP BY i) USING (i)")(lambda m: vectors.scatter(m.price(), m.packed()))

# --- coordinate matrices --------------------------------------------------------------------------------------

_PLACE = "SELECT k, ROW_NUMBER() OVER (ORDER BY {}) - 1 AS pos FROM nz"
coords("coo_sort_rowmajor", _PLACE.format("i, j, k"))(coo.sort_rowmajor)
coords("coo_sort_rowwise", _PLACE.format("i, k"))(coo.sort_rowwise)
coords("coo_dedup_sum", "SELECT i, j, SUM(a) AS a FROM nz GROUP BY i, j")(coo.merge)
coords("coo_dedup_map", "SELECT k, DENSE_RANK() OVER (ORDER BY i, j) - 1 AS pos FROM nz")(coo.merge_map)
coords(
    "coo_dedup_adjacent",

        "SELECT run - 1 AS pos, i, j, SUM(a) AS a FROM (SELECT *, CAST(SUM(c) OVER (ORDER BY k) AS BIGINT) AS run FROM (SELECT *, CASE WHEN i = "
        "LAG(i) OVER (ORDER BY k) AND j = LAG(j) OVER (ORDER BY k) THEN 0 ELSE 1 END AS c FROM (SELECT ROW_NUMBER() OVER (ORDER BY i, j, k) - 1 AS "
        "k, i, j, a FROM nz))) GROUP BY run, i, j",
)(lambda nz: coo.merge_adjacent(coo.permute(nz, coo.sort_rowmajor(nz)).withColumnRenamed("pos", "k")))
# places 1, 4, 7, ... leave gaps to close
coords("coo_compact_rows", "SELECT 3 * i + 1 AS old, ROW_NUMBER() OVER (ORDER BY i) - 1 AS new FROM (SELECT DISTINCT i FROM nz)")(lambda nz: coo.renumber(nz.withColumn("i", 3 * F.col("i") + 1), "i"))
coords("coo_compact_cols", "SELECT 3 * j + 1 AS old, ROW_NUMBER() OVER (ORDER BY j) - 1 AS new FROM (SELECT DISTINCT j FROM nz)")(lambda nz: coo.renumber(nz.withColumn("j", 3 * F.col("j") + 1), "j"))
coords("coo_permute", "SELECT ROW_NUMBER() OVER (ORDER BY i, j, k) - 1 AS pos, i, j, a FROM nz")(lambda nz: coo.permute(nz, coo.sort_rowmajor(nz)))
coords("scan_inclusive", "SELECT k, SUM(a) OVER (ORDER BY k) AS total FROM nz")(lambda nz: prefix_sum(nz, ["k"], F.col("a"), "total").select("k", "total"))
coords("scan_exclusive", "SELECT k, SUM(a) OVER (ORDER BY k) - a AS total FROM nz")(lambda nz: prefix_sum(nz, ["k"], F.col("a"), "total", exclusive=True).select("k", "total"))


def _rowp(nz: DataFrame, column: str = "i") -> DataFrame:
    return nz.select(F.col(column).alias("i")).distinct().select("i", (F.col("i") % PARTS).cast("int").alias("p"))


coords("coo_part_rows", "SELECT k, nz.i, j, a, p FROM nz JOIN rowp ON rowp.i = nz.i")(lambda nz: coo.label(nz, _rowp(nz), "i", PARTS))
coords("coo_part_cols", "SELECT k, nz.i, j, a, p FROM nz JOIN colp ON colp.i = nz.j")(lambda nz: coo.label(nz, _rowp(nz, "j"), "j", PARTS))
coords("coo_part_offsets",
    "SELECT p, CAST(SUM(c) OVER (ORDER BY p) - c AS BIGINT) AS start, c AS count FROM (SELECT p, COUNT(*) AS c FROM nz JOIN rowp ON rowp.i = "
    "nz.i GROUP BY p)")(lambda nz: coo.part_offsets(coo.label(nz, _rowp(nz), "i", PARTS), PARTS))
coords("coo_part_order", "SELECT k, ROW_NUMBER() OVER (ORDER BY p, k) - 1 AS pos FROM nz JOIN rowp ON rowp.i = nz.i")(lambda nz: coo.part_order(coo.label(nz, _rowp(nz), "i", PARTS)))
coords("sort_perm", _PLACE.format("a, k"))(lambda nz: coo.sort_keys(nz, ["a"]))
coords("sort_invperm", "SELECT ROW_NUMBER() OVER (ORDER BY a, k) - 1 AS pos, k FROM nz")(lambda nz: coo.sort_keys(nz, ["a"]).select("pos", "k"))
coords("sort_pairs", _PLACE.format("j, a, k"))(lambda nz: coo.sort_keys(nz, ["j", "a"]))

# --- parts, ghosts and halo -----------------------------------------------------------------------------------


def graph(name: str, sql: str):
    """Registers f(edges, labels, Bip)."""
    return lambda f: bip(name, sql)(lambda m: f(partition.edges(m.a), m.range_parts(), m))


graph("part_edgecut", "SELECT COUNT(*) AS edgecut FROM L WHERE pu <> pv")(lambda e, p, m: partition.edge_cut(e, p))
graph("part_class", "SELECT i, p, CASE WHEN i IN (SELECT i FROM S) THEN 'border' ELSE 'inner' END AS class FROM rp")(lambda e, p, m: partition.classes(e, p))
graph(
    "part_counts",

        "SELECT rp.p, COUNT(*) AS owned, COUNT(*) FILTER (i NOT IN (SELECT i FROM S)) AS inner, COUNT(*) FILTER (i IN (SELECT i FROM S)) AS border, "
        "(SELECT COUNT(*) FROM S WHERE q = rp.p) AS ghost, (SELECT COUNT(*) FROM L WHERE pu = pv AND pu = rp.p) AS inner_edges, (SELECT COUNT(*) "
        "FROM L WHERE pu <> pv AND rp.p IN (pu, pv)) AS interface_edges FROM rp GROUP BY rp.p".replace("AS inner,", 'AS "inner",'),
)(lambda e, p, m: partition.counts(e, p))
graph("part_ghosts", "SELECT q AS p, p AS owner, i FROM S")(lambda e, p, m: partition.ghosts(e, p))
graph("part_interfaces",
    "SELECT LEAST(pu, pv) AS p, GREATEST(pu, pv) AS q, COUNT(*) AS edges, COUNT(DISTINCT CASE WHEN pu < pv THEN u ELSE v END) AS nodes_p, "
    "COUNT(DISTINCT CASE WHEN pu < pv THEN v ELSE u END) AS nodes_q FROM L WHERE pu <> pv GROUP BY 1, 2")(lambda e, p, m: partition.interfaces(e, p))
_LOCAL = """
SELECT p, i, class, ROW_NUMBER() OVER (PARTITION BY p ORDER BY c, i) - 1 AS id
FROM (
  SELECT p, i, CASE WHEN i IN (SELECT i FROM S) THEN 'border' ELSE 'inner' END AS class, CASE WHEN i IN (SELECT i FROM S) THEN 1 ELSE 0 END AS c FROM rp
  UNION ALL SELECT q, i, 'ghost', 2 FROM S)
"""
graph("part_local_ids", _LOCAL)(lambda e, p, m: partition.local_ids(e, p))
graph("part_vector", f"SELECT p, id, l.i, class, h.v FROM ({_LOCAL}) l JOIN h ON h.i = l.i")(lambda e, p, m: partition.local_vector(e, p, m.h()))
graph(
    "halo_dump",
    """
SELECT p, 'send' AS way, q, ROW_NUMBER() OVER (PARTITION BY p ORDER BY q, i) - 1 AS k, i FROM S
UNION ALL SELECT q, 'receive', p, ROW_NUMBER() OVER (PARTITION BY q ORDER BY p, i) - 1, i FROM S
""",
)(lambda e, p, m: partition.dump_halo(partition.halo_send(e, p)))
graph(
    "graph_dump",
    f"""
SELECT p, 'node' AS what, id AS k, i AS value FROM ({_LOCAL})
UNION ALL SELECT p, 'neighbour', ROW_NUMBER() OVER (PARTITION BY p ORDER BY q) - 1, q FROM (SELECT DISTINCT p, q FROM S)
UNION ALL SELECT p, 'owned', 0, COUNT(*) FROM rp GROUP BY p
UNION ALL SELECT p, 'inner', 0, COUNT(*) FILTER (i NOT IN (SELECT i FROM S)) FROM rp GROUP BY p
UNION ALL SELECT p, 'border', 0, COUNT(*) FILTER (i IN (SELECT i FROM S)) FROM rp GROUP BY p
UNION ALL SELECT p, 'ghost', 0, (SELECT COUNT(*) FROM S WHERE q = rp.p) FROM rp GROUP BY p
UNION ALL SELECT p, 'inner_edges', 0, (SELECT COUNT(*) FROM L WHERE pu = pv AND pu = rp.p) FROM rp GROUP BY p
UNION ALL SELECT p, 'interface_edges', 0, (SELECT COUNT(*) FROM L WHERE pu <> pv AND rp.p IN (pu, pv)) FROM rp GROUP BY p
""",
)(lambda e, p, m: partition.dump_graph(e, p))
graph("halo_send", "SELECT p, q, i FROM S")(lambda e, p, m: partition.halo_send(e, p))
graph("halo_displs",
    "SELECT p, q, c AS count, CAST(SUM(c) OVER (PARTITION BY p ORDER BY q) - c AS BIGINT) AS start FROM (SELECT p, q, COUNT(*) AS c FROM S GROUP "
    "BY p, q)")(lambda e, p, m: partition.displacements(partition.halo_send(e, p)))
graph("comm_matrix", "SELECT p, q, COUNT(*) AS n FROM S GROUP BY p, q")(lambda e, p, m: partition.comm_matrix(partition.halo_send(e, p)))
graph("halo_exchange", "SELECT q AS p, p AS owner, S.i, h.v FROM S JOIN h ON h.i = S.i")(lambda e, p, m: partition.exchange(partition.halo_send(e, p), m.h()))
coords("col_segments", "SELECT DISTINCT j, p FROM nz JOIN rowp ON rowp.i = nz.i")(lambda nz: partition.column_segments(nz, _rowp(nz)))
_SEGS = "sg AS (SELECT DISTINCT j, p FROM nz JOIN rowp ON rowp.i = nz.i), sc AS (SELECT j, COUNT(*) AS c FROM sg GROUP BY j)"
_query("nz_groups", f"{SQL_ENTRIES}, {_SEGS}",
    "SELECT k, rowp.p, CASE WHEN c = 1 THEN 0 WHEN rowp.p = colp.p THEN 1 ELSE 2 END AS grp FROM nz JOIN rowp ON rowp.i = nz.i JOIN sc ON sc.j = "
    "nz.j JOIN colp ON colp.i = nz.j")(lambda spark, d: (lambda nz: partition.entry_groups(nz, _rowp(nz), _rowp(nz, "j")))(entries(spark, d)))
_query("shared_col_owners", f"{SQL_ENTRIES}, {_SEGS}",
    "SELECT sg.j, colp.p AS owner, sg.p AS q FROM sg JOIN sc ON sc.j = sg.j JOIN colp ON colp.i = sg.j WHERE c > 1 AND sg.p <> colp.p")(lambda spark, d: (lambda nz: partition.shared_owners(nz, _rowp(nz), _rowp(nz, "j")))(entries(spark, d)))
coords("part_col_counts",
    "SELECT p, COUNT(*) AS entries, COUNT(DISTINCT nz.i) AS nrows, COUNT(DISTINCT j) AS ncols FROM nz JOIN rowp ON rowp.i = nz.i GROUP BY p")(lambda nz: partition.part_extents(nz, _rowp(nz)))
coords("part_col_ids",
    "SELECT p, j, ROW_NUMBER() OVER (PARTITION BY p ORDER BY k) - 1 AS id FROM (SELECT p, j, MIN(k) AS k FROM nz JOIN rowp ON rowp.i = nz.i "
    "GROUP BY p, j)")(lambda nz: partition.first_appearance(nz, _rowp(nz)))
coords("graph_symmetrise", "SELECT DISTINCT LEAST(i, j) AS u, GREATEST(i, j) AS v FROM nz WHERE i <> j")(partition.symmetrise)
coords("graph_bipartite", "SELECT DISTINCT i AS u, j + 1000000 AS v FROM nz")(lambda nz: partition.bipartite(nz, 1_000_000))

# --- solvers --------------------------------------------------------------------------------------------------

_FIXED = SolveOptions(maxits=5, residual_rtol=0.0)


def _classic_sql(steps: int, last: str) -> str:
    """A chain of stored common table expressions, one block for each iteration."""
    out = ["s0 AS MATERIALIZED (SELECT i, CAST(0 AS DOUBLE) AS x, v AS r, v AS p FROM h)"]
    for k in range(1, steps + 1):
        o = k - 1
        out += [
            f"t{k} AS MATERIALIZED (SELECT F.i, SUM(a * p) AS t FROM F JOIN s{o} s ON F.j = s.i GROUP BY F.i)",
            f"al{k} AS MATERIALIZED (SELECT SUM(r * r) AS g, SUM(r * r) / SUM(p * t) AS a FROM s{o} JOIN t{k} USING (i))",
            f"u{k} AS MATERIALIZED (SELECT s.i, x + a * p AS x, r - a * t AS r, p FROM s{o} s JOIN t{k} USING (i), al{k})",
            f"b{k} AS MATERIALIZED (SELECT SUM(r * r) / (SELECT g FROM al{k}) AS b, SUM(r * r) AS rr FROM u{k})",
            f"s{k} AS MATERIALIZED (SELECT i, x, r, r + b * p AS p FROM u{k}, b{k})",
        ]
    return ",\n".join(out) + "\n" + last


def _pipelined_sql(steps: int, last: str) -> str:
    out = ["w0 AS MATERIALIZED (SELECT F.i, SUM(a * v) AS w FROM F JOIN h ON F.j = h.i GROUP BY F.i)",
        "s0 AS MATERIALIZED (SELECT h.i, CAST(0 AS DOUBLE) AS x, v AS r, w, CAST(0 AS DOUBLE) AS z, CAST(0 AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS p "
        "FROM h JOIN w0 USING (i))"]
    for k in range(1, steps + 1):
        o = k - 1
        beta = "CAST(0 AS DOUBLE)" if k == 1 else f"g / (SELECT g FROM c{o})"
        alpha = "g / d" if k == 1 else f"g / (d - g / (SELECT g FROM c{o}) * g / (SELECT al FROM c{o}))"
        out += [
            f"q{k} AS MATERIALIZED (SELECT F.i, SUM(a * w) AS q FROM F JOIN s{o} s ON F.j = s.i GROUP BY F.i)",
            f"c{k} AS MATERIALIZED (SELECT g, {alpha} AS al, {beta} AS be FROM (SELECT SUM(r * r) AS g, SUM(w * r) AS d FROM s{o}))",
            f"v{k} AS MATERIALIZED (SELECT s.i, x, r, w, q + be * z AS z, w + be * t AS t, r + be * p AS p, al FROM s{o} s JOIN q{k} USING (i), c{k})",
            f"s{k} AS MATERIALIZED (SELECT i, x + al * p AS x, r - al * t AS r, w - al * z AS w, z, t, p FROM v{k})",
        ]
    return ",\n".join(out) + "\n" + last


_query("cg_fixed", SQL_BIP + ",\n" + _classic_sql(5,
    "SELECT i, ROUND(x, 6) + 0.0 AS v FROM s5"), "")(lambda spark, d: (lambda m: cg.classic(m.a, m.h(), m.n, _FIXED).x.select("i", rounded("v")))(Bip(spark, d)))
_HISTORY = " UNION ALL ".join(f"SELECT {k - 1} AS k, ROUND(SQRT(rr), 4) + 0.0 AS rnrm2 FROM b{k}" for k in range(1, 6))
_query("cg_history", SQL_BIP + ",\n" + _classic_sql(5, _HISTORY), "")(
    lambda spark, d: (lambda m: spark.createDataFrame([(k, r) for k, r, *_ in cg.classic(m.a, m.h(), m.n, _FIXED).history], "k int, rnrm2 double").select("k", rounded("rnrm2", 4)))(Bip(spark, d))
)
_query("pcg_fixed", SQL_BIP + ",\n" + _pipelined_sql(5,
    "SELECT i, ROUND(x, 6) + 0.0 AS v FROM s5"), "")(lambda spark, d: (lambda m: cg.pipelined(m.a, m.h(), m.n, _FIXED).x.select("i", rounded("v")))(Bip(spark, d)))
_query("cg_one_task", SQL_BIP + ",\n" + _classic_sql(5,
    "SELECT i, ROUND(x, 6) + 0.0 AS v FROM s5"), "")(lambda spark, d: (lambda m: cg.one_task(m.a, m.h(), m.n, _FIXED).select("i", rounded("v")))(Bip(spark, d)))
_query("pcg_one_task", SQL_BIP + ",\n" + _pipelined_sql(5, "SELECT i, ROUND(x, 6) + 0.0 AS v FROM s5"), "")(
    lambda spark, d: (lambda m: cg.one_task(m.a, m.h(), m.n, _FIXED, True).select("i", rounded("v")))(Bip(spark, d))
)
_query("cg_converged", SQL_CHAIN + ",\n" + _classic_sql(30, "SELECT i, ROUND(x, 5) + 0.0 AS v FROM s30"), "")(
    lambda spark, d: (lambda a, n: cg.classic(a, h(spark.range(n).select(F.col("id").alias("i"))), n, SolveOptions(maxits=60, residual_rtol=1e-10)).x.select("i", rounded("v", 5)))(*chain(spark, d))
)


def _manufactured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the solution of A x = A x* has an error under 1e-6."""
    a, n = chain(spark, sf_dir)
    exact = h(spark.range(n).select(F.col("id").alias("i")))
    res = cg.classic(a, cg.manufactured(a, exact, n), n, SolveOptions(maxits=60, residual_rtol=1e-10))
    return spark.createDataFrame([(n, cg.error_norm(res.x, exact) < 1e-6)], "n long, solved boolean")


_query("manufactured_error", SQL_CHAIN, "SELECT COUNT(*) AS n, TRUE AS solved FROM nodes")(_manufactured)


def _op_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Bip(spark, sf_dir)
    return spark.createDataFrame(cg.classic(m.a, m.h(), m.n, _FIXED).report.rows(), "op string, calls long, flops long, bytes long")


_query(
    "op_stats",
    SQL_BIP + ", z AS (SELECT (SELECT COUNT(*) FROM F) AS z, n FROM nn)",

        "SELECT op, CAST(calls AS BIGINT) AS calls, CAST(flops AS BIGINT) AS flops, CAST(bytes AS BIGINT) AS bytes FROM (SELECT 'gemv' AS op, 5 AS "
        "calls, 10 * (z + n) AS flops, 5 * (12 * z + 24 * n) AS bytes FROM z UNION ALL SELECT 'dot', 5, 10 * n, 80 * n FROM z UNION ALL SELECT "
        "'nrm2sqr', 5, 10 * n, 40 * n FROM z UNION ALL SELECT 'axpy', 10, 20 * n, 160 * n FROM z UNION ALL SELECT 'aypx', 5, 10 * n, 80 * n FROM z "
        "UNION ALL SELECT 'scal', 5, 0, 40 * n FROM z)",
)(_op_stats)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix after it was written to a file and read again."""
    import uuid

    from ..functions.scratch import scratch_base
    from ..model import Header
    from ..sources import matrix_market as mm

    m = Bip(spark, sf_dir)
    path = f"{scratch_base(spark)}/sparsecg-{uuid.uuid4().hex}.mtx"
    mm.write(m.a, path, Header("matrix", "coordinate", "real", "symmetric", m.n, m.n, m.a.count()))
    _, back = mm.read(spark, path)
    return back.select(F.col("j").alias("i"), F.col("i").alias("j"), "a")


_query("mtx_roundtrip", SQL_BIP, "SELECT i, j, a FROM A")(_round_trip)
