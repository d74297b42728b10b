"""Matrices and vectors made from the relational tables, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Bip:
    """Parts and suppliers as nodes, line items as edges: an integer-valued diagonally dominant matrix."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.nparts, suppliers = table(spark, sf_dir, "part").count(), table(spark, sf_dir, "supplier").count()
        self.n = self.nparts + suppliers
        items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i"), (F.col("l_suppkey") + self.nparts).alias("j"))
        off = items.groupBy("i", "j").agg((-F.count("*")).cast("double").alias("a"))
        degree = items.select(F.explode(F.array("i", "j")).alias("i")).groupBy("i").agg(F.count("*").alias("d"))
        nodes = spark.range(self.n).select(F.col("id").alias("i"))
        diagonal = nodes.join(degree, "i", "left").select("i", F.col("i").alias("j"), (F.coalesce("d", F.lit(0)) + 1).cast("double").alias("a"))
        self.nodes, self.a = nodes, off.unionByName(diagonal)

    def h(self) -> DataFrame:
        return h(self.nodes)

    def ones(self) -> DataFrame:
        return self.nodes.select("i", F.lit(1.0).alias("v"))

    def price(self) -> DataFrame:
        part = table(self.spark, self.sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))
        return part.unionByName(table(self.spark, self.sf_dir, "supplier").select((F.col("s_suppkey") + self.nparts).alias("i"), F.col("s_acctbal").alias("v")))

    def hash_parts(self) -> DataFrame:
        return self.nodes.select("i", (F.col("i") % PARTS).cast("int").alias("p"))

    def range_parts(self) -> DataFrame:
        return self.nodes.select("i", F.floor(F.col("i") * PARTS / F.lit(self.n)).cast("int").alias("p"))

    def packed(self) -> DataFrame:
        """pos, i, v: every third place, and place 0 once more at the end."""
        third = self.nodes.where("i % 3 = 0").select((F.col("i") / 3).cast("long").alias("pos"), "i", (F.col("i") % 7 + 1).cast("double").alias("v"))
        again = self.spark.range(1).select(F.lit((self.n + 2) // 3).cast("long").alias("pos"), F.lit(0).cast("long").alias("i"), F.lit(5.0).alias("v"))
        return third.unionByName(again)


def h(nodes: DataFrame) -> DataFrame:
    return nodes.select("i", (F.col("i") * 7919 % 1000 / 1000.0).cast("double").alias("v"))


def star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Nations and their customers: hub rows."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("i"), (F.col("c_custkey") + 25).alias("j"))
    n = c.count() + 25
    degree = c.select(F.explode(F.array("i", "j")).alias("i")).groupBy("i").agg(F.count("*").alias("d"))
    nodes = spark.range(n).select(F.col("id").alias("i"))
    diagonal = nodes.join(degree, "i", "left").select("i", F.col("i").alias("j"), (F.coalesce("d", F.lit(0)) + 1).cast("double").alias("a"))
    return c.select("i", "j", F.lit(-1.0).alias("a")).unionByName(diagonal), n


def chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Neighbouring orders: tridiagonal."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"))
    n = o.count()
    return o.select("i", F.col("i").alias("j"), F.lit(3.0).alias("a")).unionByName(o.where(F.col("i") < n - 1).select("i", (F.col("i") + 1).alias("j"), F.lit(-1.0).alias("a"))), n


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, i, j, a: each line item as an entry, with repeated places."""
    from ..functions.scan import row_rank

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("a"))
    return row_rank(rows, ["l_orderkey", "l_linenumber", "i", "j", "a"], "k").select("k", "i", "j", "a")


#: Common table expressions.
SQL_BIP = """
np AS (SELECT COUNT(*) AS np FROM part), ns AS (SELECT COUNT(*) AS ns FROM supplier), nn AS (SELECT np + ns AS n FROM np, ns),
it AS (SELECT l_partkey AS i, l_suppkey + np AS j FROM lineitem, np),
nodes AS (SELECT CAST(x AS BIGINT) AS i FROM nn, range(n) t(x)),
dg AS (SELECT i, COUNT(*) AS d FROM (SELECT i FROM it UNION ALL SELECT j FROM it) GROUP BY i),
A AS (SELECT i, j, CAST(-COUNT(*) AS DOUBLE) AS a FROM it GROUP BY i, j UNION ALL SELECT n.i, n.i, CAST(COALESCE(d, 0) + 1 AS DOUBLE) FROM nodes n LEFT JOIN dg USING (i)),
F AS (SELECT i, j, a FROM A UNION ALL SELECT j, i, a FROM A WHERE i <> j),
h AS (SELECT i, CAST((i * 7919 % 1000) / 1000.0 AS DOUBLE) AS v FROM nodes),
ones AS (SELECT i, CAST(1 AS DOUBLE) AS v FROM nodes),
price AS (SELECT p_partkey AS i, p_retailprice AS v FROM part UNION ALL SELECT s_suppkey + np, s_acctbal FROM supplier, np),
hp AS (SELECT i, CAST(i % 4 AS INTEGER) AS p FROM nodes),
rp AS (SELECT i, CAST(floor(i * 4 / n) AS INTEGER) AS p FROM nodes, nn),
px AS (SELECT CAST(i / 3 AS BIGINT) AS pos, i, CAST(i % 7 + 1 AS DOUBLE) AS v FROM nodes WHERE i % 3 = 0 UNION ALL SELECT CAST((n + 2) // 3 AS BIGINT), 0, 5.0 FROM nn),
E AS (SELECT DISTINCT LEAST(i, j) AS u, GREATEST(i, j) AS v FROM A WHERE i <> j),
L AS (SELECT u, v, x.p AS pu, y.p AS pv FROM E JOIN rp x ON x.i = u JOIN rp y ON y.i = v),
S AS (SELECT pu AS p, pv AS q, u AS i FROM L WHERE pu <> pv UNION SELECT pv, pu, v FROM L WHERE pu <> pv)
"""
SQL_ENTRIES = """
nz AS (SELECT ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS k, l_partkey AS i, l_suppkey AS j, l_quantity AS a FROM lineitem),
rowp AS (SELECT DISTINCT i, CAST(i % 4 AS INTEGER) AS p FROM nz), colp AS (SELECT DISTINCT j AS i, CAST(j % 4 AS INTEGER) AS p FROM nz)
"""
SQL_STAR = """
it AS (SELECT CAST(c_nationkey AS BIGINT) AS i, c_custkey + 25 AS j FROM customer),
nodes AS (SELECT CAST(x AS BIGINT) AS i FROM (SELECT COUNT(*) + 25 AS n FROM customer), range(n) t(x)),
dg AS (SELECT i, COUNT(*) AS d FROM (SELECT i FROM it UNION ALL SELECT j FROM it) GROUP BY i),
A AS (SELECT i, j, CAST(-1 AS DOUBLE) AS a FROM it UNION ALL SELECT n.i, n.i, CAST(COALESCE(d, 0) + 1 AS DOUBLE) FROM nodes n LEFT JOIN dg USING (i)),
F AS (SELECT i, j, a FROM A UNION ALL SELECT j, i, a FROM A WHERE i <> j),
h AS (SELECT i, CAST((i * 7919 % 1000) / 1000.0 AS DOUBLE) AS v FROM nodes)
"""
SQL_CHAIN = """
nodes AS (SELECT o_orderkey AS i FROM orders),
A AS (SELECT i, i AS j, CAST(3 AS DOUBLE) AS a FROM nodes UNION ALL SELECT i, i + 1, CAST(-1 AS DOUBLE) FROM nodes WHERE i < (SELECT MAX(i) FROM nodes)),
F AS (SELECT i, j, a FROM A UNION ALL SELECT j, i, a FROM A WHERE i <> j),
h AS (SELECT i, CAST((i * 7919 % 1000) / 1000.0 AS DOUBLE) AS v FROM nodes)
"""
