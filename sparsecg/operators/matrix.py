"""Symmetric matrices stored as one triangle (i, j, a): expansion and products with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Code, EngineError

#: A vector of up to so many entries of 16 bytes is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def check(a: DataFrame, n: int) -> None:
    outside = (F.col("i") < 0) | (F.col("i") >= n) | (F.col("j") < 0) | (F.col("j") >= n)
    if a.where(outside).limit(1).count():
        raise EngineError(Code.INDEX_OUT_OF_BOUNDS)


def from_rows(rows: DataFrame) -> DataFrame:
    """i, j, a from rows (i, cols, vals) that hold a row's columns and values as arrays."""
    return rows.select("i", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("i", F.col("e.cols").alias("j"), F.col("e.vals").alias("a"))


def expand(a: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Both triangles; epsilon is added to each stored diagonal entry."""
    own = a.select("i", "j", (F.col("a") + F.when(F.col("i") == F.col("j"), F.lit(float(epsilon))).otherwise(F.lit(0.0))).alias("a") if epsilon else F.col("a"))
    return own.unionByName(a.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "a"))


def product(f: DataFrame, x: DataFrame, n: int) -> DataFrame:
    """i, s: rows of the full matrix f times x(i, v); rows without entries are absent.

    x is broadcast when n is small; else both are joined on the column, and only partial sums of rows are shuffled.
    """
    v = x.select(F.col("i").alias("j"), "v")
    v = F.broadcast(v) if n <= BROADCAST_ROWS else v.hint("shuffle_hash")
    return f.join(v, "j").groupBy("i").agg(F.sum(F.col("a") * F.col("v")).alias("s"))


def dsymv(alpha: float, f: DataFrame, x: DataFrame, beta: float, y: DataFrame, n: int) -> DataFrame:
    """alpha F x + beta y; an entry whose row y lacks or whose column x lacks is an error when the result is read."""
    v = x.select(F.col("i").alias("j"), "v")
    v = F.broadcast(v) if n <= BROADCAST_ROWS else v
    met = F.coalesce("v", F.raise_error(F.lit(Code.VECTOR_INCOMPATIBLE_SIZE.value)).cast("double"))
    s = f.join(v, "j", "left").groupBy("i").agg(F.sum(F.col("a") * met).alias("s"))
    old = F.lit(0.0) if beta == 0 else F.lit(float(beta)) * F.col("v")
    held = y.select("i", "v", F.lit(True).alias("held")).join(s, "i", "full")
    value = F.when(F.col("held"), old + F.lit(float(alpha)) * F.coalesce("s", F.lit(0.0)))
    return held.select("i", value.otherwise(F.raise_error(F.lit(Code.VECTOR_INCOMPATIBLE_SIZE.value)).cast("double")).alias("v"))


def product_salted(f: DataFrame, x: DataFrame, salts: int) -> DataFrame:
    """As product(), with rows dealt over salts before they are added up, for rows of very many entries."""
    v = x.select(F.col("i").alias("j"), "v")
    salted = f.join(v, "j").withColumn("salt", F.pmod(F.xxhash64("j"), F.lit(salts)))
    part = salted.groupBy("i", "salt").agg(F.sum(F.col("a") * F.col("v")).alias("s"))
    return part.groupBy("i").agg(F.sum("s").alias("s"))


def product_by_part(f: DataFrame, x: DataFrame, parts: DataFrame) -> DataFrame:
    """p, i, s: the product with each row under its part."""
    v = x.select(F.col("i").alias("j"), "v")
    return f.join(v, "j").groupBy("i").agg(F.sum(F.col("a") * F.col("v")).alias("s")).join(parts, "i").select("p", "i", "s")


def split(a: DataFrame, parts: DataFrame) -> DataFrame:
    """p, i, j, a: the matrix under the part of its rows."""
    return a.join(parts, "i").select("p", "i", "j", "a")
