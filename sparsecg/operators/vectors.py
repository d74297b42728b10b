"""Full vectors (i, v) and packed vectors (pos, i, v): construction, level-1 operations and their sparse forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Code, EngineError


def full(spark: SparkSession, n: int, value: Column) -> DataFrame:
    """i, v over 0..n-1; value may use i."""
    return spark.range(n).select(F.col("id").alias("i")).select("i", value.cast("double").alias("v"))


def check_full(x: DataFrame, n: int) -> None:
    found = x.agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
    if n and tuple(found) != (n, n, 0, n - 1) or not n and found[0]:
        raise EngineError(Code.VECTOR_EXPECTED_FULL)


def check_packed(x: DataFrame, n: int) -> None:
    if "pos" not in x.columns:
        raise EngineError(Code.VECTOR_EXPECTED_PACKED)
    if x.where((F.col("i") < 0) | (F.col("i") >= n)).limit(1).count():
        raise EngineError(Code.INDEX_OUT_OF_BOUNDS)


def same_size(x: DataFrame, y: DataFrame) -> None:
    if x.count() != y.count():
        raise EngineError(Code.VECTOR_INCOMPATIBLE_SIZE)


def _error(code: Code) -> Column:
    """A double that fails the task which computes it."""
    return F.raise_error(F.lit(code.value)).cast("double")


def _meet(x: DataFrame, y: DataFrame, how: str, code: Code) -> DataFrame:
    """i, x, y; a place that one side lacks and `how` keeps is an error when its value is read, at no further job."""
    a = x.select("i", F.col("v").alias("x"), F.lit(True).alias("hx"))
    both = a.join(y.select("i", F.col("v").alias("y"), F.lit(True).alias("hy")), "i", how)
    return both.select("i", F.when(F.col("hx"), F.col("x")).otherwise(_error(code)).alias("x"), F.when(F.col("hy"), F.col("y")).otherwise(_error(code)).alias("y"))


def together(x: DataFrame, y: DataFrame) -> DataFrame:
    """i, x, y of two full vectors of one size; vectors of other places are an error when the result is read."""
    return _meet(x, y, "full", Code.VECTOR_INCOMPATIBLE_SIZE)


def assign(x: DataFrame, values: DataFrame) -> DataFrame:
    """x with the values of values(i, v) at their places; both must hold the same places."""
    same_size(x, values)
    return x.select("i").join(values, "i").select("i", "v")


def swap(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    same_size(x, y)
    return y.select("i", "v"), x.select("i", "v")


def scal(a: float, x: DataFrame) -> DataFrame:
    """a x; 1 leaves x and 0 stores zeros whatever x holds."""
    if a == 1:
        return x.select("i", "v")
    return x.select("i", (F.lit(0.0) if a == 0 else F.lit(float(a)) * F.col("v")).alias("v"))


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """a x + y"""
    return together(x, y).select("i", (F.lit(float(a)) * F.col("x") + F.col("y")).alias("v"))


def aypx(a: float, y: DataFrame, x: DataFrame) -> DataFrame:
    """a y + x"""
    return together(x, y).select("i", (F.lit(float(a)) * F.col("y") + F.col("x")).alias("v"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return together(x, y).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("value"))


def nrm2sqr(x: DataFrame) -> DataFrame:
    return x.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("value"))


def nrm2(x: DataFrame) -> DataFrame:
    return nrm2sqr(x).select(F.sqrt("value").alias("value"))


def asum(x: DataFrame) -> DataFrame:
    return x.agg(F.coalesce(F.sum(F.abs("v")), F.lit(0.0)).alias("value"))


def iamax(x: DataFrame) -> DataFrame:
    """The first place of the largest absolute value; 0 if there is none."""
    return x.agg(F.coalesce(F.min_by("i", F.struct((-F.abs("v")).alias("m"), "i")), F.lit(0).cast("long")).alias("i"))


def nrm2sqr_by_part(x: DataFrame, parts: DataFrame) -> DataFrame:
    """p, value: what each part adds to the square of the 2-norm."""
    return x.join(parts, "i").groupBy("p").agg(F.sum(F.col("v") * F.col("v")).alias("value"))


def asum_by_part(x: DataFrame, parts: DataFrame) -> DataFrame:
    """p, value: what each part adds to the sum of absolute values."""
    return x.join(parts, "i").groupBy("p").agg(F.sum(F.abs("v")).alias("value"))


def dot_by_part(x: DataFrame, y: DataFrame, parts: DataFrame) -> DataFrame:
    """p, value: what each part adds to the dot product."""
    return together(x, y).join(parts, "i").groupBy("p").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def _need_packed(x: DataFrame) -> None:
    if "pos" not in x.columns:
        raise EngineError(Code.VECTOR_EXPECTED_PACKED)


def _need_full(y: DataFrame) -> None:
    if "pos" in y.columns:
        raise EngineError(Code.VECTOR_EXPECTED_FULL)


def _at(x: DataFrame, y: DataFrame) -> DataFrame:
    """The rows of a packed x with y's value at their places as y; a place outside y is an error when that is read."""
    _need_packed(x)
    _need_full(y)
    there = y.select("i", F.col("v").alias("y"), F.lit(True).alias("hy"))
    value = F.when(F.col("hy"), F.col("y")).otherwise(_error(Code.INDEX_OUT_OF_BOUNDS))
    return x.join(there, "i", "left").select(*x.columns, value.alias("y"))


def _onto(y: DataFrame, added: DataFrame, value: Column) -> DataFrame:
    """i, v: y with value, made of v and of s of added(i, s), which is null where there is none; a place outside y is an error."""
    held = y.select("i", "v", F.lit(True).alias("hy")).join(added, "i", "full")
    return held.select("i", F.when(F.col("hy"), value).otherwise(_error(Code.INDEX_OUT_OF_BOUNDS)).alias("v"))


def sparse_dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """Sum of x[k] y[idx[k]] over a packed x and a full y; the dot product if x is full too."""
    if "pos" not in x.columns:
        return dot(x, y)
    return _at(x, y).agg(F.coalesce(F.sum(F.col("v") * F.col("y")), F.lit(0.0)).alias("value"))


def sparse_axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """y with a x[k] added at idx[k]; repeated places add up. axpy if x is full."""
    if "pos" not in x.columns:
        return axpy(a, x, y)
    _need_full(y)
    return _onto(y, x.groupBy("i").agg(F.sum("v").alias("s")), F.col("v") + F.lit(float(a)) * F.coalesce("s", F.lit(0.0)))


def gather(x: DataFrame, y: DataFrame) -> DataFrame:
    """pos, i, v: y at the places of x."""
    return _at(x, y).select("pos", "i", F.col("y").alias("v"))


def gather_zero(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gather() that leaves zeros behind in y: a repeated place gets y's value first and zeros after."""
    first = F.row_number().over(Window.partitionBy("i").orderBy("pos")) == 1
    taken = gather(x, y).withColumn("v", F.when(first, F.col("v")).otherwise(F.lit(0.0)))
    hit = x.select("i").distinct().withColumn("s", F.lit(True))
    return taken, _onto(y, hit, F.when(F.col("s"), F.lit(0.0)).otherwise(F.col("v")))


def scatter(y: DataFrame, x: DataFrame) -> DataFrame:
    """y with x's values at x's places; the last of a repeated place stays."""
    _need_packed(x)
    _need_full(y)
    last = x.groupBy("i").agg(F.struct(F.max_by("v", "pos").alias("v")).alias("s"))
    return _onto(y, last, F.when(F.col("s").isNotNull(), F.col("s.v")).otherwise(F.col("v")))
