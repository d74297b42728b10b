"""What the operators of this subpackage share: shared scratch tables, Arrow maps and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import drop as drop
from ..functions.scratch import written as written

#: Bytes of an Arrow batch that a Python worker gets at once; a batch holds one row at least.
BATCH_BYTES = 16 << 20
_BATCH_OPTION = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Texts are handled in slices of about so many bytes inside a batch.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded in bytes, as one text can be very long.

    The bound is an option of the session, read when the plan runs; one that the session already sets stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_OPTION, None) in (None, "-1"):
        conf.set(_BATCH_OPTION, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def column(df: DataFrame, name: str) -> Column:
    """A column by its name, whatever signs the name holds."""
    return df[f"`{name.replace('`', '``')}`"]


def slices(texts: list, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about size characters, of one text at least."""
    lo = seen = 0
    for i, t in enumerate(texts):
        seen += len(t) if t else 0
        if seen >= size:
            yield lo, i + 1
            lo, seen = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): node, root (the smallest node of its component), for nodes with an edge.

    Alternates large-star and small-star steps, each two joins on a node and a minimum that is combined before
    the shuffle, so that a node with very many edges is a skewed join key (which the adaptive planner splits) and
    never a collected group. Every step is written to the shared folder, where the lineage ends.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node also keeps the link to its own minimum
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        big = written(large, "large")
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(small, "small")
        drop(big, e)
        e = new
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
