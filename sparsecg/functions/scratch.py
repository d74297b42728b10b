"""Tables in the shared folder that end a lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_base(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    Where it is unset, local mode uses a folder of its own, as driver and tasks are one process; on a cluster that
    would lose what tasks write, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="sparsecg-"))
    return _own[0]


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and any executor can read it again.

    The table goes when the driver's process ends, or earlier by drop().
    """
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/sparsecg-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparsecg_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """As written(), dealt by key into so many buckets: joins and sums on key of tables of as many need no exchange.

    dealt: the rows of each bucket already meet in one task.
    """
    spark = df.sparkSession
    table = f"sparsecg_{name}_{uuid.uuid4().hex}"
    path = f"{scratch_base(spark)}/{table}"
    rows = df if dealt else df.repartition(buckets, key)
    rows.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(table, format="parquet")
    atexit.register(remove, spark, path)
    out = spark.table(table)
    out._sparsecg_path, out._sparsecg_table = path, table
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables of written() and bucketed() that no later plan reads."""
    for t in tables:
        if hasattr(t, "_sparsecg_table"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._sparsecg_table}")
        remove(t.sparkSession, t._sparsecg_path)
