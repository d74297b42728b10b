"""Coordinate matrices as rows (k, i, j, a): sorting, merging, renumbering, permuting and splitting by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import dense_rank, prefix_sum, row_rank
from ..model import Code, EngineError


def sort_rowwise(nz: DataFrame) -> DataFrame:
    """k, pos: the place of each entry when entries are stably sorted by row."""
    return row_rank(nz.select("k", "i"), ["i", "k"], "pos").select("k", "pos")


def sort_rowmajor(nz: DataFrame) -> DataFrame:
    """k, pos: the place of each entry when entries are stably sorted by row and column."""
    return row_rank(nz.select("k", "i", "j"), ["i", "j", "k"], "pos").select("k", "pos")


def row_pointers(nz: DataFrame, rows: DataFrame) -> DataFrame:
    """i, start, count of the entries of each of rows(i) in row-sorted order."""
    counts = rows.select("i").join(nz.groupBy("i").count(), "i", "left").select("i", F.coalesce("count", F.lit(0)).alias("count"))
    return prefix_sum(counts, ["i"], F.col("count"), "start", exclusive=True).select("i", "start", "count")


def merge(nz: DataFrame) -> DataFrame:
    """i, j, a: one entry for each place, holding the sum of those there."""
    return nz.groupBy("i", "j").agg(F.sum("a").alias("a"))


def merge_map(nz: DataFrame) -> DataFrame:
    """k, pos: the merged entry, counted in row-major order, that each entry went to."""
    return dense_rank(nz.select("k", "i", "j"), ["i", "j"], "pos").select("k", "pos")


def merge_adjacent(nz: DataFrame) -> DataFrame:
    """pos, i, j, a: runs of equal places in the order of k, each summed.

    The entry before comes from a join on k, and runs from a distributed sum over the changes.
    """
    before = nz.select((F.col("k") + 1).alias("k"), F.col("i").alias("pi"), F.col("j").alias("pj"))
    changed = F.when((F.col("i") == F.col("pi")) & (F.col("j") == F.col("pj")), 0).otherwise(1)
    runs = prefix_sum(nz.join(before, "k", "left"), ["k"], changed, "run")
    return runs.groupBy((F.col("run") - 1).alias("pos"), "i", "j").agg(F.sum("a").alias("a"))


def renumber(nz: DataFrame, column: str) -> DataFrame:
    """old, new: the non-empty rows (or columns) of nz and their numbers when empty ones are left out."""
    return row_rank(nz.select(F.col(column).cast("long").alias("old")).distinct(), ["old"], "new")


def permute(nz: DataFrame, perm: DataFrame) -> DataFrame:
    """pos, i, j, a: each entry k moved to the place that perm(k, pos) gives; perm must be a permutation."""
    n = nz.count()
    seen = perm.agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()
    if n and tuple(seen) != (n, n, 0, n - 1):
        raise EngineError(Code.INVALID_VALUE, "not a permutation")
    return nz.join(perm, "k").select("pos", "i", "j", "a")


def label(nz: DataFrame, parts: DataFrame, column: str, nparts: int) -> DataFrame:
    """nz with p, the part that parts(i, p) gives its row (column="i") or column (column="j")."""
    bad = parts.where(F.col("p").isNull() | (F.col("p") < 0) | (F.col("p") >= nparts)).limit(1).count()
    if bad:
        raise EngineError(Code.INVALID_VALUE, "a part is out of range")
    return nz.join(parts.select(F.col("i").alias(column), "p"), column)


def part_offsets(labelled: DataFrame, nparts: int) -> DataFrame:
    """p, start, count: where each part's entries begin when entries are grouped by part."""
    parts = labelled.sparkSession.range(nparts).select(F.col("id").cast("int").alias("p"))
    counts = parts.join(labelled.groupBy("p").count(), "p", "left").select("p", F.coalesce("count", F.lit(0)).alias("count"))
    before = F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")  # a row for each part
    return counts.select("p", before.alias("start"), "count")


def part_order(labelled: DataFrame) -> DataFrame:
    """k, pos: places that group entries by part and keep their order inside each."""
    return row_rank(labelled.select("k", "p"), ["p", "k"], "pos").select("k", "pos")


def sort_keys(keys: DataFrame, by: list[str]) -> DataFrame:
    """k, pos: the permutation that stably sorts keys(k, ...) by the given columns; pos is its inverse's argument."""
    return row_rank(keys.select("k", *by), [*by, "k"], "pos").select("k", "pos")
