"""Inventories: one row a name, numbering, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docreef.functions.scalars import extension
from docreef.shared import written


def deduplicated(rows: DataFrame, keys: list[str], last: str) -> DataFrame:
    """One row a key, that with the greatest ``last`` (null least). Aggregates before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(last).isNotNull(), F.col(last))).alias("row"))
    return best.select(*keys, "row.*").select(*rows.columns)


def allowed(rows: DataFrame, extensions: tuple[str, ...], most_bytes: int) -> DataFrame:
    """Rows (name, size) whose extension, in any case, is on the list and whose size is within the limit."""
    return rows.where(extension(F.col("name")).isin(*extensions) & (F.col("size") <= most_bytes))


def folder_counts(folders: DataFrame, files: DataFrame) -> DataFrame:
    """(folder, n_files, present) of expected folders (folder) and files (folder)."""
    n = files.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"))
    return folders.join(n, "folder", "left").select("folder", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), F.col("n_files").isNotNull().alias("present"))


def missing(expected: DataFrame, actual: DataFrame, key: str = "name") -> DataFrame:
    return expected.join(actual, key, "left_anti").select(expected.columns)


def found(expected: DataFrame, actual: DataFrame, key: str = "name") -> DataFrame:
    return expected.join(actual, key, "left_semi").select(expected.columns)


def numbered(rows: DataFrame, key: str, out: str = "number") -> DataFrame:
    """rows with their place (from 1) in ascending order of a key, nulls first; equal keys in any order.

    One shuffle, by ranges of the key; the sorted partitions are written with each row's place in its own. The running
    total that the places start from is over a row a partition. No window runs over all rows. No name of rows is in
    the way.
    """
    packed = rows.select(F.col(key).alias("key"), F.struct("*").alias("row"))
    ranged = packed.repartitionByRange("key").sortWithinPartitions("key")
    placed = ranged.select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("place"))
    placed = written(placed, "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select("row.*", (F.col("start") + F.col("place") + 1).alias(out))  # a row a partition


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, batch): batches of ``size`` rows in order of the key."""
    return numbered(rows.select(key), key).select(key, F.ceil(F.col("number") / size).cast("long").alias("batch"))
