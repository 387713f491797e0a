"""Keeping a plan current: new files as a stream, modified ones by comparing snapshots."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docreef.sources import files as sources

_FILES = "path string, modificationTime timestamp, length bigint, content binary"

#: Trigger of the periodic synchronisation.
EVERY = "30 minutes"


def _mounted(path: str) -> bool:
    try:
        return os.path.isdir(sources.plain_path(path))
    except ValueError:
        return False


def created(spark: SparkSession, path: str, per_batch: int = 50) -> DataFrame:
    """A stream of (event_type, src_path, length): every file once, when it is first seen. It is not told of changes.

    A batch looks at a whole mounted folder, in tasks, and the stream's state (a path a file, dealt by its hash) tells
    what is new, so no list of files passes the driver. As with any state, a batch must be looked at whole. Other
    schemes and patterns are left to Spark's own reader, which lists in the driver, ``per_batch`` files a batch.
    """
    if _mounted(path):
        sources.register(spark)
        files = spark.readStream.format("docreef_watch").load(path).dropDuplicates(["path"]).where("length > 0")
    else:
        files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(F.lit("created").alias("event_type"), F.col("path").alias("src_path"), "length")


def changes(before: DataFrame, after: DataFrame, key: str = "path", mark: str = "hash") -> DataFrame:
    """(event_type, src_path): created and modified entries between two snapshots. Deletions are no events."""
    old = before.select(F.col(key), F.col(mark).alias("_old"), F.lit(True).alias("_known"))
    both = after.select(key, mark).join(old, key, "left")
    kind = F.when(F.col("_known").isNull(), "created").when(~F.col(mark).eqNullSafe(F.col("_old")), "modified")
    return both.select(kind.alias("event_type"), F.col(key).alias("src_path")).where("event_type is not null")


def reconcile(stream: DataFrame, plan: Callable[[], DataFrame], act: Callable[[DataFrame, int], object], checkpoint: str, every: str | None = EVERY) -> StreamingQuery:
    """Makes and carries out a whole plan whenever a batch has events. Batches run one at a time, so plans never race.

    every: time between batches; None: what there is now, then stop.
    """

    def batch(events: DataFrame, number: int) -> None:
        if events.count():  # all of it: a stream's state is kept only of what is looked at
            act(plan(), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def documents_seen(spark: SparkSession, path: str, schema, out: str, window: str = "10 minutes") -> DataFrame:
    """A table of documents (Parquet) read as a stream into (name, size), up to what there is now; then as a table."""
    docs = spark.readStream.schema(schema).parquet(path)
    rows = docs.select(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("name"), F.octet_length("text").cast("long").alias("size"))
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/_state").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n) per window of event time; works on tables and streams alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
