"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast, of at most 100 bytes each. Counted before; beyond it Spark sorts and merges, same rows.
BROADCAST_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where all run on one machine (master ``local[...]``) a session without one gets a temporary folder; elsewhere
    each executor would write to its own disk, so that is an error.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if told is None:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            told = made.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            told = "file://" + tempfile.mkdtemp(prefix="docreef-")
            spark.sparkContext.setCheckpointDir(told)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return told.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs only its own tasks.

    few: for light rows after a shuffle. Tasks and files are filled up to Spark's advisory size, rather than one a core at
    least, so a small table is one file.
    """
    path, spark, key = new_folder(df.sparkSession, name), df.sparkSession, "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key)
    spark.conf.set(key, "false" if few else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def sized_join(left: DataFrame, right: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A join that broadcasts the right side if it has at most ``rows`` rows, counted; else Spark sorts and merges."""
    small = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)
