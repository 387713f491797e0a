"""Entry points: one synchronisation, a watch on new files, the periodic one, and the state.

    python -m docreef.sync --mode once|watch|continuous|status --config config.json

The configuration is JSON: local_root, remote_root (mounted folders), containers (name: folder id), and optionally
history (a folder for the table of runs).
"""

from __future__ import annotations

import argparse
import json
import os
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from docreef.operators import diff
from docreef.operators.executor import FolderBackend, execute
from docreef.operators.inventory import folder_counts
from docreef.shared import new_folder
from docreef.sources import files
from docreef.streaming import watch as streams

HISTORY = "started timestamp, mode string, n_actions long, n_failed long, ok boolean"
MONITOR_EVERY, HEALTH_SECONDS = "30 seconds", 300


def load(path: str) -> dict | None:
    """A configuration, or None if it cannot be read."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return None
    return got if isinstance(got, dict) else None


class Sync:
    """Synchronises the containers of a configuration."""

    def __init__(self, spark: SparkSession, config: dict | None):
        self.spark, self.config = spark, config
        files.register(spark)

    def _ready(self) -> list[str]:
        """Containers that have a folder id; a null or empty one is none."""
        return [c for c, folder in self.config.get("containers", {}).items() if folder]

    def _local(self) -> DataFrame:
        frames = [self.spark.createDataFrame([], files._SCHEMA)]
        for c in self._ready():
            root = os.path.join(self.config["local_root"], c)
            os.makedirs(root, exist_ok=True)
            frames.append(self.spark.read.format("docreef_folder").option("container", c).load(root))
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df)
        return out

    def _remote(self) -> DataFrame:
        for c in self._ready():
            os.makedirs(os.path.join(self.config["remote_root"], c), exist_ok=True)
        return self.spark.read.format("docreef_listing").load(self.config["remote_root"]).where(F.col("container").isin(self._ready()))

    def connected(self) -> bool:
        """Whether the remote side can be listed; one entry is asked for."""
        try:
            self.spark.read.format("docreef_listing").option("pagesize", "1").load(self.config["remote_root"]).limit(1).count()
        except Exception:
            return False
        return True

    def plan(self) -> DataFrame:
        return diff.plan(self._local(), self._remote(), datetime.now(UTC).strftime("%Y-%m-%d"))

    def act(self, plan: DataFrame, mode: str = "once") -> bool:
        """Carries a plan out, once, and adds the run to the history."""
        started = datetime.now(UTC).replace(tzinfo=None)
        report = execute(plan, FolderBackend(self.config["remote_root"], self.config["local_root"]))
        n, failed = report.agg(F.count(F.lit(1)), F.coalesce(F.sum((~F.col("ok")).cast("long")), F.lit(0))).first()
        ok = failed == 0 and len(self._ready()) == len(self.config.get("containers", {}))
        if self.config.get("history"):
            self.spark.createDataFrame([(started, mode, n, failed, ok)], HISTORY).write.mode("append").parquet(self.config["history"])
        return ok

    def once(self, mode: str = "once") -> bool:
        """One synchronisation of all containers. False without a configuration, and if a container has no folder or
        an action failed; the others are carried out all the same."""
        if self.config is None:
            return False
        return self.act(self.plan(), mode)

    def watch(self, checkpoint: str | None = None, every: str | None = streams.EVERY) -> StreamingQuery:
        """Synchronises whenever there are new local files, one batch at a time."""
        stream = streams.created(self.spark, self.config["local_root"])
        return streams.reconcile(stream, self.plan, lambda plan, _: self.act(plan, "watch"), checkpoint or new_folder(self.spark, "watch"), every)

    def continuous(self, every: str = streams.EVERY, checkpoint: str | None = None) -> StreamingQuery:
        """An initial synchronisation, then one at every tick, whether files are new, modified or gone missing."""
        self.once("continuous")
        return ticking(self.spark, lambda: self.once("continuous"), checkpoint or new_folder(self.spark, "continuous"), every)

    def status(self) -> DataFrame:
        """(folder, n_files, present) of the local containers."""
        names = self.spark.createDataFrame([(c,) for c in self.config.get("containers", {})], "folder string")
        return folder_counts(names, self._local().select(F.col("container").alias("folder")))

    def history(self) -> DataFrame:
        return self.spark.read.schema(HISTORY).parquet(self.config["history"])


def ticking(spark: SparkSession, act: Callable[[], object], checkpoint: str, every: str = MONITOR_EVERY) -> StreamingQuery:
    """Calls act at every tick, one call at a time; act may look (a monitor) or synchronise."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", "1").load()
    return ticks.writeStream.foreachBatch(lambda _, __: act() and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Health(StreamingQueryListener):
    """Whether streams are alive: none has failed, and the last sign of life is not older than some seconds."""

    def __init__(self):
        self.last, self.failed = time.monotonic(), []

    def onQueryStarted(self, event) -> None:
        self.last = time.monotonic()

    def onQueryProgress(self, event) -> None:
        self.last = time.monotonic()

    def onQueryIdle(self, event) -> None:
        self.last = time.monotonic()

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed.append(event.exception)

    def fine(self, seconds: float = HEALTH_SECONDS) -> bool:
        return not self.failed and time.monotonic() - self.last <= seconds


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = argparse.ArgumentParser(prog="docreef.sync")
    args.add_argument("--mode", choices=["once", "watch", "continuous", "status"], default="continuous")
    args.add_argument("--config", default="config.json")
    got = args.parse_args(argv)
    sync = Sync(spark or SparkSession.builder.appName("docreef").getOrCreate(), load(got.config))
    if sync.config is None:
        print(f"no configuration: {got.config}")
        return 1
    if got.mode == "once":
        return 0 if sync.once() else 1
    if got.mode == "status":
        sync.status().show(truncate=False)
        return 0
    (sync.watch() if got.mode == "watch" else sync.continuous()).awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
