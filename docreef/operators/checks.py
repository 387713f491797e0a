"""Validation reports."""

from __future__ import annotations

import importlib.util
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreef.functions.scalars import percent, version


def summary(checks: DataFrame) -> DataFrame:
    """One row of checks (seq, check, status): counts, success rate (0 of none), verdict, names in order.

    Verdict: ok without failures, warning with at most two, else failed; only passed and failed count.
    """
    names = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("seq", "check")))), lambda x: x["check"]), ", ")
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    out = checks.agg(n("passed").alias("n_passed"), n("failed").alias("n_failed"), names("passed").alias("passed"), names("failed").alias("failed"))
    rate = F.round(percent(F.col("n_passed"), F.col("n_passed") + F.col("n_failed")), 1)
    verdict = F.when(F.col("n_failed") == 0, "ok").when(F.col("n_failed") <= 2, "warning").otherwise("failed")
    return out.withColumn("rate", rate).withColumn("verdict", verdict)


def json_paths(rows: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """rows with a boolean for each JSON path: whether the document has it."""
    return rows.select("*", *[F.get_json_object(column, p).isNotNull().alias(n) for n, p in paths.items()])


def new_enough(rows: DataFrame, have: str = "have", need: str = "need") -> DataFrame:
    return rows.withColumn("ok", version(F.col(have)) >= version(F.col(need)))


def least_version(rows: DataFrame, by: list[str], have: str = "have") -> DataFrame:
    """by and the least version of each group, as versions compare; of equal ones the least text."""
    return rows.groupBy(*by).agg(F.min_by(F.col(have), F.struct(version(F.col(have)).alias("v"), F.col(have).alias("text"))).alias("least"))


# --- probes of the machine that the driver runs on ---------------------------------------------------------------------
def modules(spark: SparkSession, wanted: list[tuple[str, str]]) -> DataFrame:
    """(module, package, present): whether each module can be imported here; none is imported."""

    def there(name: str) -> bool:
        try:
            return importlib.util.find_spec(name) is not None
        except (ImportError, ValueError):
            return False

    return spark.createDataFrame([(m, p, there(m)) for m, p in wanted], "module string, package string, present boolean")


def env_file(path: str) -> dict[str, str]:
    """Settings of a file of NAME=value lines; comments and lines of other forms are none, nor is a missing file."""
    out = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                name, sign, value = line.removeprefix("export ").partition("=")
                if sign and name.strip() and not line.startswith("#"):
                    out[name.strip()] = value.strip().strip("\"'")
    return out


def free_bytes(path: str = ".") -> int:
    return shutil.disk_usage(path).free


def answers(url: str, seconds: float = 5.0) -> bool:
    """Whether a GET is answered with 200 in time."""
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=seconds) as got:
            return got.status == 200
    except (OSError, ValueError):
        return False


def round_trip(folder: str, text: str = "round trip") -> bool:
    """Whether a file can be written here, read back and removed."""
    path = os.path.join(folder, f".probe-{os.getpid()}")
    try:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        with open(path, encoding="utf-8") as f:
            same = text in f.read()
        os.remove(path)
        return same
    except OSError:
        return False


def rendered(report: DataFrame, width: int = 50) -> str:
    """The row of ``summary`` as text between rules."""
    r = report.first()
    lines = [f"passed {r['n_passed']}: {r['passed']}", f"failed {r['n_failed']}: {r['failed']}", f"success rate {r['rate']:.1f}%, {r['verdict']}"]
    return "\n".join(["=" * width, *lines, "=" * width])
