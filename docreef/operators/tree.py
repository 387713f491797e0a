"""Folder trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreef.catalogue import TREE


def adjacency(tree: dict = TREE, parent: str | None = None) -> list[tuple[str, str, str | None]]:
    """(path, name, parent_path) in pre-order."""
    out = []
    for name, below in tree.items():
        path = name if parent is None else f"{parent}/{name}"
        out += [(path, name, parent), *adjacency(below, path)]
    return out


def flatten(spark: SparkSession, folders: DataFrame, failed: list[str] | None = None) -> DataFrame:
    """(path, name, parent_path, depth) reached from the roots; a failed folder leaves out all below it.

    A recursive query: Spark raises beyond 100 levels or 1,000,000 rows, its limits of recursion
    (spark.sql.cteRecursionLevelLimit, spark.sql.cteRecursionRowLimit), and leaves out nothing.
    """
    bad = spark.createDataFrame([(x,) for x in failed or []], "path string")
    return spark.sql(
        """
        WITH RECURSIVE tree AS (
          SELECT path, name, parent_path, 0 AS depth FROM {open} WHERE parent_path IS NULL
          UNION ALL
          SELECT f.path, f.name, f.parent_path, t.depth + 1 FROM {open} f JOIN tree t ON f.parent_path = t.path
        ) SELECT * FROM tree""",
        open=folders.join(F.broadcast(bad), "path", "left_anti").select("path", "name", "parent_path"),
    )


def provision(spark: SparkSession, wanted: DataFrame, existing: DataFrame, failed: list[str] | None = None) -> DataFrame:
    """(path, name, parent_path, depth, action) of every wanted folder (path, name, parent_path): EXISTS if its path is
    among the existing, CREATE if not, FAILED if it cannot be made, SKIPPED below one that failed. Parents come before
    children in order of depth; ``folder_actions`` makes it a plan for the executor."""
    bad = spark.createDataFrame([(x,) for x in failed or []], "path string")
    reached = flatten(spark, wanted, failed).select("path", "depth")
    known, lost = existing.select("path").distinct().withColumn("known", F.lit(True)), bad.withColumn("lost", F.lit(True))
    rows = wanted.select("path", "name", "parent_path").join(reached, "path", "left").join(known, "path", "left").join(F.broadcast(lost), "path", "left")
    action = F.when(F.col("lost"), "FAILED").when(F.col("depth").isNull(), "SKIPPED").when(F.col("known"), "EXISTS").otherwise("CREATE")
    return rows.select("path", "name", "parent_path", "depth", action.alias("action"))


def folder_actions(provisioned: DataFrame) -> DataFrame:
    """The folders to create as a plan that ``executor.execute`` carries out; making one makes those above it."""
    none = F.lit(None).cast("string")
    return provisioned.where("action = 'CREATE'").select(F.lit("").alias("container"), F.col("path").alias("name"), "action", none.alias("local_path"), none.alias("remote_id"))


def folder_map(folders: DataFrame) -> DataFrame:
    """(name, id) keyed by leaf name; of equal names the greatest path wins."""
    return folders.groupBy("name").agg(F.max("path").alias("path")).select("name", F.md5(F.encode("path", "utf-8")).alias("id"))


def lookup(folders: DataFrame, name: str, parent: str | None = None) -> DataFrame:
    """The first folder of a name, below a parent if one is given; by path, so that first is defined."""
    rows = folders.where(F.col("name") == name)
    if parent is not None:
        rows = rows.where(F.col("parent_path") == parent)
    return rows.orderBy("path").limit(1)


def domain_folders(domains: DataFrame, folders: DataFrame) -> DataFrame:
    """(domain, folder_id), null where no folder has the domain's name."""
    own = folder_map(folders).select(F.col("name").alias("domain"), F.col("id").alias("folder_id"))
    return domains.select("domain").join(own, "domain", "left")
