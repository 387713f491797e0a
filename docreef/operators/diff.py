"""Reconciliation: two inventories into a plan of uploads, updates and downloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreef.catalogue import POLICIES
from docreef.functions.scalars import described, missing
from docreef.operators.inventory import deduplicated


def _allows(arm: str, policies: dict) -> Column:
    """Whether the row's container allows an arm. ``Container/sub`` follows the policy of ``Container``."""
    top = F.split("container", "/")[0]
    names = [name for name, policy in policies.items() if policy[arm]]
    return top.isin(*names) if names else F.lit(False)


def plan(local: DataFrame, remote: DataFrame, day: str, policies: dict = POLICIES, prefix: str = "Document", noops: bool = True) -> DataFrame:
    """A row a container and name: NOOP, UPLOAD, UPDATE (the local side wins) or DOWNLOAD.

    One full outer join on (container, name) of the deduplicated sides decides all containers at once. Checksums
    compare null-safely: a missing one differs from any value and equals another missing one. Names are exact. A
    container without a policy is left alone.
    """
    keys = ["container", "name"]
    left = deduplicated(local.select(*keys, F.col("path").alias("local_path"), F.col("hash").alias("local_hash")), keys, "local_path")
    right = deduplicated(remote.select(*keys, F.col("id").alias("remote_id"), F.col("md5Checksum").alias("remote_hash")), keys, "remote_id")
    both = left.withColumn("here", F.lit(True)).join(right.withColumn("there", F.lit(True)), keys, "full")
    action = (
        F.when(F.col("there").isNull(), F.when(_allows("upload", policies), "UPLOAD"))
        .when(F.col("here").isNull(), F.when(_allows("download", policies), "DOWNLOAD"))
        .when(~F.col("local_hash").eqNullSafe(F.col("remote_hash")), F.when(_allows("update", policies), "UPDATE"))
    )
    rows = both.withColumn("action", F.coalesce(action, F.lit("NOOP")))
    note = F.when((F.col("action") == "UPLOAD") & _allows("describe", policies), described(prefix, day))
    rows = rows.select(*keys, "action", "local_path", "remote_id", "local_hash", "remote_hash", note.alias("description"))
    return rows if noops else rows.where("action <> 'NOOP'")


def arm(local: DataFrame, remote: DataFrame, action: str, policies: dict = POLICIES) -> DataFrame:
    """The rows of a plan with one action."""
    return plan(local, remote, "", policies).where(F.col("action") == action)


def uploads(local: DataFrame, remote: DataFrame, policies: dict = POLICIES) -> DataFrame:
    return arm(local, remote, "UPLOAD", policies).select("container", "name", F.col("local_path").alias("path"), F.col("local_hash").alias("hash"))


def downloads(local: DataFrame, remote: DataFrame, policies: dict = POLICIES) -> DataFrame:
    return arm(local, remote, "DOWNLOAD", policies).select("container", "name", F.col("remote_id").alias("id"), F.col("remote_hash").alias("md5Checksum"))


def updates(local: DataFrame, remote: DataFrame, policies: dict = POLICIES) -> DataFrame:
    rows = arm(local, remote, "UPDATE", policies)
    return rows.select("container", "name", F.col("remote_id").alias("id"), F.col("local_hash").alias("hash"), F.col("remote_hash").alias("md5Checksum"))


def names_on(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(container, name, side): each name once, with the side or sides that have it: key sets, their differences and
    their intersection."""
    keys = ["container", "name"]
    mine, theirs = local.select(*keys), remote.select(*keys)
    sides = {"local": mine.subtract(theirs), "remote": theirs.subtract(mine), "both": mine.intersect(theirs)}
    return reduce(DataFrame.unionByName, [rows.withColumn("side", F.lit(side)) for side, rows in sides.items()])


def with_folder(rows: DataFrame, folders: DataFrame, key: str = "domain") -> DataFrame:
    """Rows whose domain has a folder; a null or empty id is none."""
    return rows.join(folders.where(~missing(F.col("folder_id"))).select(key), key, "left_semi")


def status(containers: DataFrame) -> DataFrame:
    """One row (ok, n_containers, n_failed): all containers are looked at, and all need a folder."""
    ok = ~missing(F.col("folder_id"))
    return containers.agg(
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("ok"), F.count(F.lit(1)).alias("n_containers"),
        F.coalesce(F.sum((~ok).cast("long")), F.lit(0)).cast("long").alias("n_failed"),
    )
