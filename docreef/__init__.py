"""docreef: a document corpus managed as Spark tables."""

from __future__ import annotations

import os


def reachable(spark) -> None:
    """Lets Python workers import this package from where the driver found it. On a cluster, ship it instead."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
