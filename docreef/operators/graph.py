"""Connected sets of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreef.shared import sized_join, written


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes of edges (a, b): the least node of each connected set, itself included.

    Large-star and small-star rounds (Kiveris et al. 2014) until every set is a star; each is written, so lineage stays
    short. The least neighbours, a row a node, are written before they meet the edges, so that a star with very many
    edges is broadcast to or, beyond what is broadcast, split by Spark like any skewed key. Edges of a node with itself
    are left out; no edges give no rows; a graph that does not settle in ``most_rounds`` raises.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", few=True)
    for _ in range(most_rounds):
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "links", few=True)
        large = written(sized_join(both, least, "a", "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links", few=True)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "links", few=True)
        small = sized_join(large, least, "a", "inner").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = written(small, "links", few=True)
    else:
        raise RuntimeError("connected sets did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
