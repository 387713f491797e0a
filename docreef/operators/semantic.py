"""Search by meaning over given vectors, and relations between themes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def semantic_search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k other rows of greatest cosine, exactly, ties by id.

    Scores are rounded to nine digits before they are ranked. Vectors without length (null, empty, zero) take no part,
    nor do those of another dimension. Blocks of queries meet blocks of vectors, a pair a group; each gives its k best.
    """

    def blocks(rows: DataFrame, n: int) -> DataFrame:
        own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        own = own.where(F.coalesce(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), F.lit(0.0)) > 0)
        return own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))

    n, m = (max(1, -(-df.count() // block)) for df in (vectors, queries))
    points, asked = blocks(vectors, n), blocks(queries, m)
    points = points.select(F.col("block").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")).alias("q"), "id", "v", F.lit(False).alias("asks"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias("p"), F.col("block").alias("q"), "id", "v", F.lit(True).alias("asks"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby(pdf["v"].map(len)):
            have, want = own[~own["asks"]], own[own["asks"]]
            if len(have) and len(want):
                a, b = np.stack(have["v"].to_numpy()), np.stack(want["v"].to_numpy())
                a, b = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
                ids = have["id"].to_numpy()
                for who, scores in zip(want["id"].to_numpy(), np.round(b @ a.T, 9)):
                    order = np.lexsort((ids, -scores))
                    best = order[ids[order] != who][:k]
                    out.append(pd.DataFrame({"query_id": who, "vec_id": ids[best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = points.unionByName(asked).groupBy("p", "q").applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def relations(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(domain_a, domain_b, n_docs), a < b: themes that stand in one document, and in how many. Themes are few: a
    document gives a row a pair of its own themes."""
    own = hits.groupBy(key).agg(F.array_sort(F.collect_set("domain")).alias("d"))
    both = F.flatten(F.transform("d", lambda a: F.transform(F.filter("d", lambda b: b > a), lambda b: F.struct(a.alias("domain_a"), b.alias("domain_b")))))
    return own.select(F.explode(both).alias("p")).groupBy("p.domain_a", "p.domain_b").agg(F.count(F.lit(1)).alias("n_docs"))
