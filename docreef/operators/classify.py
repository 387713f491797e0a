"""Thematic classification by keywords, and the best documents of each theme."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreef.catalogue import OTHER

#: What stands beside a whole word.
EDGE = r"[^\p{L}\p{N}_]"
#: Terms that are looked for within the plan; a larger lexicon is joined.
PLANNED_TERMS = 2000

Term = tuple[str, str, int]


def _matches(terms: list[str], text: str) -> Column:
    """The terms that a text has as whole words: those of one word by its set of words, phrases each by a pattern."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = [t for t in terms if re.fullmatch(r"\w+", t)]
    found = F.array_intersect(F.split(low, EDGE + "+"), F.array(*map(F.lit, words)).cast("array<string>"))
    phrases = [F.when(low.rlike(f"(^|{EDGE}){re.escape(t)}({EDGE}|$)"), F.lit(t)) for t in terms if t not in words]
    return F.array_compact(F.concat(found, F.array(*phrases))) if phrases else found


def hits(docs: DataFrame, lexicon: list[Term], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, domain, keyword, priority): a document's matched terms. Case is ignored; a term may be in several domains.

    Narrow for a lexicon of a planned size: only matches leave the scan. A larger one meets the documents' distinct
    words in a join, its phrases still as patterns.
    """
    low = sorted({(d, k.lower(), p) for d, k, p in lexicon})
    spark = docs.sparkSession
    table = spark.createDataFrame(low, "domain string, keyword string, priority int") if low else spark.createDataFrame([], "domain string, keyword string, priority int")
    terms = sorted({k for _, k, _ in low})
    if len(terms) <= PLANNED_TERMS:
        found = docs.select(key, F.explode(_matches(terms, text)).alias("keyword"))
        return found.join(F.broadcast(table), "keyword").select(key, "domain", "keyword", "priority")
    words = docs.select(key, F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), EDGE + "+"))).alias("keyword"))
    phrases = [t for t in terms if not re.fullmatch(r"\w+", t)]
    if phrases:
        words = words.unionByName(docs.select(key, F.explode(_matches(phrases, text)).alias("keyword")))
    return words.join(table, "keyword").select(key, "domain", "keyword", "priority")


def scores(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.groupBy(key, "domain").agg(F.countDistinct("keyword").alias("score"), F.min("priority").alias("priority"))


def best(docs: DataFrame, lexicon: list[Term], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, domain, score): most matched terms, then the smaller priority, then the name; no match: OTHER with 0."""
    ranked = F.struct(-F.col("score"), F.col("priority"), F.col("domain"))
    top = scores(hits(docs, lexicon, key, text), key).groupBy(key).agg(F.min_by(F.struct("domain", "score"), ranked).alias("b"))
    return docs.select(key).join(top, key, "left").select(key, F.coalesce("b.domain", F.lit(OTHER)).alias("domain"), F.coalesce("b.score", F.lit(0)).cast("long").alias("score"))


def top_points(found: DataFrame, most: int, least: int, key: str = "doc_id") -> DataFrame:
    """(domain, rank, key, score, enough): the best documents of each domain, and whether it has ``least`` at all.

    The rank's limit cuts each partition before the shuffle, so a large domain sends ``most`` rows a task.
    """
    own = scores(found, key)
    order = Window.partitionBy("domain").orderBy(F.desc("score"), key)
    top = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    sizes = own.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return top.join(sizes, "domain").select("domain", "rank", key, "score", (F.col("n") >= least).alias("enough"))
