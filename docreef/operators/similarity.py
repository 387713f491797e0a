"""Similar documents, exactly: word shingles, Jaccard, prefix filter, common shingles last. Texts, classes, clusters."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docreef.operators.graph import connected
from docreef.shared import sized_join, written

#: A word of shingles.
SPLIT = r"[\x20\x09-\x0D]+"


def shingle_sets(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(id, copies, n, s): each text by its smallest id, how many documents have it, and its set of shingle hashes."""
    runs = F.when(F.size("w") >= width, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, width), " "))).otherwise(F.array(F.array_join("w", " ")))
    texts = docs.where(F.length(text) > 0).groupBy(F.md5(F.encode(text, "utf-8")).alias("h")).agg(F.min(key).alias("id"), F.first(text).alias("t"), F.count(F.lit(1)).alias("copies"))
    sets = texts.withColumn("w", F.filter(F.split("t", SPLIT), lambda w: w != "")).where(F.size("w") > 0)
    sets = sets.select("id", "copies", F.array_distinct(F.transform(runs, lambda s: F.xxhash64(s))).alias("s"))
    return sets.select("id", "copies", F.size("s").alias("n"), "s")


#: One text in so many is asked which members are common, and how many of the commonest are ordered by it.
ASKED, COMMON = 16, 1_000_000
#: Rows of five numbers that may be broadcast, counted before, and members that a task sorts at once.
ID_ROWS, SORTED = 1_000_000, 2_000_000
#: Texts of a block that tasks compare with blocks, and columns of a matrix.
BLOCK, WIDTH = 512, 8_192


def common_members(sets: DataFrame) -> DataFrame:
    """(x, df): members that several of the asked texts have, and how many. It serves an order only, so what the other
    texts have changes no pair."""
    asked = sets.where(F.pmod(F.xxhash64("id"), F.lit(ASKED)) == 0).select(F.explode("s").alias("x"))
    return asked.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1").orderBy(F.desc("df"), "x").limit(COMMON)


def heads(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, n, at, x): the first n - ceil(threshold * n) + 1 members of each set, uncommon ones first, then by hash, and
    their places. Arrow batches, since a set is ordered by a table that all sets share."""
    told = common_members(sets).toPandas()  # COMMON rows at most
    told = told.sort_values("x")
    shared = sets.sparkSession.sparkContext.broadcast((told["x"].to_numpy("int64"), told["df"].to_numpy("int64")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, df = shared.value
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            part = np.cumsum(sizes, dtype="int64") // SORTED
            for at in np.flatnonzero(np.diff(part, prepend=-1)):
                rows = batch.slice(at, int(np.searchsorted(part, part[at], "right")) - at)
                n, x = rows.column("n").to_numpy().astype("int64"), rows.column("s").flatten().to_numpy()
                rank = np.zeros(len(x), "int64")
                if len(common):
                    near = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    rank = np.where(common[near] == x, df[near], 0)
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((x, rank, doc))
                place = np.arange(1, len(x) + 1) - np.repeat(np.cumsum(n) - n, n)
                first = place <= np.repeat(n - (n * num + den - 1) // den + 1, n)
                whose = doc[first]
                yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(whose)), pa.array(n[whose], pa.int32()), pa.array(place[first], pa.int32()), pa.array(x[order[first]])], ["id", "n", "at", "x"])

    return sets.select("id", "n", "s").mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, n int, at int, x long")


def compared(sets: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, common, total) of the candidates (a, b) that are similar enough.

    A task gets the texts that candidates connect, each set once, and compares them all by products of 0/1 matrices.
    Where they are many, they are dealt into blocks of some BLOCK texts, and a task gets two of them: so a set is moved
    once a block, not once a pair, and no task holds more than two blocks.
    """
    nodes = written(connected(found), "similar-nodes", few=True)
    blocks = nodes.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    dealt = nodes.join(blocks, "root").withColumn("side", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    dealt = written(dealt.select(F.col("node").alias("id"), "root", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")), "similar-dealt", few=True)
    rows = sized_join(sets.select("id", "s"), dealt, "id", "inner", ID_ROWS)

    def run(texts: pa.Table) -> pa.Table:
        texts = texts.sort_by("id").combine_chunks()
        ids, s, side = (texts.column(c).combine_chunks() for c in ("id", "s", "side"))
        n = np.diff(s.offsets.to_numpy())
        _, x, times = np.unique(s.flatten().to_numpy(), return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1  # members of one text alone match nothing
        doc, x = np.repeat(np.arange(len(n)), n)[times[x] > 1], column[x[times[x] > 1]]
        order = np.argsort(x, kind="stable")
        doc, x = doc[order], x[order]
        common = np.zeros((len(n), len(n)), "float32")  # whole numbers below 2^24
        for at in range(0, int(x[-1]) + 1 if len(x) else 0, WIDTH):
            lo, hi = np.searchsorted(x, (at, at + WIDTH))
            has = np.zeros((len(n), min(WIDTH, int(x[-1]) + 1 - at)), "float32")
            has[doc[lo:hi], x[lo:hi] - at] = 1
            common += has @ has.T
        common = common.astype("int64")
        total = n[:, None] + n[None, :] - common
        wanted = np.triu(common * den >= total * num, 1)
        if texts.column("i")[0].as_py() != texts.column("j")[0].as_py():
            side = side.to_numpy()
            wanted &= side[:, None] != side[None, :]
        a, b = np.nonzero(wanted)
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "common": common[a, b], "total": total[a, b]})

    kind = sets.schema["id"].dataType.simpleString()
    return rows.groupBy("root", "i", "j").applyInArrow(run, f"a {kind}, b {kind}, common long, total long")


def pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, common, total), a < b: pairs of texts of at least ``threshold`` similarity.

    Of two sets that similar, the first n - ceil(threshold * n) + 1 members in any one order share one. The order puts
    members last that are common among some of the texts, so what many share is joined for near copies only. Only those
    first members are shuffled, once; those that one text alone has end there. Sizes and places of the shared member are
    held against the threshold before sets are compared, and only sets of candidates are moved. A member with very many
    texts is a skewed key of a plain join, which Spark splits.
    """
    share = Fraction(str(threshold))
    num, den = share.numerator, share.denominator
    first = heads(sets, num, den).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("x"))).where("df > 1").drop("df")
    first = written(first, "similar-heads")
    a, b = first.alias("a"), first.alias("b")
    sized = F.expr(f"a.n * {den} >= b.n * {num} and b.n * {den} >= a.n * {num}")
    shared = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.id") < F.col("b.id")) & sized)
    shared = shared.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count(F.lit(1)).alias("c"), F.max("a.at").alias("i"), F.max("b.at").alias("j"))
    rest = f"(greatest(na, nb) * {num} + {den - 1}) div {den} - 1"
    found = shared.where(f"(c + least({rest}, na - i, nb - j)) * {num + den} >= {num} * (na + nb)").select("a", "b").distinct()
    return compared(sets, written(found, "similar-found"), num, den)


def similar_texts(docs: DataFrame, threshold: float = 0.8, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links): every text with a similar other one, by its smallest id: the least id of the texts
    that links connect, and how many texts are similar to it. Null and empty texts have no links.

    Copies are one text before anything is joined. Links are counted, not listed; a group of m near copies still costs
    m^2 comparisons.
    """
    links = written(pairs(written(shingle_sets(docs, width, key, text), "similar-sets"), threshold).select("a", "b"), "similar-links")
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    return connected(links).join(counts, "node").select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"), "n_links")


def clusters(docs: DataFrame, related: float = 0.7, merged: float = 0.8, most: int = 10, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rank, cluster, n_texts, n_docs, n_related): the ``most`` largest clusters, by documents and then by name.

    Texts of at least ``merged`` similarity are merged into one cluster, named by its least id; n_related is the number
    of other clusters, single texts included, with a text at least ``related`` similar to one of it.
    """
    sets = written(shingle_sets(docs, width, key, text), "similar-sets")
    near = written(pairs(sets, related), "similar-links")
    share = Fraction(str(merged))
    root = connected(near.where(F.col("common") * share.denominator >= F.col("total") * share.numerator))
    named = written(sets.select(F.col("id").alias("node"), "copies").join(root, "node", "left").select("node", "copies", F.coalesce("root", "node").alias("cluster")), "similar-named")
    ends = [sized_join(near, named.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), "a", "inner"), named.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))]
    across = sized_join(*ends, "b", "inner").where("ca <> cb").select("ca", "cb")
    across = across.unionByName(across.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).groupBy(F.col("ca").alias("cluster")).agg(F.countDistinct("cb").alias("n_related"))
    sizes = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("copies").alias("n_docs"))
    top = sizes.orderBy(F.desc("n_docs"), "cluster").limit(most)  # a report of the largest
    ranked = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n_docs")).alias("o"), "cluster", "n_texts", "n_docs"))).alias("t"))
    rows = ranked.select(F.posexplode("t").alias("at", "t")).select((F.col("at") + 1).alias("rank"), "t.cluster", "t.n_texts", "t.n_docs")
    return rows.join(across, "cluster", "left").select("rank", "cluster", "n_texts", "n_docs", F.coalesce("n_related", F.lit(0)).cast("long").alias("n_related"))
