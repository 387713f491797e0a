"""Mixing sources to target weights by entropy balancing. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreef.llm.common import WORD, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes.
SHARE = 1.5
#: Most copies of a document, and of a source's words.
MOST = 2

_EXACT = "decimal(38,9)"


def word_count(text: str = "text") -> Column:
    """Number of words of a text, null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, n_docs, target) of rows (source, size).

    Targets share ``share`` of all words by weight; none exceeds ``most`` times its source's size, and the excess goes
    to the others by weight. That is a water level: with the sources in order of the level at which they fill up, the
    level is the first at which the rest can hold what is left. The one window without a key is over a row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    totals = totals.withColumn("weight", weight.cast("double")).withColumn(
        "full_at", most * F.col("source_size") / F.col("weight")
    )
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after = (
        filling.rowsBetween(Window.unboundedPreceding, -1),
        filling.rowsBetween(Window.currentRow, Window.unboundedFollowing),
    )
    everything = Window.partitionBy()
    level = (
        share * F.sum("source_size").over(everything)
        - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(after)
    totals = totals.withColumn("level", level).withColumn("place", F.row_number().over(filling))
    right = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(everything)["level"]
    return totals.withColumn("at", right).select(
        "source",
        "source_size",
        "n_docs",
        F.coalesce(F.least(most * F.col("source_size").cast("double"), F.col("at") * F.col("weight")), F.lit(0.0) + most * F.col("source_size")).alias("target"),
    )


def _tilts(sizes: DataFrame, targets: DataFrame, most: int, rounds: int, tolerance: float) -> DataFrame:
    """(source, source_size, target, mean, tilt) by Newton steps on the dual of each source's token constraint.

    The rate of a document of s words is min(most, exp(tilt * s / mean)): of all rates with the target's number of
    words and within the cap, those nearest to 1 in entropy. A step works on the logarithm of the words taken, stays
    between the bounds found so far, and is a distributed sum over the distinct sizes of a source. The first tilt is the
    one of a document of mean size. Sums are decimals, so that reruns agree whatever the order of the rows. A source
    whose words are not within ``tolerance`` of its size after ``rounds`` steps raises.
    """
    spark = sizes.sparkSession
    counts = written(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    top = math.log(most) * F.greatest("mean", F.lit(1.0))  # here every word is taken as often as may be
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = targets.withColumn("mean", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-300))).select(
        "source", "source_size", "target", "mean",
        F.when(full, top).otherwise(F.least(F.greatest(F.log(F.greatest(F.col("target") / F.greatest("source_size", F.lit(1)), F.lit(1e-9))), F.lit(-20.0)), F.lit(math.log(most)))).alias("tilt"),
        (F.lit(-60.0) * F.greatest("mean", F.lit(1.0))).alias("low"),
        top.alias("high"),
        ((F.col("source_size") <= 0) | full).alias("done"),
    )
    state = written(state, "mix-tilt")
    for _ in range(rounds):
        on = counts.alias("c").join(state.where("not done").alias("t"), F.expr("c.source <=> t.source"))
        x, rate = F.col("size") / F.col("mean"), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))
        got = on.groupBy(F.col("t.source").alias("source")).agg(
            F.sum((F.col("n") * F.col("size") * F.least(rate, F.lit(float(most)))).cast(_EXACT)).cast("double").alias("got"),
            F.sum(F.when(rate < most, F.col("n") * F.col("size") * x * rate).otherwise(0.0).cast(_EXACT)).cast("double").alias("slope"),
        )
        low = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("got") < F.col("target"), F.col("high")).otherwise(F.col("tilt"))
        step = F.col("tilt") + (F.log("target") - F.log("got")) * F.col("got") / F.col("slope")
        inside = (F.col("got") > 0) & (F.col("slope") > 0) & (F.col("target") > 0) & (step > F.col("l2")) & (step < F.col("h2"))
        state = (
            state.alias("s")
            .join(got.alias("g"), F.expr("s.source <=> g.source"), "left")
            .select("s.*", "got", "slope")
            .withColumn("l2", low).withColumn("h2", high)
            .withColumn("near", F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("source_size"))
            .withColumn("next", F.when(F.col("done") | F.col("near") | F.col("got").isNull(), F.col("tilt")).when(inside, step).otherwise((F.col("l2") + F.col("h2")) / 2))
            .select("source", "source_size", "target", "mean", F.col("next").alias("tilt"),
                    F.when(F.col("done"), F.col("low")).otherwise(F.col("l2")).alias("low"),
                    F.when(F.col("done"), F.col("high")).otherwise(F.col("h2")).alias("high"),
                    (F.col("done") | F.coalesce("near", F.lit(True))).alias("done"))
        )
        state = written(state, "mix-tilt")
        if state.where("not done").isEmpty():
            break
    else:
        left = [r["source"] for r in state.where("not done").limit(5).collect()]
        raise RuntimeError(f"tilts of sources {left} did not converge in {rounds} steps")
    return state.select("source", "source_size", "target", "mean", "tilt")


def _copies(scale: Column, most: int) -> Column:
    """Rates rounded up or down by each document's own draw, so that their mean is kept."""
    rate = F.least(F.lit(float(most)), scale * F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))))
    return F.floor(rate + F.col("draw")).cast("long")


def draw(key: str) -> Column:
    """A number from 0 to below 1, fixed by the key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mixing"), F.col(key)), 11) * (2.0**-53)


def _scaled(sizes: DataFrame, tilts: DataFrame, most: int, passes: int, points: int) -> DataFrame:
    """tilts with a scale near 1 at which the rounded copies, too, come nearest to the target.

    Words taken never fall as the scale grows, one document after another, so each pass tries a row of scales in one
    scan and goes on between the two that hold the target; integers are summed, so the outcome is exact. Of scales that
    come equally near, the one nearest to 1 stays.
    """
    both = written(tilts.select("*", F.lit(0.0).alias("below"), F.lit(4.0).alias("above"), F.lit(1.0).alias("scale"), F.lit(None).cast("double").alias("gap")), "mix-scale")
    first = [0.0, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.995, 1.0, 1.005, 1.01, 1.02, 1.05, 1.1, 1.25, 1.5, 2.0, 4.0]
    for k in range(passes):
        tries = (
            [F.lit(x) for x in first] if k == 0
            else [F.col("below") + (F.col("above") - F.col("below")) * (i / points) for i in range(points + 1)]
        )
        rows = sizes.alias("d").join(both.alias("t"), F.expr("d.source <=> t.source")).select("t.*", "size", "draw")
        took = rows.groupBy("source").agg(
            *[F.sum(F.col("size") * _copies(x, most)).alias(f"took{i}") for i, x in enumerate(tries)]
        )
        on = both.alias("s").join(took.alias("g"), F.expr("s.source <=> g.source"), "left").select(
            "s.*", F.array(*[F.struct(x.alias("scale"), F.col(f"took{i}").alias("took")) for i, x in enumerate(tries)]).alias("tried")
        )
        ends = [
            F.array_max(F.filter("tried", lambda t: t["took"] <= F.col("target")))["scale"],
            F.array_min(F.filter("tried", lambda t: t["took"] > F.col("target")))["scale"],
        ]
        best = F.array_min(F.transform("tried", lambda t: F.struct(F.abs(t["took"] - F.col("target")).alias("gap"), F.abs(t["scale"] - 1).alias("off"), t["scale"].alias("scale"))))
        best = F.array_min(F.array(best, F.struct(F.coalesce("gap", F.lit(float("inf"))).alias("gap"), F.abs(F.col("scale") - 1).alias("off"), F.col("scale").alias("scale"))))
        both = written(
            on.select("source", "source_size", "target", "mean", "tilt",
                      F.coalesce(ends[0], F.col("below")).alias("below"), F.coalesce(ends[1], F.col("above")).alias("above"),
                      F.coalesce(best["scale"], F.col("scale")).alias("scale"), F.coalesce(best["gap"], F.col("gap")).alias("gap")), "mix-scale")
    return both.drop("below", "above", "gap")


def fit(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, rounds=60, tolerance=1e-6, passes=4, points=16) -> DataFrame:
    """The mix's parameters, a row a source, from rows (source, size, draw)."""
    targets = written(source_targets(sizes, weights, share, most), "mix-targets")
    return _scaled(sizes, _tilts(sizes, targets, most, rounds, tolerance), most, passes, points)


def sized(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), "source", word_count().alias("size"), draw(key).alias("draw"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document of (doc_id, text, source): size, source_size, target, rate, scale, copies, taken.

    A rate is the source's scale times the tilted rate; the scale, near 1 unless a source has few documents, makes up for
    the rounding to copies.

    Edge cases: a null source is a source (the last in order); a null or empty text has size 0 and takes 0 words; a
    source of 0 words has target 0; rows with one doc_id share one draw; no rows give no rows; columns beside the
    three are not read. A source's words come within about one document of its target.
    """
    most = options.get("most", MOST)
    sizes = written(sized(docs), "mix-docs")
    params = fit(sizes, **options)
    rows = sizes.alias("d").join(params.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "source_size", "target", "mean", "tilt", "scale")
    return rows.withColumn("copies", _copies(F.col("scale"), most)).select(
        "doc_id", "source", "size", "source_size", "target",
        F.least(F.lit(float(most)), F.col("scale") * F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))).alias("rate"),
        "scale", "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it, all columns kept, whatever their names. The texts are not shuffled.

    Null and empty texts come at the rate of a document of no words; null sources are a source; rows of one doc_id come
    equally often; no rows give no rows.
    """
    most = options.get("most", MOST)
    params = fit(written(sized(docs), "mix-docs"), **options).select(F.col("source").alias("name"), "mean", "tilt", "scale")
    inner = docs.select(F.struct("*").alias("row"), F.col("source").alias("own"), word_count().alias("size"), draw("doc_id").alias("draw"))
    rows = inner.join(params, F.expr("own <=> name"))
    copies = F.array_repeat(F.lit(0), _copies(F.col("scale"), most).cast("int"))
    return rows.select("row", F.explode(copies)).select("row.*")
