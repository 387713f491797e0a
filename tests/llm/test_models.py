"""Operators that learn from labels or weigh sources, on held-out rows and against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docreef.llm import mixing, quality_model, toxicity
from docreef.llm.common import arrow_schema, folded_words, row_blocks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


# --- 1: mixing -------------------------------------------------------------------------------------------------------
def targets(sizes):
    """Water-filling, as the contract words it: cap, reshare the excess by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("which", ["more", "odd"])
def test_mix(which, request):
    df = request.getfixturevalue(which)
    df = df[0] if isinstance(df, tuple) else df
    got = mixing.mix(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in df.select("doc_id").collect())
    sizes, largest, taken, want = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in df.select("source", "text").collect():
        n = len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in r["text"] or "").split(" ") if w])
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] and 0 <= r["rate"] <= 2
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * largest[s], s
    again = Counter((r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(5)).collect())
    assert again == Counter((r["doc_id"], r["taken"]) for r in got)
    twice = mixing.mixed(df)
    assert twice.columns == df.columns
    assert Counter(r["doc_id"] for r in twice.collect()) == +_sum(got)


def _sum(rows):
    out = Counter()
    for r in rows:
        out[r["doc_id"]] += r["copies"]
    return out


def test_tilts_solve_the_dual(spark, more):
    """Rates meet each target before rounding and fall off exponentially with size, cut at two."""
    sizes = mixing.sized(more[0]).cache()
    t = mixing._tilts(sizes, mixing.source_targets(sizes), 2, 60, 1e-9).collect()
    by = defaultdict(list)
    for r in sizes.collect():
        by[r["source"]].append(r["size"])
    for r in t:
        x = np.array(by[r["source"]], float)
        assert (x * np.minimum(2, np.exp(np.minimum(r["tilt"] * x / r["mean"], 50)))).sum() == pytest.approx(r["target"], rel=1e-6)


def test_scales_are_near_one(spark, more):
    """With many documents a source the rounded copies meet the target at a scale near 1: the rates are the tilted ones."""
    docs = more[0].withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 4))
    for r in mixing.mix(docs).select("source", "scale").distinct().collect():
        assert abs(r["scale"] - 1) < 0.1, r


def test_tilts_that_do_not_converge_raise(more):
    sizes = mixing.sized(more[0]).cache()
    with pytest.raises(RuntimeError):
        mixing._tilts(sizes, mixing.source_targets(sizes), 2, 1, 1e-12)


def test_mix_of_nothing(none, spark):
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix(empty).collect()} == {(0, 0.0, 0)}


# --- 4: toxicity -----------------------------------------------------------------------------------------------------
def held_out(k, parts, fold):
    return zlib.crc32(str(k).encode()) % parts == fold if k is not None else zlib.crc32(b"") % parts == fold


def test_toxicity(more):
    docs, labels = more
    rows = toxicity.classify(docs, labels).collect()
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == held_out(r["doc_id"], 3, 1) for r in rows)
    out = [(known[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in known]
    hit, false = sum(a and b for a, b in out), sum(b and not a for a, b in out)
    assert hit >= 0.75 * sum(a for a, _ in out) and false <= 2, (hit, sum(a for a, _ in out), false, len(out))


def test_toxicity_ignores_held_out_labels(more):
    docs, labels = more
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert key(toxicity.classify(docs, labels)) == key(toxicity.classify(docs, flipped))


def test_risk_is_corrected_for_the_prior():
    """Half of the unlabelled are positives: a plain positive-against-unlabelled learner would score them by half."""
    pos = toxicity.Rows([([0], [1.0])] * 50, 2)
    unl = toxicity.Rows([([0], [1.0])] * 50 + [([1], [1.0])] * 50, 2)
    w, b = toxicity.nn_pu(pos, unl, np.full(50, 1 / 50), np.full(100, 1 / 100), 0.5)
    score = 1 / (1 + np.exp(-(w + b)))
    assert score[0] > 0.8 and score[1] < 0.2


@pytest.mark.parametrize("classify,parts,fold", [(toxicity.classify, 3, 1), (quality_model.classify, 4, 2)])
def test_odd_rows_and_labels(spark, odd, none, more, classify, parts, fold):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, None, None), (None, 1, 1), (3, 7, 7), (3, 0, 0), (101, 0, 1)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0), more[1]):
        rows = classify(odd, own).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
        assert all(0 <= r["score"] <= 1 and r["held_out"] == held_out(r["doc_id"], parts, fold) for r in rows)
    assert classify(none, labels).count() == 0


# --- 10: quality -----------------------------------------------------------------------------------------------------
def test_quality(more):
    docs, labels = more
    rows = quality_model.classify(docs, labels).collect()
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count() and all(r["held_out"] == held_out(r["doc_id"], 4, 2) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    out = [(known[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(a == b for a, b in out) >= 0.95 * len(out)
    kept = quality_model.accepted(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["predicted"]}


def test_normal_equations_and_isotonic():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=200).round(1), rng.integers(0, 2, 200)
    xs, ys = quality_model.isotonic(x, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    fitted = np.interp(x, xs, ys)
    for t in np.unique(x):  # pool-adjacent-violators against its min-max formula
        points = np.unique(x)
        best = max(min(y[(x >= a) & (x <= b)].mean() for b in points if b >= t) for a in points if a <= t)
        assert fitted[x == t][0] == pytest.approx(best)


def test_rows_are_blocked():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["aa", None, "bb", "c"])], names=["k", "t"])
    assert list(row_blocks([batch], 4)) == [([1, 2, 3], ["aa", None, "bb"]), ([4], ["c"])]
    assert arrow_schema("a long, b array<array<long>>").field("b").type == pa.list_(pa.list_(pa.int64()))
    assert folded_words("A-b é.Ç 1") == [b"a", b"b", "é".encode(), "Ç".encode(), b"1"]


def test_toxicity_learns_from_all_documents(spark, docs, monkeypatch):
    """All documents outside the held-out fold are counted and are unlabelled texts of some classifier."""
    seen, plain = [], toxicity.frequencies

    def spy(rows, only=None):
        if only is not None:
            seen.append(Counter(r["text"] for r in rows.select("text").collect()))
        return plain(rows, only)

    monkeypatch.setattr(toxicity, "frequencies", spy)
    got = toxicity.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"), block=50)
    open_ids = {r["doc_id"] for r in got.where("not held_out").collect()}
    assert seen == [Counter(r["text"] for r in docs.collect() if r["doc_id"] in open_ids)]


def test_rates_are_clipped_alike_in_training_and_scores():
    """A word again and again is no more toxic than what training saw at most."""
    vectors = toxicity.Vectors(["=bad"])
    assert vectors("bad " * 12)[1] == vectors("bad " * 1000)[1] == [toxicity.HIGHEST] and vectors("bad " + "word " * 79)[1] == [1.0]
    model = toxicity.Model(["=bad"], np.array([0.3]), -3.0)
    assert model.scorer()("bad " * 500) == pytest.approx(1 / (1 + np.exp(3 - 0.3 * toxicity.HIGHEST)))
    assert toxicity.Rows([vectors("bad " * 500)], 1).value.max() == toxicity.HIGHEST


def test_prior_comes_from_all_texts():
    """However many of the labelled rows are positive, the bound is that of the features among all texts."""
    counts = toxicity.Counts(500, 100_000, {"=a": 450, "=b": 100, "=c": 20}, {"=a": 4_600, "=b": 90_000, "=c": 1})
    assert 0.046 * 500 / 450 < counts.prior() < 0.06
    assert toxicity.Counts(0, 0, {}, {}).prior() == 0.1


def test_toxicity_does_not_follow_the_share_among_labels(more):
    """Labels that over-sample toxic texts leave the scores as they are."""
    docs, labels = more
    key = lambda df: {r["doc_id"]: r["score"] for r in df.collect()}
    all_, few = key(toxicity.classify(docs, labels)), key(toxicity.classify(docs, labels.where("toxic = 1 or doc_id % 5 = 0")))
    assert max(abs(all_[k] - few[k]) for k in all_) < 1e-9
