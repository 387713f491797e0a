"""Searches, joins and the pipeline, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docreef.llm import ann, jaccard
from docreef.llm.common import folded_words

SF = "/root/testdata/sf0.001"


# --- 8: nearest neighbours -------------------------------------------------------------------------------------------
def exact(rows, k=20, every=20):
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            hits = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in hits[:k]]
    return out


@pytest.mark.parametrize("options", [{}, {"shard_rows": 100}, {"shard_rows": 100, "block": 3, "blocks": 2}])
def test_recall(spark, options):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = exact({r["vec_id"]: r["embedding"] for r in df.collect()})
    got = defaultdict(list)
    for r in ann.nearest(df, **options).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))
    score = {(q, i): s for q, x in exact({r["vec_id"]: r["embedding"] for r in df.collect()}, 10**6).items() for i, s in x}
    assert all(s == pytest.approx(score[q, i], abs=1e-12) for q, x in got.items() for i, s in x)


@pytest.mark.parametrize("norms", ["one outlier", "spread"])
def test_recall_of_uneven_norms(spark, norms):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(2000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v *= np.where(np.arange(2000) == 7, 1e6, 1.0)[:, None] if norms == "one outlier" else 10 ** rng.uniform(-200, 100, (2000, 1))
    rows = dict(enumerate(v.tolist()))
    want, got = exact(rows), defaultdict(set)
    for r in ann.nearest(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(100, [3.0, 1.0, 0.0]), (120, [5.0, 5.0]), (121, [1.0, 0.5]), (140, None), (160, []), (180, [0.0, 0.0, 0.0]), (200, [nan, 1.0, 1.0]), (220, [inf, 1.0, 1.0]), (240, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (20, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as dim", "'x' as vector", "0 as shard")
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = {i: v for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    assert dict(got) == exact(fine)  # ties by id, copies apart from the row itself, other dimensions apart
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 100")).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(20, [1.0, 2.0]), (20, [3.0, -1.0]), (20, [3.0, -1.0]), (1, [2.0, 2.0]), (1, [-1.0, 5.0]), (2, [1.0, 2.0])]
    points, want = sorted({(i, tuple(v)) for i, v in rows}), []
    for p in points:
        if p[0] == 20:
            hits = sorted((-(p[1][0] * v[0] + p[1][1] * v[1]), i) for i, v in points if (i, v) != p)
            want += [(20, n, i, -s) for n, (s, i) in enumerate(hits, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in ann.nearest(df).collect()) == sorted(want) and len(want) == 8


# --- 9: n-gram Jaccard join ------------------------------------------------------------------------------------------
def brute(rows):
    """(doc_id, class_id, n_links, n_texts, n_copies) of (doc_id, text), ids unique."""
    words = {i: tuple(folded_words(t)) for i, t in rows}
    sets = {i: {w[k : k + 5] for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    up = {i: i for i in words}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = defaultdict(set)
    inverse = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverse[x].append(i)
    common = Counter((i, j) for own in inverse.values() for i in own for j in own if i < j)
    for (i, j), c in common.items():
        if 5 * c >= 4 * (len(sets[i]) + len(sets[j]) - c):
            links[i].add(j)
            links[j].add(i)
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return {(i, root(i), len(links[i]), len({words[j] for j in links[i]} - {w}), sum(words[j] == w for j in links[i])) for i, w in words.items()}


def near_copies(seed=5, groups=12, words=70):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(3, words))]
        for edits in (0, 0, 1, 1, 2, 3, 6):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"new{rng.randint(0, 99)}"
            rows.append((len(rows), (" " if rng.random() < 0.5 else "\n").join(own)))
    return rows + [(1000, None), (1001, ""), (1002, " . "), (1003, "lone"), (1004, "Lone!")]


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(spark, block):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as print", "2 as class_id", "array(1) as labels")
    got = {tuple(r) for r in jaccard.near_duplicates(df, block=block).collect()}
    assert got == brute(rows) and any(r[3] for r in got)
    kept = {r["doc_id"] for r in jaccard.deduplicated(df, block=block).collect()}
    assert kept == {r[1] for r in got}


def test_large_group(spark):
    """Three hundred near copies of one text, verified in many blocks, and as many equal ones."""
    rng = random.Random(8)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(150)] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {tuple(r) for r in jaccard.near_duplicates(df, block=64).collect()} == brute(rows)
    assert jaccard.deduplicated(df, block=64).count() == len({r[1] for r in brute(rows)})


def test_odd_rows(odd, none):
    rows = jaccard.near_duplicates(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["class_id"], r["n_copies"]))
    assert by[101] == by[102] == {(101, 1)} and by[0] == {(0, 0)} and by[None] == {(None, 0)}
    kept = jaccard.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[101] == 1 and ids[102] == 0 and ids[None] == 2 and ids[0] == 1 and 1 <= ids[3] <= 2
    assert jaccard.near_duplicates(none).count() == 0 and jaccard.deduplicated(none).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words here that differ a lot"), (4, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in jaccard.deduplicated(df).where("text is not null").collect()) == [(1, "a b c d e f g"), (3, "other words here that differ a lot")]


def test_classes_that_share_their_smallest_id_all_stay(spark, odd):
    a, b, c = "a b c d e f g", "other words here that differ a lot", "third text of yet another class of words"
    df = spark.createDataFrame([(7, a), (7, b), (9, b), (7, b), (8, a), (8, c), (10, c), (11, "alone with its own id in here")], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in jaccard.deduplicated(df).collect())
    assert kept == [(7, a), (7, b), (8, c), (11, "alone with its own id in here")]
    base = [f"v{i}" for i in range(100)]  # two near copies with one id are one class
    near = [" ".join(base), " ".join(base[:-1] + ["new"])]
    df = spark.createDataFrame([(7, near[0]), (7, near[1]), (9, near[1]), (7, a)], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in jaccard.deduplicated(df).collect()]
    assert len(kept) == 2 and {k for k, _ in kept} == {7} and (7, a) in kept
    assert sum(r["doc_id"] == 3 for r in jaccard.deduplicated(odd).select("doc_id").collect()) == 2


def test_prefix_is_shortened_to_the_target():
    """Level by level from the longest: near links stop it early, links at the threshold late, and a lost link too."""
    depth = lambda links, recall: jaccard.fitting_depth(links, 0.8, 24, 10, recall)[0]
    assert depth([], 0.9) == 10 and depth([], 0.9999) == 5
    assert depth([(95, 10, 100_000)], 0.9999) == 10 > depth([(80, 10, 100_000)], 0.9999)
    assert depth([(95, 10, 99_000), (95, 6, 1_000)], 0.9999) == 6
    for k in range(1, 10):
        assert jaccard.found_share(0.8, k, 24) >= jaccard.found_share(0.8, k + 1, 24)


def test_recall_targets_stop_at_different_depths(spark):
    """The whole forest: both depths come from the data, and both lose no link here."""
    rows = near_copies(groups=60)
    df, depths = spark.createDataFrame(rows, "doc_id long, text string"), []
    for recall in (0.5, 0.9999):
        report = {}
        got = {tuple(r) for r in jaccard.near_duplicates(df, recall=recall, report=report).collect()}
        depths.append(report["depth"])
        assert report["sampled_links"] > 0 and min(report["recall"], report["expected"]) >= recall
        linked = sum(r[2] for r in brute(rows))
        assert sum(r[2] for r in got) >= recall * linked
    assert depths[0] > depths[1] and got == brute(rows)


def test_shared_passages_do_not_draw_texts_together(spark):
    """Ten thousand texts that share two fifths to three fifths of their shingles, pair by pair: few pairs are verified."""
    rng, shared = random.Random(6), [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(shared + [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(30, 68))])) for i in range(10_000)]
    near = [(20_000 + i, " ".join([*t.split()[:-1], "end"])) for i, t in rows[:50]]
    report = {}
    got = jaccard.near_duplicates(spark.createDataFrame(rows + near, "doc_id long, text string").repartition(8), report=report).collect()
    assert report["links"].agg({"checked": "sum"}).first()[0] <= 10 * len(rows)
    assert {(r["doc_id"], r["class_id"]) for r in got if r["n_links"]} == {(i, i) for i in range(50)} | {(20_000 + i, i) for i in range(50)}


def test_runs_of_a_trie(spark):
    """Whatever the batches and partitions: texts that share a prefix are in one bucket, others are not."""
    rng = random.Random(2)
    labels = jaccard.Labels(3, 4)
    nodes = [(bytes([i // 256, i % 256]) * 8, labels(np.array([rng.randint(0, 6)], np.uint64) if i % 2 else np.array([i], np.uint64))) for i in range(1200)]
    df = spark.createDataFrame(nodes, "print binary, labels binary").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = defaultdict(set)
        for r in jaccard.buckets(df, 3, 4, 2).collect():
            got[r["bucket"]].add(bytes(r["print"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = defaultdict(set)
    for p, x in nodes:
        for t in range(3):
            want[t, x[8 * t : 8 * t + 4]].add(p)
    assert {frozenset(x) for x in got.values() if len(x) > 1} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_names_beside_ours(spark):
    """Columns named like anything inside change nothing."""
    names = ["_drop", "drop", "twice", "own", "row", "body", "mark", "print", "_shared", "_id", "_print", "root", "label", "rep", "part"]
    rows = near_copies(groups=4)
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for own in (df, df.unionByName(df)):
        kept = jaccard.deduplicated(own)
        assert kept.columns == own.columns and kept.dtypes == own.dtypes
        assert {r["doc_id"] for r in kept.collect()} == {r[1] for r in brute(rows)}


def test_connected(spark):
    rng = random.Random(1)
    edges = [(bytes([rng.randint(0, 5), rng.randint(0, 60)]), bytes([rng.randint(0, 5), rng.randint(0, 60)])) for _ in range(150)] + [(bytes([9, i]), bytes([9, i + 1])) for i in range(100)]
    sets = jaccard._Sets()
    for a, b in edges:
        sets.join(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {(bytes(r["node"]), bytes(r["root"])) for r in jaccard.connected(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {(x, sets.root(x)) for x in nodes}


def test_shingles_are_blocked_alike():
    words = [f"w{i % 37}é".encode() for i in range(1000)]
    whole = jaccard.shingles(words)
    assert (whole == jaccard.shingles(words, block=100)).all() and len(whole) == 996
    assert len(set(whole.tolist())) == len({tuple(words[i : i + 5]) for i in range(996)})


# --- the pipeline ----------------------------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline as P
    from docreef.llm import mixing, quality_model, quality_rules
    from docreef.llm.common import written

    docs = P.table(spark, SF, "documents")
    labels = P.table(spark, SF, "labels")
    at = docs
    frames = {}
    for name, stage in P.STAGES[:-1]:
        at = written(stage(spark, at, SF), f"test-{name}")
        assert at.columns == docs.columns
        frames[name] = at
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    first = {r["doc_id"] for r in quality_model.classify(docs, labels).where("predicted = 1").collect()}
    assert set(ids(frames["quality_classifier"])) == first
    texts = {r["doc_id"]: r["text"] for r in frames["quality_classifier"].collect()}
    second = {k for k, t in texts.items() for m in [quality_rules.Measures(t)] if not m.base_failed and not any(f(m) for _, f in quality_rules.RULES)}
    assert set(ids(frames["quality_rules"])) == second
    third = {c for _, c, *_ in brute([(k, texts[k]) for k in second])}
    assert set(ids(frames["near_duplicates"])) == third
    taken = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(frames["near_duplicates"]).collect()})
    assert ids(frames["mixing"]) == +taken
    last = P.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in last) == +taken and all(r["lossless"] for r in last)


@pytest.mark.parametrize("which", ["odd", "none", "repeated"])
def test_stages_on_odd_tables(spark, odd, none, which):
    """Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, one stage after another."""
    import corpus_pipeline as P
    from docreef.llm.common import written

    at = {"odd": odd, "none": none, "repeated": odd.unionByName(odd)}[which]
    before = at.count()
    kept = {}
    for name, stage in P.STAGES[:-1]:
        at = written(stage(spark, at, SF), f"odd-{name}")
        assert at.columns == odd.columns and at.dtypes == odd.dtypes
        kept[name] = at.count()
    assert list(kept.values())[:3] == sorted(list(kept.values())[:3], reverse=True) and kept["quality_classifier"] <= before
    last = P.STAGES[-1][1](spark, at, SF).collect()
    assert len(last) == kept["mixing"] and all(r["lossless"] for r in last)
    every = P.STAGES[-1][1](spark, odd, SF).collect()  # each stage by itself, too
    assert len(every) == odd.count() and all(r["lossless"] for r in every)
    assert P.STAGES[3][1](spark, odd, SF).columns == odd.columns and P.STAGES[2][1](spark, odd, SF).where("text is null").count() == odd.where("text is null").count()
