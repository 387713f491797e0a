"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers in numpy are trained from confirmed toxic texts and unlabelled ones, with the class prior's
correction of the risk (Kiryo et al. 2017): prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)]).

All documents outside the held-out fold are the unlabelled ones: every task trains a classifier from each block of its
own and the positives, and the model is the mean of the classifiers, weighted by their rows. The prior is the least
bound that a feature sets on it: what share of all texts have the feature, over that of the positives.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreef.llm.common import arrow_schema, fold_of, folded_words, map_rows, slices, written

#: Most positive texts to learn from (labelled rows, by hash), features to choose from, and features of a classifier.
POSITIVES, CANDIDATES, FEATURES = 2_000, 20_000, 1_024
#: Unlabelled texts that a classifier is trained from; a task with more trains more of them.
BLOCK = 4_096
#: Highest rate of a feature, in training and in scores: a word again and again says no more.
HIGHEST = 10.0
#: Bytes of a word by which most words are told to have no feature.
HEAD = 4
#: Prefixes of these numbers of characters are features beside whole words.
PREFIXES = (4, 5, 6, 7)


def word_features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    return ["=" + w, *[w[:k] for k in PREFIXES if len(w) >= k]]


def heads(features: Iterable[str]) -> frozenset[bytes]:
    """First bytes of the words that can have a feature: a word with another beginning has none of them."""
    return frozenset(f.removeprefix("=").encode()[:HEAD] for f in features)


def text_words(text: str | None) -> list[bytes]:
    return folded_words((text or "").lower())


def frequencies(rows: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """(feature, n): how many of the texts have each feature. Every task counts its own before the shuffle."""

    begin = None if only is None else heads(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                words = set(text_words(text))
                if begin is not None:
                    words = [w for w in words if w[:HEAD] in begin]
                own = {f for w in words for f in word_features(w)}
                counts.update(own if only is None else own & only)
        names = list(counts)
        for at in range(0, len(names), 20_000):
            block = names[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.string()), pa.array([counts[x] for x in block], pa.int64())], names=["feature", "n"])

    return rows.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """How many of n_pos positive and n_all texts have each feature."""

    n_pos: int
    n_all: int
    pos: dict[str, int]
    all: dict[str, int]

    def excess(self, f: str) -> float:
        p, q = self.pos[f] / self.n_pos, (self.all.get(f, 0) + 0.5) / (self.n_all + 1)
        return 0.0 if p <= q else self.n_pos * (p * np.log(p / q) + (1 - p + 1e-9) * np.log((1 - p + 1e-9) / (1 - q)))

    def chosen(self, most: int) -> list[str]:
        """Features more frequent in positive texts than in all, those with the clearest excess first."""
        ranked = sorted(((self.excess(f), f) for f in self.pos), key=lambda x: (-x[0], x[1]))
        return [f for e, f in ranked[:most] if e > 3.84 / 2]

    def prior(self) -> float:
        """The share of positives among all texts, from above: it times the share of positives that have a feature is at
        most the share of all texts that have it. The least of these bounds, two standard errors up, between 0.001 and 0.5."""
        bounds = [
            (u + 1) / (self.n_all + 1) * self.n_pos / p * (1 + 2 * (1 / (u + 1) + 1 / p) ** 0.5)
            for f, p in self.pos.items() for u in [self.all.get(f, 0)] if 10 * p >= self.n_pos
        ]
        return float(np.clip(min(bounds, default=0.1), 1e-3, 0.5))


def counted(positive: DataFrame, corpus: DataFrame, least: int = 3, candidates: int = CANDIDATES) -> Counts:
    """Counts of the most frequent features of the positive texts, at most ``candidates``, over all rows of both."""
    n_pos, n_all = positive.count(), corpus.count()
    if not n_pos or not n_all:
        return Counts(n_pos, n_all, {}, {})
    top = frequencies(positive).where(F.col("n") >= least).orderBy(F.desc("n"), "feature").limit(candidates)
    pos = {r["feature"]: r["n"] for r in top.collect()}
    return Counts(n_pos, n_all, pos, {r["feature"]: r["n"] for r in frequencies(corpus, frozenset(pos)).collect()})


class Vectors:
    """Texts to rates of the chosen features per hundred words, HIGHEST at most; a word's features are looked up once a
    task."""

    def __init__(self, features: list[str]):
        self.place = {f: i for i, f in enumerate(features)}
        self.heads = heads(features)
        self.memory: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[list[int], list[float]]:
        words = text_words(text)
        counts: Counter[int] = Counter()
        memory, begin = self.memory, self.heads
        for w in [w for w in words if w[:HEAD] in begin]:
            own = memory.get(w)
            if own is None:
                if len(memory) > 500_000:
                    memory.clear()
                own = memory[w] = tuple(self.place[f] for f in word_features(w) if f in self.place)
            for i in own:
                counts[i] += 1
        per = 100 / (len(words) + 20)
        return list(counts), [min(c * per, HIGHEST) for c in counts.values()]


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    bias: float

    def scorer(self):
        vectors, weights, bias = Vectors(self.features), self.weights, self.bias

        def score(text: str | None) -> float:
            at, rates = vectors(text)
            g = bias + sum(weights[i] * r for i, r in zip(at, rates))
            return float(1 / (1 + np.exp(-np.clip(g, -40, 40))))

        return score


class Rows:
    """Sparse rows in three flat arrays, with a weight each."""

    def __init__(self, rows: list[tuple[list[int], list[float]]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
        self.at = np.array([i for at, _ in rows for i in at], np.int64)
        self.value = np.array([x for _, rates in rows for x in rates], float)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], self.n)

    def back(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * d[self.row], self.width)


def nn_pu(pos: Rows, unl: Rows, share_p: np.ndarray, share_u: np.ndarray, prior: float, rounds: int = 250, rate: float = 0.1, penalty: float = 2e-4) -> tuple[np.ndarray, float]:
    """A linear classifier of least non-negative PU risk (logistic loss), by Adam over all rows.

    share_p, share_u: the rows' weights, summing to 1.
    """
    w = np.zeros(pos.width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        gp, gu = pos.times(w) + w[-1], unl.times(w) + w[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -40, 40))), 1 / (1 + np.exp(-np.clip(gu, -40, 40)))
        negative = share_u @ np.logaddexp(0, gu) - prior * (share_p @ np.logaddexp(0, gp))
        if negative >= 0:
            dp, du = -prior * share_p, share_u * su  # the positive part's and the corrected negative part's, added up
        else:  # the negative part is overfitted: climb it back to 0
            dp, du = prior * share_p * sp, -share_u * su
        grad = np.append(pos.back(dp) + unl.back(du), dp.sum() + du.sum())
        grad[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def confirmed(docs: DataFrame, labels: DataFrame, name: str, parts: int, held: int, most: int = POSITIVES) -> DataFrame:
    """(text) of rows labelled 1 outside the held-out fold: at most ``most``, those with the smallest hashes."""
    known = labels.where(F.col("doc_id").isNotNull() & (F.col(name) == 1) & (fold_of("doc_id", parts) != held))
    ids = known.select(F.col("doc_id").cast("long").alias("positive_id")).distinct().orderBy(F.xxhash64(F.lit("sample"), "positive_id"), "positive_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(own.join(F.broadcast(ids), F.col("doc_id") == F.col("positive_id")).select("text"), "toxic-positives")  # at most ``most`` numbers


def fit(positive: DataFrame, corpus: DataFrame, prior: float | None = None, block: int = BLOCK, features: int = FEATURES, **options) -> Model | None:
    """The mean of the classifiers of all blocks of the corpus; None without positives.

    corpus: the documents that may be learned from, all of them unlabelled. Memory of a task: the positives and a block.
    """
    counts = counted(positive, corpus, **options)
    chosen = counts.chosen(features)
    if not chosen:
        return None
    prior = counts.prior() if prior is None else prior
    rows = map_rows(positive, ["text"], "at array<int>, rates array<double>", lambda: Vectors(chosen))
    pos = [(r["at"], r["rates"]) for r in rows.collect()]  # bounded: at most FEATURES numbers of each of POSITIVES rows
    width = len(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, own, total, n = Vectors(chosen), [], np.zeros(width + 1), 0
        positives = Rows(pos, width)

        def trained() -> np.ndarray:
            w, b = nn_pu(positives, Rows(own, width), np.full(len(pos), 1 / len(pos)), np.full(len(own), 1 / len(own)), prior)
            return np.append(w, b) * len(own)

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                own.append(vectors(text))
                if len(own) == block:
                    total, n, own = total + trained(), n + len(own), []
        if own:
            total, n = total + trained(), n + len(own)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [total]}, schema=arrow_schema("n long, sums array<double>"))

    parts = corpus.select("text").mapInArrow(run, "n long, sums array<double>")
    parts = parts.select("n", F.posexplode("sums").alias("at", "x"))  # summed as decimals: alike in any order
    mean = parts.groupBy("at").agg((F.sum(F.col("x").cast("decimal(38,12)")).cast("double") / F.sum("n")).alias("w")).collect()
    weights = np.zeros(width + 1)
    for r in mean:
        weights[r["at"]] = r["w"]
    return Model(chosen, weights[:-1], float(weights[-1]))


def classify(
    docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, threshold: float = 0.7, name: str = "toxic",
    prior: float | None = None, positives: int = POSITIVES, **options,
) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    prior: the share of toxic documents among all; unless given, ``Counts.prior`` bounds it from all documents outside
    the held-out fold, so it doesn't matter how many of the labelled rows are toxic. Edge cases: a null or empty text
    has no words and is scored like any other; a null doc_id is scored and never learned from; repeated rows are scored
    each; labels but 1 are not learned from; without positives every score is 0.05; no rows give no rows; no column
    but the text enters a score. Whole texts are read.
    """
    corpus = docs.where(F.col("doc_id").isNotNull() & (fold_of("doc_id", parts) != held))
    model = fit(confirmed(docs, labels, name, parts, held, positives), corpus, prior, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def start():
        score = (lambda text: 0.05) if model is None else model.scorer()
        return lambda doc_id, text: (doc_id, score(text))

    out = map_rows(rows, ["doc_id", "text"], "doc_id long, score double", start)
    return out.select("doc_id", (fold_of("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
