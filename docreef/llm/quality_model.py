"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations,
isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreef.llm.common import fold_of, map_rows, slices, written
from docreef.llm.quality_rules import Measures

#: Most labelled rows that a model is fitted on. Beyond it, those with the smallest hashes are taken.
FIT_ROWS = 200_000

_BREAKS = (".", ",", "!", "?", ";", ":")


def statistics(text: str | None) -> list[float]:
    """Numbers of a whole text that do not depend on its language's words, all of moderate size."""
    m = Measures(text)
    n, chars, length = m.n_words, m.word_chars, len(m.text)
    if n == 0:
        return [0.0] * N_STATISTICS
    lines, ids = m.lines, m.ids
    sizes = np.fromiter(map(len, m.words), np.int64, n)
    kinds = len(m.kinds)
    same = int(np.count_nonzero(ids[1:] == ids[:-1]))
    marks = [m.text.count(c) for c in _BREAKS]
    ascii_words = m.n_with(bytes.isalpha)
    line_words = n / len(lines)
    return [
        np.log1p(n), np.log1p(length), chars / n / 10, float(sizes.std()) / 10, float(sizes.max()) ** 0.5 / 10,
        kinds / n, np.log1p(kinds) / np.log1p(n), same / n, m.top_word / n, m.n_repeat_words / n,
        m.n_stop_words / n, m.n_symbols / n, m.n_digits / chars, m.n_lettered / n, ascii_words / n,
        (marks[0] + marks[2] + marks[3]) / n, marks[1] / n, (marks[4] + marks[5]) / n,
        len(lines) / n, np.log1p(line_words), m.n_dup_lines / len(lines),
        float((sizes == 1).mean()), float((sizes > 14).mean()), m.n_with(bytes.istitle) / n,
    ]


N_STATISTICS = 24


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats) in one narrow pass over whole texts."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(rows, ["doc_id", "text"], "doc_id long, stats array<double>", lambda: lambda k, t: (k, statistics(t)))


@dataclass
class Model:
    """A score from 0 to 1 of a block of statistics."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    steps_x: np.ndarray
    steps_y: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        phi = np.sqrt(2 / self.waves.shape[1]) * np.cos(z @ self.waves + self.shifts)
        return np.hstack([phi, z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps_x, self.steps_y)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending step function nearest to (x, y) in least squares, as its blocks' ends and values."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    firsts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))  # equal scores are one point
    n = np.diff(np.append(firsts, len(x))).astype(float)
    y, x = np.add.reduceat(y, firsts) / n, x[firsts]
    blocks: list[list[float]] = []  # value, weight, first x, last x
    for v, w, at in zip(y, n, x, strict=True):
        blocks.append([v, w, at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, end = blocks.pop()
            last = blocks[-1]
            last[0], last[1], last[3] = (last[0] * last[1] + v2 * w2) / (last[1] + w2), last[1] + w2, end
    xs = np.array([b for block in blocks for b in (block[2], block[3])])
    ys = np.array([block[0] for block in blocks for _ in (0, 1)])
    return xs, ys


def labelled(labels: DataFrame, name: str, parts: int, held: int, key: str = "doc_id", most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, label) of the rows to learn from: not held out, label 0 or 1, one row a document (repeated: the mean
    rounded up), at most ``most`` by hash. The bound holds before the rows meet the corpus."""
    rows = labels.where(F.col(key).isNotNull() & F.col(name).isin(0, 1) & (fold_of(key, parts) != held))
    one = rows.groupBy(F.col(key).cast("long").alias("doc_id")).agg((F.avg(F.col(name)) >= 0.5).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(stats: DataFrame, learn: DataFrame, n_waves: int = 300, ridge: float = 1e-3, width: float = 0.12, seed: int = 7, tasks: int = 16) -> Model | None:
    """A model of rows (doc_id, stats) and labels (doc_id, label); None without labels of both kinds.

    A fifth of the rows (by hash) calibrates, the rest fits. ``width`` scales the Gaussian kernel's frequencies.
    Every task sums its own normal equations; the driver adds at most ``tasks`` of them, and of the calibrating rows
    it gets two numbers each.
    """
    rows = stats.join(learn, "doc_id").select("stats", F.col("label").cast("double").alias("label"), (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)) == 0).alias("hold"), F.xxhash64("doc_id").alias("h"))
    rows = written(rows, "quality-fit")
    base = rows.where("not hold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"),
        *[f(F.col("stats")[i]).alias(f"{a}{i}") for i in range(N_STATISTICS) for a, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    if not base["n"] or base["ones"] in (0, base["n"]):
        return None
    rng = np.random.default_rng(seed)
    model = Model(
        mean=np.array([base[f"m{i}"] for i in range(N_STATISTICS)]),
        scale=np.array([max(base[f"s{i}"] or 0.0, 1e-6) for i in range(N_STATISTICS)]),
        waves=rng.normal(0, width, (N_STATISTICS, n_waves)), shifts=rng.uniform(0, 2 * np.pi, n_waves),
        weights=np.zeros(n_waves + N_STATISTICS + 1), steps_x=np.zeros(1), steps_y=np.zeros(1),
    )
    d = len(model.weights)
    ones = base["ones"] / base["n"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                y = batch.column(1).to_numpy(zero_copy_only=False)
                phi = model.features(np.array(batch.column(0).to_pylist()))
                w = np.where(y > 0, 0.5 / ones, 0.5 / (1 - ones))  # both labels weigh the same
                gram += (phi * w[:, None]).T @ phi
                moment += phi.T @ (w * (2 * y - 1))
        yield pa.RecordBatch.from_pydict({"gram": [gram.ravel()], "moment": [moment]}, schema=pa.schema([("gram", pa.list_(pa.float64())), ("moment", pa.list_(pa.float64()))]))

    parts = rows.where("not hold").select("stats", "label").coalesce(tasks).mapInArrow(sums, "gram array<double>, moment array<double>").collect()
    gram = np.sum([np.array(p["gram"]) for p in parts], axis=0).reshape(d, d)
    moment = np.sum([np.array(p["moment"]) for p in parts], axis=0)
    model.weights = np.linalg.solve(gram + ridge * base["n"] * np.diag([*[1.0] * (d - 1), 1e-6]), moment)
    held = np.array([[*r["stats"], r["label"]] for r in rows.where("hold").select("stats", "label").collect()])
    if not len(held):
        held = np.array([[*model.mean, ones]])
    raw, y = model.raw(held[:, :-1]), held[:, -1]
    # a row of each label beyond either end keeps the ends off 0 and 1
    model.steps_x, model.steps_y = isotonic(np.concatenate((raw, [raw.min(), raw.max()])), np.concatenate((y, [0.5, 0.5])))
    return model


def scored(stats: DataFrame, model: Model | None, parts: int, held: int, threshold: float = 0.7) -> DataFrame:
    ddl = "doc_id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist())
                y = np.full(len(x), 0.5) if model is None else np.clip(model.scores(x), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y)], names=["doc_id", "score"])

    out = stats.select("doc_id", "stats").mapInArrow(run, ddl)
    return out.select("doc_id", (fold_of("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = 0.7, name: str = "quality", **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Texts are read once, for their statistics; labels are learned only from rows whose fold is not ``held``, and no
    other column enters a score. Edge cases: a null or empty text has statistics of 0 and a score like any other; a
    null doc_id is scored and never learned from; repeated rows are scored each; null labels and labels but 0 and 1
    are not learned from; without labels of both kinds every score is 0.5; no rows give no rows.
    """
    stats = written(with_statistics(docs), "quality-stats")
    model = fit(stats, labelled(labels, name, parts, held), **options)
    return scored(stats, model, parts, held, threshold)


def accepted(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = 0.7, name: str = "quality", **options) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns unchanged, whatever their names; the texts are not shuffled.

    It learns from the statistics of the labelled rows alone, at most FIT_ROWS; then one pass measures and judges each text.
    Edge cases: as of ``classify``; without labels of both kinds nothing is known against a row, and all stay; a null or
    empty text is judged by statistics of 0.
    """
    learn = written(labelled(labels, name, parts, held), "quality-labels").select(F.col("doc_id").alias("known"), "label")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(learn.select("known")), F.col("doc_id") == F.col("known"), "left_semi")
    model = fit(with_statistics(own), learn.withColumnRenamed("known", "doc_id"), **options)  # a bounded number of ids
    if model is None:
        return docs
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = model.scores(np.array([statistics(t) for t in batch.column(place).to_pylist()]))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
