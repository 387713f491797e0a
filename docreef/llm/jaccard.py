"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Every text gets a fingerprint of its words and a label for each tree of the forest: a row of minima of hashes of its
   shingles, the longest prefix that the trees know. Texts with equal words are copies, one node from here on.
2. The labels of a tree, sorted, are a trie. How much of a label must match is found by shortening it, level by level,
   until the links of a hashed sample, found at a far shorter prefix and verified exactly, are found again to the target
   share, as counted and as their similarities let expect (``fitting_depth``).
3. Texts that share a prefix of that length in a tree form a bucket. Of its pairs those whose labels agree in too few
   minima for the threshold are left out; the others are the candidates. A bucket gives edges that span them, so that
   texts which only share a passage aren't drawn together.
4. Candidates that hang together come into one task, block by block, with their shingle sets; there the pairs that agree
   in enough minima and in size are verified exactly, and no others.
5. Verified links, joined into classes, give each document its class and its number of links.
"""

from __future__ import annotations

import hashlib
import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from docreef.llm.common import arrow_schema, folded_words, map_rows, sized_join, slices, written
from docreef.operators.graph import connected

#: Words of a shingle, and the least similarity of a link.
WIDTH, THRESHOLD = 5, 0.8
#: Trees of the forest, longest prefix, and target recall of the links.
TREES, LONGEST, RECALL = 24, 10, 0.9999
#: The sample for the depth: texts of one in so many first minima of the first tree; the prefix at which its links are
#: found; and how many links at the threshold itself are added to them, so that few links don't promise much.
SAMPLE, SHALLOW, PRIOR = 8, 3, 10
#: A pair at the threshold agrees in fewer minima than asked for with the chance of so many standard deviations (5e-6).
DEVIATIONS = 4.4
#: Texts of a block; candidates beyond it are compared block by block.
BLOCK = 512
#: Runs of a trie up to this size are known by their members, so that equal runs of several trees are one bucket.
SMALL_RUN = 64

_U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_LETTERS = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)

log = logging.getLogger(__name__)


def found_share(similarity, depth: int, trees: int):
    """Chance that some tree has a pair of that similarity share a prefix of ``depth`` minima."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def least_agreement(threshold: float, minima: int) -> int:
    """Minima in which two texts' labels must agree to be a candidate."""
    return max(1, math.ceil(minima * threshold - DEVIATIONS * math.sqrt(minima * threshold * (1 - threshold))))


class _Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.append(self.up, self.up * _U64(pow(_BASE, k, 2**64)))
            self.down = np.append(self.down, self.down * _U64(pow(_BACK, k, 2**64)))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def shingles(words: list[bytes], width: int = WIDTH, block: int = 100_000) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words, in order; of fewer words, one of them all."""
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    out = []
    for at in range(0, len(words) - width + 1, block):
        own = words[at : at + block + width - 1]
        raw = np.frombuffer(b" ".join(own), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        up, down = _powers(len(raw) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[raw] * up[: len(raw)])))
        first = starts[: len(own) - width + 1]
        h = (sums[ends[width - 1 :]] - sums[first]) * down[first]
        h ^= h >> _U64(33)
        h *= _U64(0xFF51AFD7ED558CCD)
        h ^= h >> _U64(29)
        out.append(h)
    return np.concatenate(out)


class Labels:
    """A text's labels: for each tree, ``length`` minima of 16 bits each, one after another, so that bytes sort as a trie."""

    def __init__(self, trees: int, length: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees, self.length = trees, length
        self.factor = rng.integers(0, 2**64, trees * length, dtype=np.uint64) | _U64(1)
        self.offset = rng.integers(0, 2**64, trees * length, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray) -> bytes:
        least = np.full(len(self.factor), 2**64 - 1, np.uint64)
        for at in range(0, len(hashes), 512):
            least = np.minimum(least, (hashes[at : at + 512, None] * self.factor + self.offset).min(0))
        return ((least * _U64(_BASE)) >> _U64(48)).astype(">u2").tobytes()  # minima are small numbers: mixed, then cut


def minima(labels: list[bytes]) -> np.ndarray:
    """A row of minima for each text."""
    return np.frombuffer(b"".join(labels), ">u2").reshape(len(labels), -1).astype(np.uint16)


def agreements(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which rows of a agree with which rows of b in ``least`` minima or more."""
    if len(a) * len(b) <= 256:
        return (a[:, None, :] == b[None, :, :]).sum(2) >= least
    counts = np.zeros((len(a), len(b)), np.uint16)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        counts += x[:, None] == y[None, :]
    return counts >= least


def signed(docs: DataFrame, width: int, trees: int, length: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print, labels): null print and labels where a text has no word."""

    def start():
        labels = Labels(trees, length)

        def row(k, t):
            words = folded_words(t)
            if not words:
                return k, None, None
            return k, hashlib.md5(b" ".join(words)).digest(), labels(shingles(words, width))

        return row

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(rows, ["doc_id", "text"], "doc_id long, print binary, labels binary", start)


class _Sets:
    """Union-find over bytes; the least member names a set."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: bytes, y: bytes) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def stars(linked: np.ndarray) -> list[tuple[int, int]]:
    """(node, least node of its connected set) of all nodes but those least ones, from a symmetric matrix."""
    out, seen = [], ~linked.any(1)
    for first in range(len(linked)):
        if not seen[first]:
            seen[first], front = True, np.array([first])
            while len(front):
                front = np.flatnonzero(linked[front].any(0) & ~seen)
                seen[front] = True
                out += [(x, first) for x in front.tolist()]
    return out


# --- the tries -------------------------------------------------------------------------------------------------------
def buckets(nodes: DataFrame, trees: int, longest: int, depth: int) -> DataFrame:
    """(bucket, print): the nodes (print, labels) that share a prefix of ``depth`` minima in a tree, a bucket each.

    Labels are range-partitioned and sorted, tree by tree, ties by print, so that a prefix which very many share is
    split. A run of few rows is named by its members, whatever its tree, so that the trees in which the same texts meet
    give one bucket; a longer run, and what a partition begins and ends with, by tree and prefix. Memory: a batch.
    """
    size = 2 * longest
    leaves = nodes.select("print", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "labels")
    leaves = leaves.select("tree", F.expr(f"substring(labels, tree * {size} + 1, {size})").alias("label"), "print")
    ordered = leaves.repartitionByRange("tree", "label", "print").sortWithinPartitions("tree", "label", "print")
    rows = ordered.select(F.xxhash64("tree", F.expr(f"substring(label, 1, {2 * depth})")).alias("run"), F.xxhash64("print").alias("mark"), "print")
    schema = arrow_schema("bucket long, print binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened, at_start = None, None, True  # rows of the run that goes on; a run that was given out in part

        def given(table: pa.Table, ends_here: bool) -> Iterator[pa.RecordBatch]:
            nonlocal at_start
            run, mark = table.column(0).to_numpy(), table.column(1).to_numpy().astype(np.uint64)
            firsts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            n = np.diff(np.append(firsts, len(run)))
            named = (n > SMALL_RUN) | (run[firsts] == opened if opened is not None else False)
            named[0] |= at_start
            named[-1] |= ends_here
            at_start = False
            mark = (mark ^ (mark >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
            sums = np.add.reduceat(mark, firsts).astype(np.int64)
            keep = np.repeat(named | (n > 1), n)
            bucket = np.repeat(np.where(named, run[firsts], sums), n)
            prints = table.column(2).combine_chunks().filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), prints], schema=schema)

        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if not table.num_rows:
                continue
            run = table.column(0).to_numpy()
            last = len(run) - int(np.argmax(run[::-1] != run[-1])) if (run != run[-1]).any() else 0  # where the last run begins
            if last:
                yield from given(table.slice(0, last), False)
                opened = None if opened != run[-1] else opened
            held = table.slice(last)
            if held.num_rows > SMALL_RUN:
                opened = run[-1]
                yield from given(held, False)
                held = None
        if held is not None and held.num_rows:
            yield from given(held, True)

    return rows.mapInArrow(run, "bucket long, print binary").distinct()


def _compared(rows: DataFrame, least: int) -> DataFrame:
    """(a, b), a > b: edges that span, within each (bucket, low, high), the pairs that agree in ``least`` minima; if low
    and high differ, of those the pairs of two blocks and two families."""
    names = ["bucket", "low", "high", "block", "print", "family", "labels"]
    schema = arrow_schema("a binary, b binary")

    def edges(prints, block, family, labels, across) -> list[tuple[bytes, bytes]]:
        m = minima(labels)
        linked = agreements(m, m, least)
        np.fill_diagonal(linked, False)
        if across:
            family = np.unique(family, return_inverse=True)[1]
            linked &= (block[:, None] != block[None, :]) & (family[:, None] != family[None, :])
        return [(max(prints[x], prints[y]), min(prints[x], prints[y])) for x, y in stars(linked)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            held = table
            if not table.num_rows:
                continue
            unit = np.stack([table.column(i).to_numpy() for i in range(3)])
            firsts = np.flatnonzero(np.concatenate(([True], (unit[:, 1:] != unit[:, :-1]).any(0))))
            for at, end in zip(firsts.tolist(), firsts[1:].tolist()):
                own = table.slice(at, end - at)
                out += edges(own.column(4).to_pylist(), own.column(3).to_numpy(), own.column(5).to_pylist(), own.column(6).to_pylist(), unit[1, at] != unit[2, at])
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], schema=schema)
                    out = []
            held = table.slice(int(firsts[-1]))
        if held is not None and held.num_rows:
            out += edges(held.column(4).to_pylist(), held.column(3).to_numpy(), held.column(5).to_pylist(), held.column(6).to_pylist(), held.column(1)[0] != held.column(2)[0])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], schema=schema)

    dealt = rows.select(*names).repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def families(nodes: DataFrame, trees: int, longest: int, depth: int, least: int, block: int) -> DataFrame:
    """(node, root): the nodes that candidates connect, of pairs that share a prefix and agree in ``least`` minima.

    A bucket of more than ``block`` nodes is compared block by block, blocks dealt by another hash in every bucket: first
    each block by itself, then, where a bucket has nodes of several families, its blocks with one another, without the
    pairs within a family. So a large group of near copies, which its blocks connect already, is not compared in all
    its pairs.
    """
    members = written(buckets(nodes, trees, longest, depth), "jaccard-members")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / block).alias("blocks"))
    sizes = written(sizes, "jaccard-buckets", few=True)
    rows = sized_join(members, sizes, "bucket", "inner").withColumn("block", F.pmod(F.xxhash64("bucket", "print"), F.col("blocks")))
    rows = written(rows.join(nodes.select("print", "labels"), "print"), "jaccard-rows")
    alone = rows.select("bucket", F.col("block").alias("low"), F.col("block").alias("high"), "block", "print", F.lit(None).cast("binary").alias("family"), "labels")
    found = connected(_compared(alone, least))
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return found
    known = sized_join(large, found, large["print"] == found["node"], "left").select(*rows.columns, F.coalesce("root", "print").alias("family"))
    mixed = known.groupBy("bucket").agg(F.min("family").alias("x"), F.max("family").alias("y")).where("x <> y").select("bucket")
    known = sized_join(known, mixed, "bucket", "left_semi")
    across = known.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block")
    across = across.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "print", "family", "labels")
    return connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_compared(across, least)))


# --- exact verification ----------------------------------------------------------------------------------------------
def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sorted sets have in common."""
    m = len(sets)
    sizes = [len(s) for s in sets]
    out = np.zeros((m, m), np.int64)
    _, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(m), sizes)
    on = times[where] > 1
    owner, column = owner[on], shared[where[on]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(256, (1 << 22) // m)
    for low in range(0, int(shared[-1]) + 1, step):
        a, b = np.searchsorted(column, (low, low + step))
        part = np.zeros((m, step), np.float32)  # counts up to step are exact in 32 bits
        part[owner[a:b], column[a:b] - low] = 1
        out += (part @ part.T).astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out


@dataclass
class Verifier:
    """Exact verification of the candidates among the rows of one task."""

    threshold: float
    least: int
    trees: int
    longest: int

    def links(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, common, total, linked) of every candidate i < j: agreeing labels, sizes that allow the threshold, and,
        if the rows are of two blocks, one of each."""
        share = Fraction(str(self.threshold))
        own, block = minima(pdf["labels"].tolist()), pdf["block"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        size = np.array([len(s) for s in sets])
        may = np.triu(agreements(own, own, self.least), 1)
        may &= size[:, None] * share.denominator >= share.numerator * size[None, :]
        may &= size[None, :] * share.denominator >= share.numerator * size[:, None]
        if pdf["low"].iloc[0] != pdf["high"].iloc[0]:  # within a block, the block's own task counts
            may &= block[:, None] != block[None, :]
        i, j = np.nonzero(may)
        if len(i) > 8 * len(sets):
            common = common_counts(sets)[i, j]
        else:
            common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
        total = size[i] + size[j] - common
        return i, j, common, total, common * share.denominator >= share.numerator * total

    def counted(self, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("print").sort_values("print", ignore_index=True)
        prints, copies, m = pdf["print"].tolist(), pdf["n"].to_numpy(np.int64), len(pdf)
        i, j, _, _, linked = self.links(pdf)
        checked = np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
        i, j = i[linked], j[linked]
        texts = np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
        docs = (np.bincount(i, copies[j], m) + np.bincount(j, copies[i], m)).astype(np.int64)
        sets_ = _Sets()
        for x, y in zip(i.tolist(), j.tolist()):
            sets_.join(prints[x], prints[y])
        some = np.flatnonzero(checked)
        return pd.DataFrame({"print": [prints[k] for k in some], "texts": texts[some], "docs": docs[some], "checked": checked[some], "root": [sets_.root(prints[k]) for k in some]})

    def sampled(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """(percent, deep, links): how many links have that similarity, rounded down, and share a prefix of that length
        in the trees but the first."""
        pdf = pdf.drop_duplicates("print").reset_index(drop=True)
        own = minima(pdf["labels"].tolist()).reshape(len(pdf), self.trees, self.longest)[:, 1:]
        i, j, common, total, linked = self.links(pdf)
        out = {}
        for at in range(0, len(i), 4096):
            k = slice(at, at + 4096)
            x, y, on = i[k], j[k], linked[k]
            deep = np.cumprod(own[x] == own[y], axis=2).sum(2).max(1, initial=0)
            for key in zip((100 * common[k] // total[k])[on].tolist(), deep[on].tolist()):
                out[key] = out.get(key, 0) + 1
        return pd.DataFrame([(*k, n) for k, n in out.items()], columns=["percent", "deep", "links"]).astype("int64")


def verified(docs: DataFrame, candidates: DataFrame, width: int, verifier: Verifier, block: int, key: str, text: str, sample: bool = False) -> DataFrame:
    """What ``Verifier.counted`` (or ``sampled``) tells of candidates (print, part, rep, n): rep is a document with that
    print, n how many have it. Each text is read and brought to its family once, in blocks."""
    sizes = candidates.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = candidates.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")))
    rows = written(rows.select("print", "part", "rep", "n", "block", "blocks"), "jaccard-candidates")
    own = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    with_text = sized_join(own.alias("d"), rows.alias("c"), F.expr("d.rep <=> c.rep"), "inner").select("text", "print", "part", "n", "block", "blocks")
    trees, longest = verifier.trees, verifier.longest

    def start():
        labels = Labels(trees, longest)

        def row(t, mark, part, n, block, blocks):
            words = folded_words(t)
            if hashlib.md5(b" ".join(words)).digest() != mark:  # another document with the same id
                return mark, part, n, block, blocks, None, None
            own = shingles(words, width)
            return mark, part, n, block, blocks, np.unique(own).tobytes(), labels(own)

        return row

    sets = map_rows(with_text, with_text.columns, "print binary, part binary, n long, block long, blocks long, shingles binary, labels binary", start)
    sets = sets.where("shingles is not null")
    tasks = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "print", "n", "block", "shingles", "labels"
    )
    unit = tasks.groupBy("part", "low", "high")
    if sample:
        return unit.applyInPandas(lambda pdf: verifier.sampled(pdf), "percent long, deep long, links long")
    return unit.applyInPandas(lambda pdf: verifier.counted(pdf), "print binary, texts long, docs long, checked long, root binary")


def fitting_depth(links: list[tuple[int, int, int]], threshold: float, trees: int, longest: int, recall: float) -> tuple[int, float, float]:
    """(depth, counted, expected): the longest prefix at which the sample's links (percent, deep, number) are found again
    to the share ``recall``, shortening it level by level from the longest.

    counted: the share of links that share it in the trees but the first, whose minima chose the sample; expected: what
    their similarities let expect of all trees, PRIOR links at the threshold added. A link is sampled with its
    similarity as chance, so it weighs the inverse.
    """
    weight = np.array([n / max(p / 100, 0.01) for p, _, n in links], float)
    near, deep = np.array([max(p / 100, threshold) for p, _, _ in links], float), np.array([d for _, d, _ in links], int)
    for depth in range(longest, 0, -1):
        counted = float(weight[deep >= depth].sum() / weight.sum()) if len(links) and trees > 1 else 1.0
        expected = float((weight @ found_share(near, depth, trees) + PRIOR * found_share(threshold, depth, trees)) / (weight.sum() + PRIOR))
        if min(counted, expected) >= recall:
            break
    return depth, counted, expected


def grouped(
    docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL,
    block: int = BLOCK, key: str = "doc_id", text: str = "text", report: dict | None = None,
):
    """(signatures, groups): (doc_id, print) of all documents, and of each print its n (documents with it), least
    (their smallest id), root (a print that names its class), class_id (the class's smallest id, which other classes
    may share where ids repeat), texts and docs (links to other texts, and the documents those are).

    report gets the depth that the forest came to, the sample's recall there, and links, a table with the pairs that
    were verified (checked) a print."""
    verifier = Verifier(threshold, least_agreement(threshold, trees * longest), trees, longest)
    signs = written(signed(docs, width, trees, longest, key, text), "jaccard-signs")
    some = signs.where("print is not null")
    nodes = some.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.first("labels").alias("labels"))
    nodes = written(nodes, "jaccard-nodes")

    def checked(own: DataFrame, depth: int, sample: bool) -> DataFrame:
        parts = families(own, trees, longest, depth, verifier.least, block)
        candidates = nodes.select("print", "n", "least").join(parts, F.col("print") == F.col("node")).select("print", F.col("root").alias("part"), F.col("least").alias("rep"), "n")
        return verified(docs, candidates, width, verifier, block, key, text, sample)

    shallow = checked(nodes.where(F.pmod(F.xxhash64(F.expr("substring(labels, 1, 2)")), F.lit(SAMPLE)) == 0), min(SHALLOW, longest), True)
    found = shallow.groupBy("percent", "deep").agg(F.sum("links").alias("links")).collect()  # at most 101 x (longest + 1) rows
    depth, counted, expected = fitting_depth([tuple(r) for r in found], threshold, trees, longest, recall)
    log.info("prefixes of %d minima: recall of %d sampled links %.5f, expected %.5f", depth, sum(r["links"] for r in found), counted, expected)
    pairs = written(checked(nodes, depth, False), "jaccard-links")
    if report is not None:
        report |= {"depth": depth, "sampled_links": sum(r["links"] for r in found), "recall": counted, "expected": expected, "links": pairs}
    links = pairs.where("texts > 0")
    roots = connected(links.select(F.col("print").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("print").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    member = nodes.select("print", "n", "least").join(roots, F.col("print") == F.col("node")).select("print", "n", "least", "root")
    names = written(member.groupBy("root").agg(F.min("least").alias("class_id")), "jaccard-names", few=True)
    linked = written(sized_join(member, names, "root", "inner").join(counts, "print").select("print", "root", "class_id", "texts", "docs"), "jaccard-classes", few=True)
    groups = nodes.select("print", "n", "least").join(linked, "print", "left").select(
        "print", "n", "least", F.coalesce("root", "print").alias("root"), F.coalesce("class_id", "least").alias("class_id"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs")
    )
    # written, so that joins with documents are of two plain shuffles, of which Spark can split a print with many copies
    return signs.select("doc_id", "print"), written(groups, "jaccard-groups", few=True)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, class_id (the smallest doc_id among the documents that links connect), n_links (other
    documents at least ``threshold`` similar, copies included), n_texts (other word sequences among them), n_copies
    (other documents with the same words).

    Words are folded as for license scans; a text of fewer words than a shingle is one shingle. Edge cases: a text
    without words (null, empty) is a class of its own without links; a null doc_id is no smallest id, and a class
    without any other has a null class_id; repeated rows are copies; no rows give no rows; other columns are not read.
    """
    signs, groups = grouped(docs, **options)
    return signs.join(groups, "print", "left").select(
        "doc_id",
        F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("docs") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_copies"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without those whose class has another representative, all columns unchanged, whatever their names.

    A class is represented by its document of smallest id; of several texts of a class with that id, by the one of least
    print, and of equal rows by one. Rows without words all stay, as do rows without an id; very long texts are read
    whole; no rows give no rows. Rows to drop are found by id, so texts are not shuffled while those fit a broadcast. An
    id that several rows with words share is decided by a further pass over the rows with such ids alone.
    """
    signs, groups = grouped(docs, key=key, text=text, **options)
    rows = written(signs.join(groups.select("print", "root", "class_id"), "print").where("doc_id is not null").select("doc_id", "print", "root", "class_id"), "jaccard-rows", few=True)
    shared = written(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "jaccard-shared", few=True)
    drop = rows.where("doc_id <> class_id").select("doc_id").distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("own"), F.col(text).alias("body"))  # no name of docs beside ours
    if shared.isEmpty():
        return sized_join(packed, drop.withColumnRenamed("doc_id", "drop"), F.col("own") == F.col("drop"), "left_anti").select("row.*")
    twice = shared.withColumnRenamed("doc_id", "twice")
    drop = drop.join(shared, "doc_id", "left_anti").withColumnRenamed("doc_id", "drop")
    single = sized_join(sized_join(packed, twice, F.col("own") == F.col("twice"), "left_anti"), drop, F.col("own") == F.col("drop"), "left_anti").select("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = [hashlib.md5(b" ".join(w)).digest() if (w := folded_words(t)) else None for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary())], names=["row", "own", "mark"])

    marked = sized_join(packed, twice, F.col("own") == F.col("twice"), "left_semi").mapInArrow(run, StructType([packed.schema["row"], packed.schema["own"], StructField("mark", BinaryType())]))
    # by root: classes whose smallest id is the same are told apart
    stays = rows.where("doc_id = class_id").groupBy("root").agg(F.min("print").alias("print"), F.first("doc_id").alias("doc_id")).drop("root")
    one = marked.join(stays, (F.col("own") == F.col("doc_id")) & (F.col("mark") == F.col("print"))).select("row", "own", "mark")
    one = one.dropDuplicates(["own", "mark"]).select("row")
    return single.unionByName(one).unionByName(marked.where("mark is null").select("row")).select("row.*")
