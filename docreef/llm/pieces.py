"""SentencePiece encoding by sampling, and its lossless inverse.

A text's segmentation is drawn from the lattice of all pieces of a SentencePiece vocabulary: forward filtering sums the
weight of every prefix, backward sampling draws a path. The draws come from the row's key, so a row is always cut alike.
A piece of rank r (the vocabulary's order of merges) weighs (r + 3) ** -alpha.

Text is not normalised: a leading space is added as the vocabulary expects and taken off again, spaces become U+2581, and
what the vocabulary lacks, a literal U+2581 included, is written as byte pieces. So every text comes back as it was.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreef.llm.common import arrow_schema, map_rows, row_blocks

MARK = "▁"
#: Characters of the texts that are cut together; a longer text is a block of its own.
BLOCK_CHARS = 400_000
#: No piece goes on after a mark's left side or across a line feed, so a path is a path of each unit.
_UNITS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

_U64 = np.uint64


def _uniform(seeds: np.ndarray) -> np.ndarray:
    """Numbers from 0 to below 1 with 24 bits, by the splitmix64 finaliser."""
    z = seeds * _U64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U64(27))) * _U64(0x94D049BB133111EB)
    return ((z ^ (z >> _U64(31))) >> _U64(40)).astype(np.float32) * np.float32(2.0**-24)


class _Table:
    """Pieces by a 64-bit hash of their characters, with open addressing."""

    BASE, SPREAD = 0x100000001B3, 0x9E3779B97F4A7C15

    def __init__(self, pieces: dict[str, int], bits: int = 21):
        self.shift, self.mask = 64 - bits, (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        taken: set[int] = set()
        for piece, number in pieces.items():
            h = 0
            for c in map(ord, piece):  # step(), in Python's own integers
                h = (h * self.BASE + (c + 0x9E37) * 0xC2B2AE3D27D4EB4F) % 2**64
            at = h * self.SPREAD % 2**64 >> self.shift
            while at in taken:
                at = (at + 1) & self.mask
            taken.add(at)
            self.keys[at], self.values[at] = h, number

    def step(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return h * _U64(self.BASE) + (c + _U64(0x9E37)) * _U64(0xC2B2AE3D27D4EB4F)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = ((h * _U64(self.SPREAD)) >> _U64(self.shift)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == h, self.values[at], np.int32(-1))
        left = np.flatnonzero((found != h) & (found != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == h[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != 0)]
        return out


class Pieces:
    """A vocabulary with its lattice. Many units are filtered and sampled at once, position by position."""

    def __init__(self, model: str, alpha: float = 1.0, seed: int = 0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.seed = seed
        self.weights = np.zeros(sp.vocab_size())
        self.number: dict[str, int] = {}
        self.surface: list[bytes] = []
        self.byte_number = np.zeros(256, np.int32)
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_number[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
                self.number[piece] = i
                rank = -sp.get_score(i) if sp.get_score(i) > -1e8 else sp.vocab_size()
                self.weights[i] = (rank + 3.0) ** -alpha
        #: of a character that the vocabulary lacks, written as byte pieces
        self.lacking = (sp.vocab_size() + 3.0) ** -alpha
        self.longest = max(map(len, self.number))
        #: longest unit whose paths' weights are sure to be numbers; longer ones are filtered alone, with rescaling, and
        #: drawn from another stream of the same distribution
        self.short = max(8, int(280 / (alpha * np.log10(sp.vocab_size() + 3))))
        self.table = _Table(self.number)

    def _bytes_of(self, text: str) -> np.ndarray:
        return self.byte_number[np.frombuffer(text.encode(), np.uint8)]

    def _lattice(self, units: list[str]):
        """Of units in descending order of length: starts, code points, piece at (length, first character), and the
        cumulative shares of the last piece's lengths at every place. Forward filtering."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        n, longest = len(points), min(self.longest, int(sizes[0]) if len(sizes) else 0)
        left = np.repeat(starts + sizes, sizes) - np.arange(n)  # characters to the end of the unit
        pieces = np.full((longest, n), -1, np.int32)
        wide = points.astype(np.uint64)
        h = np.zeros(n, np.uint64)
        at = np.arange(n)
        for size in range(1, longest + 1):
            if size > 1:
                on = left[at] >= size
                at, h = at[on], h[on]
            h = self.table.step(h, wide[at + size - 1])
            pieces[size - 1, at] = self.table.find(h)
        weights = np.append(self.weights, 0.0)
        cumulative = np.ones((n, longest), np.float32)
        sums = np.zeros(n)
        ascending = -sizes  # units are sorted by length, longest first
        for k in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            end = starts[: np.searchsorted(ascending, -k, "right")] + k - 1
            total, upto = np.zeros(len(end)), []
            for size in range(1, min(k, longest) + 1):
                own = pieces[size - 1, end - size + 1]
                w = weights[own]
                if size == 1:
                    w = np.where(own < 0, self.lacking, w)
                total = total + (w if size == k else w * sums[end - size])
                upto.append(total)
            sums[end] = total
            for size, part in enumerate(upto):
                cumulative[end, size] = part / total
        return starts, sizes, points, pieces, cumulative

    def _sampled(self, lattice, of: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the occurrences one after another, and the number of each one's ids. Backward sampling.

        of: unit of each occurrence; seeds: a number of each. Step t of an occurrence draws from (seed, t).
        """
        starts, sizes, points, pieces, cumulative = lattice
        k, live, step = sizes[of].copy(), np.arange(len(of)), 0
        steps = np.zeros(len(of), np.int64)
        who, when, what, char = [], [], [], []
        while len(live):
            end = starts[of[live]] + k[live] - 1
            u = _uniform(seeds[live] + _U64(step))
            size = 1 + (u[:, None] >= cumulative[end]).sum(1)
            who.append(live)
            when.append(np.full(len(live), step))
            what.append(pieces[size - 1, end - size + 1])
            char.append(points[end])
            steps[live] += 1
            k[live] -= size
            live = live[k[live] > 0]
            step += 1
        if not who:
            return np.zeros(0, np.int32), steps
        who, when, what, char = map(np.concatenate, (who, when, what, char))
        place = (np.cumsum(steps) - 1)[who] - when  # the last step is the first piece
        ids, chars = np.empty(len(who), np.int32), np.empty(len(who), np.uint32)
        ids[place], chars[place] = what, char
        if (ids < 0).any():  # characters written as bytes
            lost = ids < 0
            wide = np.where(lost, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF), 1)
            raw = self._bytes_of(chars[lost].tobytes().decode("utf-32-le"))
            owner = np.repeat(np.arange(len(steps)), steps)
            steps = np.bincount(owner, wide, len(steps)).astype(np.int64)
            mask = np.repeat(lost, wide)
            ids = np.repeat(ids, wide)
            ids[mask] = raw
        return ids, steps

    def _edges(self, unit: str, k: int, sums, logs) -> tuple[list[tuple[int, float]], float]:
        """(start, weight) of the pieces of a unit that end at k, each times the sum of the paths up to its start, and the
        logarithm that all weights are short of."""
        get, weights, own = self.number.get, self.weights, []
        for i in range(max(0, k - self.longest), k):
            number = get(unit[i:k])
            if number is not None:
                own.append((i, weights[number]))
        if get(unit[k - 1]) is None:
            own.append((k - 1, self.lacking))
        top = max(logs[i] for i, _ in own)
        return [(i, sums[i] * w * math.exp(logs[i] - top)) for i, w in own], top

    def _long(self, unit: str, seed: int) -> np.ndarray:
        """A unit of any length: the same lattice in one pass, sums rescaled as they shrink. Of a place two numbers are
        kept; its edges are computed again where the sampled path comes by."""
        n = len(unit)
        sums, logs = array("d", [1.0]), array("d", [0.0])
        for k in range(1, n + 1):
            own, top = self._edges(unit, k, sums, logs)
            total = sum([x for _, x in own])
            small = total < 1e-100
            sums.append(1.0 if small else total)
            logs.append(top + math.log(total) if small else top)
        k, step, cuts, draws = n, 0, array("q", [n]), ()
        while k:
            if step % 65_536 == 0:
                draws = _uniform(_U64(seed) + np.arange(step, step + 65_536, dtype=np.uint64))
            own, _ = self._edges(unit, k, sums, logs)
            u = float(draws[step % 65_536]) * sum([x for _, x in own])
            for i, share in own:
                k = i
                if u < share:
                    break
                u -= share
            cuts.append(k)
            step += 1
        out = array("i")
        for at in range(len(cuts) - 1, 0, -1):
            piece = unit[cuts[at] : cuts[at - 1]]
            number = self.number.get(piece)
            if number is None:
                out.extend(self._bytes_of(piece).tolist())
            else:
                out.append(number)
        return np.array(out, np.int32)

    def encode(self, texts: list[str | None], keys: list[object]) -> list[np.ndarray]:
        """Ids of each text. The same text, key and seed give the same ids, whatever stands beside them."""
        units: dict[str, int] = {}
        of: list[int] = []
        first: list[int] = [0]
        apart: dict[int, list[tuple[int, np.ndarray]]] = {}  # ids that are not sampled from short units, by text
        seeds = []
        mark = self._bytes_of(MARK)
        for number, (text, key) in enumerate(zip(texts, keys, strict=True)):
            seed = xxhash.xxh64_intdigest(repr(key).encode(), self.seed)
            for n, part in enumerate((text or "").split(MARK)):
                if n:
                    apart.setdefault(number, []).append((len(of), mark))
                for unit in _UNITS.findall(("" if n else MARK) + part.replace(" ", MARK)):
                    if len(unit) <= self.short:
                        of.append(units.setdefault(unit, len(units)))
                    else:
                        own = xxhash.xxh64_intdigest(f"{len(of)-first[-1]} {len(apart.get(number, ()))}".encode(), seed)
                        apart.setdefault(number, []).append((len(of), self._long(unit, own)))
            count = len(of) - first[-1]
            seeds.append(_U64(seed) + np.arange(count, dtype=np.uint64) * _U64(256))
            first.append(len(of))
        names = sorted(units, key=len, reverse=True)
        rank = np.empty(len(units), np.int64)
        rank[[units[x] for x in names]] = np.arange(len(names))
        if of:
            ids, counts = self._sampled(self._lattice(names), rank[np.array(of)], np.concatenate(seeds))
        else:
            ids, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        out = []
        for number in range(len(texts)):
            a, b = first[number], first[number + 1]
            if number not in apart:
                out.append(ids[ends[a] : ends[b]])
                continue
            parts, done = [], a
            for at, own in apart[number]:
                parts += [ids[ends[done] : ends[at]], own]
                done = at
            out.append(np.concatenate([*parts, ids[ends[done] : ends[b]]]))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        surface = self.surface
        return b"".join([surface[i] for i in ids]).decode("utf-8")[1:]


@lru_cache(2)
def vocabulary(model: str, alpha: float = 1.0, seed: int = 0) -> Pieces:
    """Pieces that a Python worker reads once and keeps for its later tasks."""
    return Pieces(model, alpha, seed)


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, pieces) of whole texts: ids as an array. A null or empty text has the leading mark's piece alone; null
    keys are keys; rows with one key and text are cut alike; very long texts are cut whole, a run without spaces too, at
    two numbers a character; no rows give no rows; other columns are not read."""
    ddl = "doc_id long, pieces array<int>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model, alpha, seed)
        for keys, texts in row_blocks(batches, BLOCK_CHARS):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own.encode(texts, keys), pa.list_(pa.int32()))], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ddl)


def decoded(rows: DataFrame, model: str, key: str = "doc_id", pieces: str = "pieces") -> DataFrame:
    """(doc_id, text) of arrays of ids; null ids are the empty text."""

    def start():
        own = vocabulary(model)
        return lambda k, ids: (k, own.decode(ids) if ids else "")

    return map_rows(rows, [key, pieces], "doc_id long, text string", start)


def round_trips(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 0, with_pieces: bool = False) -> DataFrame:
    """Per document: doc_id, n_chars, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and
    lossless (whether the ids decode to the text), and with ``with_pieces`` the ids, in one pass.

    Edge cases: a null or empty text has the leading mark's piece alone; a null key is a key; rows with one key and
    text are cut alike; no rows give no rows; other columns are not read.
    """
    ddl = "doc_id long, n_chars long, n_pieces long, ids_crc32 long, lossless boolean" + ", pieces array<int>" * with_pieces
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model, alpha, seed)
        for keys, texts in row_blocks(batches, BLOCK_CHARS):
            ids = own.encode(texts, keys)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(list(map(len, ids)), pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([own.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                *[pa.array(ids, pa.list_(pa.int32()))] * with_pieces,
            ], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ddl)
