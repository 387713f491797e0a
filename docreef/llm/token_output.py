"""Token ids in binary shards: independent zstandard frames, a document directory and a trailing seek table.

A shard is a sequence of zstandard frames, so any zstandard tool can decompress it whole. In order:

* data frames: the documents' ids, little-endian unsigned 32-bit, one after another. A frame ends with a document once
  it holds ``frame_bytes``; a longer document fills frames of its own;
* a skippable frame (0x184D2A50): ``DIRECT01``, the number of documents, then doc_id (int64), is-null (uint8) and
  number of ids (uint64) of each, in the order of the shard;
* a skippable frame (0x184D2A5E): the seek table of the public zstandard seekable format, with compressed size,
  decompressed size and the low 32 bits of XXH64 of the content of every frame before it.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docreef.llm.common import arrow_schema, new_folder, row_blocks, written

DIRECTORY_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_DIRECTORY_TAG = b"DIRECT01"

MANIFEST = "path string, task int, part int, n_docs long, n_tokens long, n_frames long, n_bytes long"


def opened(path: str):
    """(file system, path in it). Schemes that pyarrow knows; a plain path is a local one."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class ShardWriter:
    """Writes one shard; memory is one frame and the directory."""

    def __init__(self, sink, frame_bytes: int = 1 << 16, level: int = 3):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.pending, self.held = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.nulls = bytearray()
        self.counts: list[int] = []
        self.n_bytes = 0

    def _frame(self, raw: bytes) -> None:
        packed = self.zstd.compress(raw)
        self.sink.write(packed)
        self.n_bytes += len(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.pending))
        self.pending, self.held = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        if len(ids) >= self.frame_bytes:
            self._flush()
            for at in range(0, len(ids), self.frame_bytes):
                self._frame(ids[at : at + self.frame_bytes])
            return
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        body = b"".join((
            _DIRECTORY_TAG, struct.pack("<Q", len(self.ids)), np.array(self.ids, "<i8").tobytes(), bytes(self.nulls),
            np.array(self.counts, "<u8").tobytes(),
        ))
        skip = struct.pack("<II", DIRECTORY_MAGIC, len(body)) + body
        self.sink.write(skip)
        table = [*self.frames, (len(skip), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        entries = b"".join(struct.pack("<III", *x) for x in table)
        footer = struct.pack("<IBI", len(table), 0x80, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.n_bytes += len(skip) + 8 + len(entries) + len(footer)


class ShardReader:
    """Random access: a document costs the frames that hold it, each verified against the seek table."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("not a shard: the seek table's footer is missing")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.packed, self.sums = starts, table[:-1, 2]
        self.raw = np.concatenate(([0], np.cumsum(table[:-1, 1])))
        body = self._at(int(starts[n - 1]) + 8, int(table[-1, 0]) - 8)
        if body[:8] != _DIRECTORY_TAG:
            raise ValueError("not a shard: the document directory is missing")
        k = struct.unpack("<Q", body[8:16])[0]
        self.doc_ids = np.frombuffer(body, "<i8", k, 16)
        self.is_null = np.frombuffer(body, np.uint8, k, 16 + 8 * k).astype(bool)
        self.counts = np.frombuffer(body, "<u8", k, 16 + 9 * k).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self.zstd, self.last = zstandard.ZstdDecompressor(), (-1, b"")
        self.frames_read = 0

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            raw = self.zstd.decompress(
                self._at(int(self.packed[i]), int(self.packed[i + 1] - self.packed[i])),
                max_output_size=int(self.raw[i + 1] - self.raw[i]),
            )
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
                raise ValueError(f"frame {i}: checksum differs")
            self.frames_read += 1
            self.last = (i, raw)
        return self.last[1]

    def document(self, k: int) -> bytes:
        """The ids of the k-th document of the shard, as bytes."""
        begin, end = 4 * int(self.starts[k]), 4 * int(self.starts[k + 1])
        out, i = [], int(np.searchsorted(self.raw, begin, "right")) - 1
        while begin < end:
            piece = self.frame(i)[begin - int(self.raw[i]) : end - int(self.raw[i])]
            out.append(piece)
            begin += len(piece)
            i += 1
        return b"".join(out)

    def find(self, doc_id: int) -> list[int]:
        """Places of a document; the directory is in ascending order, nulls first."""
        skip = int(self.is_null.sum())
        own = self.doc_ids[skip:]
        return list(range(skip + int(np.searchsorted(own, doc_id)), skip + int(np.searchsorted(own, doc_id, "right"))))


#: Normalisers and pre-tokenizers under which no token looks across a space or a line feed (fixed values).
_BY_WORDS = (
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    ),
)


def by_words(tokenizer) -> bool:
    """Whether texts may be cut at spaces: the tokenizer's parts are known ones, and no added token has a space or could
    stand beside one."""
    d = json.loads(tokenizer.to_str())
    plain = all(t["content"].startswith("<|") and " " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in d["added_tokens"])
    return plain and d["model"]["type"] == "BPE" and not d["model"].get("dropout") and (d["normalizer"], d["pre_tokenizer"]) in _BY_WORDS


class WholeEncoder:
    """Whole texts to ids by the library alone; for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def many(self, texts: list[str | None]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


class WordEncoder:
    """Whole texts to ids by way of a memory of words.

    For tokenizers that never look across a space or a line feed, as word_bpe_49k.json: its normaliser maps characters
    (NFC does not compose across a space), its pre-tokens hold no white space, and a run of letters and a
    run of other marks are one each. So a text's ids are those of its parts between spaces, and those of letters with
    marks behind them are the letters' and the marks'. A-Z are lowered first, as the normaliser would do, unless that could make a
    special token or change how a mark composes. Parts come again and again; Arrow numbers those of a block, each different
    one is looked up once a block, and encoded once while the memory holds it. Words of letters are encoded many at once and
    told apart by the ids that end a pre-token.

    The memory has two generations of at most ``room`` parts; the older goes when the younger is full.
    """

    def __init__(self, tokenizer, room: int = 500_000, longest: int = 48):
        self.tokenizer = tokenizer
        self.room, self.longest = room, longest
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        self.last = last_pieces(tokenizer)

    def _alone(self, words: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _together(self, words: list[str]) -> list[bytes]:
        """Words of letters only: at least one pre-token each."""
        if self.last is None:
            return self._alone(words)
        got = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[got]) + 1
        if len(ends) != len(words):
            return self._alone(words)  # some letter was normalised to more than letters
        raw, at = got.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[x:y] for x, y in zip(at, at[1:])]

    def _learned(self, fresh: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        letters, others, ended = {}, {}, []
        for p, word in zip(fresh, b"\n".join(fresh).decode().split("\n")):
            if word.isalpha():
                letters[p] = word
            elif len(stem := word.rstrip(_ENDS)) < len(word) and _STEM(stem):
                ended.append((p, word, stem))
            else:
                others[p] = word
        young, old, halves = self.young, self.old, []
        for p, word, stem in ended:
            x = stem.encode()
            y = p[len(x) :]
            halves.append((p, x, y))
            if x not in young and x not in old:
                letters[x] = stem
            if y not in young and y not in old:
                others[y] = word[len(stem) :]
        for group, encode in ((letters, self._together), (others, self._alone)):
            keys, words = list(group), list(group.values())
            for at in range(0, len(words), 512):
                out.update(zip(keys[at : at + 512], encode(words[at : at + 512]), strict=True))
        known = lambda x: out.get(x) or young.get(x) or old[x]
        out.update([(p, known(x) + known(y)) for p, x, y in halves])
        return out

    @staticmethod
    def parts(texts: list[str | None]) -> pa.ListArray:
        """The parts of each text between spaces and line feeds, as UTF-8."""
        rows = [
            (text or "").encode() if "<|" in (text or "") or _MARK.search(text or "") else (text or "").encode().lower()
            for text in texts
        ]
        return pc.split_pattern(pc.replace_substring(pa.array(rows, pa.large_binary()), b"\n", b" "), b" ")

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        parts = self.parts(texts)
        numbered = parts.flatten().dictionary_encode()
        words = sliced(numbered.dictionary)
        young, old = self.young, self.old
        ids = list(map(young.get, words))
        gaps = [i for i, x in enumerate(ids) if x is None]
        own = {p: x for p in (words[i] for i in gaps) if (x := old.get(p)) is not None}
        own |= self._learned([p for p in (words[i] for i in gaps) if p not in own])
        for i in gaps:
            ids[i] = own[words[i]]
        out = sliced(pa.array(ids, pa.large_binary()).take(numbered.indices), parts.offsets.to_numpy())
        if len(young) + len(own) > self.room:
            self.old, self.young = young, {b"": b""}
        if max(map(len, own), default=0) > self.longest:
            own = {p: x for p, x in own.items() if len(p) <= self.longest}
        self.young.update(own)
        return out

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


def sliced(values: pa.LargeBinaryArray, at: np.ndarray | slice = slice(None)) -> list[bytes]:
    """The values, or what lies between the places ``at``. An Arrow scalar a value would cost more than its lookup."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, "<i8", len(values) + 1, 8 * values.offset)[at].tolist() if len(values) else [0]
    raw = memoryview(data)[: ends[-1]].tobytes() if data else b""
    return [raw[x:y] for x, y in zip(ends, ends[1:])]


def last_pieces(tokenizer) -> np.ndarray | None:
    """By id, whether it ends a pre-token; None if the tokenizer does not mark every end."""
    from tokenizers import pre_tokenizers

    model = json.loads(tokenizer.to_str())["model"]
    suffix, ids = model.get("end_of_word_suffix"), tokenizer.get_vocab()
    if not suffix or any(c + suffix not in model["vocab"] for c in pre_tokenizers.ByteLevel.alphabet()):
        return None
    out = np.zeros(max(ids.values()) + 1, bool)
    out[[i for piece, i in model["vocab"].items() if piece.endswith(suffix)]] = True
    return out


#: Marks that compose with ASCII letters, and letters that stay letters when normalised, with marks behind them.
_MARK = re.compile("[\u0300-\u036f]")
_STEM = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch
_ENDS = ".,!?;:#*$%&"

_encoders: dict[str, WordEncoder | WholeEncoder] = {}


def encoder_of(path: str) -> WordEncoder | WholeEncoder:
    """The process' own encoder, so that the next task finds the words of the last. A tokenizer that is not known to keep
    to words has its texts encoded whole: the same ids as ever, more slowly."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _encoders[path] = WordEncoder(tokenizer) if by_words(tokenizer) else WholeEncoder(tokenizer)
    return _encoders[path]


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1,
    frame_bytes: int = 1 << 16, shard_bytes: int = 1 << 28, level: int = 3,
) -> DataFrame:
    """Encodes whole texts and writes shards in ascending order of the key (nulls first), rows of one key in order of a
    hash of their texts, so that repeated keys are dealt over tasks and reruns agree; returns the manifest.

    Texts are range-partitioned once. A task that is run again writes under another name; the manifest, itself
    a committed table, names the files of the tasks that counted.
    """
    schema = arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, task = encoder_of(tokenizer), TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        writer = sink = path = None
        part = 0

        def closed():
            writer.close()
            sink.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([x], type=f.type) for x, f in zip((path, task, part, len(writer.ids), sum(writer.counts), len(writer.frames), writer.n_bytes), schema, strict=True)],
                schema=schema,
            )

        for doc_ids, texts in row_blocks(batches, 2_000_000):
            for doc_id, ids in zip(doc_ids, encoder.many(texts), strict=True):
                if writer is None:
                    path = f"{folder}/tokens-{task:06d}-{part:04d}-{uuid.uuid4().hex[:12]}.zst"
                    fs, inner = opened(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(inner, compression=None)  # else the name decides
                    writer = ShardWriter(sink, frame_bytes, level)
                writer.add(doc_id, ids + end)
                if writer.n_bytes >= shard_bytes:
                    yield closed()
                    writer, part = None, part + 1
        if writer is not None:
            yield closed()

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    ordered = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    return written(ordered.mapInArrow(run, MANIFEST).repartition(1), "shard-manifest")  # one file, a row a shard


def read_shards(manifest: DataFrame, task_tokens: int = 1 << 21) -> DataFrame:
    """Per document (doc_id, start, n_tokens, ids_crc32, shard), every frame read and verified.

    The running total is over the manifest, a row a shard, not over documents. Small shards share tasks of some
    ``task_tokens`` ids, as long as every core has one.
    """
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, inner = opened(path)
                with fs.open_input_file(inner) as source:
                    shard = ShardReader(source)
                    for at in range(0, len(shard.counts), 4096):
                        own = range(at, min(at + 4096, len(shard.counts)))
                        yield pa.RecordBatch.from_arrays([
                            pa.array([None if shard.is_null[k] else int(shard.doc_ids[k]) for k in own], pa.int64()),
                            pa.array([base + int(shard.starts[k]) for k in own], pa.int64()),
                            pa.array([int(shard.counts[k]) for k in own], pa.int64()),
                            pa.array([zlib.crc32(shard.document(k)) for k in own], pa.int64()),
                            pa.array([inner.rpartition("/")[2]] * len(own), pa.string()),
                        ], schema=schema)

    had = manifest.agg(F.count("*").alias("shards"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(had["shards"], 4096, max(cores, -(-had["tokens"] // task_tokens))))
    return placed.select("path", "base").repartition(n).mapInArrow(run, ddl)


def token_output(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the documents' ids and reads them back.

    Edge cases: a null or empty text is the end id alone; a null doc_id sorts first and stays null; rows with one
    doc_id are kept, in an order that their texts fix; no rows write no shard and give no rows; other columns are not
    read. A shard that was damaged raises instead of giving other ids.
    """
    folder = folder or new_folder(docs.sparkSession, "token-shards")
    return read_shards(write_shards(docs, folder, tokenizer, **options))
