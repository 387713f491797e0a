"""Token counts that follow edits.

A document is a segment tree over blocks of pre-tokens; a node holds the characters, tokens and pre-tokens below it. An
edit finds its place by descending along the character sums, cuts the text again from a few characters before the edit
until the new pre-tokens meet an old boundary, counts tokens for those alone, and updates the sums above them. A block
that grows too large is split where it is. Trees are kept in a table: a later batch of edits loads them, opens the blocks
that it touches and writes them back, so no edit costs a count of the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreef.llm.common import arrow_schema, map_rows, new_folder, slices

#: How far beyond its end a pre-token's extent can depend on the text (white space runs look one character ahead,
#: contractions at most three from their start).
CONTEXT = 4
#: Pre-tokens of a block when it is made, and at which it is split.
BLOCK, FULL = 64, 256

EDITS = "array<struct<start:bigint,stop:bigint,replacement:string>>"


class Counter:
    """Tokens of pre-tokens of a byte-level BPE, given as ranks in tiktoken's format; remembers what it has counted."""

    def __init__(self, path: str, pattern: str, room: int = 300_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = regex.compile(pattern)
        self.room, self.memory = room, {}

    def tokens(self, piece: str) -> int:
        n = self.memory.get(piece)
        if n is None:
            n = len(self.encode(piece))
            if len(piece) <= 64:
                if len(self.memory) >= self.room:
                    self.memory.clear()
                self.memory[piece] = n
        return n


@lru_cache(2)
def counter_of(path: str, pattern: str) -> Counter:
    """The process' own counter, so that the next task finds the vocabulary read and the pre-tokens of the last counted."""
    return Counter(path, pattern)


def packed(numbers: list) -> bytes:
    """Numbers as bytes, of one byte each if all are small enough, else of four (little-endian)."""
    x = np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
    return x.astype(np.uint8 if x.max(initial=0) < 256 else "<u4").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else "<u4").astype(np.uint32)


class Leaf:
    """A block: its text and its pre-tokens' sizes and counts, cut out of the document's only when it is opened."""

    __slots__ = ("text", "sizes", "counts", "source", "node", "next")

    def __init__(self, text: str | None, sizes, counts, source=None):
        self.text, self.sizes, self.counts, self.source = text, sizes, counts, source
        self.node, self.next = -1, None

    def open(self) -> Leaf:
        if self.source is not None:
            text, a, b = self.source
            self.text, self.sizes, self.counts, self.source = text[a:b], self.sizes.tolist(), self.counts.tolist(), None
        return self


class CountTree:
    """One document's text with its counts. Node k has sums[k] = (characters, tokens, pre-tokens), its children kids[k]
    (None for a leaf) and the node above it."""

    def __init__(self, text: str | None, counter: Counter):
        pieces = counter.cut.findall(text or "")
        sizes, counts = np.fromiter(map(len, pieces), np.uint32, len(pieces)), np.fromiter(map(counter.tokens, pieces), np.uint32, len(pieces))
        self._load(text or "", sizes, counts, [min(BLOCK, len(sizes) - at) for at in range(0, len(sizes), BLOCK)], counter)

    @classmethod
    def load(cls, row: dict, counter: Counter) -> CountTree:
        """A kept tree (see TREE); nothing is cut or counted."""
        tree = cls.__new__(cls)
        n = sum(row["block_pieces"])
        tree._load(row["text"], unpacked(row["sizes"], n), unpacked(row["counts"], n), row["block_pieces"], counter, row["block_chars"], row["block_tokens"])
        return tree

    def _load(self, text, sizes, counts, block_pieces, counter, block_chars=None, block_tokens=None) -> None:
        self.counter, self.recounted = counter, 0  # pre-tokens counted for edits
        pieces = np.array(block_pieces, np.int64)
        ends = np.cumsum(pieces)
        starts = ends - pieces
        if block_chars is None:
            block_chars = np.add.reduceat(sizes, starts, dtype=np.int64).tolist() if len(ends) else []
            block_tokens = np.add.reduceat(counts, starts, dtype=np.int64).tolist() if len(ends) else []
        leaves, sums, at = [], [], 0
        for i, j, chars, tokens in zip(starts.tolist(), ends.tolist(), block_chars, block_tokens, strict=True):
            leaves.append(Leaf(None, sizes[i:j], counts[i:j], (text, at, at + chars)))
            sums.append((chars, tokens, j - i))
            at += chars
        if not leaves:
            leaves, sums = [Leaf("", [], [])], [(0, 0, 0)]
        self._grow(leaves, sums)

    def _grow(self, leaves: list[Leaf], sums: list[tuple[int, int, int]]) -> None:
        """A balanced tree over all leaves."""
        for x, y in zip(leaves, [*leaves[1:], None]):
            x.next = y
        self.first = leaves[0]
        self.sums, self.kids, self.up, self.leaf, self.n_leaves = [], [], [], [], len(leaves)
        self.root = self._subtree(leaves, sums, -1)

    def _subtree(self, leaves, sums, up: int, node: int | None = None) -> int:
        if node is None:
            node = len(self.sums)
            for column in (self.sums, self.kids, self.up, self.leaf):
                column.append(None)
        self.up[node] = up
        if len(leaves) == 1:
            self.sums[node], self.kids[node], self.leaf[node] = sums[0], None, leaves[0]
            leaves[0].node = node
        else:
            half = len(leaves) // 2
            self.leaf[node] = None
            self.kids[node] = a, b = self._subtree(leaves[:half], sums[:half], node), self._subtree(leaves[half:], sums[half:], node)
            self.sums[node] = tuple(map(sum, zip(self.sums[a], self.sums[b])))
        return node

    @property
    def n_tokens(self) -> int:
        return self.sums[self.root][1]

    @property
    def n_pieces(self) -> int:
        return self.sums[self.root][2]

    @property
    def n_chars(self) -> int:
        return self.sums[self.root][0]

    def leaves(self) -> Iterator[Leaf]:
        leaf = self.first
        while leaf is not None:
            yield leaf
            leaf = leaf.next

    @property
    def text(self) -> str:
        return "".join(x.text if x.source is None else x.source[0][x.source[1] : x.source[2]] for x in self.leaves())

    def dump(self) -> tuple:
        """The columns of TREE behind the key."""
        own = [x for x in self.leaves() if len(x.sizes)]
        sums = [self.sums[x.node] for x in own]
        flat = [packed([np.asarray(getattr(x, c), np.uint32) for x in own]) for c in ("sizes", "counts")]
        return self.text, *flat, *([x[i] for x in sums] for i in (2, 0, 1))

    def _renew(self, leaf: Leaf) -> int:
        """Sums from a leaf upwards; the leaf's depth."""
        k, depth = leaf.node, 0
        self.sums[k] = (len(leaf.text), sum(leaf.counts), len(leaf.sizes))
        while (k := self.up[k]) >= 0:
            a, b = self.kids[k]
            self.sums[k] = tuple(map(sum, zip(self.sums[a], self.sums[b])))
            depth += 1
        return depth

    def _split(self, leaf: Leaf) -> Leaf:
        """A leaf that is too large becomes a tree of blocks in its place; the last of them."""
        parts, at = [], 0
        for i in range(0, len(leaf.sizes), BLOCK):
            sizes = leaf.sizes[i : i + BLOCK]
            chars = sum(sizes)
            parts.append(Leaf(leaf.text[at : at + chars], sizes, leaf.counts[i : i + BLOCK]))
            at += chars
        node, after = leaf.node, leaf.next
        leaf.text, leaf.sizes, leaf.counts = parts[0].text, parts[0].sizes, parts[0].counts  # what points to it stays right
        parts[0] = leaf
        self._subtree(parts, [(len(x.text), sum(x.counts), len(x.sizes)) for x in parts], self.up[node], node)
        for x, y in zip(parts, [*parts[1:], after]):
            x.next = y
        self.n_leaves += len(parts) - 1
        return parts[-1]

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replaces characters [start, stop). Places beyond the text are moved to its end, a stop before start to start."""
        total = self.n_chars
        start = min(max(start, 0), total)
        stop = min(max(stop, start), total)
        shift = len(replacement) - (stop - start)
        at, k, begin = max(0, start - CONTEXT), self.root, 0
        while self.kids[k] is not None:
            a, b = self.kids[k]
            right = at >= begin + self.sums[a][0] and self.sums[b][0]
            begin += self.sums[a][0] if right else 0
            k = b if right else a
        leaf, place, first = self.leaf[k].open(), 0, begin
        while place < len(leaf.sizes) and at >= first + leaf.sizes[place]:
            first += leaf.sizes[place]
            place += 1
        # the old text from there on, as many blocks as are needed; first is where it begins
        own, old, reach, more = [leaf], [leaf.text[first - begin :]], begin + len(leaf.text), 1
        new_start, new_stop = start - first, stop - first
        while True:
            while own[-1].next is not None and (reach < stop + 4 * CONTEXT or more > 1):
                own.append(own[-1].next.open())
                old.append(own[-1].text)
                reach += len(own[-1].text)
                more -= reach >= stop + 4 * CONTEXT
            text = "".join(old)
            text = text[:new_start] + replacement + text[new_stop:]
            met = self._cut(text, own, place, new_start + len(replacement), new_stop, shift)
            if met is not None:
                break
            more = 1 + len(own)  # twice as many blocks
        sizes, counts, b, p = met
        self.recounted += len(sizes)
        last, chars = own[b], sum(sizes)
        kept = sum(last.sizes[p:])
        tail = (last.text[len(last.text) - kept :] if kept else "", last.sizes[p:], last.counts[p:])
        leaf.text = leaf.text[: first - begin] + text[:chars] + tail[0]
        leaf.sizes, leaf.counts = leaf.sizes[:place] + sizes + tail[1], leaf.counts[:place] + counts + tail[2]
        for x in own[1 : b + 1]:
            x.text, x.sizes, x.counts = "", [], []
            self._renew(x)
        if len(leaf.sizes) > FULL:
            depth = self._renew(self._split(leaf))
        else:
            depth = self._renew(leaf)
        if depth > 2 * self.n_leaves.bit_length() + 4:  # one-sided by many splits: new inner nodes over the same blocks
            full = [x for x in self.leaves() if len(x.sizes)] or [leaf]
            self._grow(full, [self.sums[x.node] for x in full])

    def _cut(self, text: str, own: list[Leaf], place: int, edited: int, stop: int, shift: int):
        """(sizes, counts, block, pre-token): the pre-tokens of the text up to where, behind the edit, an old one begins
        as well; None if more blocks are needed to tell. edited, stop: the edit's end in the new and in the old text."""
        whole = own[-1].next is None or not any(self.sums[x.node][0] for x in self._after(own[-1]))
        sizes, counts, b, p, old = [], [], 0, place, 0
        for m in self.counter.cut.finditer(text):
            end = m.end()
            if not whole and end + CONTEXT > len(text):
                return None
            sizes.append(end - m.start())
            counts.append(self.counter.tokens(m.group()))
            if end >= edited:
                while old < end - shift:
                    while b < len(own) and p >= len(own[b].sizes):
                        b, p = b + 1, 0
                    if b == len(own):
                        break
                    old += own[b].sizes[p]
                    p += 1
                if old == end - shift and old >= stop and b < len(own):
                    return sizes, counts, b, p
        return (sizes, counts, len(own) - 1, len(own[-1].sizes)) if whole else None

    @staticmethod
    def _after(leaf: Leaf) -> Iterator[Leaf]:
        while (leaf := leaf.next) is not None:
            yield leaf


def token_counts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_pieces) of whole texts. Null and empty texts have none; null keys stay; repeated rows are counted
    each, very long texts whole; no rows give no rows; other columns are not read."""

    def start():
        counter = counter_of(path, pattern)

        def row(k, t):
            tree = CountTree(t, counter)
            return k, tree.n_tokens, tree.n_pieces

        return row

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(rows, ["doc_id", "text"], "doc_id long, n_tokens long, n_pieces long", start)


def _apply(tree: CountTree, edits) -> None:
    for e in edits or ():
        if e is not None and e["start"] is not None:
            tree.edit(e["start"], e["start"] if e["stop"] is None else e["stop"], e["replacement"] or "")


#: A kept tree. The text in its blocks' order, every pre-token's size in characters and its tokens (``packed``), and the
#: blocks' sums, over which the inner nodes stand.
TREE = "doc_id long, text string, sizes binary, counts binary, block_pieces array<long>, block_chars array<long>, block_tokens array<long>"


def kept(trees: DataFrame, folder: str | None = None) -> DataFrame:
    """Trees as a table of the given (or a new shared) folder."""
    folder = folder or new_folder(trees.sparkSession, "count-trees")
    trees.write.option("compression", "zstd").parquet(folder)
    return trees.sparkSession.read.schema(trees.schema).parquet(folder)


def planted(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Trees (TREE, and the columns ``also`` beside them) of whole texts, each counted once. Null and empty texts are trees
    without blocks; null keys stay; repeated rows have trees each."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *also)
    schema = arrow_schema(TREE)
    ddl = ", ".join([TREE, *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in also]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, pattern)
        for batch in slices(batches, 128):
            trees = [CountTree(t, counter).dump() for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*trees, strict=True), list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *[batch.column(c) for c in also]], names=[*schema.names, *also])

    return rows.mapInArrow(run, ddl)


def edited_trees(trees: DataFrame, path: str, pattern: str, edits: str = "edits", texts: bool = True) -> DataFrame:
    """Kept trees after their own edits, and of each n_tokens_before, n_pieces_before, n_tokens, n_pieces, n_chars and
    n_recounted (pre-tokens that the edits had counted). Without ``texts`` the numbers alone.

    ``edits`` is a column of the type EDITS, in order, each in the text as the former ones left it. Null edits, and edits
    without a start, change nothing; a null stop inserts, a null replacement deletes; places beyond the text count as
    its end. Narrow; only the blocks that edits touch are opened.
    """
    numbers = "n_tokens_before long, n_pieces_before long, n_tokens long, n_pieces long, n_chars long, n_recounted long"
    ddl = f"{TREE}, {numbers}" if texts else f"doc_id long, {numbers}"
    schema = arrow_schema(ddl)
    names = arrow_schema(TREE).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, pattern)
        for batch in slices(batches, 128):
            out = []
            for row in batch.to_pylist():
                tree = CountTree.load(row, counter)
                before = tree.n_tokens, tree.n_pieces
                _apply(tree, row[edits])
                out.append((row["doc_id"], *(tree.dump() if texts else ()), *before, tree.n_tokens, tree.n_pieces, tree.n_chars, tree.recounted))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return trees.select(*names, edits).mapInArrow(run, ddl)


def edited_counts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """Per document, before and after its own edits: doc_id, n_tokens, n_pieces, n_tokens_edited, n_pieces_edited,
    n_recounted (pre-tokens that the edits had counted again), n_chars_edited.

    The trees are planted and kept in a table, with the edits beside them, and the edits work on the kept ones. Edge
    cases: as of ``planted`` and ``edited_trees``; no rows give no rows; other columns are not read; very long texts are
    trees of many blocks. Narrow: the texts are not shuffled.
    """
    trees = kept(planted(docs.select(key, text, F.col(edits).alias("edits")), path, pattern, key, text, also=("edits",)))
    return edited_trees(trees, path, pattern, texts=False).select(
        "doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_pieces_before").alias("n_pieces"), F.col("n_tokens").alias("n_tokens_edited"),
        F.col("n_pieces").alias("n_pieces_edited"), "n_recounted", F.col("n_chars").alias("n_chars_edited"),
    )


def followed_counts(docs: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, seq, n_tokens, n_recounted) after every edit of a table (doc_id, seq, start, stop, replacement).

    Documents and edits meet in one shuffle by doc_id and are read in order of seq, one edit at a time, so a document
    with very many edits needs no more memory than its tree. seq is from 0; a document's row is put before it. Rows
    with one doc_id follow one another: edits apply to the last of them. Edits of no document are left out.
    """
    ddl = "doc_id long, seq long, n_tokens long, n_recounted long"
    schema = arrow_schema(ddl)
    kinds = {"start": "long", "stop": "long", "replacement": "string"}
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    more = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), F.lit(None).cast("string").alias("text"), *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, tree, own = counter_of(path, pattern), None, object()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["text"] is not None:
                    tree, own = CountTree(r["text"], counter), r["doc_id"]
                elif tree is not None and r["doc_id"] == own:
                    before = tree.recounted
                    _apply(tree, [r])
                    out.append((own, r["seq"], tree.n_tokens, tree.recounted - before))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    both = base.unionByName(more).repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return both.mapInArrow(run, ddl)
