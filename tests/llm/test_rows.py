"""Operators that judge or rewrite one row at a time, against plain Python."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from docreef.llm import licenses, pieces, quality_rules, token_counts, token_output
from docreef.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 2: token output -------------------------------------------------------------------------------------------------
def want_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_output(which, request):
    df = request.getfixturevalue(which)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_output.token_output(df, Q.tokenizer_path("word_bpe_49k.json"), frame_bytes=4096).collect())
    assert got == Counter((r["doc_id"], len(x) // 4, zlib.crc32(x)) for r in df.select("doc_id", "text").collect() for x in [want_ids(r["text"])])


def test_token_starts_and_random_access(spark, docs, texts, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = token_output.write_shards(docs, folder, Q.tokenizer_path("word_bpe_49k.json"), shard_bytes=20_000, frame_bytes=8192)
    assert manifest.count() > 1
    rows = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in token_output.read_shards(manifest).collect())
    assert [s for _, s, _ in rows] == [0, *np.cumsum([n for *_, n in rows])[:-1].tolist()]
    path = manifest.where("n_frames > 3").first()["path"]
    fs, inner = token_output.opened(path)
    with fs.open_input_file(inner) as f:
        shard = token_output.ShardReader(f)
        k = len(shard.counts) // 2
        assert shard.document(k) == want_ids(texts[int(shard.doc_ids[k])]) and shard.find(int(shard.doc_ids[k])) == [k]
        assert shard.frames_read < len(shard.sums)
    raw = bytearray(open(inner, "rb").read())
    raw[20] ^= 1
    open(inner, "wb").write(raw)
    with fs.open_input_file(inner) as f, pytest.raises((ValueError, zstandard.ZstdError)):
        token_output.ShardReader(f).document(0)


def test_repeated_ids_start_alike_in_reruns(spark):
    """Rows of one id, and of none, are dealt over tasks and come in an order that their texts fix."""
    rows = [(7, f"text number {i} " * (i % 9 + 1)) for i in range(300)] + [(None, f"none {i}") for i in range(40)] + [(3, "x"), (7, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_output.token_output(x, Q.tokenizer_path("word_bpe_49k.json")).collect()) for x in (df, df.repartition(5))]
    assert got[0] == got[1] and [d for _, d, _, _ in got[0]] == [None] * 40 + [3] + [7] * 301 + [9]
    assert [s for s, *_ in got[0]] == [0, *np.cumsum([n for _, _, n, _ in got[0]])[:-1].tolist()]


@pytest.mark.parametrize("change", ["pre_tokenizer", "normalizer", "added"])
def test_other_tokenizers_get_whole_texts(tmp_path, change):
    """A tokenizer that looks across spaces must not be fed word by word."""
    import json

    from tokenizers import Tokenizer

    d = json.loads(open(Q.tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read())
    assert isinstance(token_output.encoder_of(Q.tokenizer_path("word_bpe_49k.json")), token_output.WordEncoder)
    if change == "pre_tokenizer":
        d["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    elif change == "normalizer":
        d["normalizer"]["normalizers"] = d["normalizer"]["normalizers"][:2]
    else:
        d["added_tokens"].append(d["added_tokens"][0] | {"id": 49408, "content": "a b"})
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(d, f)
    encoder = token_output.encoder_of(path)
    assert isinstance(encoder, token_output.WholeEncoder)
    plain = Tokenizer.from_file(path)
    for text in ("a b c", "The  Cat\nsat", "", None):
        assert encoder(text) == np.array(plain.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_parts_are_looked_up_once_a_block():
    """Work a part of a text is Arrow's; the memory of words is asked for each different part, not for each place."""

    class Counting(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    path = Q.tokenizer_path("word_bpe_49k.json")
    encoder = token_output.WordEncoder(token_output.encoder_of(path).tokenizer)
    encoder.young = Counting(encoder.young)
    texts = ["The cat, the hat. " * 3000, None, "", "cat\nHat " * 1000]
    assert encoder.many(texts) == [want_ids(t)[:-4] for t in texts]
    assert encoder.young.asked < 50
    assert encoder.many(texts) == [want_ids(t)[:-4] for t in texts]  # from the memory


@pytest.mark.parametrize("suffix", ["</w>", None])
def test_words_encoded_together(tmp_path, suffix):
    """Words of letters are told apart by the ids that end a pre-token, where a tokenizer marks them; letters that
    are normalised to more than letters, and generations that go, change no ids."""
    import json

    from tokenizers import Tokenizer

    d = json.loads(open(Q.tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read())
    d["model"]["end_of_word_suffix"] = suffix
    path = str(tmp_path / "words.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(d, f)
    plain = Tokenizer.from_file(path)
    encoder = token_output.WordEncoder(plain, room=40)
    assert (encoder.last is None) == (suffix is None)
    rng = random.Random(5)
    bits = ["the", "gr\u00f6\u00df", "xq", "\u0130", "\u0149", "\uac00", "\u6f22", "zu", "e\u0301", ".", "!?", "7", "'s", "</w>", "<|endoftext|>", "\t", "\u2003", "\U0001f600"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(60)) for _ in range(40)]
    for at in range(0, 40, 4):
        block = texts[at : at + 4]
        assert encoder.many(block) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in block]


def test_small_shards_share_tasks_and_files(spark, docs, tmp_path):
    """A file a task is thousands of small ones: the manifest is one, and many small shards are read by few tasks."""
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")  # else so small a table is written by one task
    try:
        manifest = token_output.write_shards(docs, f"file://{tmp_path}", Q.tokenizer_path("word_bpe_49k.json"), shard_bytes=4000, frame_bytes=2048)
    finally:
        spark.conf.set(merge, before)
    assert manifest.select("task").distinct().count() > 1
    cores, n = spark.sparkContext.defaultParallelism, manifest.count()
    assert n > 2 * cores and len(manifest.inputFiles()) == 1
    got = token_output.read_shards(manifest)
    assert got.rdd.getNumPartitions() == cores and token_output.read_shards(manifest, task_tokens=1).rdd.getNumPartitions() == n
    rows = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in got.collect())
    assert len(rows) == docs.count() and [s for _, s, _ in rows] == [0, *np.cumsum([x for *_, x in rows])[:-1].tolist()]


def test_token_output_of_nothing(none):
    assert token_output.token_output(none, Q.tokenizer_path("word_bpe_49k.json")).count() == 0


# --- 3: token counts -------------------------------------------------------------------------------------------------
def edited(text, edits):
    t = text or ""
    for e in edits or []:
        if e is not None and e["start"] is not None:
            start = min(max(e["start"], 0), len(t))
            stop = min(max(start if e["stop"] is None else e["stop"], start), len(t))
            t = t[:start] + (e["replacement"] or "") + t[stop:]
    return t


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_token_counts(which, request):
    df = request.getfixturevalue(which).select("doc_id", "text", Q.example_edits().alias("edits"))
    count = token_counts.Counter(Q.tokenizer_path("byte_bpe_50k.tiktoken"), Q.pretoken_pattern())
    got = Counter((r["doc_id"], r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) for r in token_counts.edited_counts(df, Q.tokenizer_path("byte_bpe_50k.tiktoken"), Q.pretoken_pattern()).collect())
    want = Counter()
    for r in df.collect():
        after = edited(r["text"], r["edits"])
        want[r["doc_id"], len(count.encode(r["text"] or "")), len(count.encode(after)), len(after)] += 1
    assert got == want


@pytest.mark.parametrize("at_end", [False, True])
def test_random_edits(monkeypatch, at_end):
    import random

    monkeypatch.setattr(token_counts, "BLOCK", 4)
    monkeypatch.setattr(token_counts, "FULL", 12)
    count = token_counts.Counter(Q.tokenizer_path("byte_bpe_50k.tiktoken"), Q.pretoken_pattern())
    rng, parts = random.Random(3), [" ", "\n", "'", "s", "re", "ll", "a", "9", ".", "  ", "é", "中", "don't"]
    for turn in range(300):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
        tree = token_counts.CountTree(t, count)
        for _ in range(40 if at_end else 8):
            s, new = len(t) if at_end else rng.randint(0, len(t)), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 30])))
            e = min(len(t), s + rng.choice([0, 1, 5, 40]))
            t = t[:s] + new + t[e:]
            tree.edit(s, e, new)
            if turn % 3 == 0:  # kept and loaded again
                names = ("text", "sizes", "counts", "block_pieces", "block_chars", "block_tokens")
                tree = token_counts.CountTree.load(dict(zip(names, tree.dump(), strict=True)), count)
            assert tree.text == t and tree.n_tokens == len(count.encode(t)) and tree.n_pieces == len(count.cut.findall(t))
            assert at_end or max(len(x.sizes) for x in tree.leaves()) <= 12


def test_kept_trees_save_the_count(spark, docs, texts, tmp_path):
    """A second batch of edits works on what the first one kept: it counts a few pre-tokens, and gives a full count's sums."""
    path, pattern = Q.tokenizer_path("byte_bpe_50k.tiktoken"), Q.pretoken_pattern()
    edits = Q.example_edits().alias("edits")
    first = token_counts.kept(token_counts.edited_trees(token_counts.planted(docs.select("doc_id", "text", edits), path, pattern, also=("edits",)), path, pattern), f"file://{tmp_path}/trees")
    again = [(5, 8, "new "), (2000, 2000, "x y"), (30, 31, None)]
    more = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop"), F.lit(c).cast("string").alias("replacement")) for a, b, c in again])
    rows = token_counts.edited_trees(first.select("*", more.alias("edits")), path, pattern).collect()
    once = {r["doc_id"]: edited(r["text"], r["edits"]) for r in docs.select("doc_id", "text", edits).collect()}
    count = token_counts.Counter(path, pattern)
    assert len(rows) == len(once) and max(len(r["block_pieces"]) for r in rows) > 10
    for r in rows:
        want = edited(once[r["doc_id"]], [{"start": a, "stop": b, "replacement": c} for a, b, c in again])
        assert r["text"] == want and (r["n_tokens_before"], r["n_tokens"]) == (len(count.encode(once[r["doc_id"]])), len(count.encode(want)))
        assert r["n_recounted"] <= 40 and sum(r["block_tokens"]) == r["n_tokens"]


def test_edits_read_and_cut_their_surroundings_only():
    """Of a text of a million characters an edit cuts a few thousand at most, and opens a few blocks."""
    count = token_counts.Counter(Q.tokenizer_path("byte_bpe_50k.tiktoken"), Q.pretoken_pattern())
    tree = token_counts.CountTree("some words of text, " * 50_000, count)
    names = ("text", "sizes", "counts", "block_pieces", "block_chars", "block_tokens")
    tree = token_counts.CountTree.load(dict(zip(names, tree.dump(), strict=True)), count)
    seen = []

    class Cut:
        def finditer(self, text, cut=count.cut):
            seen.append(len(text))
            return cut.finditer(text)

    count.cut = Cut()
    for at in (0, 10, 500_000, 999_990):
        tree.edit(at, at + 3, "changed words")
    assert max(seen) < 5_000 and sum(x.source is None for x in tree.leaves()) <= 12


def test_followed_edits(spark, docs, texts):
    path, pattern = Q.tokenizer_path("byte_bpe_50k.tiktoken"), Q.pretoken_pattern()
    rows = [(d, i, 5 * i, 5 * i + 3, "new ") for d in (0, 1) for i in range(20)] + [(10**9, 0, 0, 0, "x"), (2, 0, None, None, None)]
    got = {(r["doc_id"], r["seq"]): r["n_tokens"] for r in token_counts.followed_counts(docs, spark.createDataFrame(rows, "doc_id long, seq long, start long, stop long, replacement string"), path, pattern).collect()}
    count = token_counts.Counter(path, pattern)
    want = {(2, 0): len(count.encode(texts[2]))}
    for d in (0, 1):
        t = texts[d]
        for i in range(20):
            t = t[: 5 * i] + "new " + t[min(len(t), 5 * i + 3) :]
            want[d, i] = len(count.encode(t))
    assert got == want


# --- 5: license scans ------------------------------------------------------------------------------------------------
def base_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_license_base(which, request):
    df = request.getfixturevalue(which)
    rows = licenses.scan(df).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows)
    assert got == Counter((r["doc_id"], *base_scan(r["text"])) for r in df.select("doc_id", "text").collect())
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows)


def test_license_rules_against_all_patterns():
    """The prefilter and the sweep change nothing: every pattern on every text, then suppression pair by pair."""
    scanner = licenses.Scanner()
    assert len(scanner.rules) > 300 and not scanner.always
    samples = [
        "Licensed under the GNU Lesser General Public Licence, version 2.1 or later", "SPDX-License-Identifier: Apache-2.0", "CC BY-NC-SA 4.0 and CC BY 3.0 and cc by",
        "Creative Commons Attribution-NonCommercial 4.0 International License", "Copyright (c) 2020 X. All rights reserved. Released under the MIT License.", "MPL 2.0 GPLv3 gplv2",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "dual: Apache License, Version 2.0 / BSD 3-Clause License", "nothing to see",
    ]
    for text in samples:
        words = [b"license" if w == b"licence" else w for w in licenses.folded_words(text)]
        joined = b" ".join(words)
        hits = []
        for rule, pattern in zip(scanner.rules, scanner.patterns, strict=True):
            for m in pattern.finditer(joined):
                first = joined[: m.start()].count(b" ")
                hits.append((first, first + m.group().count(b" "), rule.priority, rule.label))
        rank = lambda h: (h[2], h[1] - h[0])
        kept = {h for h in hits if not any(g != h and g[0] <= h[0] and h[1] <= g[1] and (rank(g) > rank(h) or (rank(g) == rank(h) and g[3] < h[3])) for g in hits)}
        assert set(scanner.detections(licenses.folded_words(text))) == kept, text
    assert scanner.scan(samples[0])["labels"] == "lgpl-2.1" and scanner.scan(samples[-1])["score"] == 0
    assert "apache-2.0" in scanner.scan(samples[1])["labels"] and "cc-by-nc-sa-4.0" in scanner.scan(samples[2])["labels"]


@pytest.mark.parametrize("text, label", [
    ("Apache License v2.0", "apache-2.0"), ("GNU General Public License v3", "gpl-3.0"), ("Mozilla Public License v2", "mpl-2.0"), ("MPL v2", "mpl-2.0"),
    ("under GPL v2 only", "gpl-2.0"), ("GPL-3.0", "gpl-3.0"), ("GPL, version 2", "gpl-2.0"), ("Apache-2.0", "apache-2.0"), ("Apache v2", "apache-2.0"), ("LGPL-2.1", "lgpl-2.1"),
    ("LGPL v3", "lgpl-3.0"), ("AGPL-3.0-or-later", "agpl-3.0"), ("EPL v2.0", "epl-2.0"), ("Apache License, v. 2.0", "apache-2.0"), ("Apache Licence version 2.0", "apache-2.0"),
])
def test_license_versions_and_identifiers(text, label):
    scanner = licenses.Scanner()
    got = {x[3] for x in scanner.detections(licenses.folded_words(text))}
    assert got - {"gpl", "lgpl", "agpl", "mpl", "epl", "apache"} == {label}
    joined = b" ".join(b"license" if w == b"licence" else w for w in licenses.folded_words(text))
    assert all(need <= set(joined.split()) for need, p in zip(scanner.needs, scanner.patterns, strict=True) if p.search(joined))


@pytest.mark.parametrize("text, label", [
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "bsd"),
    ("2. You must cause any modified files to carry prominent notices stating that You changed the files; and", "apache-2.0"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms", "lgpl"),
    ("made available under the terms of the Eclipse Public License v1.0 which accompanies", "epl"),
    ("The GNU General Public License is a free, copyleft license for software and other kinds of works.", "gpl-3.0"),
    ("Except as contained in this notice, the name of the X Consortium shall not be used in advertising", "x11"),
    ("2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "zlib"),
])
def test_license_bodies(text, label):
    got = licenses.Scanner().scan(text)
    assert label in got["labels"].split(",") and got["score"] >= 0.9


# --- 6: pieces -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_round_trips(which, request):
    import sentencepiece

    df, model = request.getfixturevalue(which), Q.tokenizer_path("piece_bpe_32k.model")
    rows = pieces.round_trips(df, model, with_pieces=True).collect()
    assert len(rows) == df.count() and all(r["lossless"] for r in rows)
    assert all(r["n_pieces"] == len(r["pieces"]) and zlib.crc32(np.array(r["pieces"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    again = pieces.encoded(df.repartition(5), model)
    assert Counter((r["doc_id"], tuple(r["pieces"])) for r in rows) == Counter((r["doc_id"], tuple(r["pieces"])) for r in again.collect())
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decoded(again, model).collect())
    assert back == Counter((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    vocabulary = pieces.vocabulary(model)
    for r in rows[:20]:  # the library's own decoder agrees
        own = vocabulary.decode(r["pieces"])
        if "▁" not in own:
            assert sp.decode(list(r["pieces"])) == own


def test_sampling_follows_the_lattice():
    p = pieces.Pieces(Q.tokenizer_path("piece_bpe_32k.model"))
    inverse = {v: k for k, v in p.number.items()}

    def paths(u):
        return [((), 1.0)] if not u else [((u[:k], *r), p.weights[p.number[u[:k]]] * w) for k in range(1, len(u) + 1) if u[:k] in p.number for r, w in paths(u[k:])]

    want = dict(paths("▁hello"))
    total, n = sum(want.values()), 20_000
    got = Counter(tuple(inverse[i] for i in x) for x in p.encode(["hello"] * n, list(range(n))))
    for path, w in want.items():
        q = w / total
        assert abs(got[path] / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 1e-3
    assert p.decode(p.encode(["y" * 3000 + "é▁"], [1])[0]) == "y" * 3000 + "é▁"


def test_long_units_follow_the_lattice_in_little_memory():
    """A run without spaces of any length: cut by the same probabilities, with a few numbers a character."""
    import tracemalloc

    p = pieces.Pieces(Q.tokenizer_path("piece_bpe_32k.model"))
    inverse = {v: k for k, v in p.number.items()}

    def paths(u):
        return [((), 1.0)] if not u else [((u[:k], *r), p.weights[p.number[u[:k]]] * w) for k in range(1, len(u) + 1) if u[:k] in p.number for r, w in paths(u[k:])]

    want, n = dict(paths("▁hello")), 4_000
    got = Counter(tuple(inverse[i] for i in p._long("▁hello", seed)) for seed in range(0, n << 20, 1 << 20))
    for path, w in want.items():
        q = w / sum(want.values())
        assert abs(got[path] / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 2e-3
    text = "abcdefghij" * 6_000 + "😀é" * 500
    tracemalloc.start()
    ids = p.encode([text], [3])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert p.decode(ids) == text and (p.encode([text], [3])[0] == ids).all() and peak < 100 * len(text)


# --- 7: quality rules ------------------------------------------------------------------------------------------------
def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_quality_measures(which, request):
    df = request.getfixturevalue(which)
    rows = quality_rules.judged(df).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == Counter((r["doc_id"], *base_measures(r["text"])) for r in df.select("doc_id", "text").collect())
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    kept = quality_rules.kept_rows(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in rows)


def test_quality_order_changes_nothing(docs, texts):
    want = {k for k, t in texts.items() for m in [quality_rules.Measures(t)] if not m.base_failed and not any(f(m) for _, f in quality_rules.RULES)}
    assert {r["doc_id"] for r in quality_rules.judged(docs).where("kept").collect()} == want


@pytest.mark.parametrize("many", [1 << 20, 3])
def test_measures_of_random_texts(monkeypatch, many):
    """Also where three words' places do not fit one number."""
    import random

    monkeypatch.setattr(quality_rules, "MANY_WORDS", many)
    rng = random.Random(9)
    for _ in range(200):
        t = " ".join(rng.choice(["the", "Le", "A1", "9", "größe", "É"]) + str(rng.randint(0, 3)) * rng.randint(0, 1) for _ in range(rng.randint(0, 90)))
        m, words = quality_rules.Measures(t), WORD.findall(t)
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed) == base_measures(t)
        assert m.top_word == max(Counter(words).values(), default=0) and m.n_stop_words == sum(w.lower() in quality_rules.STOP_WORDS for w in words)
        assert m.n_lettered == sum(bool(re.search("[A-Za-z]|[^\x00-\x7f]", w)) for w in words)


def test_cascade_is_ordered_by_what_is_left():
    """A rule that rejects what another rejects already comes late; one whose measures are there already is cheap."""
    rules = [(n, None) for n in "abcd"]
    adds = {"a": frozenset("x"), "b": frozenset("x"), "c": frozenset("y"), "d": frozenset("z")}
    patterns = {frozenset("ab"): 40, frozenset("c"): 10, frozenset("b"): 5, frozenset(): 45}
    est = quality_rules.Estimates(100, {"a": 1.0, "b": 1.2, "c": 1.0, "d": 9.0}, dict.fromkeys("abcd", 0.01), adds, patterns)
    assert [n for n, _ in quality_rules.ordered(rules, est)] == ["a", "b", "c", "d"]
    dear = quality_rules.Estimates(100, {"a": 1.0, "b": 1.2, "c": 1.0, "d": 9.0}, dict.fromkeys("abcd", 2.0), adds, patterns)
    assert [n for n, _ in quality_rules.ordered(rules, dear)] == ["a", "c", "b", "d"]
    assert est.share("b") == 0.45


def test_sample_for_the_cascade(spark, docs):
    """Drawn from the whole table, among texts that the base test lets through, with the measures that are there anyway."""
    bodies = [" ".join(f"w{(i * k) % 997}" for k in range(60)) for i in range(1, 3000)]
    odd = [x + " #" * 40 for x in bodies[::3]]
    df = spark.createDataFrame([(t,) for t in ["short"] * 3000 + bodies + odd], "text string").repartition(7)
    est = quality_rules.estimate(df, texts=2000)
    passed = len(bodies) + len(odd)
    assert 0.7 < est.n / (2000 * passed / (3000 + passed)) < 1.3
    assert abs(est.share("symbols") - len(odd) / passed) < 0.05
    assert sum(est.patterns.values()) == est.n and est.adds["short_words"] == est.adds["long_words"] == {"word_chars"}
    free = quality_rules.estimate(df, free=quality_rules.JUDGED_MEASURES, texts=2000)
    assert not free.adds["short_words"] and est.adds["few_letters"]
    assert quality_rules.estimate(df.limit(0)).n == 0


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    q = c.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    df = Q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(map(tuple, q.fetchall()))
