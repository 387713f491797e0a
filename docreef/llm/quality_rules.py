"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

Rules are tests on integers of a text, so the verdict is the same in any order; the order decides what a text costs. It is
made from a sample of texts that the base test lets through, for those alone meet rules: what a rule costs once the
measures that are there anyway are there, and what it rejects of the texts that the rules before it left.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreef.llm.common import arrow_schema, map_rows, slices

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")

#: Common function words of the corpus' languages (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "this",
    "le", "la", "les", "de", "des", "et", "est", "un", "une", "que", "du", "en", "pour", "dans",
    "der", "die", "das", "und", "den", "dem", "mit", "von", "nicht", "ein", "eine", "zu", "auf", "ist",
    "el", "los", "las", "y", "por", "con", "una", "del", "se", "no", "para",
)
_STOP = frozenset(w.encode() for w in STOP_WORDS)


#: Distinct words of a text below which three of their places fit one number.
MANY_WORDS = 1 << 20


class Measures:
    """Numbers of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # of bytes: splits at ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def distinct(self) -> list[bytes]:
        return list(dict.fromkeys(self.words))

    @cached_property
    def ids(self) -> np.ndarray:
        """Of every word its place among the distinct ones."""
        place = dict(zip(self.distinct, range(len(self.distinct))))
        return np.array(list(map(place.__getitem__, self.words)), np.int64)

    @cached_property
    def kinds(self) -> np.ndarray:
        """How often each distinct word comes."""
        return np.bincount(self.ids, minlength=len(self.distinct))

    def n_with(self, test: Callable[[bytes], object]) -> int:
        """Words for which a test holds; each distinct one is asked once."""
        return int(self.kinds[np.fromiter(map(test, self.distinct), bool, len(self.distinct))].sum())

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _HAS_WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of three words which the text holds twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        ids, k = self.ids, len(self.distinct)
        if k < MANY_WORDS:
            windows = ids[:-2] << 40 | ids[1:-1] << 20 | ids[2:]
        else:
            pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]  # so the product stays small
            windows = pairs[:-1] * k + ids[2:]
        ranked = np.sort(windows)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if not len(twice):
            return 0
        place = np.minimum(np.searchsorted(twice, windows), len(twice) - 1)
        again = twice[place] == windows
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= again
        return int(covered.sum())

    @cached_property
    def n_lettered(self) -> int:
        return self.n_with(lambda w: w.isalpha() or _LETTER.search(w) is not None)

    @cached_property
    def n_stop_words(self) -> int:
        return self.n_with(lambda w: w.lower() in _STOP)

    @cached_property
    def n_digits(self) -> int:
        return sum(map(self.text.count, "0123456789"))

    @cached_property
    def top_word(self) -> int:
        return int(self.kinds.max(initial=0))

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


Rule = tuple[str, Callable[[Measures], bool]]

#: (name, test): a text is rejected if the test holds. SQL_RULES states the same.
RULES: list[Rule] = [
    ("short_words", lambda m: m.word_chars < 2 * m.n_words),
    ("long_words", lambda m: m.word_chars > 20 * m.n_words),
    ("symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    ("dup_lines", lambda m: 10 * m.n_dup_lines > 6 * len(m.lines)),
    ("few_letters", lambda m: 10 * m.n_lettered < 7 * m.n_words),
    ("few_stop_words", lambda m: 100 * m.n_stop_words < m.n_words),
    ("digits", lambda m: 10 * m.n_digits > 3 * m.word_chars),
    ("top_word", lambda m: 10 * m.top_word > 4 * m.n_words),
]
SQL_RULES = {
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "10 * n_dup_lines > 6 * n_lines",
    "few_letters": "10 * n_lettered < 7 * n_words",
    "few_stop_words": "100 * n_stop_words < n_words",
    "digits": "10 * n_digits > 3 * word_chars",
    "top_word": "10 * top_word > 4 * n_words",
}


#: Measures that the base test takes, and those that ``judged`` returns: no rule pays for them.
BASE_MEASURES = ("words", "n_words", "distinct", "ids", "n_repeat_words")
JUDGED_MEASURES = (*BASE_MEASURES, "word_chars", "n_symbols", "lines", "n_dup_lines")
#: Texts of the sample, about; more are not needed to order a handful of rules.
SAMPLE_TEXTS = 4_000


@dataclass
class Estimates:
    """Of n sampled texts: seconds a rule takes with the free measures there (cold) and with all of its own there (warm),
    the measures it adds, and how many texts each combination of rules rejects."""

    n: int
    cold: dict[str, float]
    warm: dict[str, float]
    adds: dict[str, frozenset[str]]
    patterns: dict[frozenset[str], int]

    def share(self, name: str) -> float:
        return sum(n for rules, n in self.patterns.items() if name in rules) / max(self.n, 1)


def _measured(body: str, free: tuple[str, ...]) -> Measures:
    m = Measures(body)
    for name in free:
        getattr(m, name)
    return m


def added(rule: Rule, free: tuple[str, ...]) -> frozenset[str]:
    """The measures that a rule takes beyond the free ones."""
    m = _measured("two words\n" * 40, free)
    there = set(m.__dict__)
    rule[1](m)
    return frozenset(set(m.__dict__) - there)


def estimate(docs: DataFrame, rules: list[Rule] = RULES, free: tuple[str, ...] = BASE_MEASURES, texts: int = SAMPLE_TEXTS, text: str = "text", seed: int = 7) -> Estimates:
    """Costs and rejections of rules on a random sample of about ``texts`` texts from the whole table, of which those that
    pass the base test count.

    The texts are drawn by Spark before any come to Python. The sample orders the rules and decides nothing else. Rules
    are timed on executors, after a few texts that warm up; only sums come back, a row a combination of rules.
    """
    n = docs.count()
    share = min(1.0, texts / max(n, 1))
    sample = docs.select(text) if share == 1.0 else docs.select(text).sample(share, seed)
    names = [name for name, _ in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, ...], list] = {}
        warmed = 0
        for batch in slices(batches):
            for body in batch.column(0).to_pylist():
                m = Measures(body)
                if m.base_failed:
                    continue
                m = _measured(body, free)
                for _ in range(2 if warmed < 3 else 1):
                    hits, cold, warm = [], [], []
                    for name, test in rules:
                        own = Measures(body)
                        own.__dict__.update(m.__dict__)
                        began = time.perf_counter()
                        hit = test(own)
                        middle = time.perf_counter()
                        test(own)
                        cold.append(middle - began)
                        warm.append(time.perf_counter() - middle)
                        if hit:
                            hits.append(name)
                warmed += 1
                row = found.setdefault(tuple(hits), [0, np.zeros(len(names)), np.zeros(len(names))])
                row[0] += 1
                row[1] += cold
                row[2] += warm
        if found:
            yield pa.RecordBatch.from_pydict({"hits": [list(k) for k in found], "n": [r[0] for r in found.values()], "cold": [r[1] for r in found.values()], "warm": [r[2] for r in found.values()]}, schema=arrow_schema(ddl))

    ddl = "hits array<string>, n long, cold array<double>, warm array<double>"
    sums = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(len(names))]).alias(c)
    rows = sample.mapInArrow(run, ddl).groupBy("hits").agg(F.sum("n").alias("n"), sums("cold"), sums("warm")).collect()  # at most a row a sampled text
    n = sum(r["n"] for r in rows)
    mean = lambda c: {name: sum(r[c][i] for r in rows) / max(n, 1) for i, name in enumerate(names)}
    return Estimates(n, mean("cold"), mean("warm"), {r[0]: added(r, free) for r in rules}, {frozenset(r["hits"]): r["n"] for r in rows})


def ordered(rules: list[Rule], est: Estimates) -> list[Rule]:
    """The cascade: next comes always the rule that rejects most of the texts left per cost, where measures that rules
    before it took cost nothing more; among rules that reject nothing, the cheapest."""
    left, todo, out, have = dict(est.patterns), list(rules), [], frozenset()
    while todo:
        def worth(rule: Rule) -> tuple[float, float]:
            name = rule[0]
            cost = max(est.warm[name] if est.adds[name] <= have else est.cold[name], 1e-9)
            return (-sum(n for hit, n in left.items() if name in hit) / cost, cost)

        best = min(todo, key=worth)
        todo.remove(best)
        out.append(best)
        have |= est.adds[best[0]]
        left = {hit: n for hit, n in left.items() if best[0] not in hit}
    return out


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Per document: its base measures, base_failed and kept.

    A text that the base test fails meets no rule; the others meet the rules one by one until one rejects. Edge cases:
    a null text has no words and fails the base test; a null key stays; repeated rows are judged each; no rows give no
    rows; other columns are not read. Whole texts are read, in one narrow pass.
    """
    cascade = ordered(rules, estimate(docs, rules, JUDGED_MEASURES, text=text))

    def start():
        def row(doc_id, body):
            m = Measures(body)
            failed = m.base_failed
            kept = not failed and not any(test(m) for _, test in cascade)
            return doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, kept

        return row

    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return map_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), ["doc_id", "text"], ddl, start)


def kept_rows(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows of docs whose text is kept, all columns unchanged; narrow, and measured only as far as the cascade goes.

    Null and empty texts have no words and go; very long ones are measured whole; repeated rows are judged each; null
    keys do not matter; no rows give no rows; other columns, whatever their names, are handed on.
    """
    cascade = ordered(rules, estimate(docs, rules, BASE_MEASURES, text=text))
    place = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches):
            mask = []
            for body in batch.column(place).to_pylist():
                m = Measures(body)
                mask.append(not m.base_failed and not any(test(m) for _, test in cascade))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
