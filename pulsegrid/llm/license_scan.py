"""License scans: phrase counts, and template-markup matching by token automata.

A template's wording is compiled to an automaton over word hashes: a mandatory word is one
transition, an optional region may be skipped, a replaceable region loops over any word a
bounded number of times.  A template is tried only where its first mandatory words stand,
so the cost of a text without license wording is that of hashing its words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.license_templates import TEMPLATES
from pulsegrid.llm.shared import small_batches
from pulsegrid.llm.textkernel import WordHasher, sliced, utf8

# The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
BASE_SCORE = 0.5


def _words(text: str, hasher: WordHasher) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return hasher(raw, np.array([0, len(raw)]))[0]


@dataclass
class Automaton:
    """word[i] is the hash state i's one step needs (None: any word); skip[i] are states reachable without a word."""

    label: str
    score: float
    word: list[int | None]
    skip: list[list[int]]
    anchor: list[int]

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepts(self, words: list[int], at: int, start: int) -> int | None:
        """End of the shortest match that begins at word `at` in state `start`, or None."""
        final = len(self.word)
        states = self._closure({start})
        while True:
            if final in states:
                return at
            if at == len(words) or not states:
                return None
            w = words[at]
            states = self._closure({s + 1 for s in states if s < final and (self.word[s] is None or self.word[s] == w)})
            at += 1


def compile_template(markup: str, label: str, score: float, hasher: WordHasher) -> tuple[Automaton, int]:
    """The automaton of a wording, and the state of its first mandatory word."""
    parts = re.findall(r"\[\[|\]\]|\{\{\s*\d+\s*\}\}|[^\[\]{}]+", markup)
    word: list[int | None] = []
    skip: list[list[int]] = [[]]
    opened: list[int] = []
    mandatory: list[int] = []

    def step(w):
        word.append(w)
        skip.append([])

    for p in parts:
        if p == "[[":
            opened.append(len(word))
        elif p == "]]":
            skip[opened.pop()].append(len(word))
        elif p.startswith("{{"):
            n, first = int(p.strip("{} ")), len(word)
            for _ in range(n):
                step(None)
            for s in range(first, len(word)):
                skip[s].append(len(word))
        else:
            for h in _words(p, hasher).tolist():
                if not opened:
                    mandatory.append(len(word))
                step(h)
    if opened or not mandatory:
        raise ValueError(f"unbalanced or empty template: {label}")
    start = mandatory[0]
    anchor = [word[start]]
    for a, b in zip(mandatory, mandatory[1:], strict=False):
        if b != a + 1 or skip[b] or len(anchor) == 3:
            break
        anchor.append(word[b])
    return Automaton(label, score, word, skip, anchor), start


def _places(h: np.ndarray, room: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the words of a phrase stand one after another in one text; room: words left in the text from each one on."""
    if len(h) < len(phrase):
        return np.zeros(0, np.int64)
    n = len(h) - len(phrase) + 1
    ok = room[:n] >= len(phrase)
    for j, w in enumerate(phrase):
        ok &= h[j : j + n] == np.uint64(w)
    return np.flatnonzero(ok)


def _scan(templates):
    def run(batches):
        import pyarrow as pa

        hasher = WordHasher("alnum")
        automata = [compile_template(m, label, score, hasher) for label, score, m in templates]
        phrases = [(_words(p, hasher).tolist(), label) for p, label in PHRASES]
        for b in sliced(batches, 1):
            h, off, _, _ = hasher(*utf8(b.column(1)))
            docs = len(off) - 1
            owner = np.repeat(np.arange(docs), np.diff(off))
            room = off[1:][owner] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)
            n_base = np.zeros(docs, np.int64)
            first = np.full(docs, np.iinfo(np.int64).max)
            last = np.full(docs, -1)
            base: dict[int, set[str]] = {}
            score = np.zeros(docs)
            for words, label in phrases:
                at = _places(h, room, words)
                d = owner[at]
                np.add.at(n_base, d, 1)
                np.minimum.at(first, d, at - off[d])
                np.maximum.at(last, d, at - off[d])
                for x in set(d.tolist()):
                    base.setdefault(x, set()).add(label)
                    score[x] = max(score[x], BASE_SCORE)
            more: dict[int, set[str]] = {}
            for auto, start in automata:
                at = _places(h, room, auto.anchor)
                for i, d in zip(at.tolist(), owner[at].tolist(), strict=True):
                    if auto.label in more.get(d, ()) and score[d] >= auto.score:
                        continue
                    if auto.accepts(h[i : min(off[d + 1], i + len(auto.word))].tolist(), 0, start) is not None:
                        more.setdefault(d, set()).add(auto.label)
                        score[d] = max(score[d], auto.score)
            none = last < 0
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(np.diff(off).astype(np.int64)),
                    pa.array(n_base),
                    pa.array(first.astype(np.int64), mask=none),
                    pa.array(last.astype(np.int64), mask=none),
                    pa.array([",".join(sorted(base.get(d, ()))) for d in range(docs)], pa.string()),
                    pa.array([",".join(sorted(base.get(d, set()) | more.get(d, set()))) for d in range(docs)], pa.string()),
                    pa.array(score),
                ],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, float, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    labels adds those of accepted templates to the phrases' base labels; score is the best
    template's, BASE_SCORE for a phrase alone, 0 without either.  A null text counts as empty:
    no words, null positions, empty labels.  Null ids and repeated rows pass through; other
    columns are ignored; texts are never cut.
    """
    small_batches(docs.sparkSession)
    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(_scan(tuple(templates.values())), schema)
    return out.withColumnRenamed("id", id_col)
