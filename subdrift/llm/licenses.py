"""Licence scan with a generalised suffix automaton of licence texts.

One automaton holds the words of all texts. A document streams through it once: after
each word the automaton knows the longest text piece that ends there (the matching
statistics). Pieces that cannot be extended are chained, per text, in the order of the
document and of the text, with bounded gaps; a chain that covers enough of a text is a
span of its licence, if it holds the words that set the text apart from similar ones. A
short text has few words and each may matter, so it must be there whole. Where spans
of several licences lie over each other, the one that covers most words stays. Phrases that name a licence are read off the same states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subdrift.llm.common import steps, text_column, utf8
from subdrift.llm.license_texts import MARKS, PHRASES, TEMPLATES
from subdrift.llm.suffix_automaton import SuffixAutomaton

# ASCII letters in lower case, digits and every byte above ASCII make words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, spans array<struct<label string, start long, end long, score double>>"
)


@dataclass(frozen=True)
class Chaining:
    """A piece counts from ``min_piece`` words, two pieces of a chain lie at most
    ``max_gap`` words apart, and a chain needs ``min_share`` of its text; texts of fewer
    than ``short`` words must be found whole, in a row."""

    min_piece: int = 4
    max_gap: int = 24
    min_share: float = 0.6
    short: int = 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton(SuffixAutomaton):
    """The automaton of some texts; the note of a state are the ends of its pieces in each text
    that has them, all of them."""

    def __init__(self, texts: list[list[bytes]]):
        super().__init__()
        for number, text in enumerate(texts):
            for end, state in enumerate(self.add(text), 1):
                while state > 0:
                    known = self.note[state] or {}  # may be shared with a state split off
                    self.note[state] = known | {number: (*known.get(number, ()), end)}
                    state = self.link[state]

    def state_of(self, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self.follow[state][word]
        return state


class Scanner:
    """The automaton with its phrases, ready for documents."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, chaining: Chaining = Chaining(), marks=MARKS):
        self.chaining = chaining
        self.marks = {label: b" " + b" ".join(words_of(mark.encode())) + b" " for label, mark in marks.items()}
        split = [(label, words_of(text.encode())) for label, text in templates]
        self.labels = [label for label, words in split if len(words) >= chaining.short]
        texts = [words for _, words in split if len(words) >= chaining.short]
        # Short texts are found like the phrases, whole, but give spans and no base places.
        named = [(words_of(phrase.encode()), label, True) for phrase, label in phrases.items()]
        named += [(words, label, False) for label, words in split if 0 < len(words) < chaining.short]
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton(texts + [words for words, _, _ in named])
        self.vocabulary = frozenset(w for t in [*texts, *[words for words, _, _ in named]] for w in t)
        at = {}
        for words, label, is_base in named:
            at.setdefault(self.automaton.state_of(words), []).append((len(words), label, is_base))
        # Phrases that end wherever a state ends: those of the state and of its suffixes.
        self.phrases: list[tuple] = []
        for state in range(len(self.automaton.link)):
            found, s = [], state
            while s > 0:
                found += at.get(s, [])
                s = self.automaton.link[s]
            self.phrases.append(tuple(found))

    def scan(self, text: bytes) -> tuple:
        words = words_of(text)
        places, whole, pieces = [], [], []
        known = [i for i, word in enumerate(words) if word in self.vocabulary]
        for _, run in groupby(enumerate(known), lambda x: x[1] - x[0]):
            run = [i for _, i in run]
            if len(run) > 1:
                self._run(words, run[0], run[-1] + 1, places, whole, pieces)
        spans = self._chosen(self._chains(pieces) + whole, words)
        base = {label for _, label in places}
        starts = [start for start, _ in places]
        return (
            len(words),
            len(places),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(base | {s["label"] for s in spans})),
            max((s["score"] for s in spans), default=1.0 if base else 0.0),
            spans,
        )

    def _run(self, words, first, stop, places, whole, pieces):
        shortest = self.chaining.min_piece
        held = (0, 0, 0)
        for i, state, length in self.automaton.statistics(words, first, stop):
            for size, label, is_base in self.phrases[state]:
                if size <= length and is_base:
                    places.append((i + 1 - size, label))
                elif size <= length:
                    whole.append({"label": label, "start": i + 1 - size, "end": i + 1, "score": 1.0, "covered": size, "chained": False})
            if length <= held[2] and held[2] >= shortest:
                pieces.append(held)
            held = (i + 1, state, length)
        if held[2] >= shortest:
            pieces.append(held)

    def _chains(self, pieces: list[tuple[int, int, int]]) -> list[dict]:
        """Best chain of each text and stretch of the document: pieces follow each other in
        both, and only those within the largest gap are looked back at."""
        gap = self.chaining.max_gap
        by_text: dict[int, list] = {}
        for end, state, length in pieces:
            for text, places in self.automaton.note[state].items():
                if text < len(self.sizes):
                    by_text.setdefault(text, []).extend((end, place, length) for place in places)
        spans = []
        for text, found in by_text.items():
            best: list[tuple[int, int]] = []  # words covered by the best chain up to a piece, and its start
            groups: dict[int, tuple[int, int]] = {}
            for k, (end, place, length) in enumerate(found):
                covered, start = length, end - length
                j = k - 1
                while j >= 0 and found[j][0] >= end - length - gap:
                    before, at, _ = found[j]
                    if at < place and end > before:
                        gain = min(length, place - at, end - before)
                        if best[j][0] + gain > covered:
                            covered, start = best[j][0] + gain, best[j][1]
                    j -= 1
                best.append((covered, start))
                groups[start] = max(groups.get(start, (0, 0)), (covered, end))
            size = self.sizes[text]
            for start, (covered, end) in groups.items():
                share = min(1.0, covered / size)
                if share >= self.chaining.min_share:
                    spans.append({"label": self.labels[text], "start": start, "end": end, "score": share, "covered": covered, "chained": True})
        return spans

    def _chosen(self, spans: list[dict], words: list[bytes]) -> list[dict]:
        """Of the chains those with the words that set their licence apart, without those that lie
        by half or more under a chain of another licence that covers more words."""
        marked = []
        for s in spans:
            mark = self.marks.get(s["label"])
            if not s["chained"] or mark is None or mark in b" " + b" ".join(words[s["start"] : s["end"]]) + b" ":
                marked.append(s)
        marked.sort(key=lambda s: (-s["covered"], -s["score"], s["label"], s["start"]))
        kept: list[dict] = []
        for s in marked:
            over = lambda k, s=s: 2 * (min(k["end"], s["end"]) - max(k["start"], s["start"])) >= s["end"] - s["start"]
            if not any(k["label"] != s["label"] and over(k) for k in kept):
                kept.append(s)
        out = [{k: s[k] for k in ("label", "start", "end", "score")} for s in kept]
        return sorted(out, key=lambda s: (s["start"], s["end"], s["label"]))


def scan_licenses(
    documents: DataFrame, templates=TEMPLATES, phrases=PHRASES, chaining: Chaining = Chaining(), marks=MARKS
) -> DataFrame:
    """Licence labels and spans for every row of ``documents`` (``doc_id``, ``text``).

    Words count from 0, ends are exclusive. A null or empty text has no words, empty labels
    and score 0; the score is the largest covered share of a text, 1 where only a phrase is
    found. Rows are scanned one by one: repeated rows and null ids give a row each; other
    columns are ignored; an empty table gives an empty result. The automaton depends on
    the given texts only and is built once per task.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return docs.mapInArrow(lambda batches: _scan(batches, templates, phrases, chaining, marks), SCHEMA)


def _scan(batches: Iterator[pa.RecordBatch], templates, phrases, chaining, marks) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, phrases, chaining, marks)
    span = pa.struct(
        [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]
    )
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    names = [field.split()[0] for field in SCHEMA.split(", ", 8)]
    for batch in steps(batches, "text"):
        rows = [scanner.scan(text) for text in utf8(batch, "text")]
        columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)
