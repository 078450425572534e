"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are a query set: they are taken in blocks of bounded size, each of which is held
against all documents. Every n-gram of an item is a seed, however frequent it is: a copy
that leaked often makes its own n-grams frequent. A document that has a seed is aligned,
word by word, with the item around it, unless too few words of the item are there for any
alignment to suffice; the score of the best local alignment, as a share of that of the
whole item, finds copies that were edited or paraphrased in places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subdrift.llm.common import steps, text_column, utf8, written
from subdrift.llm.exchange import among, mixed
from subdrift.llm.licenses import words_of
from subdrift.llm.repeated_words import Words

_STEP = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id long, item_id long, score double, first_word long, last_word long"


@dataclass(frozen=True)
class Matching:
    """Seeds have ``n`` words. A match counts ``match``, a differing, left out or put in word
    costs 1. A document is contaminated from ``least`` of the score of the item and
    ``least_words`` equal words (or all, if the item has fewer). ``block_words`` of items
    are looked for at a time."""

    n: int = 3
    match: int = 2
    least: float = 0.5
    least_words: int = 8
    block_words: int = 200_000


class Items:
    """A block of items: words as numbers, and their n-grams in order."""

    def __init__(self, rows: list[tuple[int, str]], matching: Matching):
        self.ids = [i for i, _ in rows]
        self.words = [words_of(text.encode("utf-8", "surrogatepass")) for _, text in rows]
        hashes = Words(1, 1)
        self.hashes = [hashes.hashes(w) for w in self.words]
        grams, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, h in enumerate(self.hashes):
            g = _grams(h, matching.n)
            grams.append(g)
            owners.append(np.full(len(g), k))
            places.append(np.arange(len(g)))
        grams, owners, places = map(np.concatenate, (grams, owners, places))
        order = np.argsort(grams, kind="stable")
        self.grams, self.owners, self.places = grams[order], owners[order], places[order]
        # Of each distinct n-gram: its first place in the order, and how many there are.
        self.distinct, self.first, self.many = np.unique(self.grams, return_index=True, return_counts=True)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams; a shorter text is one n-gram of its own."""
    if not len(hashes):
        return hashes
    width = min(n, len(hashes))
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        out = out * _STEP + hashes[i : len(hashes) - width + 1 + i]
    return mixed(out)


def align(item: np.ndarray, passage: np.ndarray, match: int) -> tuple[int, int]:
    """Best local alignment: its score and where it ends in the passage (exclusive)."""
    at = np.arange(len(passage))
    row = np.zeros(len(passage), np.int64)
    best, end = 0, 0
    for word in item:
        diagonal = np.concatenate([[0], row[:-1]]) + np.where(passage == word, match, -1)
        top = np.maximum(np.maximum(diagonal, row - 1), 0)
        row = np.maximum.accumulate(top + at) - at  # words put in cost one each
        k = int(np.argmax(row))
        if row[k] > best:
            best, end = int(row[k]), k + 1
    return best, end


def _starts(at: np.ndarray, gram: np.ndarray, items: Items, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """Every item that has one of the n-grams ``gram`` (numbers of distinct ones) found at the
    words ``at``, and where it would start by them, in order; may be below 0. About
    ``limit`` pairs are looked at together."""
    if not len(at):
        return
    shift = max(map(len, items.hashes))
    ends = np.concatenate([[0], np.cumsum(items.many[gram])])
    keys, first = [], 0
    while first < len(at):
        stop = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        many = items.many[gram[first:stop]]
        slot = np.arange(ends[first], ends[stop]) + np.repeat(items.first[gram[first:stop]] - ends[first:stop], many)
        start = np.repeat(at[first:stop], many) - items.places[slot]
        keys.append(np.unique((items.owners[slot] << 40) + start + shift))
        first = stop
    found = np.unique(np.concatenate(keys)) if len(keys) > 1 else keys[0]
    owner, start = found >> 40, (found & (1 << 40) - 1) - shift
    edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)).tolist()
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(owner[a]), start[a:b]


def search(text: bytes, items: Items, matching: Matching, hashes: Words) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, last word) of every item found in a text: its best place."""
    words = hashes.hashes(words_of(text))
    known, place = among(_grams(words, matching.n), items.distinct)
    for k, starts in _starts(np.flatnonzero(known), place[known], items):
        item = items.hashes[k]
        size, whole = len(item), matching.match * len(item)
        best = (0, 0, 0)
        at = 0
        while at < len(starts):
            # One stretch for all hits that lie close together.
            start = int(starts[at])
            at = int(np.searchsorted(starts, start + size, "right"))
            first, stop = max(0, start - size), min(len(words), start + 3 * size)
            passage = words[first:stop]
            # No alignment has more matches than the item has words in the passage.
            if matching.match * int(np.isin(item, passage).sum()) < matching.least * whole:
                continue
            score, end = align(item, passage, matching.match)
            if score > best[0]:
                back, length = align(item[::-1], passage[:end][::-1], matching.match)
                best = (score, first + end - length, first + end - 1)
        enough = matching.match * min(size, matching.least_words)
        if best[0] >= matching.least * whole and best[0] >= enough:
            yield items.ids[k], best[0] / whole, best[1], best[2]


def _blocks(benchmark: DataFrame, matching: Matching) -> Iterator[Items]:
    """The items, in blocks of bounded size."""
    asked = written(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_column().alias("text")).where("item_id is not null"), "items"
    )
    # A word takes two bytes at least.
    size = asked.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // (2 * matching.block_words)))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    for block in range(n_blocks):
        rows = [(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == block).collect()]
        items = Items(sorted(set(rows)), matching)
        if len(items.grams):
            yield items


def find_items(documents: DataFrame, benchmark: DataFrame, matching: Matching = Matching()) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word`` for every document that holds a test
    item (its best place; words of ASCII letters and digits and all other characters above).

    Null and empty texts hold nothing and are not looked for; an item of fewer words than a
    seed is looked for as a whole. A passage that shares no ``n`` words in a row with the
    item has no seed and is not found, whatever its score. Repeated documents give a row each, with a null id too;
    an item that stands twice in ``benchmark`` counts once, one without an id is left out.
    Other columns are ignored; an empty table on either side gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    found = []
    for items in _blocks(benchmark, matching):
        block = docs.sparkSession.sparkContext.broadcast(items)

        def find(batches, block=block):
            hashes = Words(1, 1)
            for batch in batches:
                for part in steps([batch], "text"):
                    rows = [
                        (doc_id, *hit)
                        for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part, "text"))
                        for hit in search(text, block.value, matching, hashes)
                    ]
                    columns = list(zip(*rows)) if rows else [[]] * 5
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), kind) for c, kind in zip(columns, kinds)],
                        names=[f.split()[0] for f in FOUND.split(", ")],
                    )

        found.append(docs.mapInArrow(find, FOUND))
    if not found:
        return docs.sparkSession.createDataFrame([], FOUND)
    return reduce(DataFrame.unionByName, found)


def without_items(documents: DataFrame, benchmark: DataFrame, matching: Matching = Matching()) -> DataFrame:
    """The rows of ``documents`` that hold no test item, with all their columns, found row
    by row without a join."""
    left = documents
    for items in _blocks(benchmark, matching):
        left = left.where(_clean(documents.sparkSession.sparkContext.broadcast(items), matching)(text_column()))
    return left


def _clean(block, matching: Matching):
    """A vectorised function from a text column to whether it holds none of the items."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        hashes = Words(1, 1)
        parts = steps([pa.RecordBatch.from_arrays([texts], names=["text"])], "text")
        return pa.array([next(search(raw, block.value, matching, hashes), None) is None for part in parts for raw in utf8(part, "text")], pa.bool_())

    return clean
