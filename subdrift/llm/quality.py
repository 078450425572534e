"""Quality rules with a suffix array of the words of each document.

The suffixes of every document are sorted by prefix doubling, all documents of a step in
one vectorised sort. Longest common prefixes of neighbours in that order give, for each
word, the longest substring that starts there and occurs again in the document: the
deepest interval of the suffix array that holds the suffix. The union of these spans is
the repeated part of the document; its share and its longest span are limited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subdrift.llm.common import steps, text_column, utf8

# Characters counted as symbols, and white space between words.
SYMBOLS = b"#*$%&|<>"
WHITE_SPACE = b" \t\n\x0b\x0c\r"
BASE_WINDOW = 3
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50
# Text whose suffixes are sorted together, in bytes.
BATCH_BYTES = 2 << 20


@dataclass(frozen=True)
class Limits:
    """A repeat counts from ``min_repeat`` words. A document is rejected if repeats cover
    more than ``max_covered_percent`` of its words or one reaches ``long_repeat`` words."""

    min_repeat: int = 8
    max_covered_percent: int = 50
    long_repeat: int = 200


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, n_maximal_repeats long, longest_repeat long"
)


def quality(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Counts and verdict for every row of ``documents`` (``doc_id``, ``text``).

    A null or empty text has no words and fails. Rows are judged one by one, so repeated
    rows and ids and null ids give a row each; other columns are ignored; an empty table
    gives an empty result. A text of any length is sorted whole.
    """
    counted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(
        lambda batches: _count(batches, limits), SCHEMA
    )
    base_failed = (F.col("n_words") < BASE_MIN_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words")
    )
    repetitive = (100 * F.col("covered_words") > limits.max_covered_percent * F.col("n_words")) | (
        F.col("longest_repeat") >= limits.long_repeat
    )
    return counted.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~repetitive)


def keep_good(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``documents`` that pass, with all their columns.

    The verdict is found beside each row in one pass, without a join.
    """
    verdicts = quality_of_text(limits)
    return documents.where(verdicts(text_column()))


def quality_of_text(limits: Limits = Limits()):
    """A vectorised function from a text column to the verdict."""

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        # A batch is a number of rows, whatever their length; what is sorted together is cut by bytes.
        verdicts = [np.zeros(0, bool)]
        for part in steps([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", BATCH_BYTES):
            c = measure(utf8(part, "text"), limits)
            failed = (c["n_words"] < BASE_MIN_WORDS) | (100 * c["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * c["n_words"])
            repetitive = (100 * c["covered_words"] > limits.max_covered_percent * c["n_words"]) | (
                c["longest_repeat"] >= limits.long_repeat
            )
            verdicts.append(~failed & ~repetitive)
        return pa.array(np.concatenate(verdicts))

    return good


def _count(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", BATCH_BYTES):
        columns = measure(utf8(batch, "text"), limits)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in columns.values())],
            names=["doc_id", *columns],
        )


def measure(texts: list[bytes], limits: Limits) -> dict[str, np.ndarray]:
    """The counts of each text."""
    vocabulary: dict[bytes, int] = {}
    sizes, ids, word_chars, symbols, dup_lines = [], [], [], [], []
    for text in texts:
        words = text.split()
        sizes.append(len(words))
        ids.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
        del words
        bare = text.translate(None, WHITE_SPACE)
        word_chars.append(len(bare.decode("utf-8", "surrogatepass")))
        symbols.append(len(bare) - len(bare.translate(None, SYMBOLS)))
        lines = [line for line in text.split(b"\n") if line.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    n_docs = len(texts)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), sizes)
    repeats = longest_repeats(np.concatenate(ids) if ids else np.zeros(0, np.int32), doc)
    inner = np.where(repeats >= limits.min_repeat, repeats, 0)
    # A span whose left neighbour reaches as far does not start a maximal repeat.
    follows = np.zeros(len(inner), bool)
    follows[1:] = (inner[1:] > 0) & (inner[:-1] == inner[1:] + 1) & (doc[1:] == doc[:-1])
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, doc, repeats)
    return {
        "n_words": np.array(sizes, np.int64),
        "word_chars": np.array(word_chars, np.int64),
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": _covered(np.where(repeats >= BASE_WINDOW, BASE_WINDOW, 0), doc, n_docs),
        "covered_words": _covered(inner, doc, n_docs),
        "n_maximal_repeats": np.bincount(doc[(inner > 0) & ~follows], minlength=n_docs),
        "longest_repeat": longest,
    }


def _covered(spans: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document in the union of the spans ``[i, i + spans[i])``."""
    n = len(spans)
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(spans)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + spans[starts], -1)
    return np.bincount(doc[np.cumsum(edges)[:n] > 0], minlength=n_docs)


def longest_repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place the length of the longest substring that starts there and at another
    place of the same document too (places may overlap). ``doc`` ascends.

    Memory is a fixed number of arrays of the length of the text, however repetitive it is.
    """
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order = _suffix_array(ids, doc)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    del order
    common = _common_prefixes(ids, doc, before)
    longest[:] = common
    shared = np.flatnonzero(common)
    np.maximum.at(longest, before[shared], common[shared])
    return longest


def _common_prefixes(ids: np.ndarray, doc: np.ndarray, before: np.ndarray, together: int = 64) -> np.ndarray:
    """Common prefix of every suffix with the one ``before`` it in their order.

    Where the words to the left of both are equal, the prefix is that of the place to the
    left less one; only the other places are compared, word by word, and their prefixes
    add up to n log n words at most. The first ``together`` words are compared for all
    places at once, longer ones in doubling slices.
    """
    n = len(ids)
    place = np.flatnonzero((before >= 0) & (doc == doc[before]))
    near = before[place]
    left = (place > 0) & (near > 0)
    left &= (ids[place - 1] == ids[near - 1]) & (doc[place - 1] == doc[place]) & (doc[near - 1] == doc[near])
    # The place to the left must have that very neighbour's left neighbour before it.
    left &= before[place - 1] == near - 1
    follows = np.zeros(n, bool)
    follows[place[left]] = True
    i, j = place[~left], near[~left]
    room = np.searchsorted(doc, doc[i], side="right") - np.maximum(i, j)
    common = np.zeros(n, np.int64)
    length = np.zeros(len(i), np.int64)
    active = np.arange(len(i))
    for step in range(together):
        active = active[room[active] > step]
        active = active[ids[i[active] + step] == ids[j[active] + step]]
        if not len(active):
            break
        length[active] += 1
    for k in active.tolist():
        a, b, have, end, width = int(i[k]), int(j[k]), int(length[k]), int(room[k]), together
        while have < end:
            width = min(width, end - have)
            differ = np.flatnonzero(ids[a + have : a + have + width] != ids[b + have : b + have + width])
            if len(differ):
                have += int(differ[0])
                break
            have, width = have + width, 2 * width
        length[k] = have
    common[i] = length
    # A run of places that follow one another counts down from its first.
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(follows, 0, at))
    return np.where(follows, common[first] - (at - first), common)


def _suffix_array(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Suffixes in the order of (document, words)."""
    n = len(ids)
    last = np.searchsorted(doc, doc, side="right")  # end of the own document
    rank = _ranks(doc * (int(ids.max()) + 1) + ids, np.zeros(n, np.int64))
    length = 1
    tied = np.arange(n)
    while True:
        # Only what is tied still can be told apart by more words.
        sizes = np.bincount(rank[tied], minlength=n)
        tied = tied[sizes[rank[tied]] > 1]
        del sizes
        if not len(tied):
            break
        ahead = tied + length
        follower = np.where(ahead < last[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
        # A suffix that has ended differs from every other, longer or equal.
        old = rank[tied]
        rank[tied] = old + _offsets(old, follower, n)
        length *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def _ranks(key: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Number of smaller keys."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    return rank


def _offsets(group: np.ndarray, follower: np.ndarray, n: int) -> np.ndarray:
    """Number of smaller followers within the same group."""
    place = _ranks(group * (n + 2) + follower, group)
    return place - _ranks(group, group)
