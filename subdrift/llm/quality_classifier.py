"""Quality classifier: a factorisation machine over words, structure and metadata.

Words are hashed into slots and weighted by their share of the text; statistics of the
structure and the metadata of a document each light up one bucket. Every pair of features
interacts with the strength of the product of two short vectors. Spark's own
factorisation machine learns from a bounded sample of labelled documents; all documents
are then scored beside their text in one pass, in time linear in their features, as the
sum over pairs is half of the square of the sum less the sum of the squares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subdrift.llm.common import steps, text_column, utf8, written

# Classes of characters.
UPPER, LOWER = (bytes(range(a, a + 26)) for a in (0x41, 0x61))
DIGITS, SYMBOLS, POINTS = b"0123456789", b"#*$%&|<>", b".,;:!?"
_LOWERED = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

BUCKETS = 16
STRUCTURE = (
    "words", "word_length", "line_length", "upper", "digits", "symbols", "points", "exclaims", "single", "stuttered", "distinct",
    "most_frequent", "repeated_lines", "given_length", "length_agrees",
)
STEP_BYTES = 4 << 20
TASKS = 8
FOLDS = 5


@dataclass(frozen=True)
class Fit:
    """Words fall into ``slots``; a vector has ``factors`` numbers. About ``sample`` labelled
    rows, drawn by hash from all, are learned from in ``steps`` rounds. All words of a text
    together weigh as much as ``word_weight`` buckets of its structure."""

    slots: int = 1 << 14
    factors: int = 6
    sample: int = 12_000
    word_weight: float = 0.3
    steps: int = 80
    rate: float = 0.02
    shrinkage: float = 1e-3
    seed: int = 5

    @property
    def size(self) -> int:
        return BUCKETS * len(STRUCTURE) + self.slots


@dataclass(frozen=True)
class Machine:
    """A fitted machine; its size is fixed by ``Fit``, not by the corpus."""

    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def probability(self, starts: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Of label 1 for documents whose features begin at ``starts`` (each has some)."""
        if not len(starts):
            return np.zeros(0)
        single = np.add.reduceat(self.linear[index] * value, starts)
        part = self.factors[index] * value[:, None]
        pairs = np.add.reduceat(part, starts) ** 2 - np.add.reduceat(part * part, starts)
        margin = self.intercept + single + pairs.sum(axis=1) / 2
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def features(texts: list[bytes], given: list[int | None], fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the features of each text start, their numbers (ascending in a text) and values."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    vocabulary: dict[bytes, int] = {}
    sizes, numbers, chars = [], [], []
    for text in texts:
        words = text.translate(_LOWERED).split()
        sizes.append(len(words))
        numbers.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64))
        count = lambda kinds, text=text: len(text) - len(text.translate(None, kinds))
        lines = [line for line in text.split(b"\n") if line.strip()]
        chars.append(
            (
                len(text.decode("utf-8", "surrogatepass")), sum(map(len, words)), len(lines), len(lines) - len(set(lines)), count(UPPER),
                count(LOWER), count(DIGITS), count(SYMBOLS), count(POINTS), text.count(b"!"), sum(len(w) == 1 for w in words),
            )
        )
    sizes = np.array(sizes, np.int64)
    length, in_words, lines, repeated, upper, lower, digits, symbols, points, exclaims, single = np.array(chars, np.int64).T
    word = np.concatenate(numbers)
    doc = np.repeat(np.arange(n), sizes)

    # The words of each text in slots, as a vector of length 1.
    slot_of = np.fromiter((xxhash.xxh64_intdigest(w) % fit.slots for w in vocabulary), np.int64, len(vocabulary))
    word_key, word_n = np.unique(doc * max(1, len(vocabulary)) + word, return_counts=True)
    word_doc = word_key // max(1, len(vocabulary))
    key, at = np.unique(word_doc * fit.slots + slot_of[word_key % max(1, len(vocabulary))], return_inverse=True)
    times = np.bincount(at, word_n, len(key))
    slot_doc = key // fit.slots
    norm = np.sqrt(np.bincount(slot_doc, times**2, n))

    stuttered = np.bincount(doc[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(word) else np.zeros(n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, word_doc, word_n)
    share = lambda part, whole: np.ceil((BUCKETS - 1) * np.sqrt(part / np.maximum(whole, 1)))
    scale = lambda x: np.ceil(np.log2(np.maximum(x, 0) + 1))
    told = np.array([-1 if g is None else g for g in given], np.int64)
    letters = upper + lower
    structure = {
        "words": scale(sizes),
        "word_length": np.floor(in_words / np.maximum(sizes, 1)),
        "line_length": scale(sizes / np.maximum(lines, 1)),
        "upper": share(upper, letters),
        "digits": share(digits, length),
        "symbols": share(symbols, length),
        "points": share(points, length),
        "exclaims": share(exclaims, length),
        "single": share(single, sizes),
        "stuttered": share(stuttered, sizes),
        "distinct": share(np.bincount(word_doc, minlength=n), sizes),
        "most_frequent": share(most, sizes),
        "repeated_lines": share(repeated, lines),
        "given_length": np.where(told < 0, 0, 1 + scale(told) / 2),
        "length_agrees": np.where(told < 0, 0, 1 + (told == length)),
    }
    buckets = np.stack([np.clip(structure[name], 0, BUCKETS - 1).astype(np.int64) for name in STRUCTURE])
    buckets += BUCKETS * np.arange(len(STRUCTURE))[:, None]

    base = BUCKETS * len(STRUCTURE)
    owner = np.concatenate([np.tile(np.arange(n), len(STRUCTURE)), slot_doc])
    index = np.concatenate([buckets.ravel(), base + key % fit.slots])
    # All words together weigh as much as ``word_weight`` buckets.
    value = np.concatenate([np.ones(buckets.size), fit.word_weight * times / norm[slot_doc]])
    order = np.argsort(owner * (base + fit.slots) + index, kind="stable")
    owner = owner[order]
    return np.searchsorted(owner, np.arange(n)), index[order], value[order]


def _columns(documents: DataFrame) -> list[Column]:
    """Text and metadata; a missing length is like an unknown one."""
    given = F.col("n_chars").try_cast("long") if "n_chars" in documents.columns else F.lit(None).cast("long")
    return [text_column().alias("text"), given.alias("n_chars")]


def _featured(batches: Iterator[pa.RecordBatch], fit: Fit):
    for batch in batches:
        for part in steps([batch], "text", STEP_BYTES):
            yield part, *features(utf8(part, "text"), part.column("n_chars").to_pylist(), fit)


def fold(doc_id: Column) -> Column:
    """The number of the fold, by the checksum of the id as text (null: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def fitted(documents: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Machine:
    """The machine learned from ``labels`` (``doc_id``, ``quality``) and their ``documents``.

    Labels other than 0 and 1, without an id or without a document teach nothing; one that
    stands twice teaches twice. Where one class is missing, every document gets the share
    of label 1 among the labels, or a half if there are none.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select(
        F.col("doc_id").cast("long").alias("_doc_id"), F.col("quality").cast("double").alias("label")
    )
    counts = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    n, ones = counts[0], counts[1] or 0.0
    nothing = Machine(0.0, np.zeros(fit.size), np.zeros((fit.size, fit.factors)))
    if not 0 < ones < n:
        return nothing if not n else Machine(700.0 if ones else -700.0, nothing.linear, nothing.factors)
    # Drawn by hash: the same rows each time, from all parts of the table alike.
    draw = F.pmod(F.xxhash64(F.lit(fit.seed), "_doc_id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = written(known.where(draw < fit.sample / n), "labels")
    # Its size is bounded by ``sample``, whatever the size of the corpus.
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_columns(documents))
    taught = docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("_doc_id"))

    def described(batches):
        for part, starts, index, value in _featured(batches, fit):
            ends = pa.array(np.append(starts, len(index)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("label"),
                    pa.ListArray.from_arrays(ends, pa.array(index, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(value, pa.float64())),
                ],
                names=["doc_id", "label", "index", "value"],
            )

    size = fit.size
    vector = F.udf(lambda index, value: SparseVector(size, index, value), VectorUDT())
    described_rows = taught.select("doc_id", "label", "text", "n_chars").mapInArrow(
        described, "doc_id long, label double, index array<int>, value array<double>"
    )
    # The sample is small, and every round of the fit runs a task for each of its parts.
    rows = written(described_rows.repartition(TASKS, "doc_id"), "taught")
    classes = {r["label"] for r in rows.groupBy("label").count().collect()}
    if len(classes) < 2:
        share = ones / n
        return Machine(float(np.log(share / (1 - share))), nothing.linear, nothing.factors)
    machine = FMClassifier(
        factorSize=fit.factors, maxIter=fit.steps, stepSize=fit.rate, regParam=fit.shrinkage, seed=fit.seed, initStd=0.05, solver="adamW"
    ).fit(rows.select("label", vector("index", "value").alias("features")))
    return Machine(float(machine.intercept), machine.linear.toArray(), machine.factors.toArray())


def scored(documents: DataFrame, machine: Machine, fit: Fit = Fit()) -> DataFrame:
    """``doc_id`` and ``score``, the probability of label 1, for every row of ``documents`` (``doc_id``,
    ``text`` and, if there, ``n_chars``).

    A null text is an empty one; empty texts are scored by their structure. Rows are scored
    one by one, whole, with repeated and null ids too. Other columns are ignored; an empty
    table gives an empty result.
    """
    held = documents.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def score(batches):
        for part, starts, index, value in _featured(batches, fit):
            found = held.value.probability(starts, index, value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_columns(documents))
    return docs.mapInArrow(score, "doc_id long, score double")
