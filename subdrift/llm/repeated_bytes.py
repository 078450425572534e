"""Suffix-array dedup by threshold-bounded interval expansion.

Pieces of documents that may hold repeated strings meet in shards (``windows``). A shard
lays its distinct pieces end to end and forms their Burrows-Wheeler transform. From the
interval of all suffixes, backward extension goes breadth first: every interval of
strings of one length is extended by each byte before it, and where a new interval ends,
the common prefix of the two neighbours is the length reached, unless it was found
before. Values therefore appear by increasing length, and the search stops at the least
length: places still without a value join suffixes that share at least that much.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from subdrift.llm.exchange import BLOCK_BYTES, blocked, mixed
from subdrift.llm.windows import HOT_BLOCKS, Search, Units, covered, decided_windows

# A byte that UTF-8 never uses parts the pieces.
_BETWEEN = b"\xff"


class Bytes(Units):
    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.numbers = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def split(self, text: bytes) -> bytes:
        return text

    def joined(self, parts: list[bytes]) -> bytes:
        return b"".join(parts)

    def hashes(self, raw: bytes) -> np.ndarray:
        return self.numbers[np.frombuffer(raw, np.uint8)]

    def cut(self, raw: bytes, first: int, stop: int) -> bytes:
        return raw[first:stop]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``text`` in the order of their first ``depth`` bytes, by doubling; only
    ties are sorted again."""
    n = len(text)
    wide = np.concatenate([text, text[:8]] if n >= 8 else [np.resize(text, n + 8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | wide[i : i + n].astype(np.uint64)
    order = np.argsort(key)  # ties get one rank, so their order is free
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    length = 8
    while length < depth:
        sizes = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(sizes[rank] > 1)
        if not len(tied):
            break
        group, follower = rank[tied], rank[(tied + length) % n]
        by = np.argsort(group * n + follower)
        g, f = group[by], follower[by]
        at = np.arange(len(by))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), at, 0))
        same = np.maximum.accumulate(np.where(np.concatenate([[True], (g[1:] != g[:-1]) | (f[1:] != f[:-1])]), at, 0))
        rank[tied[by]] = g + same - first
        length *= 2
    return np.argsort(rank * n + np.arange(n))


def long_common(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether suffix ``i`` of the order shares ``least`` bytes or more with the one before."""
    n = len(text)
    before = text[order - 1]  # the transform
    to_front = np.argsort(before, kind="stable")  # from the first column to the last
    step = np.empty(n, np.int64)
    step[to_front] = np.arange(n)  # place of the suffix that is one byte longer
    head = text[order]
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)  # ends exclusive
    for _ in range(least):
        sizes = high - low
        inside = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        of = np.repeat(np.arange(len(low)), sizes)
        longer = step[inside]
        by = np.argsort(longer)
        longer, of = longer[by], of[by]
        # Neighbours with one interval and one byte form the interval of the longer string.
        parted = (longer[1:] != longer[:-1] + 1) | (of[1:] != of[:-1]) | (head[longer[1:]] != head[longer[:-1]])
        first = np.flatnonzero(np.concatenate([[True], parted]))
        low, high = longer[first], longer[np.append(first[1:], len(longer)) - 1] + 1
        fresh = unset[high]
        low, high = low[fresh], high[fresh]
        unset[high] = False
        if not len(low):
            break
    return unset[:n]


def repeated_starts(pieces: list[bytes], window: int) -> list[np.ndarray]:
    """For every piece, which windows also start elsewhere in the pieces (1 or 0)."""
    text = np.frombuffer(_BETWEEN.join(pieces) + _BETWEEN, np.uint8)
    order = suffix_order(text, window)
    joined = long_common(text, order, window)
    again = np.zeros(len(text), np.int64)
    again[order[joined]] = 1
    again[order[np.flatnonzero(joined) - 1]] = 1
    at, found = 0, []
    for piece in pieces:
        found.append(again[at : at + len(piece) - window + 1])
        at += len(piece) + 1
    return found


def remove_repeated_bytes(
    documents: DataFrame, window: int = 200, gram: int = 64, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` for every row of ``documents``.

    Removes each byte covered by a string of ``window`` bytes that also starts anywhere
    else, in the same row or another; overlaps count. A null or empty text has no bytes.
    Repeated rows are places of their own and so remove each other; null ids are rows
    like any other. Kept bytes may end inside a character. Other columns are ignored; an
    empty table gives an empty result.
    """
    blocks, n_blocks = blocked(documents, block_bytes)

    def decide(pieces: list[bytes], low: np.ndarray, high: np.ndarray):
        found = repeated_starts(pieces, window)
        for k in np.flatnonzero(high > low):
            found[k] = np.ones_like(found[k])
        return found, np.array([f.any() for f in found])

    def finish(ids: list, texts: list[bytes], judged) -> pa.Table:
        removed: dict[int, np.ndarray] = {}
        for step, again in judged:
            if not again.any():
                continue
            gone = covered(again, window)
            for r, a, b in zip(step.docs.tolist(), step.starts[:-1].tolist(), step.starts[1:].tolist()):
                if gone[a:b].any():
                    whole = removed.setdefault(r, np.zeros(len(texts[r]), bool))
                    whole[step.offset : step.offset + b - a] |= gone[a:b]
        out = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
        for r, text in enumerate(texts):
            gone = removed.get(r)
            kept = text if gone is None else np.frombuffer(text, np.uint8)[~gone].tobytes()
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(0 if gone is None else int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
            out["kept"].append(kept)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.string()]
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds)})

    search = Search(Bytes(window, gram), True, decide, 0, hot_blocks)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return decided_windows(blocks, n_blocks, search, finish, schema)
