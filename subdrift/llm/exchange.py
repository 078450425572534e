"""Finding keys that occur more than once, and telling every block of documents which.

Documents are dealt over blocks of bounded text by a hash. A block sends each of its keys
once, packed per bucket of the key space with all others of that bucket; a bucket sees a
key at most once per block, however often it occurs, so a key that a third of all
documents hold is no heavier than any other. Each bucket answers every block with
those of its keys that occur elsewhere too. Keys are sorted and travel as the gaps between
them, whose high bytes are zeros (and the low ones, if the caller's keys have fewer bits).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subdrift.llm.common import text_column

BLOCK_BYTES = 8 << 20

SENT = "bucket int, block int, keys binary, several binary"
ANSWERED = "block int, keys binary, hot binary"

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def blocked(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``doc_id, text`` (null: empty) with ``block``, and the number of blocks."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    size = docs.select(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")), n_blocks


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def packed(keys: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Numbers sorted between ``edges``, each part by itself: its first number and the gaps behind,
    all lowest bytes, all second bytes, ...; runs of zeros, which the exchange compresses."""
    gaps = np.diff(keys, prepend=keys[:1])
    gaps[edges[:-1]] = keys[edges[:-1]]
    planes = gaps.view(np.uint8).reshape(-1, 8)
    return [planes[a:b].T.tobytes() for a, b in zip(edges[:-1], edges[1:])]


def unpacked(parts: list[bytes]) -> np.ndarray:
    """The numbers of packed parts, end to end."""
    parts = [p for p in parts if p]
    if not parts:
        return np.zeros(0, np.uint64)
    sizes = np.array([len(p) // 8 for p in parts])
    planes = np.concatenate([np.frombuffer(p, np.uint8).reshape(8, -1) for p in parts], axis=1)
    gaps = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    sums, first = np.cumsum(gaps), np.cumsum(sizes) - sizes
    return sums - np.repeat(sums[first] - gaps[first], sizes)


def repeated_keys(
    blocks: DataFrame,
    n_buckets: int,
    keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]],
    hot_blocks: int | tuple[int, ...] = 64,
) -> DataFrame:
    """``block, keys, hot``: the keys of a block that occur more than once, sorted within a
    row, and for each whether more than ``hot_blocks`` blocks hold it (of several limits: how
    many of them are exceeded).

    ``keys_of`` gives the distinct sorted keys of a block and whether each occurs more than
    once in the block already.
    """

    limits = np.atleast_1d(hot_blocks)

    def send(table: pa.Table) -> pa.Table:
        keys, several = keys_of(table)
        block = table.column("block")[0].as_py()
        # Keys are spread numbers: their range cut evenly gives the buckets.
        bucket = np.minimum((keys >> np.uint64(32)).astype(np.int64) * n_buckets >> 32, n_buckets - 1)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=n_buckets))
        rows = [(bucket[a], several[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "block": pa.array([block] * len(rows), pa.int32()),
                "keys": pa.array(packed(keys, edges), pa.binary()),
                "several": pa.array([r[1].astype(np.uint8).tobytes() for r in rows], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        sent = table.column("keys").to_pylist()
        sizes = [len(p) // 8 for p in sent]
        keys = unpacked(sent)
        several = np.frombuffer(b"".join(table.column("several").to_pylist()), np.uint8)
        block = np.repeat(np.array(table.column("block").to_pylist(), np.int64), sizes)
        order = np.argsort(keys)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        counts = np.diff(starts, append=len(order))
        repeated = (counts > 1) | (np.maximum.reduceat(several[order], starts) > 0)
        wanted = order[np.repeat(repeated, counts)]
        hot = np.repeat(np.searchsorted(limits, counts, "left"), counts)[np.repeat(repeated, counts)]
        by_block = np.lexsort((keys[wanted], block[wanted]))
        wanted, hot = wanted[by_block], hot[by_block]
        edges = np.flatnonzero(np.diff(block[wanted], prepend=-1, append=-1)) if len(wanted) else np.zeros(1, int)
        parts = list(zip(edges[:-1], edges[1:]))
        return pa.table(
            {
                "block": pa.array([block[wanted[a]] for a, _ in parts], pa.int32()),
                "keys": pa.array(packed(keys[wanted], edges), pa.binary()),
                "hot": pa.array([hot[a:b].astype(np.uint8).tobytes() for a, b in parts], pa.binary()),
            }
        )

    sent = blocks.groupBy("block").applyInArrow(send, SENT)
    return sent.groupBy("bucket").applyInArrow(answer, ANSWERED)


def answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all answers to a block, and their hot flags."""
    keys, levels = answered_levels(table)
    return keys, levels.astype(bool)


def answered_levels(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all answers to a block, and how many limits each exceeds."""
    keys = unpacked(table.column("keys").to_pylist())
    levels = np.frombuffer(b"".join(table.column("hot").to_pylist()), np.uint8)
    order = np.argsort(keys)  # a block is told of a key once
    return keys[order], levels[order]


def among(wanted: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each number is among sorted ones, and its place there."""
    if not len(ordered):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    place = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return ordered[place] == wanted, place


def distinct_keys(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and whether each has two or more different owners."""
    if not len(keys):
        return keys, np.zeros(0, bool)
    order = np.argsort(keys)
    k, o = keys[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[starts], np.minimum.reduceat(o, starts) != np.maximum.reduceat(o, starts)
