"""Fixed-length windows that occur more than once, over bytes or words.

Every window has an anchor, the least hash of the grams inside it. Equal windows have
equal anchors, so all windows can be dealt out by their anchors: a stretch of
neighbouring windows with one anchor travels as one piece. Only stretches
whose anchor occurs again are sent to the shard of the anchor, once per block; there
a method decides for every window, and the block gets the decisions back.
Anchors that very many blocks hold have their windows dealt out one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from subdrift.llm.exchange import among, answers, distinct_keys, mixed, repeated_keys

# Units (bytes or words) that are gone through at a time.
STEP_UNITS = 1 << 19
# Windows of a stretch; longer ones, in periodic texts, are cut.
STRETCH = 4096
# Blocks from which an anchor is hot.
HOT_BLOCKS = 4096

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# Bytes of distinct pieces that are decided together; the pieces of an anchor stay together.
BATCH_BYTES = 1 << 20

PIECES = "shard int, block int, hashes binary, anchors binary, sizes binary, low binary, high binary, pieces array<binary>"
VERDICTS = "block int, hashes binary, sizes binary, verdicts binary"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Step:
    """Some documents of a block, their units end to end, or a part of a long one."""

    docs: np.ndarray  # row numbers in the block
    starts: np.ndarray  # where each document starts, and the end
    units: np.ndarray  # hashes of the units
    raw: object  # what pieces are cut from
    offset: int = 0  # of the part in its document; parts overlap, their windows do not


@dataclass
class Stretches:
    """Runs of windows with one anchor: first window, number of windows, anchor, whether the
    anchor stands in it at several places, hash of the content; ``window_hash`` gives
    that of the single windows at some places."""

    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    several: np.ndarray
    content: np.ndarray
    window_hash: Callable[[np.ndarray], np.ndarray]


class Units:
    """What differs between bytes and words."""

    window: int
    gram: int

    def split(self, text: bytes):
        """The units of a text, as bytes or a list."""
        raise NotImplementedError

    def hashes(self, raw) -> np.ndarray:
        raise NotImplementedError

    def cut(self, raw, first: int, stop: int) -> bytes:
        raise NotImplementedError

    def joined(self, parts: list):
        raise NotImplementedError

    def steps(self, texts: list[bytes]) -> Iterator[Step]:
        parts, docs, starts = [], [], [0]

        def together() -> Step:
            raw = self.joined(parts)
            return Step(np.array(docs), np.array(starts), self.hashes(raw), raw)

        for row, text in enumerate(texts):
            raw = self.split(text)
            if len(raw) > STEP_UNITS:
                for at in range(0, len(raw), STEP_UNITS):
                    part = raw[at : at + STEP_UNITS + self.window - 1]
                    yield Step(np.array([row]), np.array([0, len(part)]), self.hashes(part), part, at)
                continue
            if docs and starts[-1] + len(raw) > STEP_UNITS:
                yield together()
                parts, docs, starts = [], [], [0]
            parts.append(raw)
            docs.append(row)
            starts.append(starts[-1] + len(raw))
        if docs:
            yield together()

    def stretches(self, step: Step) -> Stretches | None:
        n, window, gram = len(step.units), self.window, self.gram
        if n < window:
            return None
        base, inverse = self.powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(step.units * base, out=sums[1:])
        grams = mixed((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
        at = _leftmost_least(grams, window - gram + 1)
        inside = np.ones(n - window + 1, bool)
        for end in step.starts[1:].tolist():
            inside[max(0, end - window + 1) : end] = False
        least = grams[at]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        count = np.add.reduceat(inside, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        if len(first) and count.max() > STRETCH:  # a long stretch begins anew
            parts = -(-count // STRETCH)
            skipped = STRETCH * _spread(np.zeros(len(first), np.int64), parts)
            first, count = np.repeat(first, parts) + skipped, np.minimum(np.repeat(count, parts) - skipped, STRETCH)
            new[first] = True
        moved = np.flatnonzero((at[1:] != at[:-1]) & inside[1:] & ~new[1:]) + 1
        several = np.zeros(len(first), bool)
        several[np.searchsorted(first, moved, side="right") - 1] = True
        last = first + count - 1 + window
        content = mixed((sums[last] - sums[first]) * inverse[first] + count.astype(np.uint64))
        one = lambda at: mixed((sums[at + window] - sums[at]) * inverse[at] + np.uint64(1))
        # Least hashes crowd at the low end; spread they can be dealt out evenly.
        return Stretches(first, count, mixed(least[first]), several, content, one)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse, kept while a task goes through its steps."""
        kept = getattr(self, "_kept", None)
        if kept is None or len(kept[0]) < n:
            kept = self._kept = _powers(_BASE, n), _powers(_INVERSE, n)
        return kept[0][:n], kept[1][:n]


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in every window of ``width``, the leftmost of equals; as
    many last bits of the values as places need do not count."""
    places = np.uint64((1 << max(1, len(values) - 1).bit_length()) - 1)
    least = values & ~places | np.arange(len(values), dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        rest = width - have
        least = np.minimum(least[:-rest], least[rest:])
    return (least & places).astype(np.int64)


def _columns(table: pa.Table) -> tuple[list, list[bytes]]:
    if not table.num_rows:
        return [], []
    return table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first, first + 1, ...`` of every stretch, end to end."""
    return np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


@dataclass
class Search:
    """What to look for, and how.

    Two places of a window count as a repetition if they differ (``by_place``) or if their
    documents have different ids (else; documents without an id then take no part).
    ``decide(pieces, low, high)`` gets distinct pieces with the smallest and largest id of
    each (with ``by_place``: equal if there is one place only) and returns a number for every
    window of every piece and which pieces are worth an answer. Windows without an
    answer have the number ``absent``.
    """

    units: Units
    by_place: bool
    decide: Callable[[list[bytes], np.ndarray, np.ndarray], tuple[list[np.ndarray], np.ndarray]]
    absent: int
    hot_blocks: int = HOT_BLOCKS

    def steps(self, ids: list, texts: list[bytes]) -> Iterator[Step]:
        return self.units.steps(texts if self.by_place else [t if i is not None else b"" for i, t in zip(ids, texts)])

    def owners(self, ids: np.ndarray, step: Step, first: np.ndarray) -> np.ndarray:
        if self.by_place:
            return first + step.offset + (int(step.docs[0]) << 36)
        return ids[step.docs[np.searchsorted(step.starts, first, side="right") - 1]]


def decided_windows(
    blocks: DataFrame,
    n_blocks: int,
    search: Search,
    finish: Callable[[list, list[bytes], Iterator[tuple[Step, np.ndarray]]], pa.Table],
    schema: str,
) -> DataFrame:
    """Runs the exchange and applies ``finish`` to the ids and texts of every block and to the
    numbers of all windows, step by step."""
    units, window = search.units, search.units.window

    def stretches(table: pa.Table):
        ids, texts = _columns(table)
        numbers = np.array([0 if i is None else i for i in ids], np.int64)
        for step in search.steps(ids, texts):
            s = units.stretches(step)
            if s is not None and len(s.first):
                yield step, s, numbers

    def keys_of(table: pa.Table):
        found = []
        for step, s, ids in stretches(table):
            found.append((s.anchor, search.owners(ids, step, s.first)))
            if search.by_place:
                found.append((s.anchor[s.several], -1 - found[-1][1][s.several]))
        found.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        return distinct_keys(*map(np.concatenate, zip(*found)))

    def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
        repeated, hot = answers(told)
        found: dict[int, list] = {}
        for step, s, ids in stretches(docs):
            again, place = among(s.anchor, repeated)
            if not again.any():
                continue
            single = again & hot[place]
            whole = np.flatnonzero(again & ~single)
            alone = _spread(s.first[single], s.count[single])
            first = np.concatenate([s.first[whole], alone])
            count = np.concatenate([s.count[whole], np.ones(len(alone), np.int64)])
            hashes = s.window_hash(alone)
            content = np.concatenate([s.content[whole], hashes])
            anchor = np.concatenate([s.anchor[whole], hashes])
            # Windows sent one by one are told from stretches by the size 0.
            size = np.concatenate([s.count[whole], np.zeros(len(alone), np.int64)])
            owner = search.owners(ids, step, first)
            for f, c, z, h, a, o in zip(*(x.tolist() for x in (first, count, size, content, anchor, owner))):
                old = found.get(h)
                if old is None:
                    found[h] = [a, z, o, o, units.cut(step.raw, f, f + c - 1 + window)]
                else:
                    old[2], old[3] = min(old[2], o), max(old[3], o)
        by_shard: dict[int, list] = {}
        for h, item in found.items():
            by_shard.setdefault((item[0] >> 32) * n_blocks >> 32, []).append((h, *item))
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        shards = {shard: tuple(zip(*items)) for shard, items in by_shard.items()}
        packed = lambda i, kind: pa.array([np.array(v[i], kind).tobytes() for v in shards.values()], pa.binary())
        return pa.table(
            {
                "shard": pa.array(list(shards), pa.int32()),
                "block": pa.array([block] * len(shards), pa.int32()),
                "hashes": packed(0, np.uint64),
                "anchors": packed(1, np.uint64),
                "sizes": packed(2, np.int32),
                "low": packed(3, np.int64),
                "high": packed(4, np.int64),
                "pieces": pa.array([list(v[5]) for v in shards.values()], pa.list_(pa.binary())),
            }
        )

    def judge(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        low, high, anchors, counts, rows = [], [], [], [], []
        for row in table.to_pylist():
            places = []
            kinds = {"low": np.int64, "high": np.int64, "anchors": np.uint64, "sizes": np.int32}
            values = [np.frombuffer(row[c], kind).tolist() for c, kind in kinds.items()]
            for piece, a, b, anchor, size in zip(row["pieces"], *values):
                k = number.setdefault(piece, len(number))
                if k == len(low):
                    low.append(a)
                    high.append(b)
                    anchors.append(anchor)
                    counts.append(max(size, 1))
                else:
                    # Places in different blocks are different, whatever their numbers.
                    high[k] = max(high[k], b, low[k] + 1) if search.by_place else max(high[k], b)
                    low[k] = min(low[k], a)
                places.append(k)
            rows.append((row["block"], row["hashes"], row["sizes"], places))
        pieces, low, high = list(number), np.array(low, np.int64), np.array(high, np.int64)
        verdicts: list = [None] * len(pieces)
        worth = np.zeros(len(pieces), bool)
        # The only piece of an anchor decides itself if it stands at two places.
        anchors = np.array(anchors, np.uint64)
        _, which, pieces_of = np.unique(anchors, return_inverse=True, return_counts=True)
        plain = (pieces_of[which] == 1) & (high > low) if len(pieces) else np.zeros(0, bool)
        for k in np.flatnonzero(plain).tolist():
            verdicts[k], worth[k] = np.full(counts[k], 1 if search.by_place else low[k], np.int64), True
        for batch in _batches(pieces, anchors, np.flatnonzero(~plain)):
            found, good = search.decide([pieces[k] for k in batch], low[batch], high[batch])
            worth[batch] = good
            for k, v in zip(batch, found):
                verdicts[k] = v
        out = {"block": [], "hashes": [], "sizes": [], "verdicts": []}
        for block, hashes, sizes, places in rows:
            pick = np.flatnonzero(worth[places])
            if len(pick):
                out["block"].append(block)
                out["hashes"].append(np.frombuffer(hashes, np.uint64)[pick].tobytes())
                out["sizes"].append(np.frombuffer(sizes, np.int32)[pick].tobytes())
                out["verdicts"].append(np.concatenate([verdicts[places[i]] for i in pick]).astype(np.int64).tobytes())
        kinds = {"block": pa.int32(), "hashes": pa.binary(), "sizes": pa.binary(), "verdicts": pa.binary()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    def apply(docs: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts = _columns(docs)
        joined = lambda c, kind: np.frombuffer(b"".join(told.column(c).to_pylist()), kind)
        hashes, sizes, verdicts = joined("hashes", np.uint64), joined("sizes", np.int32).astype(np.int64), joined("verdicts", np.int64)
        order = np.argsort(hashes)
        single = sizes[order] == 0
        sizes = np.maximum(sizes, 1)
        begin, ordered = (np.cumsum(sizes) - sizes)[order], hashes[order]
        begin_single, ordered_single = begin[single], ordered[single]

        def judged():
            for step in search.steps(ids, texts):
                numbers = np.full(max(0, len(step.units) - window + 1), search.absent, np.int64)
                s = units.stretches(step) if len(ordered) else None
                if s is not None and len(s.first):
                    known, place = among(s.content, ordered)
                    count = s.count[known]
                    numbers[_spread(s.first[known], count)] = verdicts[_spread(begin[place[known]], count)]
                    # The windows of hot anchors were sent one by one.
                    if len(ordered_single):
                        alone = _spread(s.first[~known], s.count[~known])
                        known, place = among(s.window_hash(alone), ordered_single)
                        numbers[alone[known]] = verdicts[begin_single[place[known]]]
                yield step, numbers

        return finish(ids, texts, judged())

    repeated = repeated_keys(blocks, n_blocks, keys_of, search.hot_blocks)
    pieces = blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(cut, PIECES)
    told = pieces.groupBy("shard").applyInArrow(judge, VERDICTS)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(apply, schema)


def _batches(pieces: list[bytes], anchors: np.ndarray, chosen: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of chosen pieces, in batches of about ``BATCH_BYTES`` that never part an anchor."""
    order = chosen[np.argsort(anchors[chosen], kind="stable")]
    size, first = 0, 0
    for i, k in enumerate(order):
        if size > BATCH_BYTES and anchors[k] != anchors[order[i - 1]]:
            yield order[first:i]
            size, first = 0, i
        size += len(pieces[k])
    if len(order):
        yield order[first:]


def covered(numbers: np.ndarray, window: int) -> np.ndarray:
    """Which units the chosen windows cover."""
    edges = np.zeros(len(numbers) + window, np.int64)
    edges[: len(numbers)] += numbers
    edges[window:] -= numbers
    return np.cumsum(edges)[: len(numbers) + window - 1] > 0
