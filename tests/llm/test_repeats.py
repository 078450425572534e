"""Repeated windows against counting all windows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from subdrift.llm.exchange import distinct_keys, packed, unpacked
from subdrift.llm.repeated_bytes import Bytes, remove_repeated_bytes, repeated_starts
from subdrift.llm.repeated_words import remove_repeated_words
from subdrift.llm.suffix_automaton import SuffixAutomaton
from subdrift.llm.windows import STRETCH
from tests.llm.helpers import awkward, frame, tuples

# Block size and number of blocks from which an anchor is hot.
SETTINGS = [(8 << 20, 64), (60_000, 64), (60_000, 0)]


def rows_with_passages(spark):
    rows = awkward(spark)
    a, b = rows[9][1], rows[10][1]
    more = [(2000 + i, a[:500] + f" {i} " + b[:700]) for i in range(12)] + [(2100, a[:300] + "Q" + a[300:]), (2101, "é" * 301)]
    return rows + more


def brute_bytes(rows, window=200):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(x[i : i + window] for x in texts for i in range(len(x) - window + 1))
    out = []
    for (doc_id, _), x in zip(rows, texts):
        gone = bytearray(len(x))
        for i in range(len(x) - window + 1):
            if count[x[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(v for v, g in zip(x, gone) if not g)
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        out.append((doc_id, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, window=13):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for doc_id, words in texts:
        for i in range(len(words) - window + 1 if doc_id is not None else 0):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, words in texts:
        gone = set()
        for i in range(len(words) - window + 1 if doc_id is not None else 0):
            if first[tuple(words[i : i + window])] < doc_id:
                gone |= set(range(i, i + window))
        out.append((doc_id, len(words), len(gone), bytearray(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes,hot_blocks", SETTINGS)
def test_bytes(spark, block_bytes, hot_blocks):
    # Without the one text that repeats everywhere, which one-by-one windows make slow.
    rows = [(d, t[:3000] if t is not None and len(t) > 20000 else t) for d, t in rows_with_passages(spark)]
    got = remove_repeated_bytes(frame(spark, rows), block_bytes=block_bytes, hot_blocks=hot_blocks).drop("kept")
    assert tuples(got) == brute_bytes(rows)


@pytest.mark.parametrize("block_bytes,hot_blocks", SETTINGS)
def test_words(spark, block_bytes, hot_blocks):
    rows = rows_with_passages(spark)
    got = remove_repeated_words(frame(spark, rows), block_bytes=block_bytes, hot_blocks=hot_blocks)
    want = [(d, n, k, bytes(kept)) for d, n, k, kept in brute_words(rows)]
    assert [(d, n, k, bytes(kept)) for d, n, k, kept in tuples(got)] == want


def test_empty_tables(spark):
    empty = frame(spark, awkward(spark)).limit(0)
    assert remove_repeated_bytes(empty).count() == 0 and remove_repeated_words(empty).count() == 0


def test_interval_expansion_on_random_pieces():
    random.seed(3)
    for _ in range(150):
        window = random.choice([2, 5, 9, 20])
        alphabet = random.choice([b"ab", b"abc", b"a", bytes(range(97, 120))])
        pieces = []
        for _ in range(random.randint(1, 6)):
            piece = bytes(random.choice(alphabet) for _ in range(random.randint(window, 60)))
            if pieces and random.random() < 0.5:
                piece = piece[: random.randint(0, 30)] + random.choice(pieces)[random.randint(0, 5) :]
            if len(piece) >= window and piece not in pieces:
                pieces.append(piece)
        count = Counter(p[i : i + window] for p in pieces for i in range(len(p) - window + 1))
        want = [[int(count[p[i : i + window]] > 1) for i in range(len(p) - window + 1)] for p in pieces]
        assert [x.tolist() for x in repeated_starts(pieces, window)] == want


def test_matching_statistics_of_random_sequences():
    random.seed(4)
    for _ in range(60):
        texts = [[random.randint(0, 2) for _ in range(random.randint(1, 15))] for _ in range(3)]
        automaton = SuffixAutomaton()
        for t in texts:
            list(automaton.add(t))
        asked = [random.randint(0, 3) for _ in range(20)]
        known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        for i, _, length in automaton.statistics(asked, 0, len(asked)):
            assert length == max((n for n in range(i + 2) if n == 0 or tuple(asked[i + 1 - n : i + 1]) in known), default=0)


def test_stretches_cover_every_window_once():
    """Windows of one anchor form stretches that never cross documents, and equal windows have equal anchors and hashes."""
    random.seed(7)
    units, window = Bytes(9, 4), 9
    for texts in ([bytes(random.choice(b"ab") for _ in range(random.randint(0, 40))) for _ in range(30)], [b"abab" * 3000], [b"x" * 9000, b"", b"y" * 9], [b"ab"]):
        for step in units.steps(texts):
            s = units.stretches(step)
            raw, docs = step.raw, list(zip(step.starts[:-1].tolist(), step.starts[1:].tolist()))
            want = [i for a, b in docs for i in range(a, b - window + 1)]
            if s is None:
                assert not want
                continue
            got = [(f + i, a) for f, c, a in zip(s.first.tolist(), s.count.tolist(), s.anchor.tolist()) for i in range(c)]
            assert [i for i, _ in got] == want and (not want or s.count.max() <= STRETCH)
            of = dict(zip(want, s.window_hash(np.array(want, np.int64)).tolist()))
            windows = {i: raw[i : i + window] for i in want}
            assert len(set(windows.values())) == len(set(of.values())) == len({(windows[i], of[i], a) for i, a in got})
            pieces = [raw[f : f + c - 1 + window] for f, c in zip(s.first.tolist(), s.count.tolist())]
            assert len(set(pieces)) == len(set(s.content.tolist())) == len(set(zip(pieces, s.content.tolist())))


def test_keys_with_several_owners():
    random.seed(9)
    rows = [(random.randint(0, 40), random.randint(-2, 2)) for _ in range(120)]
    keys, several = distinct_keys(np.array([k for k, _ in rows], np.uint64), np.array([o for _, o in rows], np.int64))
    owners = {k: {o for q, o in rows if q == k} for k, _ in rows}
    assert keys.tolist() == sorted(owners) and several.tolist() == [len(owners[k]) > 1 for k in sorted(owners)]


@pytest.mark.parametrize("bits,most", [(64, 6.5), (48, 4.5)])
def test_sorted_keys_travel_as_gaps(bits, most):
    """As many keys as a block sends, in parts: they come back, and take less than their 8 bytes."""
    keys = np.random.default_rng(bits).integers(0, 1 << bits, 300_000, np.uint64) << np.uint64(64 - bits)
    keys = np.unique(np.concatenate([keys, np.array([0, (1 << 64) - 1], np.uint64)]))
    edges = np.array([0, 1, 2, 1000, 150_000, len(keys)])
    parts = packed(keys, edges)
    assert [len(p) for p in parts] == [8 * n for n in np.diff(edges)]
    assert (unpacked(parts) == keys).all() and (unpacked(parts[2:4]) == keys[2:150_000]).all()
    assert len(zlib.compress(b"".join(parts), 1)) < most * len(keys)
    assert unpacked([]).tolist() == unpacked([b""]).tolist() == []
    assert packed(np.zeros(0, np.uint64), np.array([0])) == []
