"""Substring dedup with suffix automata of reference shards.

The reference is the corpus itself: every document is compared with all of smaller id. A
reference of that size cannot be broadcast, so it is cut into shards by the anchors of
its windows, and the pieces of documents that may match a shard are streamed to it. A
shard's automaton knows for each of its pieces the smallest id of a document that has
it; streaming a piece gives the matching statistics, and a match of the least length
whose document is smaller is removed.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from subdrift.llm.exchange import BLOCK_BYTES, blocked
from subdrift.llm.suffix_automaton import SuffixAutomaton
from subdrift.llm.windows import HOT_BLOCKS, Search, Units, covered, decided_windows

_NONE = np.iinfo(np.int64).max


class Words(Units):
    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def split(self, text: bytes) -> list[bytes]:
        return text.split()

    def joined(self, parts: list[list[bytes]]) -> list[bytes]:
        return list(chain.from_iterable(parts))

    def hashes(self, raw: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))

    def cut(self, raw: list[bytes], first: int, stop: int) -> bytes:
        return b" ".join(raw[first:stop])


def remove_repeated_words(
    documents: DataFrame, window: int = 13, gram: int = 5, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``documents``.

    A word is removed if a run of ``window`` words around it also starts in a document of
    smaller id. Words are parted by ASCII white space and kept joined by one space. A null
    or empty text has no words. Rows of equal id do not count against each other; a row
    without an id neither removes nor loses words. Other columns are ignored; an empty
    table gives an empty result.
    """
    blocks, n_blocks = blocked(documents, block_bytes)

    def decide(pieces: list[bytes], low: np.ndarray, high: np.ndarray):
        automaton, parted = SuffixAutomaton(), [p.split() for p in pieces]
        note, link, length = automaton.note, automaton.link, automaton.length
        # In the order of documents, so the first mark on a state is the smallest.
        for k in np.argsort(low, kind="stable").tolist():
            smallest = int(low[k])
            for state in automaton.add(parted[k]):
                while state > 0 and note[state] is None:
                    note[state] = smallest
                    state = link[state]
        verdicts = []
        for words in parted:
            smallest = []
            for i, state, _ in automaton.statistics(words, 0, len(words)):
                if i + 1 >= window:
                    # The state of just the last words of a window's length.
                    while length[link[state]] >= window:
                        state = link[state]
                    smallest.append(note[state])
            verdicts.append(np.array(smallest, np.int64))
        return verdicts, np.array([v.min() for v in verdicts]) < high

    def finish(ids: list, texts: list[bytes], judged) -> pa.Table:
        removed: dict[int, list] = {}
        for step, smallest in judged:
            own = np.array([0 if ids[r] is None else ids[r] for r in step.docs], np.int64)
            row = np.searchsorted(step.starts, np.arange(len(smallest)), side="right") - 1
            gone = covered(smallest < own[row], window) if len(smallest) else np.zeros(len(step.units), bool)
            for r, a, b in zip(step.docs.tolist(), step.starts[:-1].tolist(), step.starts[1:].tolist()):
                if gone[a:b].any():
                    removed.setdefault(r, []).append(step.offset + np.flatnonzero(gone[a:b]))
        out = {"doc_id": ids, "n_words": [], "n_removed": [], "kept": []}
        for r, text in enumerate(texts):
            words = text.split()
            gone = np.unique(np.concatenate(removed[r])) if r in removed else np.zeros(0, np.int64)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(gone))
            if len(gone):
                stay = np.ones(len(words), bool)
                stay[gone] = False
                words = [words[i] for i in np.flatnonzero(stay)]
            out["kept"].append(b" ".join(words))
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    search = Search(Words(window, gram), False, decide, _NONE, hot_blocks)
    return decided_windows(
        blocks, n_blocks, search, finish, "doc_id long, n_words long, n_removed long, kept binary"
    )
