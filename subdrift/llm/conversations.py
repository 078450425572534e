"""Conversation structure repair: a dynamic program over secondary-sorted turns.

The rows of a conversation are brought together by a repartition and read in the order of
their turns. A program of four states (nothing yet, after the system's, the user's, the
assistant's turn) is carried from Arrow batch to Arrow batch: for every state the cheapest
edits so far and, among equally cheap ones, those whose letters come first. Between two
rows only the differences of the four costs and the order of the four letter sequences
matter, and these are few, so each step is worked out once and then looked up. Nothing of
a conversation is held but the state, one digest per state, and a byte per state and row
that says where it came from; of giant conversations these bytes are spilled in chunks,
as rows of a table, and followed back from the last chunk to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subdrift.llm.common import written

# White space, ends of sentences, costs of the edits, roles that may be given.
WHITE_SPACE = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = (".", "!", "?")
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
GIVEN = {"u": "user", "a": "assistant"}

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
# The role that must be next, and the state after it; a system's turn may only come first.
_NEXT = {_START: ("u", _USER), _SYSTEM: ("u", _USER), _USER: ("a", _ASSISTANT), _ASSISTANT: ("u", _USER)}
_NONE = 255

SUMMARY = (
    "conv string, chunk long, pointers binary, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "end int, tail string, audit string, repaired_sha256 string"
)
_FIELDS = [f.split()[0] for f in SUMMARY.split(", ")]
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


@dataclass(frozen=True)
class Spill:
    """Pointers of ``rows`` turns are held at most; those of longer conversations are spilled."""

    rows: int = 1 << 16


# -- the program --------------------------------------------------------------


def _moves(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of every way past a row. Insertions that could as well follow
    a deletion do so: it costs the same and its letters come first."""
    out = []
    for state in range(4):
        out.append((state, state, DELETE, "D"))
        if must_go:
            continue
        end, cost, letters = state, int(truncated) * TRUNCATED, ""
        for _ in range(2):
            due, after = _NEXT[end]
            if initial == due:
                out.append((state, after, cost, letters + "K"))
            elif initial == "s" and end == _START:
                out.append((state, _SYSTEM, cost, letters + "K"))
            out.append((state, after, cost + REROLE, letters + "R"))
            end, cost, letters = after, cost + INSERT, letters + "I"
    return out


_ENDINGS = {_START: (0, ""), _SYSTEM: (2 * INSERT, "II"), _USER: (INSERT, "I"), _ASSISTANT: (0, "")}
_LETTERS = ("D", "K", "IK", "R", "IR")


class Program:
    """The steps between the reachable situations, each worked out when it first occurs.

    A situation is, for each state, its cost beyond the least one (None: not reachable) and
    the rank of its letters among those of the others. Letters of different states
    hold as many rows and end in one, so none begins with another and ranks decide.
    """

    def __init__(self):
        self.situations = [((0, None, None, None), (0, 0, 0, 0))]
        self.numbers = {self.situations[0]: 0}
        self.steps: dict[tuple, tuple] = {}

    def step(self, situation: int, row: tuple[str, bool, bool]) -> tuple:
        """(situation, added to the least cost, pointers, moves) after a row; a pointer holds
        the state before and the letters, a move (to, from, letters) too."""
        known = self.steps.get((situation, row))
        if known is None:
            known = self.steps[situation, row] = self._work_out(situation, row)
        return known

    def _work_out(self, situation, row):
        costs, ranks = self.situations[situation]
        best: dict[int, tuple] = {}
        for start, to, cost, letters in _moves(*row):
            if costs[start] is not None:
                found = (costs[start] + cost, ranks[start], letters, start)
                best[to] = min(best.get(to, found), found)
        least = min(b[0] for b in best.values())
        order = sorted(best, key=lambda to: best[to][1:3])
        after = (
            tuple(best[s][0] - least if s in best else None for s in range(4)),
            tuple(order.index(s) if s in best else 0 for s in range(4)),
        )
        if after not in self.numbers:
            self.numbers[after] = len(self.situations)
            self.situations.append(after)
        pointers = bytes(best[s][3] | _LETTERS.index(best[s][2]) << 2 if s in best else _NONE for s in range(4))
        return self.numbers[after], least, pointers, [(s, best[s][3], best[s][2]) for s in best]

    def ending(self, situation: int) -> tuple[int, int, str]:
        """(state, further cost, letters) of the best way to end."""
        costs, ranks = self.situations[situation]
        ways = [(costs[s] + cost, ranks[s], letters, s) for s, (cost, letters) in _ENDINGS.items() if costs[s] is not None]
        cost, _, letters, state = min(ways)
        return state, cost, letters


def followed(pointers: bytes, state: int) -> tuple[str, int]:
    """The letters of a chunk of pointers that ends in a state, and the state it starts from."""
    out = []
    for at in range(len(pointers) - 4, -1, -4):
        pointer = pointers[at + state]
        out.append(_LETTERS[pointer >> 2])
        state = pointer & 3
    return "".join(reversed(out)), state


class _Digests:
    """For every state the running digest of the repaired conversation that leads to it."""

    def __init__(self):
        self.of = [hashlib.sha256(), None, None, None]

    def move(self, moves, role: bytes, text: bytes):
        after = [None] * 4
        for to, start, letters in moves:
            after[to] = self.of[start] if letters == "D" else self._grown(start, letters, role, text)
        self.of = after

    def _grown(self, state: int, letters: str, role: bytes, text: bytes):
        digest = self.of[state].copy()
        for letter in letters:
            if letter == "D":
                continue
            if state != _START:
                digest.update(b"\n")
            due, after = _NEXT[state]
            if letter == "K":
                after = _SYSTEM if role[:1] == b"s" else after
                digest.update(role + b":" + text)
            else:
                digest.update(GIVEN[due].encode() + b":" + (text if letter == "R" else b""))
            state = after
        return digest

    def ending(self, state: int, letters: str) -> str:
        return self._grown(state, letters, b"", b"").hexdigest()


class _Conversation:
    def __init__(self, name: str, program: Program, spill: Spill):
        self.name, self.program, self.spill = name, program, spill
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = None
        self.turns = 0
        self.before, self.initial = None, None
        self.situation, self.pointers, self.chunk = 0, bytearray(), 0
        self.digests = _Digests()

    def add(self, turn: int | None, role: str, text: str, repeated: int, digest: str) -> Iterator[dict]:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        bare = text.rstrip(WHITE_SPACE)
        blank = not bare
        # Copies of one turn stand next to each other; of later turns it is known already.
        copy = repeated == _LATER or (repeated == _FIRST and self.before == (turn, digest))
        self.before = (turn, digest)
        cut = not bare.endswith(SENTENCE_ENDS)
        self.counts["blank" if blank else "duplicate" if copy else "truncated"] += blank or copy or cut
        initial = role[:1]
        self.counts["illegal"] += self.initial is not None and (self.initial, initial) not in LEGAL
        self.initial = initial
        kind = initial if initial in ("s", "u", "a") else ""
        gone = blank or copy
        self.situation, added, pointers, moves = self.program.step(self.situation, (kind, gone, cut and not gone))
        self.counts["cost"] += added
        self.pointers += pointers
        self.digests.move(moves, role.encode("utf-8", "surrogatepass"), b"" if gone else text.encode("utf-8", "surrogatepass"))
        if len(self.pointers) >= 4 * self.spill.rows:
            yield self._spilled()

    def _spilled(self) -> dict:
        row = self._row(chunk=self.chunk, pointers=bytes(self.pointers))
        self.pointers, self.chunk = bytearray(), self.chunk + 1
        return row

    def end(self) -> Iterator[dict]:
        state, cost, letters = self.program.ending(self.situation)
        self.counts["cost"] += cost
        if self.first is not None:
            self.counts["gaps"] = min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        digest = self.digests.ending(state, letters)
        audit = None
        if self.chunk == 0:
            audit = followed(self.pointers, state)[0] + letters
        elif self.pointers:
            yield self._spilled()
        yield self._row(chunk=self.chunk, end=state, tail=letters, audit=audit, repaired_sha256=digest, **self.counts)

    def _row(self, **values) -> dict:
        nothing = {"pointers": b"", "end": 0, "tail": None, "audit": None, "repaired_sha256": None, **dict.fromkeys(_COUNTS, 0)}
        return {"conv": self.name, **nothing, **values}


# -- over tables --------------------------------------------------------------

_FIRST, _LATER = 1, 2


def repair(conversations: DataFrame, spill: Spill = Spill()) -> DataFrame:
    """One row per ``conv_id`` of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``): counts of
    ``gaps`` in the turns, of ``blank``, ``duplicate`` and ``truncated`` rows (first fault of each) and of
    ``illegal`` neighbours, the ``cost`` of the cheapest repair, its letters (``audit``: keep, rerole,
    delete, insert), and the digest of the repaired turns.

    Rows are taken by turn, null turns first, and within a turn by role and text; a null role
    or text counts as one space. Repeated rows are duplicates. A null ``conv_id`` is a
    conversation like any other. Other columns are ignored; an empty table gives an empty result.
    """
    kind = conversations.schema["conv_id"].dataType
    streamed = written(
        _sorted_turns(conversations).mapInPandas(lambda batches: _stream(batches, spill), SUMMARY), "conversations"
    )
    # Where pointers were spilled, the letters are found from the end of each conversation on.
    giant = streamed.where("tail is not null and audit is null")
    chunks = streamed.where("tail is null").select("conv", "chunk", "pointers", "end").unionByName(giant.select("conv", "chunk", "pointers", "end"))
    pieces = chunks.repartition("conv").sortWithinPartitions("conv", F.desc("chunk")).mapInPandas(_follow, "conv string, chunk long, piece string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"])
    letters = pieces.groupBy("conv").agg(F.array_join(ordered, "").alias("letters"))
    audited = giant.join(letters, "conv").withColumn("audit", F.concat("letters", "tail")).drop("letters")
    done = streamed.where("audit is not null").unionByName(audited)
    conv_id = F.expr("substring(conv, 2)").cast(kind).alias("conv_id")
    return done.select(F.when(F.col("conv") != "", conv_id).alias("conv_id"), *_COUNTS, "audit", "repaired_sha256")


def repaired_turns(conversations: DataFrame, repaired: DataFrame) -> DataFrame:
    """The turns that the ``audit`` of ``repair`` leaves of each conversation: ``conv_id``, ``position``
    (from 0), ``role``, ``text`` and the ``edit`` that made each (keep, rerole or insert)."""
    kind = conversations.schema["conv_id"].dataType
    rows = _plain(conversations).select("conv", F.lit(1).alias("part"), "turn", "role", "text")
    audits = repaired.select(_name().alias("conv"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.unionByName(audits).repartition("conv").sortWithinPartitions("conv", "part", "turn", "role", "text")
    schema = "conv string, position long, role string, text string, edit string"
    turns = both.select("conv", "part", "role", "text").mapInPandas(_edited, schema)
    conv_id = F.expr("substring(conv, 2)").cast(kind)
    return turns.select(F.when(F.col("conv") != "", conv_id).alias("conv_id"), "position", "role", "text", "edit")


def _name():
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _plain(conversations: DataFrame) -> DataFrame:
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return conversations.select(_name().alias("conv"), F.col("turn").cast("long").alias("turn"), said("role"), said("text"))


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    """All rows, those of a conversation together and in order, with what is known of equal
    ones. Only texts that occur again in their conversation are joined with their first turn;
    a row repeated very often is one row there, and on the other side of a plain join."""
    length = F.length("role").cast("string")
    rows = _plain(conversations).withColumn("digest", F.sha2(F.concat(length, F.lit(":"), "role", "text"), 256))
    groups = rows.groupBy("conv", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("turn").isNull()).alias("without"), F.min("turn").alias("first")
    )
    repeated = written(groups.where("n > 1").drop("n"), "repeated")
    later = F.col("turn").isNotNull() & (F.col("without") | (F.col("turn") > F.col("first")))
    known = F.when(F.col("without").isNull(), 0).when(later, _LATER).otherwise(_FIRST)
    marked = rows.join(repeated, ["conv", "digest"], "left").select(
        "conv",
        "turn",
        "role",
        "text",
        known.alias("repeated"),
        F.when(F.col("without").isNotNull(), F.col("digest")).otherwise("").alias("digest"),
    )
    return (
        marked.repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("numbered"), "role", "text", "repeated", "digest")
    )


def _stream(batches: Iterator[pd.DataFrame], spill: Spill) -> Iterator[pd.DataFrame]:
    program, now = Program(), None
    for batch in batches:
        out = []
        columns = (batch[c].tolist() for c in ("conv", "turn", "numbered", "role", "text", "repeated", "digest"))
        for conv, turn, numbered, role, text, repeated, digest in zip(*columns):
            if now is None or now.name != conv:
                if now is not None:
                    out.extend(now.end())
                now = _Conversation(conv, program, spill)
            out.extend(now.add(turn if numbered else None, role, text, repeated, digest))
        if out:
            yield pd.DataFrame(out, columns=_FIELDS)
    if now is not None:
        yield pd.DataFrame(list(now.end()), columns=_FIELDS)


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of one conversation after the other, the last first, behind the row that ends it."""
    now, state = None, 0
    for batch in batches:
        out = []
        for conv, chunk, pointers, end in zip(*(batch[c].tolist() for c in ("conv", "chunk", "pointers", "end"))):
            if now != conv:
                now, state = conv, end
            else:
                piece, state = followed(pointers, state)
                out.append((conv, chunk, piece))
        yield pd.DataFrame(out, columns=["conv", "chunk", "piece"])


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    audit, at, state, position = "", 0, _START, 0

    def inserted(conv):
        nonlocal at, state, position
        while at < len(audit) and audit[at] == "I":
            due, state = _NEXT[state]
            yield conv, position, GIVEN[due], "", "insert"
            at, position = at + 1, position + 1

    now = None
    for batch in batches:
        out = []
        for conv, part, role, text in zip(*(batch[c].tolist() for c in ("conv", "part", "role", "text"))):
            if part == 0:
                out.extend(inserted(now))
                now, audit, at, state, position = conv, text, 0, _START, 0
                continue
            out.extend(inserted(conv))
            letter, at = audit[at], at + 1
            if letter != "D":
                due, after = _NEXT[state]
                keeps = letter == "K"
                state = _SYSTEM if keeps and role[:1] == "s" else after
                out.append((conv, position, role if keeps else GIVEN[due], text, "keep" if keeps else "rerole"))
                position += 1
        yield pd.DataFrame(out, columns=["conv", "position", "role", "text", "edit"])
    yield pd.DataFrame(list(inserted(now)), columns=["conv", "position", "role", "text", "edit"])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a checksum of conversation and turn: a twentieth each is
    dropped, emptied, freed of ends of sentences, repeated, or given the role of the user."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", "".join(SENTENCE_ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")
