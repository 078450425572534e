"""Conversation repair against trying all edits of each conversation."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from subdrift.llm.conversations import Spill, damaged, repair, repaired_turns
from subdrift.llm.queries import op12_conversation_repair
from tests.llm.helpers import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def brute(rows):
    """(counts, audit, repaired turns) of one conversation, from its last row backwards."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    counts, seen, faults = dict.fromkeys(COUNTS, 0), set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    counts["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

    def fits(initials, last):
        return re.fullmatch(r"(s?(ua)*u?|)" if not last else r"(s?(ua)+)?", initials) is not None

    # The last two initials and whether there are more say all that the pattern needs.
    @functools.lru_cache(None)
    def best(i, end):
        ways = [(0, "", ())] if i == len(rows) and end in ("", "a") else []
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[end]
        # No insertion right after an insertion beyond two, which never helps.
        if i < len(rows):
            _, role, text = rows[i]
            more = int(faults[i] == "truncated")
            options = [(3, "D", end, ())]
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] and role[:1] in follow:
                    options.append((more, "K", role[:1], ((role, text),)))
                options += [(2 + more, "R", to, ((name, text),)) for to, name in (("u", "user"), ("a", "assistant")) if to in follow]
            for cost, letter, to, kept in options:
                rest = best(i + 1, to)
                if rest:
                    ways.append((cost + rest[0], letter + rest[1], kept + rest[2]))
        for to, name in (("u", "user"), ("a", "assistant")):
            if to in follow:
                for k in range(2):  # one insertion, or two
                    if k == 0:
                        rest = after_insertion(i, to)
                        if rest:
                            ways.append((2 + rest[0], "I" + rest[1], ((name, ""),) + rest[2]))
        return min(ways, key=lambda w: (w[0], w[1])) if ways else None

    @functools.lru_cache(None)
    def after_insertion(i, end, left=2):
        """Like ``best``, with so many insertions left before the next row."""
        ways = [(0, "", ())] if i == len(rows) and end == "a" else []
        follow = {"u": "a", "a": "u"}[end]
        if left:
            name = "user" if follow == "u" else "assistant"
            rest = after_insertion(i, follow, left - 1)
            if rest:
                ways.append((2 + rest[0], "I" + rest[1], ((name, ""),) + rest[2]))
        if i < len(rows):
            _, role, text = rows[i]
            more = int(faults[i] == "truncated")
            options = [(3, "D", end, ())]
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] == follow:
                    options.append((more, "K", follow, ((role, text),)))
                options.append((2 + more, "R", follow, (("user" if follow == "u" else "assistant", text),)))
            for cost, letter, to, kept in options:
                rest = best(i + 1, to)
                if rest:
                    ways.append((cost + rest[0], letter + rest[1], kept + rest[2]))
        return min(ways, key=lambda w: (w[0], w[1])) if ways else None

    cost, audit, turns = best(0, "")
    assert fits("".join(r[:1] for r, _ in turns), True)
    return counts | {"cost": cost}, audit, turns


def conversations():
    r = random.Random(5)
    texts = ["Hello there.", "And then", "Why?", "", " \t\n", "Stop!", "So it goes . ", "é", "x" * 40000 + ".", "I see.\x0b"]
    out = {}
    for conv in range(160):
        roles = ["user", "assistant"] * 4 if conv % 2 else ["system", "user", "assistant", "user", "assistant", "tool", "", "Sam", "small"]
        n = r.randint(1, 9)
        rows = [(r.choice([None, r.randint(0, 12), i, i]), r.choice(roles) if r.random() < 0.5 else roles[i % len(roles)], r.choice(texts) + str(r.randint(0, 3)) * (r.random() < 0.5)) for i in range(n)]
        out[conv] = rows + rows[: r.randint(0, 2)]
    out[None] = [(0, "user", "Hi."), (1, "assistant", "Ho."), (None, "user", "Hi.")]
    out[900] = [(3, "user", "The same.")] * 40
    out[901] = [(None, "user", "None.")] * 3
    out[902] = [(-(2**62), "user", "Far."), (2**62, "assistant", "Away.")]
    return out


def rows_of(found):
    return [(c, *r) for c, rows in found.items() for r in rows]


def expected(found):
    out = []
    for conv, rows in found.items():
        counts, audit, turns = brute(rows)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out.append((conv, *counts.values(), audit, digest))
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "chunk", "digest", "fault", "position", "n", "first"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df.repartition(5)


@pytest.mark.parametrize("spill", [Spill(), Spill(1), Spill(3)])
def test_repair(spark, spill):
    found = conversations()
    got = repair(frame(spark, rows_of(found)), spill)
    assert got.columns == ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(found)


def test_null_role_and_text(spark):
    got = repair(spark.createDataFrame([(1, 0, None, None), (1, 1, "user", "Yes.")], SCHEMA)).collect()
    assert [tuple(r)[:7] for r in got] == [(1, 0, 1, 0, 0, 1, 5)] and got[0].audit == "DKI"


def test_repaired_turns(spark):
    found = conversations()
    df = frame(spark, rows_of(found))
    turns = repaired_turns(df, repair(df)).collect()
    of = {}
    for t in sorted(turns, key=lambda t: t.position):
        of.setdefault(t.conv_id, []).append((t.role, t.text))
    for conv, rows in found.items():
        assert tuple(of.get(conv, [])) == brute(rows)[2]


def test_giant_conversation(spark):
    """Many turns in several Arrow batches; the whole must equal the same turns as a chain of edits."""
    r = random.Random(8)
    roles = ["user", "assistant"]
    rows = [(7, i, roles[i % 2] if r.random() < 0.9 else r.choice(["user", "system"]), f"Turn {i}{r.choice(['.', '', '?'])}") for i in range(30000)]
    df = frame(spark, rows)
    small, whole = (repair(df, s).collect() for s in (Spill(997), Spill(1 << 20)))
    assert small == whole and sum(c in "KRD" for c in small[0].audit) == 30000


def test_empty_table(spark):
    empty = frame(spark, rows_of(conversations())).limit(0)
    assert repair(empty).count() == 0 and repaired_turns(empty, repair(empty)).count() == 0


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def test_damage(spark):
    rows = rows_of(conversations())
    assert sorted(map(tuple, damaged(frame(spark, rows)).collect()), key=repr) == sorted(hurt(rows), key=repr)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {conv: [] for conv, *_ in rows}
    for conv, *row in hurt(rows):
        found[conv].append(tuple(row))
    got = op12_conversation_repair(spark, SMALL)
    assert sorted(map(tuple, got.select("conv_id", *COUNTS, "audit", "repaired_sha256").collect()), key=repr) == expected(found)
