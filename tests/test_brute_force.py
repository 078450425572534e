"""Random snapshots of many servers against the rules written as plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from subdrift import Options, Snapshot, findings, prepare
from subdrift.functions import texts
from subdrift.plans import CHECKS
from tests.helpers import contents, raw

SERVERS = 60
SCHEMA = "ASN"


def random_rows(seed):
    """Few names, so that every kind of match and mismatch occurs; copies, padding and NULLs too."""
    r = random.Random(seed)
    data = {t: [] for t in ("subs", "sendqueues", "src_cols", "tables", "columns", "q_base")}

    def pick(*values, null=0.05, pad=0.1):
        if r.random() < null:
            return None
        value = r.choice(values)
        return value + "  " if r.random() < pad else value

    clauses = ("TRGCOLS INCLUDE (A, B)", "trgcols exclude (a,C)", "TRGCOLS ALL", "TRGCOLS INCLUDE (C) KEYS (A)")
    for n in range(SERVERS):
        server = f"SRV{n}"
        for _ in range(r.randint(1, 6)):
            data["subs"].append(
                (server, pick("S1", "S2", "S3"), pick("O1", "O2"), pick("T1", "T2"), pick("TO"), pick("T1", "T2"),
                 pick("A", "I", "N"), pick("Q1", "Q2"), pick("G1", "G2"))
            )
        for _ in range(r.randint(0, 3)):
            data["sendqueues"].append((server, pick("Q1", "Q2"), pick("M1", "M2")))
        for _ in range(r.randint(0, 8)):
            data["src_cols"].append((server, pick("S1", "S2", "S3"), pick("A", "B", "C", "d")))
        for _ in range(r.randint(0, 4)):
            data["tables"].append((server, pick("O1", "O2"), pick("T1", "T2"), pick("Y", "N", null=0.2)))
        for _ in range(r.randint(0, 8)):
            data["columns"].append((server, pick("O1", "O2"), pick("T1", "T2"), pick("A", "B", "C", "d")))
        for _ in range(r.randint(2, 12)):
            data["q_base"].append(
                (server, pick("O1", "O2"), pick("T1", "T2"), pick("TO"), pick("T1", "T2"), pick(*clauses, null=0.1))
            )
    return data


def equal(*pairs):
    return all(a is not None and a == b for a, b in pairs)


def glue(*parts):
    return None if None in parts else "".join(parts)


def expected(data, lang, generator):
    clean = {
        t: {tuple(v if v is None else v.rstrip(" ") for v in row) for row in rows} for t, rows in data.items()
    }
    found = set()
    for srv, subname, owner, table, towner, ttable, state, sendq, target in clean["subs"]:
        def row(order, check, sev, mtxt, fixit, creator=None, tbname=None, col=None):
            found.add((order, f"ASNQCAP({SCHEMA})", srv, check, subname, sev, mtxt, fixit, target, state, owner,
                       table, creator, tbname, col))

        tables = [t for t in clean["tables"] if t[0] == srv and equal((t[1], owner), (t[2], table))]
        columns = [c for c in clean["columns"] if c[0] == srv and equal((c[1], owner), (c[2], table))]
        listed = [c for c in clean["src_cols"] if c[0] == srv and equal((c[1], subname))]
        head = glue("QSUB ", subname, " (", state, ")")
        en = lang == "EN"

        if not tables:
            for s, q, m in clean["sendqueues"]:
                if s == srv and equal((q, sendq)):
                    active = state == "A"
                    row(110, "C-TNF", "ERROR" if active else "WARNING",
                        glue(head, " for source table " if en else " fuer Quell-Tabelle ", owner, ".", table,
                             ", STATE=", state,
                             ", exists, but the source table does not exist in DB2! " if en else
                             ", existiert, aber die Tabelle exitiert nicht in DB2! ",
                             ("Deactivate and remove" if active else "Remove") if en else
                             ("Deactiviere und entferne" if active else "Entferne"),
                             " the subscription." if en else " die Subscription."),
                        glue('DROP QSUB ( SUBNAME "', subname, '"  USING REPLQMAP ', m, ");"))
        else:
            for _, _, col in listed:
                if not any(equal((c[3], col)) for c in columns):
                    row(120, "C-CNF", "ERROR",
                        glue(head, " contains source column " if en else " enthaelt Quell-Spalte ", owner, ".",
                             table, ".", col,
                             " but the column does not exist in DB2!  Modify the subscription." if en else
                             " aber die Spalte existiert nicht in DB2!  Die Subscription ist anzupassen."),
                        glue("ALTER TABLE ", owner, ".", table, " ADD COLUMN ", col, "<datatype>"), col=col)

        for _, _, _, col in columns:
            if any(equal((c[2], col)) for c in listed):
                continue
            intents = [q for q in clean["q_base"]
                       if q[0] == srv and equal((q[1], owner), (q[2], table), (q[3], towner), (q[4], ttable))]
            for clause in ([q[5] for q in intents] or [None]) if generator else [None]:
                cl = (clause or "").upper().replace(" ", "")
                word = "INCLUDE" if "TRGCOLSINCLUDE" in cl else "EXCLUDE" if "TRGCOLSEXCLUDE" in cl else None
                named = col is not None and any(f"{a}{col}{b}" in cl for a in "(," for b in "),")
                if word == "INCLUDE" and not named or word == "EXCLUDE" and named:
                    continue
                note = f" {'with' if en else 'mit'} TRGCOLS {word}" if word else ""
                row(130, "C-CNS", "ERROR",
                    glue(head, note, " does not contain source col " if en else " enthaelt die Quell-Spalte ", owner,
                         ".", table, ".", col, ". Modify the subscription." if en else
                         " nicht. Die Subscription ist anzupassen."),
                    glue("INSERT INTO IBMQREP_SIGNAL(SIGNAL_TIME, SIGNAL_TYPE, SIGNAL_SUBTYPE, SIGNAL_INPUT_IN, "
                         "SIGNAL_STATE) values (CURRENT TIMESTAMP, 'CMD', 'ADDCOL', '", subname, ";", col,
                         "', 'P' );"), owner, table, col)

        if any(t[3] is not None and t[3] != "Y" for t in tables):
            row(140, "C-DCC", "ERROR",
                glue(head, ": Source table " if en else ": Quelltabelle ", owner, ".", table,
                     "does not have DATA CAPTURE flag. Alter the table." if en else
                     "hat kein DATA CAPTURE Attribut. ALTER TABLE DATA CATRURE CHANGES ist auszufuehren."),
                glue("ALTER TABLE ", owner, ".", table, " DATA CAPTURE CHANGES;"), owner, table)
    return found


CASES = [
    (1, "EN", "plain", 10**6), (2, "DE", "plain", 1), (3, "EN", "generator", 1), (4, "DE", "generator", 10**6), (5, "EN", "generator", 2),
]


@pytest.mark.parametrize("seed,lang,mode,rows_per_salt", CASES)
def test_against_loops(spark, seed, lang, mode, rows_per_salt):
    """A ``rows_per_salt`` of 1 or 2 salts nearly every key; results stay the same."""
    data = random_rows(seed)
    shot = Snapshot.of(raw(spark, data, server=True), capture_schema=SCHEMA)
    options = Options(lang=lang, mode=mode, rows_per_salt=rows_per_salt)
    wanted = expected(data, lang, mode == "generator")
    assert len({row[3] for row in wanted}) == 4
    assert {tuple(r) for r in findings(shot, options).collect()} == wanted
    for check, single in CHECKS.items():
        assert {tuple(r) for r in single(shot, options).collect()} == {r for r in wanted if r[3] == check}, check


@pytest.mark.parametrize("seed,lang,mode,rows_per_salt", [(6, "DE", "plain", 2), (7, "EN", "generator", 1)])
def test_columns_row_by_row(spark, seed, lang, mode, rows_per_salt):
    data = random_rows(seed)
    shot = Snapshot.of(raw(spark, data, server=True), capture_schema=SCHEMA)
    options = Options(lang=lang, mode=mode, rows_per_salt=rows_per_salt, packed=False)
    wanted = expected(data, lang, mode == "generator")
    assert {tuple(r) for r in findings(shot, options).collect()} == wanted
    for check in ("C-CNF", "C-CNS"):
        assert {tuple(r) for r in CHECKS[check](shot, options).collect()} == {r for r in wanted if r[3] == check}, check


@pytest.mark.parametrize("seed,lang,mode,rows_per_salt", [(8, "EN", "plain", 1), (9, "DE", "generator", 10**6)])
def test_prepared_snapshot(spark, scratch, seed, lang, mode, rows_per_salt):
    data = random_rows(seed)
    shot = prepare(Snapshot.of(raw(spark, data, server=True), capture_schema=SCHEMA), scratch, buckets=5, rows_per_salt=rows_per_salt)
    options = Options(lang=lang, mode=mode)
    wanted = expected(data, lang, mode == "generator")
    assert {tuple(r) for r in findings(shot, options).collect()} == wanted
    for checks in (("C-CNS",), ("C-TNF", "C-CNF"), ("C-DCC",)):
        assert {tuple(r) for r in findings(shot, options, checks).collect()} == {r for r in wanted if r[3] in checks}, checks


def test_findings_are_distinct_over_what_they_show(spark):
    """Inputs that differ only in what no finding shows: blanks around a schema's name, parts of a
    column name that neither a text nor the cut name holds, clauses of a text that is NULL."""
    long = "COLUMN_NAME_OF_EIGHTEEN"
    rows = {
        "subs": [("S", None, "O", "T", "TO", "T", None, "Q", "G"), ("S", "N", "O", "T", "TO", "T", None, "Q", "G")],
        "sendqueues": [("S", "Q", "M")],
        "src_cols": [],
        "tables": [("S", "O", "T", "N")],
        "columns": [("S", "O", "T", long + "A"), ("S", "O", "T", long + "B"), ("S", "O", "T", " " * 18 + "A"), ("S", "O", "T", " " * 19 + "A")],
        "q_base": [("S", "O", "T", "TO", "T", "TRGCOLS ALL"), ("S", "O", "T", "TO", "T", None), ("S", "O", "T", "TO", "T", f"TRGCOLS INCLUDE ({long}A)")],
    }
    both = {
        t: df if t in ("tables", "columns") else df.withColumn("capture_schema", F.lit("ASN")).unionByName(df.withColumn("capture_schema", F.lit(" ASN")))
        for t, df in raw(spark, rows, server=True).items()
    }
    for mode in ("plain", "generator"):
        for prefix in (False, mode == "generator"):
            options = Options(mode=mode, flag_prefix=prefix)
            found = findings(Snapshot.of(both), options).collect()
            singles = {tuple(r) for single in CHECKS.values() for r in single(Snapshot.of(both), options).collect()}
            assert len(found) == len(singles) and {tuple(r) for r in found} == singles


def test_findings_hold_no_repeated_row(spark):
    shot = Snapshot.of(raw(spark, random_rows(6), server=True), capture_schema=SCHEMA)
    found = contents(findings(shot))
    assert len(found) == len(set(found))
