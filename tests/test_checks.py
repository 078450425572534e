"""Hand-made rows for every clause of the four checks."""

import pytest

from subdrift import (
    Options,
    column_not_subscribed,
    data_capture_missing,
    findings,
    source_table_not_found,
    subscribed_column_missing,
)
from subdrift.schemas import FINDINGS
from tests.helpers import rows, snapshot, sub
from workload import inputs

GENERATOR = Options(mode="generator")


def test_findings_schema(spark):
    found = findings(snapshot(spark, subs=[sub()], sendqueues=[("Q", "M")]))
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in FINDINGS]
    assert found.first().asDict() == {
        "ordercol": 110, "program": "ASNQCAP(ASN)", "current_server": "SRV", "mtyp": "C-TNF",
        "subname": "S1", "sev": "ERROR",
        "mtxt": "QSUB S1 (A) for source table OWN.T1, STATE=A, exists, but the source table does not exist "
                "in DB2! Deactivate and remove the subscription.",
        "fixit": 'DROP QSUB ( SUBNAME "S1"  USING REPLQMAP M);', "target_server": "TGT1", "state": "A",
        "source_owner": "OWN", "source_name": "T1", "tbcreator": None, "tbname": None, "colname": None,
    }


def test_missing_table_needs_a_queue(spark):
    shot = snapshot(
        spark,
        subs=[sub("A"), sub("B", sendq="OTHER"), sub("C", sendq=None), sub("D", state="I"), sub("E", state=None)],
        sendqueues=[("Q", "M")],
    )
    assert rows(source_table_not_found(shot), "subname", "sev") == [
        ("A", "ERROR"), ("D", "WARNING"), ("E", "WARNING")
    ]


def test_repeated_queue_row_is_reported_once_and_a_second_map_twice(spark):
    shot = snapshot(spark, subs=[sub()], sendqueues=[("Q", "M"), ("Q", "M"), ("Q  ", "M")])
    assert findings(shot).count() == 1
    shot = snapshot(spark, subs=[sub()], sendqueues=[("Q", "M"), ("Q", "N")])
    assert findings(shot).count() == 2


def test_padded_names_are_equal(spark):
    shot = snapshot(
        spark,
        subs=[sub("S1  ", owner="OWN ", table="T1   ", sendq="Q ")],
        sendqueues=[("Q", "M")],
        src_cols=[("S1", "A ")],
        tables=[("OWN", "T1", "Y ")],
        columns=[("OWN  ", "T1", "A")],
    )
    assert findings(shot).count() == 0


def test_leading_blanks_count(spark):
    shot = snapshot(spark, subs=[sub(table=" T1")], sendqueues=[("Q", "M")], tables=[("OWN", "T1", "Y")])
    assert rows(findings(shot), "mtyp", "source_name") == [("C-TNF", " T1")]
    assert "OWN.T1," in findings(shot).first().mtxt


def test_missing_column_only_where_the_table_exists(spark):
    shot = snapshot(
        spark,
        subs=[sub("S1", table="T1"), sub("S2", table="TGONE")],
        sendqueues=[("Q", "M")],
        src_cols=[("S1", "A"), ("S1", "LONG_COLUMN_NAME_OF_SORTS"), ("S2", "A"), ("NOSUB", "A")],
        tables=[("OWN", "T1", "Y")],
        columns=[("OWN", "T1", "A"), ("OTHER", "T1", "LONG_COLUMN_NAME_OF_SORTS")],
    )
    assert rows(subscribed_column_missing(shot), "subname", "colname", "tbcreator", "sev") == [
        ("S1", "LONG_COLUMN_NAME_O", None, "ERROR")
    ]
    assert rows(findings(shot), "mtyp", "subname") == [("C-CNF", "S1"), ("C-TNF", "S2")]


def test_unlisted_column_is_reported_per_subscription_in_any_state(spark):
    shot = snapshot(
        spark,
        subs=[sub("S1", state="A"), sub("S2", state="I"), sub("S3", state=None)],
        src_cols=[("S1", "A"), ("S2", "A"), ("S2", "B"), ("S3", "B")],
        columns=[("OWN", "T1", "A"), ("OWN", "T1", "B"), ("OWN", "UNSUBSCRIBED", "A")],
    )
    # The table list is not consulted.
    expected = [("S1", "B", "ERROR", "OWN", "T1"), ("S3", "A", "ERROR", "OWN", "T1")]
    columns = ("subname", "colname", "sev", "tbcreator", "tbname")
    assert rows(column_not_subscribed(shot), *columns) == expected
    assert rows(findings(shot), *columns) == expected


def test_capture_flag(spark):
    flags = {"T1": "N", "T2": " ", "T3": "", "T4": "y", "T5": "Y", "T6": None, "T7": "Y "}
    shot = snapshot(
        spark,
        subs=[sub(f"S{t}", table=t) for t in flags],
        tables=[("OWN", t, flag) for t, flag in flags.items()],
    )
    for found in (data_capture_missing(shot), findings(shot)):
        assert rows(found, "source_name") == [("T1",), ("T2",), ("T3",), ("T4",)]


def test_debug_names_are_cut(spark):
    owner, table = "OWNER_WITH_A_LONG_NAME", "TABLE_WITH_A_LONG_NAME"
    shot = snapshot(spark, subs=[sub(owner=owner, table=table)], tables=[(owner, table, "N")])
    assert rows(findings(shot), "tbcreator", "tbname", "source_owner", "source_name") == [
        (owner[:18], table[:18], owner, table)
    ]


CLAUSES = [
    (None, "B", True),
    ("TRGCOLS ALL", "B", True),
    ("TRGCOLS INCLUDE (B)", "B", True),
    ("TRGCOLS INCLUDE (B, C)", "B", True),
    ("trgcols  include (a, b ,c)", "B", True),
    ("TRGCOLS INCLUDE (A,B)", "B", True),
    ("TRGCOLS INCLUDE (A)", "B", False),
    ("TRGCOLS INCLUDE (A,\tB)", "B", False),
    ("TRGCOLS INCLUDE (BC, AB)", "B", False),
    ("TRGCOLS INCLUDE (C1)", "C10", False),
    ("TRGCOLS INCLUDE (C10)", "C1", False),
    ("TRGCOLS INCLUDE (b)", "b", False),
    ("TRGCOLS EXCLUDE (b)", "b", True),
    ("TRGCOLS EXCLUDE (B)", "B", False),
    ("TRGCOLS EXCLUDE (A)", "B", True),
    ("TRGCOLS EXCLUDE (B) TRGCOLS INCLUDE (A)", "B", True),
    ("TRGCOLS INCLUDE (A) TRGCOLS EXCLUDE (C)", "B", False),
    ("KEYS (B) TRGCOLS INCLUDE (A)", "B", True),
]


def test_generator_mode(spark):
    names = [f"T{i}" for i in range(len(CLAUSES))]
    shot = snapshot(
        spark,
        subs=[sub(f"S{i}", table=n) for i, n in enumerate(names)],
        columns=[("OWN", n, column) for n, (_, column, _) in zip(names, CLAUSES)],
        q_base=[("OWN", n, "TO", n, clause) for n, (clause, _, _) in zip(names, CLAUSES)],
    )
    expected = {n for n, (_, _, reported) in zip(names, CLAUSES) if reported}
    for found in (column_not_subscribed(shot, GENERATOR), findings(shot, GENERATOR)):
        assert {r.source_name for r in found.collect()} == expected


def test_generator_mode_without_an_intent_row(spark):
    shot = snapshot(
        spark,
        subs=[sub()],
        src_cols=[("S1", "A")],
        columns=[("OWN", "T1", "A"), ("OWN", "T1", "B")],
        q_base=[("OWN", "T1", "OTHER", "T1", "TRGCOLS INCLUDE (X)")],
    )
    assert rows(column_not_subscribed(shot, GENERATOR), "colname") == [("B",)]
    assert rows(findings(shot, GENERATOR), "colname") == [("B",)]


def test_options_are_checked():
    for bad in ({"lang": "FR"}, {"mode": "other"}, {"flag_prefix": True}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_findings_meet_queues_and_clauses_before_they_are_told(spark):
    """No join sorts the rows of findings: queues and clauses are joined to subscriptions."""
    found = findings(inputs.snapshot(spark, "/root/testdata/sf0.001", fleet=True), Options(mode="generator", rows_per_salt=50))
    plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    told = [i for i, line in enumerate(plan) if "Generate inline" in line]
    assert told and not [line for line in plan[: told[0]] if "Join" in line]
    assert [line for line in plan[told[0] :] if "Join" in line]
