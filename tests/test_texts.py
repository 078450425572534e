"""Byte-exact texts, one row per template, language and state."""

import pytest

from subdrift import Options, findings, report
from subdrift.operators.checks import column_not_subscribed
from tests.helpers import rows, snapshot, sub


def drifted(spark, state, map_name="MAP1", **more):
    """One subscription of a vanished table, one with all other findings."""
    return snapshot(
        spark,
        subs=[sub("GONE", table="TGONE", state=state), sub("HERE", table="T1", state=state)],
        sendqueues=[("Q", map_name)],
        src_cols=[("GONE", "A"), ("HERE", "A"), ("HERE", "X")],
        tables=[("OWN", "T1", "N")],
        columns=[("OWN", "T1", "A"), ("OWN", "T1", "B")],
        **more,
    )


EXPECTED = {
    ("EN", "A"): [
        ("C-CNF", "QSUB HERE (A) contains source column OWN.T1.X but the column does not exist in DB2!  "
                  "Modify the subscription."),
        ("C-CNS", "QSUB HERE (A) does not contain source col OWN.T1.B. Modify the subscription."),
        ("C-DCC", "QSUB HERE (A): Source table OWN.T1does not have DATA CAPTURE flag. Alter the table."),
        ("C-TNF", "QSUB GONE (A) for source table OWN.TGONE, STATE=A, exists, but the source table does not "
                  "exist in DB2! Deactivate and remove the subscription."),
    ],
    ("EN", "I"): [
        ("C-CNF", "QSUB HERE (I) contains source column OWN.T1.X but the column does not exist in DB2!  "
                  "Modify the subscription."),
        ("C-CNS", "QSUB HERE (I) does not contain source col OWN.T1.B. Modify the subscription."),
        ("C-DCC", "QSUB HERE (I): Source table OWN.T1does not have DATA CAPTURE flag. Alter the table."),
        ("C-TNF", "QSUB GONE (I) for source table OWN.TGONE, STATE=I, exists, but the source table does not "
                  "exist in DB2! Remove the subscription."),
    ],
    ("DE", "A"): [
        ("C-CNF", "QSUB HERE (A) enthaelt Quell-Spalte OWN.T1.X aber die Spalte existiert nicht in DB2!  "
                  "Die Subscription ist anzupassen."),
        ("C-CNS", "QSUB HERE (A) enthaelt die Quell-Spalte OWN.T1.B nicht. Die Subscription ist anzupassen."),
        ("C-DCC", "QSUB HERE (A): Quelltabelle OWN.T1hat kein DATA CAPTURE Attribut. "
                  "ALTER TABLE DATA CATRURE CHANGES ist auszufuehren."),
        ("C-TNF", "QSUB GONE (A) fuer Quell-Tabelle OWN.TGONE, STATE=A, existiert, aber die Tabelle exitiert "
                  "nicht in DB2! Deactiviere und entferne die Subscription."),
    ],
    ("DE", "I"): [
        ("C-CNF", "QSUB HERE (I) enthaelt Quell-Spalte OWN.T1.X aber die Spalte existiert nicht in DB2!  "
                  "Die Subscription ist anzupassen."),
        ("C-CNS", "QSUB HERE (I) enthaelt die Quell-Spalte OWN.T1.B nicht. Die Subscription ist anzupassen."),
        ("C-DCC", "QSUB HERE (I): Quelltabelle OWN.T1hat kein DATA CAPTURE Attribut. "
                  "ALTER TABLE DATA CATRURE CHANGES ist auszufuehren."),
        ("C-TNF", "QSUB GONE (I) fuer Quell-Tabelle OWN.TGONE, STATE=I, existiert, aber die Tabelle exitiert "
                  "nicht in DB2! Entferne die Subscription."),
    ],
}


@pytest.mark.parametrize("lang,state", EXPECTED)
def test_messages(spark, lang, state):
    found = findings(drifted(spark, state), Options(lang=lang))
    assert rows(found, "mtyp", "mtxt") == EXPECTED[lang, state]


def test_repairs(spark):
    found = findings(drifted(spark, "A"))
    assert rows(found, "mtyp", "fixit") == [
        ("C-CNF", "ALTER TABLE OWN.T1 ADD COLUMN X<datatype>"),
        ("C-CNS", "INSERT INTO IBMQREP_SIGNAL(SIGNAL_TIME, SIGNAL_TYPE, SIGNAL_SUBTYPE, SIGNAL_INPUT_IN, "
                  "SIGNAL_STATE) values (CURRENT TIMESTAMP, 'CMD', 'ADDCOL', 'HERE;B', 'P' );"),
        ("C-DCC", "ALTER TABLE OWN.T1 DATA CAPTURE CHANGES;"),
        ("C-TNF", 'DROP QSUB ( SUBNAME "GONE"  USING REPLQMAP MAP1);'),
    ]


def test_add_column_delimiter(spark):
    found = column_not_subscribed(drifted(spark, "A"), Options(addcol_delimiter="#"))
    assert "'HERE#B'" in found.first().fixit


def test_null_parts_make_the_text_null(spark):
    found = findings(drifted(spark, None, map_name=None))
    assert {(r.mtyp, r.mtxt) for r in found.collect()} == {
        ("C-CNF", None), ("C-CNS", None), ("C-DCC", None), ("C-TNF", None)
    }
    gone = [r for r in found.collect() if r.mtyp == "C-TNF"]
    assert [(r.sev, r.fixit) for r in gone] == [("WARNING", None)]


@pytest.mark.parametrize("lang,word", [("EN", "with"), ("DE", "mit")])
def test_clause_note(spark, lang, word):
    shot = drifted(spark, "A", q_base=[("OWN", "T1", "TO", "T1", "trgcols Include (B)")])
    text = column_not_subscribed(shot, Options(lang=lang, mode="generator")).first().mtxt
    assert text.startswith(f"QSUB HERE (A) {word} TRGCOLS INCLUDE ")


def test_flag_prefix(spark):
    options = Options(mode="generator", flag_prefix=True)
    shot = drifted(spark, "A", q_base=[("OWN", "T1", "TO", "T1", "TRGCOLS INCLUDE (B)")])
    assert column_not_subscribed(shot, options).first().mtxt.startswith("INCLUDEYNQSUB HERE (A) with")
    shot = drifted(spark, "A")
    assert column_not_subscribed(shot, options).first().mtxt.startswith("NNQSUB HERE (A) does")


@pytest.mark.parametrize(
    "schema,shown",
    [("ASN", "ASNQCAP(ASN)"), ("  ASN", "ASNQCAP(ASN)"), ("NINECHARS", "ASNQCAP(NINECHARS)"),
     ("TENLETTERS", "ASNQCAP(TENLETTE..")],
)
def test_program_is_shortened(spark, schema, shown):
    shot = snapshot(spark, schema=schema, subs=[sub()], sendqueues=[("Q", "M")])
    assert report(findings(shot)).first().program == shown
