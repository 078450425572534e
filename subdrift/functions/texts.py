"""Message and repair texts as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("EN", "DE")
ADDCOL_DELIMITER = ";"

# The report texts are matched byte for byte, slips of spelling
# and missing blanks included.
MESSAGES = {
    "EN": {
        "C-TNF": "QSUB {subname} ({raw_state}) for source table {owner}.{table}, STATE={state}, exists, "
        "but the source table does not exist in DB2! {action} the subscription.",
        "C-CNF": "QSUB {subname} ({raw_state}) contains source column {owner}.{table}.{column} "
        "but the column does not exist in DB2!  Modify the subscription.",
        "C-CNS": "QSUB {subname} ({raw_state}){clause} does not contain source col {owner}.{table}.{column}"
        ". Modify the subscription.",
        "C-DCC": "QSUB {subname} ({raw_state}): Source table {owner}.{table}does not have DATA CAPTURE flag. "
        "Alter the table.",
    },
    "DE": {
        "C-TNF": "QSUB {subname} ({raw_state}) fuer Quell-Tabelle {owner}.{table}, STATE={state}, existiert, "
        "aber die Tabelle exitiert nicht in DB2! {action} die Subscription.",
        "C-CNF": "QSUB {subname} ({raw_state}) enthaelt Quell-Spalte {owner}.{table}.{column} "
        "aber die Spalte existiert nicht in DB2!  Die Subscription ist anzupassen.",
        "C-CNS": "QSUB {subname} ({raw_state}){clause} enthaelt die Quell-Spalte {owner}.{table}.{column}"
        " nicht. Die Subscription ist anzupassen.",
        "C-DCC": "QSUB {subname} ({raw_state}): Quelltabelle {owner}.{table}hat kein DATA CAPTURE Attribut. "
        "ALTER TABLE DATA CATRURE CHANGES ist auszufuehren.",
    },
}
TABLE_GONE_ACTION = {
    "EN": {"active": "Deactivate and remove", "other": "Remove"},
    "DE": {"active": "Deactiviere und entferne", "other": "Entferne"},
}
CLAUSE_NOTE = {"EN": " with TRGCOLS {keyword}", "DE": " mit TRGCOLS {keyword}"}
REPAIRS = {
    "C-TNF": 'DROP QSUB ( SUBNAME "{padded_subname}"  USING REPLQMAP {queue_map});',
    "C-CNF": "ALTER TABLE {owner}.{table} ADD COLUMN {column}<datatype>",
    "C-CNS": "INSERT INTO IBMQREP_SIGNAL(SIGNAL_TIME, SIGNAL_TYPE, SIGNAL_SUBTYPE, SIGNAL_INPUT_IN, "
    "SIGNAL_STATE) values (CURRENT TIMESTAMP, 'CMD', 'ADDCOL', '{subname}{delimiter}{column}', 'P' );",
    "C-DCC": "ALTER TABLE {owner}.{table} DATA CAPTURE CHANGES;",
}
PROGRAM = "ASNQCAP({schema})"
SECOND_PARM_ROW = "No more than one row allowed in table {table}"

# Our own wording: a scope without any row is not an error at the source.
NO_PARM_ROW = "No row in table {table}"


def fill(template: str, **values: Column) -> Column:
    """``template`` with its named places taken from columns.

    One ``concat`` of the fixed pieces and the columns: as at the source, a NULL
    in any place makes the whole text NULL.
    """
    parts = []
    for fixed, place, _, _ in Formatter().parse(template):
        if fixed:
            parts.append(F.lit(fixed))
        if place is not None:
            parts.append(values[place])
    return F.concat(*parts)


def program_name(schema: Column) -> Column:
    return fill(PROGRAM, schema=F.trim(schema))


def short_program(program: Column) -> Column:
    """Names over 18 characters keep their first 16 and two dots."""
    return F.when(F.length(program) <= 18, F.substring(program, 1, 18)).otherwise(
        F.concat(F.substring(program, 1, 16), F.lit(".."))
    )


def clause_note(keyword: Column, lang: str) -> Column:
    return F.coalesce(fill(CLAUSE_NOTE[lang], keyword=keyword), F.lit(""))


def message(check: str, lang: str, clause: Column | None = None) -> Column:
    """Message of one finding, over the columns of a joined candidate row."""
    state = F.col("state")
    action = TABLE_GONE_ACTION[lang]
    return fill(
        MESSAGES[lang][check],
        subname=F.trim("subname"),
        raw_state=state,
        state=F.trim(state),
        owner=F.trim("source_owner"),
        table=F.trim("source_name"),
        column=F.trim("column_name"),
        clause=F.lit("") if clause is None else clause,
        action=F.when(state == "A", action["active"]).otherwise(action["other"]),
    )


def repair(check: str, addcol_delimiter: str = ADDCOL_DELIMITER) -> Column:
    """Suggested repair statement; text only, never executed."""
    return fill(
        REPAIRS[check],
        subname=F.trim("subname"),
        padded_subname=F.rtrim("subname"),
        queue_map=F.col("pubqmapname"),
        owner=F.trim("source_owner"),
        table=F.trim("source_name"),
        column=F.trim("column_name"),
        delimiter=F.lit(addcol_delimiter),
    )
