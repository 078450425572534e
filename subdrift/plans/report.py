"""The report over findings, in its default, view and debug shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subdrift.functions.texts import short_program
from subdrift.operators.monitor import timestamp

# After the two keys of the report order these only separate ties: many findings may
# share one text (all with a NULL state have none), and a range sort cannot split
# equal keys over several tasks.
_TIE_BREAKERS = ("subname", "colname", "current_server", "program", "fixit")


def report(
    findings: DataFrame,
    check_ts: str | Column | None = None,
    fixit: bool = True,
    view: bool = False,
    debug: bool = False,
    ordered: bool | None = None,
) -> DataFrame:
    """Report rows.

    ``view`` adds the order key, the target database and the source owner and drops the
    ordering; ``debug`` adds state, subscription, table and column; ``fixit`` keeps the
    repair text. ``check_ts`` defaults to the time the query starts. The order key
    sorts the default report without being shown; ``ordered=False`` saves that sort
    where the rows are written to files anyway.
    """
    if ordered is None:
        ordered = not view
    now = F.localtimestamp() if check_ts is None else timestamp(check_ts)

    shown = [F.col("ordercol")] if view else []
    shown += [
        now.alias("check_ts"),
        short_program(F.col("program")).alias("program"),
        *[F.col(c) for c in ("current_server", "mtyp", "sev", "mtxt")],
    ]
    if fixit:
        shown.append(F.col("fixit"))
    if view:
        shown += [F.col("target_server").alias("target_dbname"), F.col("source_owner")]
    if debug:
        shown += [F.col(c) for c in ("state", "subname", "source_name", "colname")]

    if ordered:
        keys = [F.col(c).asc_nulls_last() for c in ("mtxt", *_TIE_BREAKERS)]
        findings = findings.orderBy("ordercol", *keys)
    return findings.select(shown)


def create_report_view(name: str, findings: DataFrame, check_ts: str | Column | None = None) -> None:
    """Register the view shape as a temporary view; filters on it reach the checks."""
    report(findings, check_ts, view=True).createOrReplaceTempView(name)
