"""Replication drift audit on Spark.

Compares snapshots of configured subscriptions with snapshots of database
catalogues, and grades monitor samples against thresholds::

    snapshot = Snapshot.load(spark, "/snapshots/2024-01-30")
    report(findings(snapshot, Options(lang="EN"))).write.parquet("/reports/2024-01-30")
"""

from subdrift.operators.checks import (
    Options,
    column_not_subscribed,
    data_capture_missing,
    source_table_not_found,
    subscribed_column_missing,
)
from subdrift.operators.monitor import (
    capture_latency,
    end_to_end_latency,
    end_to_end_latency_cause,
    hot_scopes,
    recent_exceptions,
    recent_heartbeats,
    silent_queues,
)
from subdrift.operators.params import effective_parms, row_violations, shipped_row
from subdrift.plans import Prepared, create_report_view, findings, prepare, register_functions, report
from subdrift.schemas import PARM_APPLY, PARM_CAPTURE
from subdrift.sources import Snapshot, normalise, read_table

__all__ = [
    "PARM_APPLY",
    "PARM_CAPTURE",
    "Options",
    "Prepared",
    "Snapshot",
    "capture_latency",
    "column_not_subscribed",
    "create_report_view",
    "data_capture_missing",
    "effective_parms",
    "end_to_end_latency",
    "end_to_end_latency_cause",
    "findings",
    "hot_scopes",
    "normalise",
    "prepare",
    "read_table",
    "recent_exceptions",
    "recent_heartbeats",
    "register_functions",
    "report",
    "row_violations",
    "shipped_row",
    "silent_queues",
    "source_table_not_found",
    "subscribed_column_missing",
]
