"""Grading of monitor samples as column expressions (batch and streaming)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def latency_severity(latency: Column, warning: Column, error: Column) -> Column:
    """ERROR or WARNING once the latency is *past* the limit, else OK; NULL stays NULL."""
    return (
        F.when(latency > error, "ERROR")
        .when(latency > warning, "WARNING")
        .when(latency.isNotNull(), "OK")
    )


def latency_cause(severity: Column, qdepth: Column, capture_limit: Column, apply_limit: Column) -> Column:
    """Whom a late sample is put down to; the capture limit is tested first."""
    late = severity.isin("WARNING", "ERROR")
    return F.when(late & (qdepth <= capture_limit), "CAPTURE").when(
        late & (qdepth >= apply_limit), "APPLY"
    )


def hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n)


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n)


def in_window(ts: Column, as_of: Column, length: Column) -> Column:
    """``as_of - length < ts <= as_of``."""
    return (ts > as_of - length) & (ts <= as_of)
