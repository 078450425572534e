"""Monitor operators over samples.

Only the meaning of the thresholds is given at the source; its monitor queries are
not. The sample columns are therefore ours and few: the scope keys, ``queue``,
``sample_ts``, ``latency_s``, ``qdepth`` and ``kind``.

A scope without a parameter row is graded with the defaults. The latency operators
keep every sample and work on streams as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from subdrift.functions import grading
from subdrift.operators.params import effective_parms, no_second_rows, single_rows
from subdrift.operators.skew import SALT, hot_keys
from subdrift.schemas import PARM_APPLY, PARM_CAPTURE, SERVER, ParmTable

# Fixed values of ours: the sample kinds.
EXCEPTION = "error"
HEARTBEAT = "view"

# The columns of a sample, for spreading the rows of a hot scope.
_SAMPLE = ("queue", "sample_ts", "latency_s", "qdepth", "kind")
# What is joined to samples carries this prefix, so their own columns may have any other name.
_OWN = "_parm_"
_KEYS = (SERVER,)


def with_parms(
    samples: DataFrame,
    parms: DataFrame,
    table: ParmTable,
    names: list[str],
    keys: tuple[str, ...] = _KEYS,
    hot: DataFrame | None = None,
    strategy: str | None = None,
    on_second_row: str = "fail",
    observation: Observation | None = None,
) -> DataFrame:
    """Samples with the named parameters of their scope, as columns ``_parm_<name>``.

    Nothing runs here, and the plan is the same at any number of scopes. Spark broadcasts
    the parameters if its own check finds their bytes small, in a stream anew for every
    micro-batch; otherwise both sides are shuffled by scope and adaptive execution splits
    the partitions of hot scopes. Where it does not run (streams, or switched off), ``hot``
    names the hot scopes and the salts of each (key columns and ``salts``, a short table; see
    ``hot_scopes``): their samples are spread over as many tasks, their parameters copied.
    ``strategy`` is a join hint of Spark for the side of the parameters, where its own choice
    does not suit.

    A scope with a second row fails the job, which names it. With ``on_second_row="skip"`` neither
    row is used and its samples are graded with the defaults; an ``observation`` then tells, once
    the job has run, how many such scopes there were (``scopes_with_second_rows``) and how
    many had one row (``scopes_with_one_row``), counted in the same pass.
    """
    if on_second_row == "skip":
        scoped = effective_parms(single_rows(parms, keys, observation), table, keys=keys)
    elif on_second_row == "fail" and observation is None:
        scoped = effective_parms(parms, table, keys=keys).where(no_second_rows(parms, table, keys))
    else:
        raise ValueError("on_second_row must be 'fail', or 'skip', which alone takes an observation")
    scoped = scoped.select(*[F.col(c).alias(_OWN + c) for c in (*keys, *names)])
    joined = [F.col(k) == F.col(_OWN + k) for k in keys]
    if hot is not None:
        salts = hot.select(*[F.col(k).alias("_hot_" + k) for k in keys], F.col("salts").alias("_salts"))
        known = [c for c in _SAMPLE if c in samples.columns]
        # The input partition spreads copies of one sample too, and a repeated task gets
        # the same number again. The numbers are hashed together, never added.
        spread = F.pmod(F.xxhash64(*known, F.spark_partition_id()), F.coalesce("_salts", F.lit(1)))
        samples = _beside(samples, salts, keys, "").withColumn(_OWN + "spread", spread.cast("int")).drop(*salts.columns)
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
        scoped = _beside(scoped, salts, keys, _OWN).withColumn(_OWN + SALT, copies).drop(*salts.columns)
        joined.append(F.col(_OWN + "spread") == F.col(_OWN + SALT))
    defaults = {_OWN + n: F.coalesce(F.col(_OWN + n), F.lit(table.defaults[n])) for n in names}
    if strategy is not None:
        scoped = scoped.hint(strategy)
    return samples.join(scoped, joined, "left").withColumns(defaults)


def _beside(df: DataFrame, salts: DataFrame, keys: tuple[str, ...], prefix: str) -> DataFrame:
    return df.join(F.broadcast(salts), [F.col(prefix + k) == F.col("_hot_" + k) for k in keys], "left")


def hot_scopes(samples: DataFrame, rows_per_salt: int, keys: tuple[str, ...] = _KEYS) -> DataFrame:
    """Scopes with more than ``rows_per_salt`` samples and the salts of each, by exact count.
    Their number is bounded as described at ``hot_keys``."""
    counted = hot_keys(samples, list(keys), rows_per_salt)
    return counted.select(*[F.col("_hot_" + k).alias(k) for k in keys], F.col("_salts").alias("salts"))


def _parm(name: str) -> Column:
    return F.col(_OWN + name)


def end_to_end_latency(samples: DataFrame, parms: DataFrame, keys: tuple[str, ...] = _KEYS, **join) -> DataFrame:
    """A-LAT: severity of the end-to-end latency of every sample."""
    return _latency(samples, parms, PARM_APPLY, "alat_thresh_warning", "alat_thresh_error", [], keys, join).select(
        *samples.columns, "sev"
    )


def end_to_end_latency_cause(
    samples: DataFrame, parms: DataFrame, keys: tuple[str, ...] = _KEYS, **join
) -> DataFrame:
    """A-LAT with the cause of warnings and errors, by queue depth."""
    limits = ["alat_cause_cap_qdepth", "alat_cause_app_qdepth"]
    graded = _latency(
        samples, parms, PARM_APPLY, "alat_thresh_warning", "alat_thresh_error", limits, keys, join
    )
    cause = grading.latency_cause(F.col("sev"), F.col("qdepth"), *[_parm(n) for n in limits])
    return graded.select(*samples.columns, "sev", cause.alias("cause"))


def capture_latency(samples: DataFrame, parms: DataFrame, keys: tuple[str, ...] = _KEYS, **join) -> DataFrame:
    """C-LAT: severity of the capture latency of every sample."""
    return _latency(
        samples, parms, PARM_CAPTURE, "clat_thresh_warning", "clat_thresh_error", [], keys, join
    ).select(*samples.columns, "sev")


def _latency(samples, parms, table, warning, error, more, keys, join):
    scoped = with_parms(samples, parms, table, [warning, error, *more], keys, **join)
    return scoped.withColumn(
        "sev", grading.latency_severity(F.col("latency_s"), _parm(warning), _parm(error))
    )


def recent_exceptions(
    samples: DataFrame, parms: DataFrame, as_of: str | Column, keys: tuple[str, ...] = _KEYS, **join
) -> DataFrame:
    """A-EXC: exceptions within the last EXCEPTION_TIME_WINDOW hours before ``as_of``."""
    return _recent(
        samples.where(F.col("kind") == EXCEPTION),
        parms,
        "exception_time_window",
        grading.hours,
        as_of,
        keys,
        join,
    )


def recent_heartbeats(
    samples: DataFrame, parms: DataFrame, as_of: str | Column, keys: tuple[str, ...] = _KEYS, **join
) -> DataFrame:
    """A-CHB: number of heartbeats and the last one, per queue that sent any within
    the last HEARTBEAT_TIME_WINDOW minutes before ``as_of``."""
    recent = _recent(
        samples.where(F.col("kind") == HEARTBEAT),
        parms,
        "heartbeat_time_window",
        grading.minutes,
        as_of,
        keys,
        join,
    )
    return recent.groupBy(*keys, "queue").agg(
        F.count(F.lit(1)).alias("heartbeats"), F.max("sample_ts").alias("last_seen")
    )


def silent_queues(
    queues: DataFrame | None,
    samples: DataFrame,
    parms: DataFrame,
    as_of: str | Column,
    keys: tuple[str, ...] = _KEYS,
    **join,
) -> DataFrame:
    """Queues of ``queues`` without a heartbeat in the window (our derived row).

    With ``None`` they are the queues of the samples, and one pass over them finds the queues
    and counts their heartbeats.
    """
    names = [*keys, "queue"]
    if queues is not None:
        seen = recent_heartbeats(samples, parms, as_of, keys, **join)
        return queues.select(*names).distinct().join(seen, names, "left_anti")
    window, now = "heartbeat_time_window", timestamp(as_of)
    scoped = with_parms(samples, parms, PARM_APPLY, [window], keys, **join)
    beat = (F.col("kind") == HEARTBEAT) & grading.in_window(F.col("sample_ts"), now, grading.minutes(_parm(window)))
    counted = scoped.groupBy(*names).agg(F.count_if(beat).alias(_OWN + "beats"))
    return counted.where(F.col(_OWN + "beats") == 0).select(*names)


def _recent(rows, parms, window, unit, as_of, keys, join):
    # Of the type of the samples, as a cast of their column would keep comparisons from the scan.
    now = timestamp(as_of).cast(rows.schema["sample_ts"].dataType)
    bounded = rows.where((F.col("sample_ts") <= now) & _horizon(parms, window, unit, now, keys))
    scoped = with_parms(bounded, parms, PARM_APPLY, [window], keys, **join)
    return scoped.where(grading.in_window(F.col("sample_ts"), now, unit(_parm(window)))).select(
        *rows.columns
    )


def _horizon(parms: DataFrame, window: str, unit, now: Column, keys: tuple[str, ...]) -> Column:
    """What a sample in any window fulfils, made of comparisons with bare columns, so that it
    reaches the file scan as a pushed filter.

    Parquet skips row groups by it where the column is a timestamp with time zone; other columns
    are only filtered behind the scan. Most scopes have windows up to a usual length (twice the median, or the default), which
    bounds the scan for all of them. Scopes with wider windows, if any, are looked for further
    back, between the first and the last of them only: one scope that wants a year does
    not make the scan of all others a year long. Every value is a scalar subquery.
    """
    scoped = effective_parms(parms, PARM_APPLY, keys=keys)
    usual = F.greatest(2 * F.percentile_approx(window, 0.5), F.lit(PARM_APPLY.defaults[window]))
    start = scoped.select(now - unit(usual)).scalar()
    wide = scoped.where(now - unit(F.col(window)) < start)
    key, ts = keys[0], F.col("sample_ts")
    # First rows, not aggregates: Spark merges aggregates over one table into a single subquery,
    # whose parts it does not push.
    first = lambda order, value: wide.orderBy(order).limit(1).select(value).scalar()
    oldest = first(F.desc(window), now - unit(F.col(window)))
    between = (F.col(key) >= first(F.asc_nulls_last(key), key)) & (F.col(key) <= first(F.desc_nulls_last(key), key))
    recent, further = ts > start, (ts > oldest) & between
    return recent | further


def timestamp(value: str | Column) -> Column:
    """A timestamp without zone, from text or a column."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")
