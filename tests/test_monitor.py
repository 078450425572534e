"""Thresholds, causes and windows at, below and above each limit."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import subdrift as sd
from tests.helpers import contents, rows

AS_OF = "2024-01-30 00:00:00"
NOW = dt.datetime(2024, 1, 30)


def samples(spark, data):
    """(server, queue, seconds before AS_OF, latency, depth, kind)"""
    made = [
        (s, i, q, NOW - dt.timedelta(seconds=ago), None if lat is None else float(lat), depth, kind)
        for i, (s, q, ago, lat, depth, kind) in enumerate(data)
    ]
    return spark.createDataFrame(
        made,
        "server string, sample_id long, queue string, sample_ts timestamp_ntz, latency_s double, qdepth long, kind string",
    )


def latencies(spark, *values, server="S"):
    return samples(spark, [(server, "Q", 0, v, 500, "view") for v in values])


@pytest.fixture
def shipped(spark):
    return sd.shipped_row(spark, sd.PARM_APPLY, "S")


def test_end_to_end_latency_limits(spark, shipped):
    graded = sd.end_to_end_latency(latencies(spark, 599, 600, 600.5, 3600, 3601, None), shipped)
    assert [r.sev for r in graded.orderBy("sample_id").collect()] == [
        "OK", "OK", "WARNING", "WARNING", "ERROR", None
    ]


def test_capture_latency_limits(spark):
    parms = sd.shipped_row(spark, sd.PARM_CAPTURE, "S")
    graded = sd.capture_latency(latencies(spark, 499, 500, 501, 5399, 5400, 5401), parms)
    assert [r.sev for r in graded.orderBy("sample_id").collect()] == [
        "OK", "OK", "WARNING", "WARNING", "WARNING", "ERROR"
    ]


def test_cause_limits_and_only_for_late_samples(spark, shipped):
    depths = [99, 100, 101, 59999, 60000, 60001, None]
    data = [("S", "Q", 0, 700, d, "view") for d in depths] + [("S", "Q", 0, 600, 1, "view")]
    graded = sd.end_to_end_latency_cause(samples(spark, data), shipped).orderBy("sample_id").collect()
    assert [r.cause for r in graded] == ["CAPTURE", "CAPTURE", None, None, "APPLY", "APPLY", None, None]
    assert [r.sev for r in graded] == ["WARNING"] * 7 + ["OK"]


def test_capture_is_tested_before_apply(spark, shipped):
    both = shipped.withColumn("alat_cause_cap_qdepth", F.lit(10)).withColumn("alat_cause_app_qdepth", F.lit(5))
    graded = sd.end_to_end_latency_cause(samples(spark, [("S", "Q", 0, 9999, 7, "view")]), both)
    assert graded.first().cause == "CAPTURE"


def test_defaults_for_null_and_for_a_server_without_a_row(spark):
    parms = spark.createDataFrame([("S", None, 100)], "server string, alat_thresh_warning int, alat_thresh_error int")
    data = [("S", "Q", 0, 30, 1, "view"), ("S", "Q", 0, 31, 1, "view"), ("S", "Q", 0, 101, 1, "view"),
            ("OTHER", "Q", 0, 600, 1, "view"), ("OTHER", "Q", 0, 601, 1, "view"), (None, "Q", 0, 31, 1, "view")]
    graded = sd.end_to_end_latency(samples(spark, data), parms)
    assert [r.sev for r in graded.orderBy("sample_id").collect()] == [
        "OK", "WARNING", "ERROR", "WARNING", "ERROR", "WARNING"
    ]
    nothing = sd.end_to_end_latency(samples(spark, data), parms.limit(0))
    assert [r.sev for r in nothing.orderBy("sample_id").collect()] == [
        "OK", "WARNING", "WARNING", "WARNING", "ERROR", "WARNING"
    ]


def test_repeated_samples_stay(spark, shipped):
    one = latencies(spark, 700)
    assert sd.end_to_end_latency(one.unionByName(one), shipped).count() == 2


def test_a_second_parameter_row_fails_the_grading(spark, shipped):
    with pytest.raises(PySparkException, match="No more than one row allowed in table QREP_MON_APPLY_PARM"):
        sd.end_to_end_latency(latencies(spark, 700), shipped.unionByName(shipped)).collect()


def test_many_scopes_are_shuffled_with_the_same_result(spark):
    parms = spark.range(300).select(
        F.concat(F.lit("S"), F.col("id").cast("string")).alias("server"),
        F.col("id").cast("int").alias("alat_thresh_warning"), (F.col("id") * 3).cast("int").alias("alat_thresh_error"),
    )
    data = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "S7")
        .otherwise(F.concat(F.lit("S"), (F.col("id") % 320).cast("string")))
        .alias("server"),
        F.col("id").alias("sample_id"), (F.col("id") % 500).cast("double").alias("latency_s"),
    )
    data = data.unionByName(data.where("sample_id < 100"))
    plain = sd.end_to_end_latency(data, parms)
    hot = sd.hot_scopes(data, 200)
    spread = sd.end_to_end_latency(data, parms, hot=hot, strategy="merge")
    assert [tuple(r) for r in hot.collect()] == [("S7", 9)]
    assert contents(plain) == contents(spread)
    assert spread.count() == 5100
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "_parm__salt" in plan
    assert "SortMergeJoin" not in plain._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shuffled", [False, True])
def test_samples_may_have_any_further_columns(spark, shipped, shuffled):
    """A map cannot be hashed or compared, and a name may be that of a threshold."""
    data = latencies(spark, 599, 700, 4000).select(
        "*", F.create_map(F.lit("k"), "sample_id").alias("tags"), F.lit("x").alias("alat_thresh_error"), F.lit(1).alias("_salt")
    )
    hot = {"hot": spark.createDataFrame([("S", 3)], "server string, salts int"), "strategy": "merge"} if shuffled else {}
    graded = sd.end_to_end_latency(data, shipped, **hot)
    assert graded.columns == [*data.columns, "sev"]
    assert [(r.tags["k"], r.alat_thresh_error, r._salt, r.sev) for r in graded.orderBy("sample_id").collect()] == [
        (0, "x", 1, "OK"), (1, "x", 1, "WARNING"), (2, "x", 1, "ERROR")
    ]


def test_building_a_grading_runs_nothing(spark, shipped):
    data = latencies(spark, 700)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    sd.end_to_end_latency_cause(data, shipped)
    sd.recent_exceptions(data, shipped, AS_OF)
    sd.silent_queues(None, data, shipped, AS_OF)
    sd.end_to_end_latency(data, shipped, hot=sd.hot_scopes(data, 10))
    assert tracker.getJobIdsForGroup("building") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_refusal_names_the_scope(spark, shipped):
    twice = shipped.unionByName(shipped)
    with pytest.raises(PySparkException, match="QREP_MON_APPLY_PARM: server=S"):
        sd.end_to_end_latency(latencies(spark, 700), twice).collect()


def test_hot_scopes_are_split_by_the_adaptive_skew_join(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        server = F.when(F.col("id") % 3 == 0, "S7").otherwise(F.concat(F.lit("S"), F.col("id").cast("string")))
        data = spark.range(0, 60000, 1, 8).select(server.alias("server"), (F.col("id") % 5000).cast("double").alias("latency_s"))
        parms = spark.range(500).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("server"))
        graded = sd.end_to_end_latency(data, parms)
        graded.collect()
        assert "skew=true" in graded._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_exception_window(spark, shipped):
    day = 24 * 3600
    data = [("S", "Q", ago, 1, 1, "error") for ago in (-1, 0, 1, day - 1, day, day + 1)]
    data.append(("S", "Q", 5, 1, 1, "view"))
    found = sd.recent_exceptions(samples(spark, data), shipped, AS_OF)
    assert rows(found, "sample_id") == [(1,), (2,), (3,)]


def test_exception_window_per_scope(spark):
    parms = spark.createDataFrame([("A", 1), ("B", 48), ("C", None)], "server string, exception_time_window int")
    hour = 3600
    data = [(s, "Q", h * hour + 60, 1, 1, "error") for s in ("A", "B", "C", "NOROW") for h in (0, 1, 23, 24, 47, 48)]
    found = sd.recent_exceptions(samples(spark, data), parms, AS_OF)
    assert {r.server: r["count"] for r in found.groupBy("server").count().collect()} == {
        "A": 1, "B": 5, "C": 3, "NOROW": 3
    }


def test_heartbeats_and_silent_queues(spark, shipped):
    data = [("S", "Q1", 0, 1, 1, "view"), ("S", "Q1", 599, 1, 1, "view"), ("S", "Q2", 600, 1, 1, "view"),
            ("S", "Q3", 10, 1, 1, "error"), ("S", "Q4", 300, 1, 1, "view"), ("S", "Q4", -1, 1, 1, "view")]
    all_samples = samples(spark, data)
    seen = sd.recent_heartbeats(all_samples, shipped, AS_OF)
    assert rows(seen, "server", "queue", "heartbeats", "last_seen") == [
        ("S", "Q1", 2, NOW), ("S", "Q4", 1, NOW - dt.timedelta(minutes=5))
    ]
    for queues in (all_samples, None):
        silent = sd.silent_queues(queues, all_samples, shipped, AS_OF)
        assert rows(silent, "server", "queue") == [("S", "Q2"), ("S", "Q3")]


def test_the_window_reaches_the_scan(spark, shipped, scratch):
    samples(spark, [("S", "Q", 5, 1, 1, "error")]).write.parquet(f"{scratch}/samples")
    stored = spark.read.parquet(f"{scratch}/samples")
    found = sd.recent_exceptions(stored, shipped, AS_OF)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "sample_ts" in pushed.split("PushedFilters")[1] and "EqualTo(kind,error)" in pushed


def rows_scanned(df):
    """Rows that the file scans of a query gave, after row groups were skipped."""
    df.collect()
    plan, total, seen = df._jdf.queryExecution().executedPlan(), 0, [df._jdf.queryExecution().executedPlan()]
    while seen:
        node = seen.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            seen.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in name:
            seen.append(node.plan())
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        seen += [children.apply(i) for i in range(children.size())]
    return total


def test_one_wide_window_does_not_widen_the_scan_of_others(spark, scratch):
    """Forty servers with a year of hourly exceptions each; one of them wants the whole year."""
    hours = 24 * 365
    n = spark.range(40 * hours)
    data = n.select(
        F.format_string("S%02d", (F.col("id") % 40).cast("int")).alias("server"),
        F.lit("Q").alias("queue"),
        (F.lit(NOW) - F.make_dt_interval(hours=F.floor(F.col("id") / 40).cast("int"), mins=F.lit(1))).cast("timestamp").alias("sample_ts"),
        F.lit("error").alias("kind"),
    )
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")  # has statistics
    try:
        data.repartitionByRange(160, "server", "sample_ts").sortWithinPartitions("server", "sample_ts").write.parquet(f"{scratch}/s")
    finally:
        spark.conf.unset("spark.sql.parquet.outputTimestampType")
    stored = spark.read.parquet(f"{scratch}/s")
    parms = spark.createDataFrame([(f"S{i:02d}", 24 * 365 if i == 17 else 12) for i in range(40)], "server string, exception_time_window int")
    found = sd.recent_exceptions(stored, parms, AS_OF)
    counts = {r.server: r["count"] for r in found.groupBy("server").count().collect()}
    assert counts == {f"S{i:02d}": hours if i == 17 else 12 for i in range(40)}
    # The files with recent rows and those of the one scope; a common horizon would read all files.
    narrow = rows_scanned(sd.recent_exceptions(stored, parms.where("server <> 'S17'"), AS_OF))
    assert rows_scanned(found) <= narrow + 2 * hours
    assert rows_scanned(found) < 40 * hours / 2


def test_windows_of_any_spread(spark):
    """Against a plain loop: many widths, several of them far beyond the median, absent rows and NULLs."""
    import random

    r = random.Random(2)
    windows = {f"S{i}": r.choice([None, 1, 5, 20, 30, 100, 400, 2000]) for i in range(30)}
    parms = spark.createDataFrame([(s, w) for s, w in windows.items() if s != "S3"], "server string, exception_time_window int")
    data = [(r.choice(["S%d" % r.randint(0, 34), None]), "Q", r.randint(-3600, 2500 * 3600), 1, 1, "error") for _ in range(3000)]
    got = sd.recent_exceptions(samples(spark, data), parms, AS_OF)
    want = [i for i, d in enumerate(data) if 0 <= d[2] < 3600 * (windows.get(d[0] if d[0] != "S3" else None) or 24)]
    assert sorted(x.sample_id for x in got.collect()) == want
