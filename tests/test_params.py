import pytest
from pyspark.sql import Observation

import subdrift as sd
from tests.helpers import raw, rows

APPLY = {"alat_thresh_warning": 600, "alat_thresh_error": 3600, "alat_cause_cap_qdepth": 100,
         "alat_cause_app_qdepth": 60000, "exception_time_window": 24, "heartbeat_time_window": 10,
         "maxdepth_global": 130000}
APPLY_DEFAULTS = {"alat_thresh_warning": 30, "alat_thresh_error": 600, "alat_cause_cap_qdepth": 100,
                  "alat_cause_app_qdepth": 60000, "exception_time_window": 24, "heartbeat_time_window": 10,
                  "maxdepth_global": 100000}
CAPTURE = {"clat_thresh_warning": 500, "clat_thresh_error": 5400, "maxdepth_global": 130000}
CAPTURE_DEFAULTS = {"clat_thresh_warning": 300, "clat_thresh_error": 3600, "maxdepth_global": 100000}


@pytest.mark.parametrize("table,row", [(sd.PARM_APPLY, APPLY), (sd.PARM_CAPTURE, CAPTURE)])
def test_shipped_row(spark, table, row):
    shipped = sd.shipped_row(spark, table, "SRV")
    assert shipped.first().asDict() == {"server": "SRV", **row}
    assert all(not f.nullable and f.dataType.simpleString() == "int" and f.metadata["comment"]
               for f in shipped.schema.fields[1:])


@pytest.mark.parametrize("table,defaults", [(sd.PARM_APPLY, APPLY_DEFAULTS), (sd.PARM_CAPTURE, CAPTURE_DEFAULTS)])
def test_defaults(spark, table, defaults):
    parms = spark.createDataFrame([("A",)], "server string")
    scopes = spark.createDataFrame([("A",), ("B",)], "server string")
    effective = sd.effective_parms(parms, table, scopes)
    assert {r.server: r.asDict() for r in effective.collect()} == {
        s: {"server": s, **defaults} for s in "AB"
    }


def test_values_in_any_case_and_type(spark):
    parms = spark.createDataFrame([("A", "7", None)], "server string, CLAT_THRESH_WARNING string, clat_thresh_error int")
    assert sd.effective_parms(parms, sd.PARM_CAPTURE).first().asDict() == {
        "server": "A", "clat_thresh_warning": 7, "clat_thresh_error": 3600, "maxdepth_global": 100000
    }


def test_row_violations(spark):
    parms = spark.createDataFrame([("ONE",), ("TWO",), ("TWO",), ("UNKNOWN",)], "server string")
    scopes = spark.createDataFrame([("ONE",), ("TWO",), ("NONE",), ("NONE",)], "server string")
    found = sd.row_violations(parms, sd.PARM_CAPTURE, scopes)
    assert rows(found, "server", "row_count", "message") == [
        ("NONE", 0, "No row in table QREP_MON_CAPTURE_PARM"),
        ("TWO", 2, "No more than one row allowed in table QREP_MON_CAPTURE_PARM"),
    ]


@pytest.mark.parametrize("table", [sd.PARM_APPLY, sd.PARM_CAPTURE])
def test_comments_in_both_languages(table):
    for lang in ("EN", "DE"):
        assert [f.name for f in table.schema_in(lang) if f.metadata["comment"]] == list(table.defaults)


def test_second_rows_are_skipped_and_counted(spark):
    """The counts are those of ``row_violations``; the scopes are graded as if they had no row."""
    parms = spark.createDataFrame(
        [("A", 5), ("B", 5), ("B", 7), ("C", 5), ("C", 5), ("C", 9)], "server string, clat_thresh_warning int"
    )
    samples = spark.createDataFrame([(s, 100.0 * k) for s in "ABCD" for k in (0, 1, 4)], "server string, latency_s double")
    seen = Observation("parameters")
    graded = sd.capture_latency(samples, parms, on_second_row="skip", observation=seen)
    assert rows(graded, "server", "latency_s", "sev") == sorted(
        (s, 100.0 * k, "WARNING" if k == 4 or (k == 1 and s == "A") else "OK") for s in "ABCD" for k in (0, 1, 4)
    )
    violations = sd.row_violations(parms, sd.PARM_CAPTURE, parms)
    assert seen.get == {"scopes_with_second_rows": violations.count(), "scopes_with_one_row": 1}
    for bad in ({"on_second_row": "other"}, {"observation": Observation("none")}):
        with pytest.raises(ValueError):
            sd.capture_latency(samples, parms, **bad)


@pytest.mark.parametrize("mode", ["plain", "generator"])
def test_subscriptions_left_out_for_want_of_a_queue_are_counted(spark, scratch, mode):
    from tests.test_brute_force import SCHEMA, random_rows

    shot = sd.Snapshot.of(raw(spark, random_rows(31), server=True), capture_schema=SCHEMA)
    gone = shot.subs.join(shot.tables, ["server", "source_owner", "source_name"], "left_anti")
    without = gone.join(shot.sendqueues, ["server", "capture_schema", "sendq"], "left_anti").count()
    options = sd.Options(mode=mode)
    for number, one in enumerate((shot, sd.prepare(shot, scratch, buckets=3))):
        seen = Observation(f"queues {number}")
        found = sd.findings(one, options, observation=seen)
        found.write.format("noop").mode("overwrite").save()
        assert seen.get["vanished_without_queue"] == without > 0
        assert seen.get["vanished_with_queue"] >= found.where("mtyp = 'C-TNF'").count()
    with pytest.raises(ValueError):
        sd.findings(shot, options, ("C-CNS",), Observation("none"))
