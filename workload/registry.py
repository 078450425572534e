"""The registered queries: every operator over the inputs derived from the given tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import subdrift as sd
from subdrift import Options, Snapshot
from subdrift.streaming import grade_new_files, samples_from_files
from workload import inputs

Query = Callable[[SparkSession, str], DataFrame]

GENERATOR = Options(mode="generator")


def _check(check, options: Options = Options(), snapshot=inputs.snapshot) -> Query:
    return lambda spark, sf: check(snapshot(spark, sf), options).distinct()


def _findings(options: Options = Options(), fleet: bool = False) -> Query:
    return lambda spark, sf: sd.findings(inputs.snapshot(spark, sf, fleet), options)


def _report(
    options: Options = Options(), fleet: bool = False, schema: str = inputs.CAPTURE_SCHEMA, **shape
) -> Query:
    def run(spark, sf):
        snapshot: Snapshot = inputs.snapshot(spark, sf, fleet, schema)
        return sd.report(sd.findings(snapshot, options), inputs.CHECK_TS, **shape)

    return run


def _graded(grade, fleet: bool, table=sd.PARM_APPLY, as_of: bool = False, shuffled: bool = False) -> Query:
    """With ``shuffled`` nothing is broadcast, and scopes with over a hundred samples are salted."""

    def run(spark, sf):
        more = [inputs.AS_OF] if as_of else []
        samples, parms = inputs.samples(spark, sf, fleet), _parms(spark, sf, table, fleet)
        if not shuffled:
            return grade(samples, parms, *more)
        return grade(samples, parms, *more, hot=sd.hot_scopes(samples, 100), strategy="merge")

    return run


def _parms(spark, sf, table, fleet):
    if not fleet:
        return sd.shipped_row(spark, table, inputs.SINGLE_SERVER)
    derive = inputs.fleet_parms_apply if table is sd.PARM_APPLY else inputs.fleet_parms_capture
    return derive(spark, sf)


def _silent(fleet: bool) -> Query:
    def run(spark, sf):
        samples = inputs.samples(spark, sf, fleet)
        return sd.silent_queues(None, samples, _parms(spark, sf, sd.PARM_APPLY, fleet), inputs.AS_OF)

    return run


def _effective(derive, table) -> Query:
    return lambda spark, sf: sd.effective_parms(derive(spark, sf), table, inputs.scopes(spark, sf))


def _violations(derive, table) -> Query:
    return lambda spark, sf: sd.row_violations(
        inputs.with_second_rows(derive(spark, sf)), table, inputs.scopes(spark, sf)
    )


def _shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names for checkpoints; a local one only
    where all executors are on this machine anyway."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        shared = tempfile.mkdtemp(prefix="run-")
    return f"{shared}/subdrift-{uuid.uuid4().hex}"


def _stored(options: Options = Options()) -> Query:
    """The fleet snapshot cleaned once into the shared folder, then checked from there."""
    return lambda spark, sf: sd.findings(
        inputs.snapshot(spark, sf, fleet=True).stored(_shared_folder(spark)), options
    )


def _prepared(options: Options = Options()) -> Query:
    """The fleet snapshot stored in the form the checks compare, then checked."""
    return lambda spark, sf: sd.findings(sd.prepare(inputs.snapshot(spark, sf, fleet=True), _shared_folder(spark)), options)


def _reports_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Two reports from one prepared snapshot."""
    prepared = sd.prepare(inputs.snapshot(spark, sf, fleet=True), _shared_folder(spark))
    return _in_two_languages(prepared)


def _in_two_languages(snapshot) -> DataFrame:
    reports = [
        sd.report(sd.findings(snapshot, Options(lang=lang)), inputs.CHECK_TS, ordered=False).select(F.lit(lang).alias("lang"), "*")
        for lang in ("EN", "DE")
    ]
    return reports[0].unionByName(reports[1])


def _reports_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Two reports from one snapshot that was cleaned and stored once."""
    return _in_two_languages(inputs.snapshot(spark, sf, fleet=True).stored(_shared_folder(spark)))


def _view_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The report as a view, asked for the later checks of one owner."""
    sd.create_report_view("subscription_report", sd.findings(inputs.snapshot(spark, sf, fleet=True)), inputs.CHECK_TS)
    return spark.sql("SELECT * FROM subscription_report WHERE ordercol > 120 AND source_owner = 'OWN3'")


def _by_function(spark: SparkSession, sf: str) -> DataFrame:
    """Two checks of one server each, asked in SQL, and the report of a third."""
    sd.register_functions(inputs.snapshot(spark, sf, fleet=True), GENERATOR, inputs.CHECK_TS)
    columns = "current_server, mtyp, sev, subname, mtxt, fixit"
    return spark.sql(
        f"SELECT {columns} FROM c_cns('SRV1') WHERE source_owner = 'OWN3' UNION ALL SELECT {columns} FROM c_dcc('SRV2') "
        "UNION ALL SELECT current_server, mtyp, sev, NULL, mtxt, fixit FROM drift_report('SRV0')"
    )


def _streamed(grade, table, shuffled: bool = False) -> Query:
    """The events table read as a stream, graded, and written to the shared folder."""

    def run(spark, sf):
        base = _shared_folder(spark)
        events = samples_from_files(
            spark, sf, inputs.read(spark, sf, "events").schema, pathGlobFilter="events.parquet"
        )
        parms, more = _parms(spark, sf, table, fleet=True), {}
        if shuffled:
            # The scopes that were hot in earlier samples, as a stream cannot be counted.
            more = {"hot": sd.hot_scopes(inputs.samples(spark, sf, fleet=True), 100), "strategy": "merge"}
        grade_new_files(
            inputs.samples_of(events, fleet=True),
            lambda samples: grade(samples, parms, **more),
            f"{base}/graded",
            f"{base}/checkpoint",
        )
        return spark.read.parquet(f"{base}/graded")

    return run


def queries() -> dict[str, Query]:
    return {
        "c_tnf": _check(sd.source_table_not_found),
        "c_cnf": _check(sd.subscribed_column_missing),
        "c_cns": _check(sd.column_not_subscribed),
        "c_cns_generator": _check(sd.column_not_subscribed, GENERATOR),
        "c_dcc": _check(sd.data_capture_missing),
        "c_dcc_host": _check(sd.data_capture_missing, snapshot=inputs.host_snapshot),
        "findings": _findings(),
        "findings_generator": _findings(GENERATOR),
        "findings_fleet": _findings(fleet=True),
        "findings_fleet_generator": _findings(GENERATOR, fleet=True),
        "findings_fleet_stored": _stored(GENERATOR),
        # Every table and queue with over fifty subscriptions is salted here.
        "findings_salted": _findings(Options(rows_per_salt=50), fleet=True),
        "findings_generator_salted": _findings(Options(mode="generator", rows_per_salt=50), fleet=True),
        "report": _report(),
        "report_de": _report(Options(lang="DE")),
        "report_de_generator": _report(Options(lang="DE", mode="generator")),
        "report_long_schema": _report(schema="CAPTURESCHEM"),
        "report_view": _report(view=True),
        "report_debug": _report(debug=True),
        "report_debug_generator": _report(Options(mode="generator", flag_prefix=True), debug=True),
        "report_fleet": _report(fleet=True),
        "report_delimiter": _report(Options(addcol_delimiter="#")),
        "report_view_filtered": _view_filtered,
        "checks_by_function": _by_function,
        "reports_stored": _reports_stored,
        "findings_fleet_prepared": _prepared(GENERATOR),
        "reports_prepared": _reports_prepared,
        "parm_apply_effective": _effective(inputs.fleet_parms_apply, sd.PARM_APPLY),
        "parm_capture_effective": _effective(inputs.fleet_parms_capture, sd.PARM_CAPTURE),
        "parm_row_violations": _violations(inputs.fleet_parms_apply, sd.PARM_APPLY),
        "parm_capture_row_violations": _violations(inputs.fleet_parms_capture, sd.PARM_CAPTURE),
        "a_lat": _graded(sd.end_to_end_latency, False),
        "a_lat_cause": _graded(sd.end_to_end_latency_cause, False),
        "a_exc": _graded(sd.recent_exceptions, False, as_of=True),
        "a_chb": _graded(sd.recent_heartbeats, False, as_of=True),
        "a_chb_silent": _silent(False),
        "c_lat": _graded(sd.capture_latency, False, sd.PARM_CAPTURE),
        "a_lat_fleet": _graded(sd.end_to_end_latency, True),
        "a_lat_cause_fleet": _graded(sd.end_to_end_latency_cause, True),
        "a_exc_fleet": _graded(sd.recent_exceptions, True, as_of=True),
        "a_chb_fleet": _graded(sd.recent_heartbeats, True, as_of=True),
        "a_chb_silent_fleet": _silent(True),
        "c_lat_fleet": _graded(sd.capture_latency, True, sd.PARM_CAPTURE),
        "a_lat_cause_stream": _streamed(sd.end_to_end_latency_cause, sd.PARM_APPLY),
        "c_lat_stream": _streamed(sd.capture_latency, sd.PARM_CAPTURE),
        "a_lat_cause_fleet_shuffled": _graded(sd.end_to_end_latency_cause, True, shuffled=True),
        "a_exc_fleet_shuffled": _graded(sd.recent_exceptions, True, as_of=True, shuffled=True),
        "c_lat_stream_shuffled": _streamed(sd.capture_latency, sd.PARM_CAPTURE, shuffled=True),
    }
