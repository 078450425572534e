import datetime as dt

import pytest
from pyspark.sql import functions as F

from subdrift import Options, Snapshot, create_report_view, findings, register_functions, report
from tests.helpers import contents, raw
from tests.test_brute_force import SCHEMA, random_rows

CHECK_TS = "2024-01-30 00:00:00"
DEFAULT = ["check_ts", "program", "current_server", "mtyp", "sev", "mtxt", "fixit"]


@pytest.fixture(scope="module")
def found(spark):
    return findings(Snapshot.of(raw(spark, random_rows(21), server=True), capture_schema=SCHEMA)).persist()


def test_default_shape_and_order(found):
    shown = report(found, CHECK_TS)
    assert shown.columns == DEFAULT
    assert dict(shown.dtypes)["check_ts"] == "timestamp_ntz"
    result = shown.collect()
    order = {"C-TNF": 110, "C-CNF": 120, "C-CNS": 130, "C-DCC": 140}
    keys = [(order[r.mtyp], r.mtxt is None, r.mtxt or "") for r in result]
    assert keys == sorted(keys)
    assert any(r.mtxt is None for r in result)
    assert {r.check_ts for r in result} == {dt.datetime(2024, 1, 30)}


def test_rows_that_differ_only_in_hidden_columns_all_stay(found):
    assert report(found, CHECK_TS).count() == found.count()


def test_other_shapes(found):
    assert report(found, CHECK_TS, fixit=False).columns == DEFAULT[:-1]
    assert report(found, CHECK_TS, view=True).columns == ["ordercol", *DEFAULT, "target_dbname", "source_owner"]
    assert report(found, CHECK_TS, debug=True).columns == [*DEFAULT, "state", "subname", "source_name", "colname"]


def test_only_ordered_reports_sort(found):
    def sorts(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return any("Sort [" in line and "], true" in line for line in plan.splitlines())

    assert sorts(report(found, CHECK_TS))
    assert not sorts(report(found, CHECK_TS, view=True))
    assert not sorts(report(found, CHECK_TS, ordered=False))


def test_time_of_the_check(found):
    times = {r.check_ts for r in report(found).collect()}
    assert len(times) == 1
    assert abs(times.pop() - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) < dt.timedelta(hours=24)


def test_view_and_filters_on_it(spark, found):
    create_report_view("drift", found, CHECK_TS)
    got = spark.sql("SELECT * FROM drift WHERE mtyp = 'C-DCC' AND sev = 'ERROR'")
    assert contents(got) == contents(report(found, CHECK_TS, view=True).where(F.col("ordercol") == 140))


def test_a_filter_on_one_check_drops_the_other_pass(spark):
    shot = Snapshot.of(raw(spark, random_rows(22), server=True), capture_schema=SCHEMA)
    only = findings(shot).where(F.col("mtyp") == "C-CNS")
    assert contents(only) == contents(findings(shot, checks=("C-CNS",)))


def test_choice_of_checks(spark):
    shot = Snapshot.of(raw(spark, random_rows(23), server=True), capture_schema=SCHEMA)
    options = Options(lang="DE", mode="generator")
    whole = findings(shot, options)
    for checks in (("C-TNF", "C-CNS"), ("C-DCC",), ("C-CNF", "C-CNS")):
        assert contents(findings(shot, options, checks)) == contents(whole.where(F.col("mtyp").isin(*checks)))


def test_generator_findings_are_among_the_plain_ones(spark):
    shot = Snapshot.of(raw(spark, random_rows(24), server=True), capture_schema=SCHEMA)
    keys = ("current_server", "subname", "source_owner", "source_name", "colname", "state", "target_server")
    plain, generated = [
        {tuple(r) for r in findings(shot, Options(mode=m), ("C-CNS",)).select(*keys).collect()}
        for m in ("plain", "generator")
    ]
    assert generated < plain


def test_no_table_is_both_gone_and_lacking_a_column(found):
    gone, lacking = [
        {tuple(r) for r in found.where(F.col("mtyp") == m).select("current_server", "source_owner", "source_name").collect()}
        for m in ("C-TNF", "C-CNF")
    ]
    assert gone and lacking and not gone & lacking


def test_a_new_column_adds_one_finding_per_subscription(spark):
    data = random_rows(25)
    owner, table = "NEW", "WIDE"
    data["subs"] += [("SRV0", f"N{i}", owner, table, "TO", table, "A", "Q1", "G1") for i in range(5)]
    before = findings(Snapshot.of(raw(spark, data, server=True), capture_schema=SCHEMA), checks=("C-CNS",)).count()
    data["columns"].append(("SRV0", owner, table, "ADDED"))
    after = findings(Snapshot.of(raw(spark, data, server=True), capture_schema=SCHEMA), checks=("C-CNS",)).count()
    assert after == before + 5


def test_checks_as_table_functions(spark, scratch):
    """Each function gives the findings of its check, of one server or all, and a server reaches the scans."""
    shot = Snapshot.of(raw(spark, random_rows(26), server=True), capture_schema=SCHEMA).stored(scratch)
    options = Options(lang="DE", mode="generator")
    assert register_functions(shot, options, CHECK_TS) == ["c_tnf", "c_cnf", "c_cns", "c_dcc", "drift_report"]
    whole = findings(shot, options).persist()
    for name in ("c_tnf", "c_cnf", "c_cns", "c_dcc"):
        check = whole.where(F.col("mtyp") == name.upper().replace("_", "-"))
        assert contents(spark.sql(f"SELECT * FROM {name}()")) == contents(check)
        server = check.first().current_server
        one = spark.sql(f"SELECT * FROM {name}('{server}') WHERE subname IS NOT NULL")
        assert contents(one) == contents(check.where((F.col("current_server") == server) & F.col("subname").isNotNull()))
        assert f"EqualTo(server,{server})" in one._jdf.queryExecution().executedPlan().toString()
    view = report(whole, CHECK_TS, view=True)
    assert contents(spark.sql("SELECT * FROM drift_report(NULL)")) == contents(view)
    lateral = spark.sql("SELECT s.x, r.mtyp FROM VALUES ('SRV3'), ('SRV4') AS s(x), LATERAL drift_report(s.x) AS r")
    assert lateral.count() == view.where("current_server IN ('SRV3', 'SRV4')").count()
