"""Hot keys are spread, and results do not depend on it."""

import re

import pytest
from pyspark.sql import functions as F

from subdrift import Options, Snapshot, findings
from subdrift.operators.checks import Subscriptions, catalogue, column_drift, listing, table_drift
from subdrift.operators.skew import SALT, add_salt, copy_per_salt, hot_keys
from tests.helpers import contents

SUBS = 9000


def text(prefix, number):
    return F.concat(F.lit(prefix), number.cast("string"))


def hot_snapshot(spark):
    """A third of the subscriptions share one table and one queue, one table has a third of
    the catalogue columns, one subscription a third of the listed ones, and rows repeat."""
    n = spark.range(SUBS)
    i = F.col("id")
    hot = i % 3 == 0
    owner = F.lit("OWN")
    table = F.when(hot, "THOT").otherwise(text("T", i))
    subs = n.select(
        text("S", i).alias("subname"),
        owner.alias("source_owner"),
        table.alias("source_name"),
        F.lit("TO").alias("target_owner"),
        table.alias("target_name"),
        F.lit("A").alias("state"),
        F.when(hot, "QHOT").otherwise(text("Q", i % 50)).alias("sendq"),
        F.lit("TGT").alias("target_server"),
    )
    tables = n.where(~hot & (i % 7 != 1)).select(
        owner.alias("creator"),
        text("T", i).alias("name"),
        F.when(i % 5 == 1, "N").otherwise("Y").alias("data_capture"),
    )

    def columns_of(rows, name, column):
        return rows.select(owner.alias("tbcreator"), name.alias("tbname"), column.alias("name"))

    two = F.explode(F.array(F.lit("C1"), F.lit("C2")))
    three = F.explode(F.array(F.lit("C1"), F.lit("C2"), F.lit("C3")))
    columns = (
        columns_of(n.where(~hot), text("T", i), two)
        .unionByName(columns_of(n, F.lit("T1"), text("C", i)))
        .unionByName(columns_of(spark.range(1), F.lit("THOT"), three))
    )

    def listed(rows, name, column):
        return rows.select(name.alias("subname"), column.alias("src_colname"))

    src_cols = (
        listed(n, text("S", i), F.explode(F.array(F.lit("C1"), F.lit("C2"), F.lit("C4"))))
        .unionByName(listed(n.where(i % 2 == 0), F.lit("S1"), text("C", i)))
        .unionByName(listed(n, F.lit("S2"), F.lit("C1")))
    )
    queues = spark.range(41).select(
        F.when(i == 40, "QHOT").otherwise(text("Q", i)).alias("sendq"), text("MAP", i).alias("pubqmapname")
    )
    q_base = subs.where(F.col("subname").endswith("2")).select(
        F.col("source_owner").alias("tabschema"),
        F.col("source_name").alias("tabname"),
        F.col("target_owner").alias("target_schema"),
        "target_name",
        F.lit("TRGCOLS INCLUDE (C3)").alias("targetcolclause"),
    )
    return Snapshot.of(
        {
            "subs": subs.unionByName(subs.where(F.col("subname").endswith("000"))),
            "sendqueues": queues,
            "src_cols": src_cols,
            "tables": tables,
            "columns": columns,
            "q_base": q_base,
        },
        server="SRV",
        capture_schema="ASN",
    )


@pytest.fixture
def no_broadcast(spark):
    """What the joins look like when no side is small, with a low bar for skew."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_only_heavy_keys_are_hot(spark):
    df = spark.range(1000).select((F.when(F.col("id") < 300, 0).otherwise(F.col("id"))).alias("k"), "id")
    assert [tuple(r) for r in hot_keys(df, ["k"], 100).collect()] == [(0, 3)]
    assert hot_keys(df, ["k"], 300).count() == 0


def test_hot_keys_follow_the_size_of_the_data(spark):
    """Half an average partition is hot: with 8 partitions, a sixteenth of all rows."""
    df = spark.range(1600).select(F.when(F.col("id") < 500, 0).when(F.col("id") < 590, 1).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in hot_keys(df, ["k"]).collect()] == [(0, 5)]
    assert hot_keys(df, ["k"], 1).count() == 2  # raised to an eighth of a partition
    assert hot_keys(df.limit(0), ["k"]).count() == 0


def test_more_than_a_thousand_hot_keys_are_all_split(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        df = spark.range(60000).select((F.col("id") % 1500).alias("k"), "id")
        hot = hot_keys(df, ["k"], 10)
        assert hot.where("_salts = 4").count() == 1500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_salts_cover_all_partners(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 1, "x").alias("k"), "id")
    hot = hot_keys(df, ["k"], 100)
    salted = add_salt(df, hot)
    copies = copy_per_salt(spark.createDataFrame([("x",), (None,), ("y",)], "k string"), hot)
    per_salt = salted.groupBy("k", SALT).count().collect()
    assert {(r.k, r[SALT]) for r in per_salt} == {(k, s) for k in (None, "x") for s in range(10)}
    assert max(r["count"] for r in per_salt) < 200
    assert sorted((r.k or "", r[SALT]) for r in copies.collect()) == sorted(
        [("y", 0)] + [(k, s) for k in ("", "x") for s in range(10)]
    )


@pytest.mark.parametrize("mode", ["plain", "generator"])
def test_salting_keeps_the_findings(spark, no_broadcast, mode):
    shot = hot_snapshot(spark)
    plain = findings(shot, Options(mode=mode))
    salted = findings(shot, Options(mode=mode, rows_per_salt=200))
    assert contents(plain) == contents(salted)
    counts = {r.mtyp: r["count"] for r in plain.groupBy("mtyp").count().collect()}
    assert counts["C-TNF"] > SUBS / 3


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_gets_a_hot_table(spark, no_broadcast):
    """Rows per shuffle key of the salted side stay near the wanted number."""
    subs = Subscriptions(hot_snapshot(spark), Options(rows_per_salt=200))
    heaviest = subs.rows.groupBy("source_owner", "source_name", SALT).count().agg(F.max("count")).first()[0]
    assert heaviest < 400


def test_wide_tables_are_split_by_the_adaptive_skew_join(spark, no_broadcast):
    rows = Options(rows_per_salt=200, packed=False)
    assert "skew=true" in final_plan(column_drift(hot_snapshot(spark), rows))
    assert contents(column_drift(hot_snapshot(spark), rows)) == contents(column_drift(hot_snapshot(spark), Options()))


def test_salted_table_pass_leaves_no_skew(spark, no_broadcast):
    """Neither the hot table and queue nor the rows that need no queue meet in one task."""
    assert "skew=true" not in final_plan(table_drift(hot_snapshot(spark), Options(rows_per_salt=200)))


def test_no_nested_loops_and_nothing_broadcast_but_hot_keys(spark, no_broadcast):
    shot = hot_snapshot(spark)
    plans = [plan(shot, Options(mode="generator", packed=packed)) for plan in (table_drift, column_drift) for packed in (True, False)]
    for df in [*plans, findings(shot, Options(mode="generator"))]:
        text = final_plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text
        for line in text.splitlines():
            if "BroadcastHashJoin" in line:
                assert "_hot_" in line


def exchanges(df):
    """The attributes each exchange of the final plan carries, by the details behind the tree."""
    df.collect()
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.findall(r"\(\d+\) (?:Shuffle)?(?:Exchange|ShuffleQueryStage)\b.*?\nInput \[\d+\]: \[(.*?)\]\n", text, re.S)
    return [{re.sub(r"#.*", "", name.strip()) for name in node.split(",")} for node in nodes]


@pytest.mark.parametrize("mode", ["plain", "generator"])
def test_no_exchange_carries_a_text(spark, mode):
    """Texts are made behind the last exchange, those of the distinct included; columns of the
    catalogue and the configuration cross as sets but for their own grouping."""
    carried = exchanges(findings(hot_snapshot(spark), Options(mode=mode)))
    assert len(carried) > 4
    for names in carried:
        assert not names & {"mtxt", "fixit", "program", "tbcreator"}


def test_one_row_per_table_and_subscription_after_the_grouping(spark):
    shot, options = hot_snapshot(spark), Options()
    subs = Subscriptions(shot, options)
    assert listing(shot, subs).count() == subs.rows.count()
    tables = catalogue(shot, subs)
    assert tables.count() == tables.select("server", "source_owner", "source_name", SALT).distinct().count()
