"""Replication inputs derived from the given tables.

Every order becomes a subscription, every line number one of its columns, every event a
monitor sample. The remainders below do not thin the data out: they decide where the
derived catalogue and the derived configuration disagree, so that each check has findings
and non-findings among all rows; every line is in one of the two at least.
``reference_sql`` builds the same inputs in plain SQL.

On a single server every order has a table of its own. In a fleet the same names of
owners, tables, subscriptions and queues stand on three servers and under two capture
schemas, and up to four subscriptions share a table, so a check that forgets a
scope key finds something else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subdrift import PARM_APPLY, PARM_CAPTURE, Snapshot

SINGLE_SERVER = "SRV0"
CAPTURE_SCHEMA = "ASN"
CHECK_TS = "2024-01-30 00:00:00"
AS_OF = "2024-01-30 00:00:00"
SERVERS, SCHEMAS = 3, 2


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def raw_tables(spark: SparkSession, sf_dir: str, fleet: bool = False) -> dict[str, DataFrame]:
    """The six input tables under their source column names, blank padding included.
    With ``fleet`` every table carries its server, and those of the configuration their
    capture schema."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    whole = lambda n: F.floor(key / n)
    sub, table, group, part = (whole(6), whole(12), whole(12) % 25, key % SERVERS) if fleet else (key, key, customer % 25, customer % 5)
    padding = F.when(key % 10 == 0, "   ").otherwise("")
    orders = read(spark, sf_dir, "orders").select(
        key.alias("k"),
        "o_orderstatus",
        F.concat(_text("SUB", sub), padding).alias("subname"),
        F.concat(_text("OWN", group), padding).alias("owner"),
        F.concat(_text("T", table), padding).alias("tab"),
        _text("TGT", group).alias("target"),
        F.concat(_text("SENDQ.", group), padding).alias("sendq"),
        _text("TGTDB", part).alias("target_server"),
        F.concat(_text("SRV", key % SERVERS), padding).alias("server"),
        _text("ASN", whole(3) % SCHEMAS).alias("capture_schema"),
    )
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    k, line, lk = F.col("k"), F.col("l_linenumber"), F.col("l_orderkey")
    column = F.when(line == 7, "c7").otherwise(_text("C", line))
    # In a fleet all orders of a table on a server are known or none.
    is_known = lambda n: ((F.floor(n / 12) + n % SERVERS) % 11 if fleet else n % 11) != 3
    catalogued = is_known(lk) & ((lk + line) % 19 != 0)
    config, catalogue = (["server", "capture_schema"], ["server"]) if fleet else ([], [])

    state = (
        F.when(F.col("o_orderstatus") == "F", "A")
        .when(F.col("o_orderstatus") == "O", "I")
        .when(k % 29 != 7, "N")
    )
    subs = orders.select(
        *config,
        "subname",
        F.col("owner").alias("source_owner"),
        F.col("tab").alias("source_name"),
        F.col("target").alias("target_owner"),
        F.col("tab").alias("target_name"),
        state.alias("state"),
        "sendq",
        "target_server",
    )

    known = orders.where(is_known(k))
    flag = F.when(k % 13 == 5, "N ").when(k % 17 != 4, "Y ")
    tables = known.select(
        *catalogue, F.col("owner").alias("creator"), F.col("tab").alias("name"), flag.alias("data_capture")
    )
    of_lines = orders.join(lines, k == lk)
    columns = of_lines.where(catalogued).select(
        *catalogue, F.col("owner").alias("tbcreator"), F.col("tab").alias("tbname"), F.concat(column, F.lit(" ")).alias("name")
    )
    src_cols = of_lines.where(((lk * 3 + line) % 23 != 0) | ~catalogued).select(
        *config, "subname", column.alias("src_colname")
    )

    clause = (
        F.when(k % 8 == 0, "TRGCOLS EXCLUDE (C4) TRGCOLS INCLUDE (C2,C5)")
        .when(k % 16 == 4, "TRGCOLS\tINCLUDE (C1)")
        .when(k % 4 == 1, "TRGCOLS INCLUDE (C1, C2,C3,c7)")
        .when(k % 4 == 2, "trgcols exclude (c4,C5,c7)")
        .when(k % 4 == 3, "TRGCOLS ALL")
    )
    q_base = orders.where(k % 5 != 0).select(
        *config,
        F.col("owner").alias("tabschema"),
        F.col("tab").alias("tabname"),
        F.col("target").alias("target_schema"),
        F.col("tab").alias("target_name"),
        clause.alias("targetcolclause"),
    )
    return {
        "subs": subs,
        "sendqueues": _sendqueues(spark, sf_dir, fleet),
        "src_cols": src_cols,
        "tables": tables,
        "columns": columns,
        "q_base": q_base,
    }


def _sendqueues(spark, sf_dir, fleet):
    """One queue per nation, some missing; in a fleet others on every server and schema,
    under other map names."""
    nation, n = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    sendq = _text("SENDQ.", n).alias("sendq")
    if not fleet:
        queues = nation.where(n < 23).select(sendq, F.when(n != 7, F.col("n_name")).alias("pubqmapname"))
        return queues.unionByName(queues.where(F.col("sendq") == "SENDQ.3"))
    each = nation.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(SERVERS - 1))).alias("f")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(SCHEMAS - 1))).alias("c"))
    f, c = F.col("f"), F.col("c")
    name = F.concat("n_name", f.cast("string"), c.cast("string"))
    return each.where((n + f + 2 * c) % 7 != 0).select(
        _text("SRV", f).alias("server"), _text("ASN", c).alias("capture_schema"), sendq, F.when(n != 7, name).alias("pubqmapname")
    )


def snapshot(
    spark: SparkSession, sf_dir: str, fleet: bool = False, schema: str = CAPTURE_SCHEMA
) -> Snapshot:
    scope = {} if fleet else {"server": SINGLE_SERVER, "capture_schema": schema}
    return Snapshot.of(raw_tables(spark, sf_dir, fleet), **scope)


def host_snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The same server with the capture flag under its name on the host platform."""
    raw = raw_tables(spark, sf_dir)
    raw["tables"] = raw["tables"].withColumnRenamed("data_capture", "DATACAPTURE")
    return Snapshot.of(raw, server=SINGLE_SERVER, capture_schema=CAPTURE_SCHEMA)


def samples_of(events: DataFrame, fleet: bool = False) -> DataFrame:
    """Monitor samples; works on the events table and on a stream of it alike."""
    user = F.col("user_id")
    return events.select(
        (_text("SRV", user) if fleet else F.lit(SINGLE_SERVER)).alias("server"),
        F.col("event_id").alias("sample_id"),
        _text("RECVQ.", user % 25).alias("queue"),
        F.col("ts").alias("sample_ts"),
        (F.col("value") * 100).alias("latency_s"),
        (F.col("event_id") * 37 % 130001).alias("qdepth"),
        F.col("event_type").alias("kind"),
    )


def samples(spark: SparkSession, sf_dir: str, fleet: bool = False) -> DataFrame:
    return samples_of(read(spark, sf_dir, "events"), fleet)


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer stands for one monitored server."""
    return read(spark, sf_dir, "customer").select(_text("SRV", F.col("c_custkey")).alias("server"))


def _server_parms(spark, sf_dir):
    return read(spark, sf_dir, "customer").where(F.col("c_custkey") % 13 != 4)


def fleet_parms_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for most servers, none for some, with NULLs where the default applies."""
    c = F.col("c_custkey")
    return _server_parms(spark, sf_dir).select(
        _text("SRV", c).alias("server"),
        F.when(c % 7 != 3, 300 + c % 900).alias("alat_thresh_warning"),
        F.when(c % 11 != 5, 3000 + c % 4000).alias("alat_thresh_error"),
        F.when(c % 5 != 2, 50 + c % 500).alias("alat_cause_cap_qdepth"),
        F.when(c % 9 != 1, 40000 + c % 50000).alias("alat_cause_app_qdepth"),
        F.when(c % 6 != 4, 12 + c % 96).alias("exception_time_window"),
        F.when(c % 8 != 6, 5 + c % 720).alias("heartbeat_time_window"),
        F.when(c % 3 != 0, F.lit(PARM_APPLY.shipped["maxdepth_global"])).alias("maxdepth_global"),
    )


def fleet_parms_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return _server_parms(spark, sf_dir).select(
        _text("SRV", c).alias("server"),
        F.when(c % 7 != 3, 200 + c % 900).alias("clat_thresh_warning"),
        F.when(c % 11 != 5, 3500 + c % 4000).alias("clat_thresh_error"),
        F.when(c % 3 != 0, F.lit(PARM_CAPTURE.shipped["maxdepth_global"])).alias("maxdepth_global"),
    )


def with_second_rows(parms: DataFrame) -> DataFrame:
    """Breaks the one-row rule for some servers."""
    number = F.substring("server", 4, 20).cast("long")
    return parms.unionByName(parms.where(number % 17 == 5))
