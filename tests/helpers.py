"""Small snapshots from Python rows."""

from subdrift import Snapshot
from subdrift.schemas import INPUT_TABLES

RAW_COLUMNS = {
    "subs": "subname source_owner source_name target_owner target_name state sendq target_server".split(),
    "sendqueues": "sendq pubqmapname".split(),
    "src_cols": "subname src_colname".split(),
    "tables": "creator name data_capture".split(),
    "columns": "tbcreator tbname name".split(),
    "q_base": "tabschema tabname target_schema target_name targetcolclause".split(),
}


def raw(spark, rows, server=False):
    """DataFrames under the source column names; rows are tuples, or dicts for some columns."""
    out = {}
    for table in INPUT_TABLES:
        names = (["server"] if server else []) + RAW_COLUMNS[table]
        data = [
            tuple(r.get(n) for n in names) if isinstance(r, dict) else tuple(r) for r in rows.get(table, [])
        ]
        out[table] = spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))
    return out


def snapshot(spark, server_name="SRV", schema="ASN", **rows):
    return Snapshot.of(raw(spark, rows), server=server_name, capture_schema=schema)


def sub(name="S1", owner="OWN", table="T1", state="A", sendq="Q", target="TGT1", **more):
    return {
        "subname": name,
        "source_owner": owner,
        "source_name": table,
        "state": state,
        "sendq": sendq,
        "target_server": target,
        "target_owner": more.get("target_owner", "TO"),
        "target_name": more.get("target_name", table),
    }


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def contents(df):
    columns = sorted(df.columns)
    return sorted(repr(tuple(r)) for r in df.select(columns).collect())
