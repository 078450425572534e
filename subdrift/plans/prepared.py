"""Snapshots stored so that the checks need no shuffle of them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation

from subdrift.operators.checks import TABLE_KEYS, Options, Subscriptions, all_drift, catalogue, subscribed
from subdrift.operators.skew import SALT
from subdrift.sources import Snapshot

_KEYS = [*TABLE_KEYS, SALT]


@dataclass(frozen=True)
class Prepared:
    """A snapshot in the form the checks compare: subscriptions with their listings, queues and
    clauses, and tables with their columns, in equal buckets by table and salt. The salts of hot tables are counted
    once, when it is stored."""

    snapshot: Snapshot
    subscribed: DataFrame
    catalogue: DataFrame
    hot: DataFrame

    def drift(self, options: Options, wanted: tuple[str, ...], observation: Observation | None = None) -> DataFrame:
        met = self.subscribed.join(self.catalogue, _KEYS, "left")
        return all_drift(self.snapshot, options, wanted, Subscriptions(self.snapshot, options, self.hot), met, observation)


def prepare(snapshot: Snapshot, path: str, buckets: int | None = None, rows_per_salt: int | None = None) -> Prepared:
    """Writes ``snapshot`` under ``path``, a folder all executors share, for any number of findings
    and reports: every input is cleaned, counted, combined and shuffled once.

    ``buckets`` (by default as many as shuffle partitions) should be as many as partitions of a
    shuffle of the columns would be; each is one sorted file, so the comparison reads both
    sides bucket by bucket, without an exchange, and sorts what is in order. A hot table is spread
    over its salts, and so over buckets. The tables of the session's catalogue that name the
    files are called ``subdrift_*``.
    """
    spark = snapshot.subs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    subs = Subscriptions(snapshot, Options(rows_per_salt=rows_per_salt))
    subs.hot.write.parquet(f"{path}/hot")
    hot = spark.read.parquet(f"{path}/hot")
    subs = Subscriptions(snapshot, Options(), hot)
    small = {name: snapshot._tables()[name] for name in ("sendqueues", "q_base") if name in snapshot._tables()}
    for name, df in small.items():
        df.write.parquet(f"{path}/{name}")
    stored = {name: spark.read.parquet(f"{path}/{name}") for name in small}
    asked = subscribed(snapshot, subs, Options(rows_per_salt=rows_per_salt), True, snapshot.q_base is not None)
    stored_subs = _bucketed(asked, f"{path}/subscribed", n)
    tables = _bucketed(catalogue(snapshot, subs), f"{path}/catalogue", n)
    rest = {name: getattr(snapshot, name) for name in ("src_cols", "tables", "columns")}
    # What is counted of subscriptions later on (queues) is counted from the stored ones.
    return Prepared(Snapshot(subs=stored_subs.select(snapshot.subs.columns), **rest, **stored), stored_subs, tables, hot)


def _bucketed(df: DataFrame, path: str, n: int) -> DataFrame:
    name = f"subdrift_{uuid.uuid4().hex}"
    # Dealt like the buckets, so each is written by one task, as one file.
    df.repartition(n, *_KEYS).write.option("path", path).bucketBy(n, *_KEYS).sortBy(*_KEYS).saveAsTable(name, format="parquet")
    return df.sparkSession.table(name)
