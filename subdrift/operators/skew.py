"""Spreading hot join keys.

A table, a queue or a server may own a third of all subscriptions. Hash
partitioning sends all rows of one key to one task, so the rows of such a key get
a salt on the side that has many of them, and the few partner rows are copied
once per salt on the other side. Keys that are not hot have the single salt 0:
nothing is copied for them, and results never depend on which keys are hot.

``hot_keys`` counts exactly (no sample), so both sides of a join agree on the
salts even when the plan evaluates the count twice or a lost executor makes
Spark repeat it. Sizes follow the data: a key is hot if it has more rows than half an
average shuffle partition, and gets as many salts as it has such halves. There are at
most two hot keys per partition then, which is what allows broadcasting them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"
# Of an average partition: what a salt holds, and the least that a caller may ask for.
_WANTED, _LEAST = 2, 8
_SALTS = "_salts"
_HOT = "_hot_"


def hot_keys(df: DataFrame, keys: list[str], rows_per_salt: int | None = None) -> DataFrame:
    """Keys with more than ``rows_per_salt`` rows and the number of salts each needs.

    By default that is half an average shuffle partition. A smaller number than an eighth is
    raised to it, so there are eight hot keys per partition at most.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    share = _WANTED if rows_per_salt is None else _LEAST
    fair = F.ceil(F.coalesce(df.select(F.count(F.lit(1))).scalar(), F.lit(0)) / F.lit(share * partitions))
    wanted = fair if rows_per_salt is None else F.greatest(fair, F.lit(rows_per_salt))
    salts = F.ceil(F.col("_rows") / wanted).cast("int")
    return counted.where(F.col("_rows") > wanted).select(*[F.col(k).alias(_HOT + k) for k in keys], salts.alias(_SALTS))


def add_salt(df: DataFrame, hot: DataFrame, salt: str = SALT) -> DataFrame:
    """Give every row of a hot key one of its salts, by content; other rows get 0.

    ``df`` must hold no repeated rows: copies would share a salt.
    """
    chosen = F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(_SALTS), F.lit(1)))
    return _with_salts(df, hot).select(*df.columns, chosen.cast("int").alias(salt))


def copy_per_salt(df: DataFrame, hot: DataFrame, salt: str = SALT) -> DataFrame:
    """The partner side: one copy of a row per salt of its key."""
    salts = F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)
    return _with_salts(df, hot).select(*df.columns, F.explode(salts).alias(salt))


def _with_salts(df: DataFrame, hot: DataFrame) -> DataFrame:
    keys = [c for c in hot.columns if c.startswith(_HOT)]
    same: Column = reduce(
        lambda a, b: a & b, [F.col(k.removeprefix(_HOT)).eqNullSafe(F.col(k)) for k in keys]
    )
    return df.join(F.broadcast(hot), same, "left")
