"""Threshold tables of the monitor: defaults, and one row per scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subdrift.functions import texts
from subdrift.schemas import SERVER, ParmTable


def shipped_row(spark: SparkSession, table: ParmTable, server: str) -> DataFrame:
    """The row delivered with the table, for one server."""
    schema = T.StructType([T.StructField(SERVER, T.StringType(), False), *table.schema.fields])
    return spark.createDataFrame([(server, *table.shipped.values())], schema)


def effective_parms(
    parms: DataFrame, table: ParmTable, scopes: DataFrame | None = None, keys: tuple[str, ...] = (SERVER,)
) -> DataFrame:
    """Parameters as integers with the column default for NULL or absent columns.

    With ``scopes`` (distinct key rows) the result has every scope, and one without a
    row gets the defaults.
    """
    if scopes is not None:
        parms = scopes.join(parms, list(keys), "left")
    present = {c.lower() for c in parms.columns}
    values = []
    for f in table.schema:
        default = F.lit(f.metadata["default"])
        value = F.coalesce(F.col(f.name).cast(f.dataType), default) if f.name in present else default
        values.append(value.alias(f.name, metadata=f.metadata))
    return parms.select(*keys, *values)


def row_violations(
    parms: DataFrame, table: ParmTable, scopes: DataFrame, keys: tuple[str, ...] = (SERVER,)
) -> DataFrame:
    """Scopes that do not have exactly one parameter row."""
    counted = parms.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = F.coalesce(F.col("_n"), F.lit(0))
    second = F.lit(texts.SECOND_PARM_ROW.format(table=table.name))
    absent = F.lit(texts.NO_PARM_ROW.format(table=table.name))
    return (
        scopes.select(*keys)
        .distinct()
        .join(counted, list(keys), "left")
        .select(*keys, rows.alias("row_count"))
        .where(F.col("row_count") != 1)
        .withColumn("message", F.when(F.col("row_count") > 1, second).otherwise(absent))
    )


def no_second_rows(parms: DataFrame, table: ParmTable, keys: tuple[str, ...] = (SERVER,)) -> Column:
    """A condition that holds, or fails the job if a scope has a second row, as the source
    refuses that row; the message names such a scope. Use ``row_violations`` to list them all."""
    counted = parms.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    scope = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in keys])
    refused = counted.select(F.min(scope)).scalar()
    refusal = F.raise_error(F.concat(F.lit(texts.SECOND_PARM_ROW.format(table=table.name) + ": "), refused)).cast("boolean")
    return F.when(refused.isNotNull(), refusal).otherwise(F.lit(True))


def single_rows(parms: DataFrame, keys: tuple[str, ...] = (SERVER,), observation: Observation | None = None) -> DataFrame:
    """The rows of scopes that have just one, in one grouping; ``observation`` counts both kinds of scopes."""
    values = [F.first(c).alias(c) for c in parms.columns if c not in keys]
    counted = parms.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *values)
    if observation is not None:
        several = F.count_if(F.col("_n") > 1).alias("scopes_with_second_rows")
        counted = counted.observe(observation, several, F.count_if(F.col("_n") == 1).alias("scopes_with_one_row"))
    return counted.where("_n = 1").drop("_n")
