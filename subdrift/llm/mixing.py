"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: its share of the target divided by its share of
the corpus. A document's number of copies is drawn from the Poisson distribution of that
mean by inversion, with a uniform number made from a hash of its id and a seed: the same
run gives the same copies, whatever the partitions, and a repeated task the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subdrift.llm.common import written

COPY, ORDER = "copy", "shuffle_key"
# Copies whose probability is below double precision are never drawn.
_TAIL_SIGMAS = 12


def rates(documents: DataFrame, weights: DataFrame | None, source: str = "source", size: Column | None = None) -> DataFrame:
    """Mean repetitions per source: ``source, rate``.

    ``weights`` (``source, weight``) need not add up to one; a source that it lacks is
    dropped from the mix (rate 0), a null source is a source like any other. Without
    ``weights`` every source of the corpus gets the same weight. ``size`` measures a row
    (default: one). The expected size of the mix is the size of the corpus.
    """
    measured = documents.groupBy(F.col(source).alias("source")).agg(F.sum(F.lit(1.0) if size is None else size).alias("_size"))
    if weights is None:
        weighted = measured.withColumn("_weight", F.lit(1.0))
    else:
        wanted = weights.groupBy(F.col("source").alias("_name")).agg(F.sum("weight").alias("_weight"))
        weighted = measured.join(wanted, measured["source"].eqNullSafe(wanted["_name"]), "left").drop("_name")
    totals = weighted.agg(
        F.sum("_size").alias("_total"), F.sum(F.when(F.col("_size") > 0, F.col("_weight"))).alias("_weights")
    )
    share = F.coalesce(F.col("_weight"), F.lit(0.0)) / F.col("_weights")
    rate = F.when(F.col("_size") > 0, share * F.col("_total") / F.col("_size"))
    # Two rows of fixed shape meet: one row of totals for the sources.
    return weighted.join(F.broadcast(totals)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a digest of the parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson(u: Column, rate: Column) -> Column:
    """The smallest k with P(X <= k) >= u: the terms are summed up until they reach u."""
    steps = F.sequence(F.lit(1), F.ceil(rate + _TAIL_SIGMAS * F.sqrt(rate) + 20).cast("int"))
    start = F.struct(
        F.lit(0).alias("k"), F.exp(-rate).alias("term"), F.exp(-rate).alias("sum")
    )

    def step(state, k):
        term = state["term"] * rate / k
        return F.when(state["sum"] >= u, state).otherwise(
            F.struct(k.alias("k"), term.alias("term"), (state["sum"] + term).alias("sum"))
        )

    return F.aggregate(steps, start, step, lambda state: state["k"])


def mix(
    documents: DataFrame,
    weights: DataFrame | None = None,
    seed: int = 17,
    source: str = "source",
    size: Column | None = None,
) -> DataFrame:
    """``documents`` with every row repeated as drawn, in a global random order.

    Adds ``copy`` (from 1) and ``shuffle_key`` (columns of these names are replaced).
    A null id draws like the id "null"; rows of equal id and source draw alike. Rates
    above 700 are cut into equal parts that are drawn apart and added, as exp() would
    vanish. An empty table gives an empty mix.
    """
    mean = written(rates(documents, weights, source, size), "rates")
    mean = mean.select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"))
    plain = documents.drop(COPY, ORDER)
    # The table of rates has one row per source; Spark broadcasts it if it is small and
    # else splits the partitions of hot sources, as both sides are plain exchanges.
    joined = plain.join(mean, plain[source].eqNullSafe(mean["_mix_source"]))
    parts = F.greatest(F.ceil(F.col("_mix_rate") / 700), F.lit(1)).cast("int")
    drawn = F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda total, i: total + poisson(uniform(F.lit(seed), F.col("doc_id"), i), F.col("_mix_rate") / parts),
    )
    copies = joined.withColumn("_mix_n", drawn).where(F.col("_mix_n") > 0)
    exploded = copies.select(*plain.columns, F.explode(F.sequence(F.lit(1), F.col("_mix_n"))).alias(COPY))
    key = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), COPY))
    return exploded.withColumn(ORDER, key).repartitionByRange(ORDER).sortWithinPartitions(ORDER)
