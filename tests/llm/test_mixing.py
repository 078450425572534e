"""Poisson draws against a loop, and the shares they lead to."""

import hashlib
import math

from pyspark.sql import functions as F

from subdrift.llm.mixing import mix, poisson, rates
from tests.llm.helpers import awkward, frame


def draw(u, rate):
    k, term = 0, math.exp(-rate)
    total = term
    while total < u:
        k += 1
        term *= rate / k
        total += term
    return k


def test_inversion(spark):
    cases = [(u / 1000 + 0.0005, rate) for rate in (0.0, 0.01, 0.5, 1.0, 7.3, 120.0) for u in range(0, 1000, 37)]
    df = spark.createDataFrame(cases, "u double, rate double")
    got = df.select("u", "rate", poisson(F.col("u"), F.col("rate")).alias("k")).collect()
    assert all(r.k == draw(r.u, r.rate) for r in got)


def sources(spark):
    return frame(spark, awkward(spark)).withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 3 == 0, "b").otherwise("a"))


def test_every_row_is_repeated_as_drawn(spark):
    df = sources(spark)
    rate = {r["source"]: r.rate for r in rates(df, None).collect()}
    want = 0
    for r in df.collect():
        digest = hashlib.md5(f"17:{'null' if r.doc_id is None else r.doc_id}:1".encode()).hexdigest()
        want += draw((int(digest[:13], 16) + 0.5) / (1 << 52), rate[r["source"]])
    mixed = mix(df)
    keys = [r.shuffle_key for r in mixed.collect()]
    assert len(keys) == want and keys == sorted(keys)
    assert set(df.columns) - {"copy"} <= set(mixed.columns)
    assert mix(df).exceptAll(mixed).count() == 0


def test_weights(spark):
    big = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 4000, "a").when(F.col("id") < 5900, "b").otherwise("c").alias("source"))
    weights = spark.createDataFrame([("a", 1.0), ("c", 1.0)], "source string, weight double")
    counts = {r["source"]: r["count"] for r in mix(big, weights).groupBy("source").count().collect()}
    assert set(counts) == {"a", "c"} and all(abs(n - 3000) < 400 for n in counts.values())


def test_high_rates_and_empty_tables(spark):
    few = spark.createDataFrame([(1, "x", "rare")] + [(i, "x", "often") for i in range(2, 4000)], "doc_id long, text string, source string")
    n = mix(few).where("source = 'rare'").count()
    assert abs(n - 2000) < 300
    assert mix(sources(spark).limit(0)).count() == 0
