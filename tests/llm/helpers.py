"""Small tables with the awkward cases every operator must take."""

import random

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def documents(spark):
    """(doc_id, text) of the smallest table, as a list."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def awkward(spark, more=()):
    """Texts that are null, empty, blank, long without and with breaks, repeated; rows without
    an id and with an id of another row."""
    random.seed(8)
    some = documents(spark)[:30]
    long = " ".join(random.choice(["alpha", "beta", "gamma", "delta", "é", "x1"]) for _ in range(30000))
    texts = [None, "", " \n\t ", "x" * 50000, long, "a a a a " * 400, some[3][1], some[3][1]]
    rows = some + [(1000 + i, t) for i, t in enumerate(texts)] + [(None, some[4][1]), (None, None), (some[5][0], some[5][1]), some[6]]
    return rows + list(more)


def frame(spark, rows):
    """With further columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("block", "bucket", "shard", "component", "node", "label", "span", "key", "n", "part", "copy", "_id", "_hash", "size"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df.repartition(5)


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
