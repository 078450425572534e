"""The factorisation machine against sums over pairs, Spark's own scores, and held-out labels."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from subdrift.llm.queries import op11_quality_classifier
from subdrift.llm.quality_classifier import BUCKETS, STRUCTURE, Fit, Machine, features, fitted, fold, scored
from tests.llm.helpers import SMALL, awkward, documents, frame

QUICK = Fit(slots=1 << 8, factors=3, steps=8)


def sparse(texts, given=None, fit=QUICK):
    starts, index, value = features([t.encode() for t in texts], given or [None] * len(texts), fit)
    ends = [*starts[1:], len(index)]
    return [dict(zip(index[a:b].tolist(), value[a:b].tolist())) for a, b in zip(starts, ends)], (starts, index, value)


def test_sum_of_squares_is_the_sum_over_pairs():
    r = np.random.default_rng(3)
    machine = Machine(0.2, r.normal(0, 0.3, QUICK.size), r.normal(0, 0.3, (QUICK.size, 3)))
    rows, arrays = sparse(["some words, some MORE words\nand a line 12", "", "x x x x", "## || a"])
    got = machine.probability(*arrays)
    for row, p in zip(rows, got):
        items = list(row.items())
        pairs = sum(x * y * machine.factors[i] @ machine.factors[j] for a, (i, x) in enumerate(items) for j, y in items[a + 1 :])
        margin = machine.intercept + sum(machine.linear[i] * x for i, x in items) + pairs
        assert p == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-12)
    assert len(machine.probability(*features([], [], QUICK))) == 0


def test_features():
    rows, _ = sparse(["A b b b\nA b b b\n!", "", "Straße é"], [9, None, 8])
    base = BUCKETS * len(STRUCTURE)
    for row in rows:
        structure = [i for i in row if i < base]
        assert [i // BUCKETS for i in structure] == list(range(len(STRUCTURE)))
        assert list(row) == sorted(row)
        words = [v for i, v in row.items() if i >= base]
        assert not words or sum(v * v for v in words) == pytest.approx(QUICK.word_weight**2)
    bucket = lambda row, name: next(i % BUCKETS for i in row if i // BUCKETS == STRUCTURE.index(name))
    assert bucket(rows[0], "words") == 4 and bucket(rows[0], "repeated_lines") > 0 and bucket(rows[2], "repeated_lines") == 0
    assert [bucket(r, "length_agrees") for r in rows] == [1, 0, 2] and bucket(rows[0], "stuttered") > bucket(rows[2], "stuttered")


def tables(spark):
    rows = awkward(spark)
    labels = [(d, int(len(t or "") % 3 > 0)) for d, t in rows] + [(None, 1), (10**9, 0), (rows[0][0], 7), (rows[1][0], None)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int").withColumn("label", F.lit("own label"))


def test_awkward_rows(spark):
    docs, labels = tables(spark)
    machine = fitted(docs, labels, QUICK)
    got = scored(docs, machine, QUICK)
    assert got.columns == ["doc_id", "score"] and got.count() == docs.count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    by_text = docs.select("doc_id", "text").join(got, docs["doc_id"].eqNullSafe(got["doc_id"]))
    assert by_text.count() > 0
    one = {repr(r.doc_id): r.score for r in scored(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), machine, QUICK).collect()}
    assert all(r.score == pytest.approx(one[repr(r.doc_id)]) for r in got.collect() if r.doc_id is not None and r.doc_id >= 1000)


def test_one_class_and_empty_tables(spark):
    docs, labels = tables(spark)
    for some, score in ((labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0), (labels.limit(0), 0.5)):
        assert [r.score for r in scored(docs, fitted(docs, some, QUICK), QUICK).select("score").distinct().collect()] == [pytest.approx(score)]
    machine = fitted(docs.limit(0), labels, QUICK)
    share = labels.where("quality = 1 and doc_id is not null").count() / labels.where("quality in (0, 1) and doc_id is not null").count()
    assert [r.score for r in scored(docs, machine, QUICK).select("score").distinct().collect()] == [pytest.approx(share)]
    assert scored(docs.limit(0), machine, QUICK).count() == 0


def test_spark_scores_alike(spark):
    """Our scores are those of the fitted model: the same bias, weights and vectors."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.linalg import SparseVector

    texts = [t or "" for _, t in documents(spark)[:60]]
    rows, arrays = sparse(texts)
    data = spark.createDataFrame([(float(i % 3 > 0), SparseVector(QUICK.size, r)) for i, r in enumerate(rows)], ["label", "features"])
    model = FMClassifier(factorSize=3, maxIter=5, stepSize=0.1, seed=1).fit(data)
    machine = Machine(float(model.intercept), model.linear.toArray(), model.factors.toArray())
    want = [r.probability[1] for r in model.transform(data).collect()]
    assert machine.probability(*arrays) == pytest.approx(want)


def test_folds(spark):
    ids = [0, 1, 17, -5, 10**12]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", fold(F.col("doc_id")).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(str(r.doc_id).encode()) % 5 for r in got]


def test_query_on_held_out_labels(spark):
    """Junk of the held-out fold is told from prose it was not trained on."""
    sf = "/root/testdata/sf0.1"
    got = op11_quality_classifier(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    junk, good = ([r.predicted for r in held if r.quality == q] for q in (0, 1))
    assert len(junk) > 80 and np.mean(junk) < 0.08 and np.mean(good) > 0.99
    assert all((r.score >= 0.3) == bool(r.predicted) for r in rows)


def test_query_ignores_other_columns_and_held_out_labels(spark, scratch):
    spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}).write.parquet(f"{scratch}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.withColumn("quality", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{scratch}/labels.parquet")
    a, b = ({r.doc_id: r.score for r in op11_quality_classifier(spark, d).collect()} for d in (SMALL, scratch))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
