"""The registered queries against SQL, and the pipeline's stages one after another."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from subdrift.llm import decontaminate, jaccard, mixing, quality
from subdrift.llm.common import written
from subdrift.llm.queries import queries
from subdrift.llm.reference_sql import oracle_sql
from tests.llm.helpers import SMALL, awkward


@pytest.mark.parametrize("name", oracle_sql())
def test_query(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    got = queries()[name](spark, SMALL)
    result = db.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == sorted(map(repr, result.fetchall()))


def test_every_operator_is_registered():
    numbers = {name.split("_")[0] for name in queries() if name.startswith("op")}
    assert numbers == {f"op{n}" for n in range(1, 14)} and "pipeline" in queries()


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    stages = [stage for _, stage in corpus_pipeline.STAGES]

    def ids(df):
        return {r.doc_id for r in df.select("doc_id").collect()}

    good = stages[0](spark, docs, SMALL).cache()
    assert ids(good) == ids(quality.quality(docs).where("kept"))
    single = stages[1](spark, good, SMALL).cache()
    assert ids(single) == ids(jaccard.jaccard_components(good).where("doc_id = component_id"))
    clean = stages[2](spark, single, SMALL).cache()
    assert ids(clean) == ids(single) - ids(decontaminate.find_items(single, benchmark))
    mixed = stages[3](spark, clean, SMALL).cache()
    for df in (good, single, clean, mixed):
        assert df.columns == docs.columns
    draws = mixing.mix(clean, size=F.length("text").cast("double")).groupBy("doc_id").count()
    assert sorted(map(tuple, mixed.groupBy("doc_id").count().collect())) == sorted(map(tuple, draws.collect()))
    tokens = stages[4](spark, mixed, SMALL)
    assert tokens.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and tokens.count() == mixed.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, tokens.collect()))


def test_stages_on_awkward_and_empty_tables(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(d, t, "en", None if i % 4 == 0 else f"src{i % 3}", None) for i, (d, t) in enumerate(awkward(spark))]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        count = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SMALL), "stage")
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert (docs.count() > 0) == (count > 0)
