import os

import pytest

import __spark_entry__
import corpus_pipeline
from tessera.storage import cut

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and docs.count() > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.where("length > 0").count() == pieces.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op")])
def test_queries_give_rows(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0
