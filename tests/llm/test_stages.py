"""Stages of the pipeline on empty tables, nulls, repeated rows and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavecrest.llm.common import table

OTHER = {"_language": "'kept'", "_toxicity": "'kept'", "_CONTAMINATION": "'kept'", "score": "cast(null as double)", "contaminated": "true"}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_of_an_empty_table(spark, sf_dir, name, stage):
    docs = table(spark, sf_dir, "documents").where("false")
    got = stage(spark, docs, sf_dir)
    assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns_whose_names_clash(spark, sf_dir, name, stage):
    docs = table(spark, sf_dir, "documents")
    odd = [(None, None, None, None, None), (10**6, None, "en", "s", 0), (10**6 + 1, "", None, "s", 0)]
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame(odd, docs.schema))
    plain = sorted(map(str, stage(spark, docs, sf_dir).select("doc_id", "text").collect()))
    got = stage(spark, docs.withColumns({k: F.expr(v) for k, v in OTHER.items()}), sf_dir)
    assert got.columns == [*docs.columns, *OTHER]
    assert sorted(map(str, got.select("doc_id", "text").collect())) == plain and plain
    assert not got.where("_language <> 'kept' or _toxicity <> 'kept' or _CONTAMINATION <> 'kept' or score is not null or not contaminated").count()
