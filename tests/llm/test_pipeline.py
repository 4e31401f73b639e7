"""The pipeline's stages, one after another, on the smallest tables."""

import pathlib

import corpus_pipeline
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="needs the tables")
def test_stages_keep_columns_and_shrink(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == columns and 0 < kept.count() <= before
            docs, before = kept, kept.count()
        else:
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}
