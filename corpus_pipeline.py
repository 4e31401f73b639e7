"""From raw documents to packed training sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reweave.llm.common import written
from reweave.llm.decontaminate import keep_clean
from reweave.llm.exact_dedup import keep_unique
from reweave.llm.near_dedup import keep_one
from reweave.llm.packing import best_fit_packing
from reweave.llm.quality import accepted
from reweave.llm.queries import table, vocabulary

# Every stage takes an empty table to an empty one and gives back columns of any name as they came.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from `labels`, and from no document that is held out.

    Null and empty texts are scored as empty; repeated rows share their score; without labels the score is 0.5 and none stays.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, A-Z lower-cased and null as empty: the largest id (null is the smallest), one row of it."""
    return keep_unique(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    The smallest id stays; where ids repeat, any one row. Null and empty texts are linked with nothing and all stay.
    """
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`. Null and empty texts stay; rows that share an id are judged one by one."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 2048 tokens. Null and empty texts hold the end id only; repeated rows are
    packed each for itself."""
    return best_fit_packing(docs, vocabulary=vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL: a fitted model and a tokenizer stand between documents and rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
