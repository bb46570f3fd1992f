"""A training-data pipeline from the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared checkpoint folder and reads it back as the next
stage's ``docs``, so a lost executor never reaches behind the last stage.

toxicity         rows that the network scores as toxic go
quality          rows that the additive model scores below its threshold go
near_duplicates  one document of each SimHash component stays (the smallest id)
decontamination  documents that overlap a benchmark item go
tokens           ids of every text, with the digests of ids and decoded bytes

All stages but the last return the columns of ``documents``.  Classifiers learn
from the labelled rows among their own input outside their held-out folds.
Rows with a null id pass stages that go by id; empty tables pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ebbtide.llm import bpe, decontaminate, gam, simhash, toxicity
from ebbtide.llm.common import written
from ebbtide.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return gam.keep_good(docs, gam.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(spark, docs, ["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("tokens", tokens),
]

#: Networks and fitted tables have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
