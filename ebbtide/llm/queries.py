"""Query and oracle registry of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ebbtide.llm import (
    alignment,
    bpe,
    decontaminate,
    divergence,
    gam,
    langid,
    licenses,
    masked_lm,
    pivots,
    quality_rules,
    simhash,
    toxicity,
    urls,
)
from ebbtide.sources.tables import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.contract(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.contract(spark, table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.contract(spark, table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.contract(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.contract(spark, table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.contract(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contract(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.contract(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.contract(spark, table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.contract(spark, table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.contract(spark, table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.contract(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash": op2_simhash,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_alignment": op11_alignment,
    "op12_divergence": op12_divergence,
    "op13_embedding_dedup": op13_embedding_dedup,
}
ORACLES = {
    "op1_license_scan": licenses.oracle(),
    "op4_quality_rules": quality_rules.oracle(),
    "op7_decontamination": decontaminate.oracle(),
    "op9_url_filter": urls.oracle(),
    "op12_divergence": divergence.oracle(),
}
