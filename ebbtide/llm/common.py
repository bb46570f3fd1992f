"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.session import scratch_path

#: ASCII white space, the only word separators of the word contracts.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def ascii_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: fold of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


#: Rows in an Arrow batch of texts.
TEXT_BATCH = 512


def text_batches(spark: SparkSession) -> None:
    """Send texts to Python in small batches: the default of 10,000 rows is meant for rows of numbers,
    and every Python stage of every running task holds a batch on both sides."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting, "10000")) <= TEXT_BATCH:
        spark.conf.set(setting, str(TEXT_BATCH))


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table into the shared checkpoint folder and read it
    back.  A later stage that loses an executor re-reads files; nothing before
    this point is computed again."""
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
