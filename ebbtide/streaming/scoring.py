"""Structured Streaming: apply a fitted preprocessing + scoring pipeline to a stream.

The reference has no streaming work; this is the by-product its design allows.
Every fitted stage transform is a projection or a stream-static join against
a small fitted table (imputation values, clip bounds, binary maps, encoder
tables), so a ``PipelineModel`` fitted in batch applies unchanged to a
streaming DataFrame.  The sink is a Parquet folder with a checkpoint under the
cluster's shared checkpoint folder, so a restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ebbtide.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema: StructType, max_files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def score_stream(model: PipelineModel, stream: DataFrame, sink_path: str, name: str = "scoring",
                 available_now: bool = False) -> StreamingQuery:
    """Start the scoring query (append mode, Parquet sink)."""
    spark = stream.sparkSession
    checkpoint = scratch_path(spark, f"streams/{name}")
    writer = (
        model.transform(stream)
        .writeStream.format("parquet")
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
