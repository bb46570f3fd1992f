"""Sources and sinks (S1-S6): CSV, Parquet and JSON metric documents.

Writes go to a caller-given path; for intermediate tables use
``ebbtide.session.scratch_path`` (under the cluster's shared checkpoint folder).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from ebbtide.functions.constants import NULL_TOKENS
from ebbtide.functions.scalar import without_nan


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Header CSV with an explicit schema (no inference pass over the data).  A NaN in
    a numeric column is a missing value; ``corrupt_cells`` counts unreadable ones."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(*[without_nan(df, c).alias(c) for c in df.columns])


def corrupt_cells(spark: SparkSession, path: str, schema: StructType,
                  tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """(column, corrupt): cells that hold text other than a null token but do not
    read as the column's type.  One aggregate over the file read as text."""
    typed = [f for f in schema.fields if not isinstance(f.dataType, StringType)]
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    raw = spark.read.schema(text).option("header", True).csv(path)
    bad = [
        F.count_if(F.col(f.name).isNotNull() & ~F.trim(f.name).isin("", "NaN", *tokens)
                   & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name)
        for f in typed
    ]
    if not bad:
        return spark.createDataFrame([], "column string, corrupt long")
    return raw.agg(*bad).unpivot([], [f.name for f in typed], "column", "corrupt")


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)  # keep a blank " " category as written
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scrub_null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Every string column: exact, case-sensitive token match -> NULL, in one select."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            c = F.col(f.name)
            cols.append(F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---- metric documents ------------------------------------------------------

def metrics_document(long_metrics: DataFrame, outer: str = "metric", inner: str = "model",
                     value: str = "value") -> DataFrame:
    """Long (metric, model, value) -> one row holding ``{metric: {model: value}}`` as JSON.

    The nesting is built with two aggregations of a table whose size is
    #metrics x #models (a handful of rows), never the scored data itself.
    """
    per_outer = long_metrics.groupBy(outer).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(inner), F.col(value)))).alias("m")
    )
    return per_outer.agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(outer), F.col("m"))))).alias("json")
    )


def write_text_document(doc: DataFrame, path: str) -> None:
    doc.coalesce(1).write.mode("overwrite").text(path)


def read_metrics_document(spark: SparkSession, path: str, outer: str = "metric", inner: str = "model") -> DataFrame:
    """``{metric: {model: value}}`` JSON text -> long (metric, model, value)."""
    schema = MapType(StringType(), MapType(StringType(), DoubleType()))
    raw = spark.read.text(path)
    parsed = raw.select(F.explode(F.from_json(F.col("value"), schema)).alias(outer, "m"))
    return parsed.select(outer, F.explode("m").alias(inner, "value"))


def records_document(table: DataFrame) -> DataFrame:
    """A small table -> one row holding ``[{column: value}, ...]`` as JSON, rows in the order of all columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    return table.agg(F.to_json(F.array_sort(F.collect_list(row)), {"ignoreNullFields": "false"}).alias("json"))


def map_document(table: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """A small (key, value) table -> one row holding ``{key: value}`` as JSON."""
    return table.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value)))).alias("json"))


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document of any of the three shapes -> long (outer, inner, value as text).

    ``{a: {b: v}}`` gives (a, b, v); ``[{b: v}, ...]`` gives (number of the record from 0, b, v);
    ``{b: v}`` gives (null, b, v).  Values that are null stay rows with a null value."""
    top = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    first = top.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer())).select(
        "pos", "key", F.col("value").alias("v"))
    inner = first.select(F.col("pos").alias("p"), F.col("key").alias("k"), "v")
    deep = inner.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer())).select(
        "p", "k", "v", F.col("key").alias("k2"), F.col("value").alias("v2"))
    is_deep = F.col("k2").isNotNull()
    outer = F.when(is_deep, F.coalesce(F.col("k"), F.col("p").cast("string")))
    return deep.select(
        outer.alias("outer"), F.when(is_deep, F.col("k2")).otherwise(F.col("k")).alias("inner"),
        F.when(is_deep, F.col("v2").cast("string")).otherwise(F.col("v").cast("string")).alias("value"))
