"""Running sums over any number of rows in a given order.

``Window.orderBy`` without a partition moves all rows to one task, and fixed
buckets grow with the data.  Here the rows are counted and dealt into range
partitions of some ``SCAN_ROWS`` rows on (group, order); the partition number is
pinned by writing the table.  Partition sums, one row per group and partition, give
the offset each partition begins with, and a window inside (group, partition)
does the rest.  Equal rows in the order never part, so ties stay together.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import scratch_path

#: Rows of a range partition, about (ranges come from a sample: a partition may hold some times as many).
SCAN_ROWS = 250_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"scan/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_parts(df: DataFrame, by: Sequence[str], order: Column, rows: int | None = None) -> DataFrame:
    """The rows with ``_part``, the number of their range on (by..., order); ranges rise with the order within a group."""
    table = _written(df, "rows")
    parts = -(-table.count() // (rows or SCAN_ROWS))
    if parts <= 1:
        return table.withColumn("_part", F.lit(0))
    return _written(table.repartitionByRange(parts, *by, order).withColumn("_part", F.spark_partition_id()), "parts")


def prefix_sums(df: DataFrame, by: Sequence[str], order: Column, sums: dict[str, str], totals: dict[str, str] | None = None,
                rows: int | None = None) -> DataFrame:
    """``df`` with running sums ``{new: column}`` over the rows of its group up to each row, and group totals ``{new: column}``."""
    totals = totals or {}
    group = list(by) or ["_all"]
    table = range_parts(df if by else df.withColumn("_all", F.lit(0)), group, order, rows)
    added = table.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in {*sums.values(), *totals.values()}])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = added.select(
        *group, "_part", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{new}") for new, c in sums.items()],
        *[F.sum(f"_s_{c}").over(Window.partitionBy(*group)).alias(new) for new, c in totals.items()])
    inside = Window.partitionBy(*group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table.join(offsets, [*group, "_part"]).select(
        *df.columns, *[(F.sum(c).over(inside) + F.col(f"_o_{new}")).cast("long").alias(new) for new, c in sums.items()],
        *[F.col(new).cast("long").alias(new) for new in totals])
