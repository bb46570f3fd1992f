"""Exact quantiles (linear interpolation at rank (n-1)q) and modes without
holding a group's distinct values in one task.

``percentile``/``median``/``mode`` aggregates keep a map of every distinct
value of a group, and the final merge of a group happens in one task.  Here
the exact answer is found by selection:

1. per group, ``n`` and approximate quantiles at q - e and q + e with
   e = 4 / accuracy (``percentile_approx`` has rank error <= n / accuracy),
   which bracket the two ranks floor((n-1)q) and floor((n-1)q) + 1;
2. one pass over the rows counts, per (group, q), the values below the
   bracket and, for each distinct value inside it, its copies; equal values
   collapse before the shuffle, however many there are;
3. running counts over the distinct values of a bracket (about 8n / accuracy at
   most) say which value holds each target rank; the two are interpolated.

A bracket that fails its check (possible only for tiny, edge-case groups)
is widened and recomputed for those groups alone; the last round uses the
whole value range, which is always correct.  The result, one row per group and
probability, is written to the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import scratch_path

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    accuracy: int = ACCURACY) -> DataFrame:
    """(by..., q, value): exact linear-interpolated quantiles of ``value`` per group (NULLs ignored)."""
    by = list(by)
    probs = [float(q) for q in probs]
    d = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    margin = 4.0 / accuracy
    result = None
    pending = None  # (by..., qi) still to solve
    for attempt in range(4):
        whole = attempt == 3
        lo_p = [max(0.0, q - margin) for q in probs]
        hi_p = [min(1.0, q + margin) for q in probs]
        st = d.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_n"),
            F.percentile_approx("_v", F.array(*[F.lit(x) for x in lo_p + hi_p]), accuracy).alias("_br"),
            F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        )
        k = len(probs)
        targets = st.select(
            *by, "_n",
            F.posexplode(F.array(*[
                F.struct(
                    F.lit(q).alias("q"),
                    (F.col("_min") if whole else F.col("_br")[i]).alias("lo"),
                    (F.col("_max") if whole else F.col("_br")[k + i]).alias("hi"),
                ) for i, q in enumerate(probs)
            ])).alias("qi", "t"),
        ).select(*by, "_n", "qi", "t.q", "t.lo", "t.hi")
        pos = (F.col("_n") - 1) * F.col("q")
        targets = targets.select("*", F.floor(pos).cast("long").alias("_k"),
                                 (pos - F.floor(pos)).alias("_frac"))
        if pending is not None:
            targets = targets.join(pending, [*by, "qi"], "left_semi")
        # one row per (group, q, value in the bracket), and one with a null value for all below it
        joined = d.join(targets, by).where(F.col("_v") <= F.col("hi"))
        counts = joined.groupBy(*by, "qi", "q", "_k", "_frac", "_n", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias(
            "_v")).agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy(*by, "qi").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        upto = counts.withColumn("_to", F.sum("_c").over(w)).withColumn("_from", F.col("_to") - F.col("_c"))

        def at(rank):
            return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))

        picked = upto.groupBy(*by, "qi", "q", "_k", "_frac", "_n").agg(
            at(F.col("_k")).alias("_a"), at(F.least(F.col("_k") + 1, F.col("_n") - 1)).alias("_b"))
        picked = _written(picked, attempt)
        ok = picked.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        solved = ok.select(*by, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")).alias("value"))
        result = solved if result is None else result.unionByName(solved)
        pending = picked.where(F.col("_a").isNull() | F.col("_b").isNull()).select(*by, "qi")
        if whole or not pending.head(1):
            break
        margin *= 16
    return result


def _written(df: DataFrame, attempt: int) -> DataFrame:
    path = scratch_path(df.sparkSession, f"quantiles/{uuid.uuid4().hex}-{attempt}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def exact_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return exact_quantiles(df, by, value, [0.5]).drop("q")


def modes(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Most frequent non-NULL value per group, smallest value on ties: counts per
    (group, value) are a distributed aggregate; the pick per group is a bounded
    partial aggregate (``min_by`` over (-count, value))."""
    by = list(by)
    counts = long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*by).agg(
        F.min_by(F.col(value), F.struct((-F.col("_c")).alias("c"), F.col(value).alias("v"))).alias("mode")
    )
