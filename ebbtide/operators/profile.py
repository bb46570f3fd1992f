"""Profiling aggregates.

Rule: one scan per profile.  Per-column statistics go into ONE ``agg`` (wide)
or ONE ``unpivot`` + ``groupBy`` (long) -- never a Python loop of jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from ebbtide.functions.scalar import is_missing, width_bin


def _numeric_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def _string_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def dtype_split(spark: SparkSession, df: DataFrame, target: str | None = None,
                exclude: Sequence[str] = ()) -> DataFrame:
    """(column, kind) from schema inspection: numeric vs categorical, minus target."""
    skip = set(exclude) | ({target} if target else set())
    rows = []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        kind = "numeric" if isinstance(f.dataType, NumericType) else "categorical"
        rows.append((f.name, kind))
    schema = StructType([StructField("column", StringType(), False), StructField("kind", StringType(), False)])
    return spark.createDataFrame(rows, schema)


def long_values(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), value_type: str = "double",
                var: str = "feature", val: str = "value") -> DataFrame:
    """Unpivot ``cols`` to (ids..., feature, value), casting values to one type."""
    cast = df.select(*ids, *[F.col(c).cast(value_type).alias(c) for c in cols])
    return cast.unpivot(list(ids), list(cols), var, val)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows after the first equal row over ALL columns (null equals null), counted, not removed.

    Grouping on every column: the partial (map-side) aggregate collapses copies
    before the shuffle, so a hot duplicate group costs one row per task."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
    )


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: count and rate of missing values (NULL or NaN), from one one-row aggregate then unpivot."""
    cols = list(cols or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(is_missing(df, c).cast("long")).alias(f"_m{i}") for i, c in enumerate(cols)],
    )
    stack = ", ".join(f"'{c}', _m{i}" for i, c in enumerate(cols))
    long = wide.select("_rows", F.expr(f"stack({len(cols)}, {stack}) AS (column, nulls)"))
    return long.select(
        "column",
        F.col("nulls").cast("long").alias("nulls"),
        F.when(F.col("_rows") == 0, 0.0).otherwise(F.col("nulls") / F.col("_rows")).alias("null_rate"),
    )


def missing_by_row_bucket(df: DataFrame, key: str, cols: Sequence[str], buckets: int = 50) -> DataFrame:
    """Heat-map data at scale: null rate per (row bucket, column); rows bucketed by
    an md5 hash of the key (one grouped pass, #buckets x #columns output cells)."""
    from ebbtide.functions.scalar import md5_int

    b = df.select((md5_int(F.col(key).cast("string")) % buckets).cast("int").alias("row_bucket"), *cols)
    wide = b.groupBy("row_bucket").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(is_missing(df, c).cast("long")).alias(c) for c in cols]
    )
    long = wide.unpivot(["row_bucket", "_rows"], list(cols), "column", "nulls")
    return long.select("row_bucket", "column", (F.col("nulls") / F.col("_rows")).alias("null_rate"))


def class_share(df: DataFrame, label: str) -> DataFrame:
    """``value_counts(normalize=True)``: share per class, nulls dropped."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()  # over the per-class table (#classes rows)
    return counts.select(label, "n", (F.col("n") / F.sum("n").over(total)).alias("share"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Target mean, sum, complement and the positive-class weight (1 - mean) / mean."""
    m = F.avg(F.col(label))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label)).cast("long").alias("positives"),
        m.alias("target_mean"),
        (1 - m).alias("complement"),
        ((1 - m) / m).alias("scale_pos_weight"),
    )


def crosstab(df: DataFrame, cats: Sequence[str], label: str) -> DataFrame:
    """Contingency counts (column, value, label, n) for many columns in one pass; NULL values dropped."""
    long = long_values(df, cats, ids=[label], value_type="string", var="column", val="value")
    return (
        long.where(F.col("value").isNotNull())
        .groupBy("column", "value", label)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = 10000) -> DataFrame:
    """Per column quantiles with linear interpolation at (n-1)q, exact by distributed
    selection (see ``operators.quantile``)."""
    from ebbtide.operators.quantile import exact_quantiles

    return exact_quantiles(long_values(df, cols), ["feature"], "value", probs, accuracy)


def box_stats(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Box plot statistics per (feature, label): quartiles, mean, whiskers ending on a
    datum within 1.5 IQR, outlier count.  Pass 1: quartiles (exact selection);
    pass 2: fence join and min/max/count inside the fences."""
    from ebbtide.operators.quantile import exact_quantiles

    long = long_values(df, cols, ids=[label]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    qs = exact_quantiles(long, ["feature", label], "value", [0.25, 0.5, 0.75]).groupBy("feature", label).agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(name)
          for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    mom = long.groupBy("feature", label).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    q = mom.join(qs, ["feature", label]).select("feature", label, "n", "mean", "q1", "median", "q3")
    fences = q.select(
        "*",
        (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo_fence"),
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi_fence"),
    )
    v = F.col("value")
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    w = long.join(fences.select("feature", label, "lo_fence", "hi_fence"), ["feature", label])
    whiskers = w.groupBy("feature", label).agg(
        F.min(F.when(inside, v)).alias("whisker_lo"),
        F.max(F.when(inside, v)).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("outliers"),
    )
    return fences.join(whiskers, ["feature", label]).select(
        "feature", label, "n", "mean", "q1", "median", "q3", "whisker_lo", "whisker_hi", "outliers"
    )


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation with pairwise-complete nulls; one aggregate for all pairs,
    upper triangle computed, mirrored, diagonal 1 (NULL when a column is constant)."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = [F.corr(F.col(a), F.col(b)).alias(f"_c{k}") for k, (a, b) in enumerate(pairs)]
    aggs += [F.stddev_samp(F.col(c)).alias(f"_s{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    entries = []
    for k, (a, b) in enumerate(pairs):
        entries += [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_c{k}").alias("corr")),
                    F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"_c{k}").alias("corr"))]
    for i, c in enumerate(cols):
        one = F.when(F.col(f"_s{i}") > 0, F.lit(1.0))
        entries.append(F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), one.alias("corr")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.a", "e.b", "e.corr")


def correlation_from_products(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, corr): pairwise-complete Pearson matrix of any number of columns, both triangles.

    With X the values (0 where missing) and M the presence of each cell, the sums of a pair over the
    rows where both are present are cells of M'M, X'M, (X X)'M and X'X.  Each task multiplies its Arrow
    batches and returns those cells; one small grouped sum adds them.  Columns are centred and scaled
    first, so that no cancellation is worse than for standard scores."""
    cols = list(cols)
    d = len(cols)
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in cols]
    row = df.agg(*[F.avg(v).alias(f"m{k}") for k, v in enumerate(known)],
                 *[F.stddev_pop(v).alias(f"s{k}") for k, v in enumerate(known)]).first()  # two numbers a column
    scaled = [((v - F.lit(row[f"m{k}"] or 0.0)) / F.lit(row[f"s{k}"] or 1.0)).alias(f"x{k}") for k, v in enumerate(known)]
    i, j = (v.ravel() for v in np.indices((d, d)))

    def products(batches):
        sums = np.zeros((4, d, d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            m = ~np.isnan(x)
            x, m = np.where(m, x, 0.0), m.astype(float)
            sums += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), **{
            name: s.ravel() for name, s in zip(("n", "sx", "sxx", "sxy"), sums, strict=True)}})

    parts = df.select(*scaled).mapInPandas(products, "i int, j int, n double, sx double, sxx double, sxy double")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy")])
    other = total.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    spread = (F.col("sxx") - F.col("sx") ** 2 / F.col("n")) * (F.col("syy") - F.col("sy") ** 2 / F.col("n"))
    corr = F.when(F.col("i") == F.col("j"), F.when(F.col("sxx") > 0, 1.0)).otherwise(
        F.when((F.col("n") > 1) & (spread > 1e-18), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(spread)))
    names = F.array(*[F.lit(c) for c in cols])
    return total.join(other, ["i", "j"]).select(
        F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), corr.alias("corr"))


def variance_topk(df: DataFrame, cols: Sequence[str], k: int = 20) -> DataFrame:
    """Columns with the largest sample variance (ddof=1): one-row agg, unpivot, top-k."""
    wide = df.agg(*[F.var_samp(F.col(c)).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "feature", "variance")
    return long.where(F.col("variance").isNotNull()).orderBy(F.col("variance").desc(), F.col("feature")).limit(k)


def hists_by_label(df: DataFrame, values: dict[str, Column], label: str, n_bins: int) -> DataFrame:
    """(feature, label, bin, n, bin_lo): equal-width histograms of several columns, bins shared across labels:
    exactly ``n_bins`` over the pooled [min, max] of a column, top edge closed.

    Two scans for all columns: one row of ranges, then counts by (column, label, bin) that
    are added up within each task before the shuffle."""
    known = df.where(F.col(label).isNotNull())
    ranges = known.agg(*[f(v).alias(f"{end}{k}") for k, v in enumerate(values.values())
                         for end, f in (("lo", F.min), ("hi", F.max))]).first()  # two numbers a column
    cells = [F.struct(F.lit(name).alias("feature"), F.lit(float(ranges[f"lo{k}"])).alias("lo"), F.lit(float(ranges[f"hi{k}"])).alias("hi"),
                      F.when(v.isNotNull(), width_bin(v, float(ranges[f"lo{k}"]), float(ranges[f"hi{k}"]), n_bins)).alias("bin"))
             for k, (name, v) in enumerate(values.items()) if ranges[f"lo{k}"] is not None]
    empty = "array<struct<feature:string,lo:double,hi:double,bin:int>>"
    binned = known.select(label, F.explode((F.array(*cells) if cells else F.array()).cast(empty)).alias("c")).where(
        F.col("c.bin").isNotNull())
    return binned.groupBy(F.col("c.feature").alias("feature"), label, F.col("c.bin").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("c.lo").alias("lo"), F.first("c.hi").alias("hi")).select(
            "feature", label, "bin", "n", (F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / n_bins).alias("bin_lo"))


def density_smooth(df: DataFrame, col: str, label: str, clip_q: float = 0.97, n_bins: int = 80,
                   window: int = 7) -> DataFrame:
    """Per label: clip the top at the label's own p97, ``n_bins`` bins over its own
    clipped range, density ``count / (n * width)``, then a centred moving average
    of width ``window`` with zero padding (edges divide by ``window``).

    Dense bin spine: bins 1..n_bins per label come from ``sequence`` exploded
    over the per-label stats table (#labels rows), so empty bins exist.
    """
    v = df.select(F.col(label), F.col(col).cast("double").alias("x")).where(
        F.col("x").isNotNull() & F.col(label).isNotNull()
    )
    from ebbtide.operators.quantile import exact_quantiles

    caps = exact_quantiles(v, [label], "x", [clip_q]).select(label, F.col("value").alias("cap"))
    stats = v.groupBy(label).agg(F.min("x").alias("x_min"), F.count(F.lit(1)).alias("n")).join(caps, label)
    stats = stats.select(label, "cap", "n", F.least(F.col("x_min"), F.col("cap")).alias("lo"),
                         F.col("cap").alias("hi"))
    clipped = v.join(stats, label).select(
        label, F.least(F.col("x"), F.col("cap")).alias("x"), "lo", "hi", "n"
    )
    counts = clipped.groupBy(label, width_bin("x", F.col("lo"), F.col("hi"), n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("c")
    )
    spine = stats.select(label, "lo", "hi", "n", F.explode(F.sequence(F.lit(1), F.lit(n_bins))).alias("bin"))
    dense = spine.join(counts, [label, "bin"], "left").select(
        label, "bin", "lo", "hi", "n", F.coalesce(F.col("c"), F.lit(0)).alias("c")
    )
    width = (F.col("hi") - F.col("lo")) / n_bins
    dens = dense.select(
        label, "bin",
        (F.col("lo") + (F.col("bin") - 0.5) * width).alias("center"),
        F.when(width == 0, F.lit(None)).otherwise(F.col("c") / (F.col("n") * width)).alias("density"),
    )
    half = window // 2
    w = Window.partitionBy(label).orderBy("bin").rowsBetween(-half, half)
    return dens.select(label, "bin", "center", "density", (F.sum("density").over(w) / window).alias("smooth"))
