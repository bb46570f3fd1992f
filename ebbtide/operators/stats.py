"""Two-group tests per feature (V1 Welch t, V2 chi-square with Yates correction).

Both are built from one grouped pass over an unpivoted table: all features in
one job, p-values computed on the small per-feature result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.special import chi2_p_value, t_p_value
from ebbtide.operators.profile import long_values


def welch_t(df: DataFrame, cols: Sequence[str], label: str, with_p: bool = True) -> DataFrame:
    """Welch's unequal-variance t statistic (group 0 minus group 1) and the
    Welch-Satterthwaite degrees of freedom; nulls dropped per feature."""
    long = long_values(df, cols, ids=[label]).where(F.col("value").isNotNull())
    g0 = F.col(label) == 0
    g1 = F.col(label) == 1
    v = F.col("value")
    mom = long.groupBy("feature").agg(
        F.sum(g0.cast("long")).alias("n0"),
        F.sum(g1.cast("long")).alias("n1"),
        F.avg(F.when(g0, v)).alias("mean0"),
        F.avg(F.when(g1, v)).alias("mean1"),
        F.var_samp(F.when(g0, v)).alias("var0"),
        F.var_samp(F.when(g1, v)).alias("var1"),
    )
    se0 = F.col("var0") / F.col("n0")
    se1 = F.col("var1") / F.col("n1")
    out = mom.select(
        "feature", "n0", "n1", "mean0", "mean1", "var0", "var1",
        ((F.col("mean0") - F.col("mean1")) / F.sqrt(se0 + se1)).alias("t"),
        (F.pow(se0 + se1, 2) / (F.pow(se0, 2) / (F.col("n0") - 1) + F.pow(se1, 2) / (F.col("n1") - 1))).alias("dof"),
    )
    if with_p:
        out = out.withColumn("p_value", t_p_value(F.col("t"), F.col("dof")))
    return out


def chi2_independence(df: DataFrame, cats: Sequence[str], label: str, with_p: bool = True) -> DataFrame:
    """Chi-square test of each categorical column against a binary label.

    Observed cells (value x label) come from one grouped pass with the two label
    counts side by side, so empty cells are zeros; marginals are window sums over
    that small table.  Yates' continuity correction applies when dof = 1."""
    long = long_values(df, cats, ids=[label], value_type="string", var="column", val="value")
    cells = (
        long.where(F.col("value").isNotNull() & F.col(label).isNotNull())
        .groupBy("column", "value")
        .agg(
            F.sum((F.col(label) == 0).cast("long")).alias("o0"),
            F.sum((F.col(label) == 1).cast("long")).alias("o1"),
        )
    )
    per_col = Window.partitionBy("column")
    m = cells.select(
        "column", "value", "o0", "o1",
        (F.col("o0") + F.col("o1")).alias("row_n"),
        F.sum("o0").over(per_col).alias("c0"),
        F.sum("o1").over(per_col).alias("c1"),
        F.count(F.lit(1)).over(per_col).alias("r"),
    )
    n = F.col("c0") + F.col("c1")
    ncols = (F.col("c0") > 0).cast("int") + (F.col("c1") > 0).cast("int")
    dof = (F.col("r") - 1) * (ncols - 1)
    e0 = F.col("row_n") * F.col("c0") / n
    e1 = F.col("row_n") * F.col("c1") / n

    def term(o, e):
        diff = F.abs(F.col(o) - e)
        adj = F.when(dof == 1, diff - F.least(F.lit(0.5), diff)).otherwise(diff)
        return F.when(e > 0, F.pow(adj, 2) / e).otherwise(F.lit(0.0))

    stat = m.select("column", dof.alias("dof"), (term("o0", e0) + term("o1", e1)).alias("part"))
    out = stat.groupBy("column").agg(F.sum("part").alias("chi2"), F.first("dof").alias("dof"))
    if with_p:
        out = out.withColumn("p_value", chi2_p_value(F.col("chi2"), F.col("dof")))
    return out
