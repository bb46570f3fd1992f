"""Risk segmentation, KPI strip, customer explorer, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.constants import RISK_HIGH, RISK_LABELS, RISK_MEDIUM
from ebbtide.functions.scalar import at_threshold, churn_label, r6, risk_label, round_half_even


def risk_tiers(scores: DataFrame, by: Sequence[str] = ("model",), p: str = "p", label: str = "churn") -> DataFrame:
    """Customers and churners per risk tier, every tier present even when empty.

    One partial-aggregated pass with conditional counts per group, then a
    3-row ``stack``: no join to a tier spine and no cross join.
    """
    pc = F.col(p)
    tiers = {
        "High Risk": pc >= RISK_HIGH,
        "Medium Risk": (pc >= RISK_MEDIUM) & (pc < RISK_HIGH),
        "Low Risk": pc < RISK_MEDIUM,
    }
    aggs = []
    for i, name in enumerate(RISK_LABELS):
        cond = tiers[name]
        aggs.append(F.sum(F.when(cond, 1).otherwise(0)).alias(f"n{i}"))
        aggs.append(F.sum(F.when(cond, F.col(label)).otherwise(0)).alias(f"c{i}"))
    wide = scores.groupBy(*by).agg(*aggs)
    stack_args = ", ".join(f"'{name}', n{i}, c{i}" for i, name in enumerate(RISK_LABELS))
    long = wide.select(*by, F.expr(f"stack({len(RISK_LABELS)}, {stack_args}) AS (risk_level, customers, churned)"))
    return long.select(
        *by,
        "risk_level",
        F.col("customers").cast("long").alias("customers"),
        F.col("churned").cast("long").alias("churned"),
        r6(F.when(F.col("customers") == 0, F.lit(0.0)).otherwise(F.col("churned") / F.col("customers"))).alias(
            "churn_share"
        ),
    )


def kpi_strip(scores: DataFrame, threshold: Column | float, auc: DataFrame | None = None, p: str = "p",
              label: str = "churn", by: Sequence[str] = ("model",)) -> DataFrame:
    """total, churn rate, predicted churners, mean probability, high-risk count."""
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        r6(F.avg(F.col(label))).alias("churn_rate"),
        F.sum(at_threshold(p, thr)).cast("long").alias("pred_churners"),
        r6(F.avg(F.col(p))).alias("mean_prob"),
        F.sum(F.when(F.col(p) >= RISK_HIGH, 1).otherwise(0)).cast("long").alias("high_risk"),
    )


def explorer_table(scored_features: DataFrame, threshold_col: str, features: Sequence[str],
                   key: str = "cust_id", p: str = "p") -> DataFrame:
    """Customer explorer rows: id, probability x100 (half-even, 1 dp), prediction,
    tier and key features at 2 dp.  The positional ``CUST-%05d`` label is a
    ranking of the natural key; ranking over a window by key alone would move
    every row to one task, so it uses the per-bucket offset ranking instead."""
    from ebbtide.operators.split import key_rank

    present = [f for f in features if f in scored_features.columns]
    r = key_rank(scored_features, key, "_pos")
    pred = at_threshold(p, F.col(threshold_col))
    return r.select(
        F.col(key),
        F.format_string("CUST-%05d", F.col("_pos")).alias("customer_no"),
        round_half_even(F.col(p) * 100, 1).alias("churn_prob"),
        churn_label(pred).alias("predicted"),
        risk_label(p).alias("risk_level"),
        *[round_half_even(F.col(f), 2).alias(f) for f in present],
    )


def filter_explorer(explorer: DataFrame, risk: str = "all", predicted: str = "all") -> DataFrame:
    """Optional conjunctive filter; ``all`` is a no-op.  Adds the shown and total counts."""
    cond = F.lit(True)
    if risk != "all":
        cond = cond & (F.col("risk_level") == risk)
    if predicted != "all":
        cond = cond & (F.col("predicted") == predicted)
    flagged = explorer.withColumn("_keep", cond).withColumn("_one", F.lit(1))
    counts = flagged.groupBy("_one").agg(
        F.sum(F.col("_keep").cast("int")).alias("shown"), F.count(F.lit(1)).alias("total")
    )
    # one-row aggregate: broadcasting it is bounded by construction
    return (
        flagged.where("_keep")
        .drop("_keep")
        .join(F.broadcast(counts), on="_one")
        .drop("_one")
        .withColumn(
            "count_text",
            F.format_string("Showing %s of %s customers.", F.format_number(F.col("shown"), 0),
                            F.format_number(F.col("total"), 0)),
        )
    )


def page(df: DataFrame, order: Sequence[Column], page_no: int, page_size: int = 20) -> DataFrame:
    """Sorted page ``page_no`` (0-based) of a table: top-k plus offset."""
    return df.orderBy(*order).offset(page_no * page_size).limit(page_size)


