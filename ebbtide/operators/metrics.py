"""Evaluation metrics as distributed queries.

Everything ordered by score starts from the score histogram: one row per
(model, distinct score) with positive/negative counts (partial aggregation,
rows <= distinct scores).  Cumulative counts over descending scores use a
two-level prefix sum (equal-count score buckets from approximate quantiles,
bucket offsets from a small table, running sums inside buckets), so no step
puts all rows in one task.

Tie rules follow scikit-learn: one curve point per distinct score (ties
collapse), ROC-AUC by the trapezoid rule (ties get half credit), average
precision by the step sum  sum_n (R_n - R_{n-1}) P_n,  ``zero_division=0``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.constants import COMPOSITE_WEIGHTS
from ebbtide.functions.scalar import safe_div
from ebbtide.operators.scan import prefix_sums

# numpy.linspace(0.01, 0.99, 100) and the calibration edges linspace(0, 1, 11)
SWEEP_GRID = [float(x) for x in np.linspace(0.01, 0.99, 100)]
CALIBRATION_EDGES = [float(x) for x in np.linspace(0.0, 1.0, 11)[1:-1]]
SLIDER_GRID = [float(f"{k / 100:.2f}") for k in range(1, 100)]


def score_histogram(scores: DataFrame, by: Sequence[str] = ("model",), p: str = "p", label: str = "churn") -> DataFrame:
    """(by..., p, pos, neg): one row per distinct score."""
    y = F.col(label)
    return scores.groupBy(*by, p).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("neg"),
    )


def cumulative_confusion(hist: DataFrame, by: Sequence[str] = ("model",), p: str = "p") -> DataFrame:
    """Adds tp, fp = positives / negatives with score >= p (inclusive), and n_pos, n_neg totals (see ``scan``)."""
    by = list(by)
    rows = hist.select(*by, F.col(p).cast("double").alias(p), "pos", "neg")
    return prefix_sums(rows, by, F.col(p).desc(), {"tp": "pos", "fp": "neg"}, {"n_pos": "pos", "n_neg": "neg"})


def roc_auc(cum: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Trapezoid AUC = sum_i neg_i * (tp_i - pos_i / 2) / (P * N)."""
    return cum.groupBy(*by).agg(
        (F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / (F.first("n_pos") * F.first("n_neg"))).alias("roc_auc")
    )


def average_precision(cum: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Step-wise AP = sum_i (pos_i / P) * tp_i / (tp_i + fp_i)."""
    return cum.groupBy(*by).agg(
        F.sum(F.col("pos") / F.col("n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr_auc")
    )


def roc_curve(cum: DataFrame, by: Sequence[str] = ("model",), p: str = "p") -> DataFrame:
    """Unthinned ROC points, plus the (0, 0) start at threshold +inf."""
    pts = cum.select(*by, F.col(p).alias("threshold"), (F.col("fp") / F.col("n_neg")).alias("fpr"),
                     (F.col("tp") / F.col("n_pos")).alias("tpr"))
    start = cum.groupBy(*by).agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                                 F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_curve(cum: DataFrame, by: Sequence[str] = ("model",), p: str = "p") -> DataFrame:
    """Precision/recall per distinct score plus the final (P=1, R=0) point and the base rate."""
    pts = cum.select(*by, F.col(p).alias("threshold"),
                     (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                     (F.col("tp") / F.col("n_pos")).alias("recall"),
                     (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("base_rate"))
    end = cum.groupBy(*by).agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
        (F.first("n_pos") / (F.first("n_pos") + F.first("n_neg"))).alias("base_rate"),
    )
    return pts.unionByName(end)


def best_threshold(cum: DataFrame, by: Sequence[str] = ("model",), p: str = "p", rule: str = "reference",
                   fallback: float = 0.0) -> DataFrame:
    """Threshold maximising F1 over distinct scores (lowest score on ties).

    ``rule="reference"`` returns the distinct score just BELOW the argmax (the
    reference's ``thresholds[idx - 1]``), or ``fallback`` when the argmax is the
    lowest score; ``rule="exact"`` returns the argmax score itself."""
    f1 = safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + (F.col("n_pos") - F.col("tp")))
    scored = cum.select(*by, p, f1.alias("f1"))
    best = scored.groupBy(*by).agg(
        F.max_by(F.col(p), F.struct(F.col("f1"), -F.col(p))).alias("best_score"),
        F.max("f1").alias("best_f1"),
    )
    below = scored.join(best, list(by)).where(F.col(p) < F.col("best_score")).groupBy(*by).agg(
        F.max(p).alias("prev_score")
    )
    out = best.join(below, list(by), "left")
    thr = F.col("best_score") if rule == "exact" else F.coalesce(F.col("prev_score"), F.lit(float(fallback)))
    return out.select(*by, thr.alias("threshold"), "best_score", "best_f1")


def confusion_counts(scores: DataFrame, threshold: Column, by: Sequence[str] = ("model",), p: str = "p",
                     label: str = "churn") -> DataFrame:
    """TN, FP, FN, TP at ``p >= threshold`` from one conditional-sum pass."""
    pred = F.col(p) >= threshold
    y = F.col(label) == 1
    return scores.groupBy(*by).agg(
        F.sum((~pred & ~y).cast("long")).alias("tn"),
        F.sum((pred & ~y).cast("long")).alias("fp"),
        F.sum((~pred & y).cast("long")).alias("fn"),
        F.sum((pred & y).cast("long")).alias("tp"),
    )


def point_metrics(counts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        *by, "tn", "fp", "fn", "tp",
        safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, tp + fn).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion_long(counts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rows actual x predicted, zero-filled by construction."""
    return counts.select(
        *by,
        F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, n)"),
    )


def classification_report(counts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p1, r1 = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    p0, r0 = safe_div(tn, tn + fn), safe_div(tn, tn + fp)
    f1_1 = safe_div(2 * p1 * r1, p1 + r1)
    f1_0 = safe_div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    total = s0 + s1
    base = counts.select(
        *by, p0.alias("p0"), r0.alias("r0"), f1_0.alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f1_1.alias("f1"), s1.alias("s1"),
        safe_div(tp + tn, total).alias("acc"), total.alias("tot"),
    )
    return base.select(
        *by,
        F.expr(
            "stack(5,"
            " 'No Churn', p0, r0, f0, s0,"
            " 'Churn', p1, r1, f1, s1,"
            " 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, tot,"
            " 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot,"
            " 'weighted avg', (p0 * s0 + p1 * s1) / tot, (r0 * s0 + r1 * s1) / tot, (f0 * s0 + f1 * s1) / tot, tot"
            ") AS (class, precision, recall, f1, support)"
        ),
    )


def brier(scores: DataFrame, by: Sequence[str] = ("model",), p: str = "p", label: str = "churn") -> DataFrame:
    m = F.avg(F.col(label))
    return scores.groupBy(*by).agg(
        F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"), (m * (1 - m)).alias("naive_brier")
    )


def calibration(scores: DataFrame, by: Sequence[str] = ("model",), p: str = "p", label: str = "churn",
                edges: Sequence[float] = CALIBRATION_EDGES) -> DataFrame:
    """Uniform bins; bin = number of interior edges strictly below p (an edge value
    goes to the lower bin); empty bins are absent."""
    bin_no = sum(((F.col(p) > F.lit(e)).cast("int") for e in edges), F.lit(0))
    return scores.groupBy(*by, bin_no.alias("bin")).agg(
        F.avg(F.col(label).cast("double")).alias("frac_positive"),
        F.avg(F.col(p)).alias("mean_predicted"),
        F.count(F.lit(1)).alias("n"),
    )


def grid_counts(scores: DataFrame, grid: Sequence[float], by: Sequence[str] = ("model",), p: str = "p",
                label: str = "churn") -> DataFrame:
    """For every grid threshold t_j: tp, fp = rows with p >= t_j (theta join by
    binary search), in ONE pass over the scores.

    Each score falls in one grid cell (``Bucketizer``: cell c holds
    t_{c-1} <= p < t_c), so "p >= t_j" means "cell >= j + 1".  Counts per
    cell form a (#groups x len(grid)+1)-row table; running sums over it give
    the >= counts of each populated cell c, which hold for every j from the
    previous populated cell up to c - 1; thresholds above the top populated
    cell count zero.  One ``explode`` emits the dense grid -- no join and no
    score x grid product."""
    by = list(by)
    g = len(grid)
    splits = [float("-inf"), *grid, float("inf")]
    b = Bucketizer(splits=splits, inputCol="_pd", outputCol="_cell").transform(
        scores.withColumn("_pd", F.col(p).cast("double"))
    )
    y = F.col(label) == 1
    cells = b.groupBy(*by, F.col("_cell").cast("int").alias("cell")).agg(
        F.sum(y.cast("long")).alias("pos"), F.sum((~y).cast("long")).alias("neg")
    )
    down = Window.partitionBy(*by).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*by).orderBy("cell")
    whole = Window.partitionBy(*by)
    c2 = cells.select(
        *by, "cell",
        F.sum("pos").over(down).alias("tp_c"), F.sum("neg").over(down).alias("fp_c"),
        F.coalesce(F.lag("cell").over(up), F.lit(0)).alias("prev"),
        F.max("cell").over(whole).alias("top"),
        F.sum("pos").over(whole).alias("n_pos"), F.sum("neg").over(whole).alias("n_neg"),
    )
    empty = F.array().cast("array<int>")
    own = F.when(F.col("cell") > F.col("prev"), F.sequence(F.col("prev"), F.col("cell") - 1)).otherwise(empty)
    tail = F.when((F.col("cell") == F.col("top")) & (F.col("top") <= g - 1),
                  F.sequence(F.col("top"), F.lit(g - 1))).otherwise(empty)
    entries = F.concat(
        F.transform(own, lambda j: F.struct(j.alias("j"), F.col("tp_c").alias("tp"), F.col("fp_c").alias("fp"))),
        F.transform(tail, lambda j: F.struct(j.alias("j"), F.lit(0).cast("long").alias("tp"),
                                             F.lit(0).cast("long").alias("fp"))),
    )
    grid_arr = F.array(*[F.lit(t) for t in grid])
    out = c2.select(*by, "n_pos", "n_neg", F.explode(entries).alias("e"))
    return out.select(
        *by, F.col("e.j").alias("j"), F.element_at(grid_arr, F.col("e.j") + 1).alias("threshold"),
        F.col("e.tp").cast("long").alias("tp"), F.col("e.fp").cast("long").alias("fp"),
        F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
    )


def sweep_metrics(gc: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    tp, fp, P, N = (F.col(c) for c in ("tp", "fp", "n_pos", "n_neg"))
    fn, tn = P - tp, N - fp
    return gc.select(
        *by, "threshold", "tp", "fp", fn.alias("fn"), tn.alias("tn"),
        safe_div(tp + tn, P + N).alias("accuracy"),
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, P).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def composite_score(m: DataFrame) -> Column:
    w = COMPOSITE_WEIGHTS
    return (F.col("roc_auc") * w["roc_auc"] + F.col("pr_auc") * w["pr_auc"] + F.col("f1") * w["f1"]
            + F.col("recall") * w["recall"] - F.col("brier") * w["brier"])
