"""Metric operators against hand-worked values and brute force."""

import math
import random

from pyspark.sql import functions as F

from ebbtide.operators import metrics as M
from ebbtide.operators.stats import chi2_independence, welch_t


def _brute_auc(rows):
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _brute_ap(rows):
    thr = sorted({p for p, _ in rows}, reverse=True)
    P = sum(y for _, y in rows)
    ap, prev_r = 0.0, 0.0
    for t in thr:
        tp = sum(1 for p, y in rows if p >= t and y == 1)
        fp = sum(1 for p, y in rows if p >= t and y == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def _frame(spark, rows):
    return spark.createDataFrame([("m", p, y) for p, y in rows], "model string, p double, churn int")


def test_auc_ap_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), rng.randint(0, 1)) for _ in range(300)]
    cum = M.cumulative_confusion(M.score_histogram(_frame(spark, rows)))
    auc = M.roc_auc(cum).first()["roc_auc"]
    ap = M.average_precision(cum).first()["pr_auc"]
    assert math.isclose(auc, _brute_auc(rows), rel_tol=1e-12)
    assert math.isclose(ap, _brute_ap(rows), rel_tol=1e-12)


def test_all_tied_scores(spark):
    rows = [(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0), (0.5, 0)]
    cum = M.cumulative_confusion(M.score_histogram(_frame(spark, rows)))
    assert math.isclose(M.roc_auc(cum).first()["roc_auc"], 0.5)
    assert math.isclose(M.average_precision(cum).first()["pr_auc"], 0.4)


def test_auc_invariant_under_monotone_map(spark):
    rng = random.Random(5)
    rows = [(rng.random(), rng.randint(0, 1)) for _ in range(200)]
    a = M.roc_auc(M.cumulative_confusion(M.score_histogram(_frame(spark, rows)))).first()[1]
    rows2 = [(p ** 3, y) for p, y in rows]
    b = M.roc_auc(M.cumulative_confusion(M.score_histogram(_frame(spark, rows2)))).first()[1]
    assert math.isclose(a, b, rel_tol=1e-12)


def test_best_threshold_fallback_at_index_zero(spark):
    # the argmax F1 is at the lowest score (predict everything positive) -> fallback
    rows = [(0.1, 1), (0.2, 1), (0.3, 0), (0.4, 1)]
    cum = M.cumulative_confusion(M.score_histogram(_frame(spark, rows)))
    t = M.best_threshold(cum, fallback=0.0).first()
    assert t["best_score"] == 0.1 and t["threshold"] == 0.0
    t5 = M.best_threshold(cum, fallback=0.5).first()
    assert t5["threshold"] == 0.5


def test_best_threshold_one_below_argmax(spark):
    rows = [(0.1, 0), (0.2, 0), (0.6, 1), (0.7, 1), (0.8, 0)]
    cum = M.cumulative_confusion(M.score_histogram(_frame(spark, rows)))
    t = M.best_threshold(cum).first()
    assert t["best_score"] == 0.6 and t["threshold"] == 0.2
    assert M.best_threshold(cum, rule="exact").first()["threshold"] == 0.6


def test_confusion_identity(spark):
    counts = spark.createDataFrame([("m", 4618, 5470, 2006, 7906)], "model string, tn long, fp long, fn long, tp long")
    r = M.point_metrics(counts).first()
    assert round(r["recall"], 4) == 0.7976
    assert round(r["precision"], 4) == 0.5911
    assert round(r["f1"], 4) == 0.6790


def test_calibration_edge_goes_to_lower_bin(spark):
    df = _frame(spark, [(0.5, 1), (0.51, 0), (0.1, 0)])
    bins = {r["mean_predicted"]: r["bin"] for r in M.calibration(df).collect()}
    assert bins[0.5] == 4 and bins[0.51] == 5 and bins[0.1] == 0


def test_grid_counts_match_theta_join(spark):
    rng = random.Random(11)
    rows = [(round(rng.random(), 2), rng.randint(0, 1)) for _ in range(400)]
    gc = {r["threshold"]: (r["tp"], r["fp"]) for r in M.grid_counts(_frame(spark, rows), M.SWEEP_GRID).collect()}
    for t in M.SWEEP_GRID:
        tp = sum(1 for p, y in rows if p >= t and y == 1)
        fp = sum(1 for p, y in rows if p >= t and y == 0)
        assert gc[t] == (tp, fp)


def test_welch_equal_means_zero_t(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 1.0), (1, 2.0), (1, 3.0)], "churn int, x double")
    r = welch_t(df, ["x"], "churn").first()
    assert r["t"] == 0.0 and math.isclose(r["p_value"], 1.0)


def test_chi2_2x2_yates(spark):
    # a: (y0=10, y1=20), b: (y0=30, y1=15)
    data = [("a", 0)] * 10 + [("a", 1)] * 20 + [("b", 0)] * 30 + [("b", 1)] * 15
    df = spark.createDataFrame(data, "c string, churn int")
    r = chi2_independence(df, ["c"], "churn").first()
    obs = [[10, 20], [30, 15]]
    n = 75
    rows = [sum(x) for x in obs]
    cols = [40, 35]
    chi = 0.0
    for i in range(2):
        for j in range(2):
            e = rows[i] * cols[j] / n
            chi += (max(abs(obs[i][j] - e) - 0.5, 0)) ** 2 / e
    assert r["dof"] == 1 and math.isclose(r["chi2"], chi, rel_tol=1e-12)


def test_prefix_sums_not_single_partition(spark):
    rows = [(i / 1000.0, i % 2) for i in range(1000)]
    cum = M.cumulative_confusion(M.score_histogram(_frame(spark, rows)))
    top = cum.orderBy(F.col("p").desc()).first()
    assert top["tp"] == 1 and top["fp"] == 0  # 0.999 has label 1
    low = cum.orderBy("p").first()
    assert low["tp"] == 500 and low["fp"] == 500
