"""Evaluation queries over the deterministic ``scored`` view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.constants import COMPOSITE_WEIGHTS
from ebbtide.operators import metrics as M
from ebbtide.plans.common import round_doubles
from ebbtide.plans.fixture_sql import with_views
from ebbtide.plans.fixtures import cust_feat, cust_split, scored
from ebbtide.plans.registry import register


def _lit(x: float) -> str:
    return f"'{x!r}'::DOUBLE"


def scored_split(spark, sf_dir) -> DataFrame:
    """(model, cust_id, churn, p, split); cached because every evaluation query
    derives several aggregates (train thresholds, test curves, counts) from it."""
    s = cust_split(spark, sf_dir).select("cust_id", "split")
    return scored(spark, sf_dir).join(s, "cust_id").cache()


def _cum(df: DataFrame) -> DataFrame:
    return M.cumulative_confusion(M.score_histogram(df))


def train_thresholds(spark, sf_dir, rule="reference", fallback=0.0) -> DataFrame:
    """Per-model decision threshold fitted on TRAIN scores (reference procedure)."""
    tr = scored_split(spark, sf_dir).where(F.col("split") == "train")
    return M.best_threshold(_cum(tr), rule=rule, fallback=fallback)


def test_metrics(spark, sf_dir) -> DataFrame:
    """Per model on TEST rows: AUC, AP, Brier and point metrics at the train threshold."""
    ss = scored_split(spark, sf_dir)
    te = ss.where(F.col("split") == "test")
    thr = train_thresholds(spark, sf_dir).select("model", "threshold")
    cum = _cum(te)
    counts = M.confusion_counts(te.join(F.broadcast(thr), "model"), F.col("threshold"))  # thr: one row per model
    pm = M.point_metrics(counts)
    return (
        M.roc_auc(cum).join(M.average_precision(cum), "model").join(M.brier(te), "model").join(pm, "model")
        .join(thr, "model")
    )


# ---- SQL building blocks ---------------------------------------------------------

SS = "ss AS (SELECT s.model, s.cust_id, s.churn, s.p, c.split FROM scored s JOIN cust_split c ON s.cust_id = c.cust_id)"


def HIST(src: str, name: str = "hist") -> str:
    return (f"{name} AS (SELECT model, p, CAST(sum(churn) AS BIGINT) AS pos, CAST(sum(1 - churn) AS BIGINT) AS neg "
            f"FROM {src} GROUP BY model, p)")


def CUM(src: str = "hist", name: str = "cum") -> str:
    return (f"{name} AS (SELECT model, p, pos, neg, "
            "sum(pos) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp, "
            "sum(neg) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp, "
            "sum(pos) OVER (PARTITION BY model) AS n_pos, sum(neg) OVER (PARTITION BY model) AS n_neg "
            f"FROM {src})")


_TRAIN_SRC = "(SELECT * FROM ss WHERE split = 'train')"
_TEST_SRC = "(SELECT * FROM ss WHERE split = 'test')"
THR = (
    f"{SS}, {HIST(_TRAIN_SRC, 'hist_tr')}, {CUM('hist_tr', 'cum_tr')}, "
    "f1_tr AS (SELECT model, p, CASE WHEN tp + fp + n_pos = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (tp + fp + n_pos) END AS f1 "
    "FROM cum_tr), "
    "best AS (SELECT model, p AS best_score, f1 AS best_f1 FROM (SELECT *, row_number() OVER "
    "(PARTITION BY model ORDER BY f1 DESC, p ASC) AS rn FROM f1_tr) WHERE rn = 1), "
    "prev AS (SELECT b.model, max(f.p) AS prev_score FROM best b JOIN f1_tr f ON f.model = b.model "
    "AND f.p < b.best_score GROUP BY b.model), "
    "thr AS (SELECT b.model, coalesce(prev_score, 0.0) AS threshold, best_score, best_f1 "
    "FROM best b LEFT JOIN prev USING (model))"
)

TEST_COUNTS = (
    "te AS (SELECT ss.*, thr.threshold FROM ss JOIN thr USING (model) WHERE split = 'test'), "
    "cnt AS (SELECT model, min(threshold) AS threshold, "
    "CAST(sum(CASE WHEN p < threshold AND churn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
    "CAST(sum(CASE WHEN p >= threshold AND churn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
    "CAST(sum(CASE WHEN p < threshold AND churn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
    "CAST(sum(CASE WHEN p >= threshold AND churn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM te GROUP BY model)"
)


def _div(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) = 0 THEN 0.0::DOUBLE ELSE CAST({n} AS DOUBLE) / ({d}) END"


POINT_COLS = (
    f"{_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_div('tp', 'tp + fp')} AS precision, "
    f"{_div('tp', 'tp + fn')} AS recall, {_div('2 * tp', '2 * tp + fp + fn')} AS f1"
)

TEST_METRICS = (
    f"{THR}, {TEST_COUNTS}, {HIST('te', 'hist_te')}, {CUM('hist_te', 'cum_te')}, "
    "auc AS (SELECT model, sum(neg * (tp - pos / 2.0)) / (min(n_pos) * min(n_neg)) AS roc_auc, "
    "sum(CAST(pos AS DOUBLE) / n_pos * tp / (tp + fp)) AS pr_auc FROM cum_te GROUP BY model), "
    "br AS (SELECT model, avg((p - churn) * (p - churn)) AS brier FROM te GROUP BY model), "
    f"pm AS (SELECT model, threshold, tn, fp, fn, tp, {POINT_COLS} FROM cnt), "
    "tm AS (SELECT * FROM auc JOIN br USING (model) JOIN pm USING (model))"
)


def sql(body: str, ctes: str = "") -> str:
    text = f"WITH {ctes}\n{body}" if ctes else body
    return with_views(text, "scored", "cust_split")


# ---- W2 cumulative confusion --------------------------------------------------

@register(
    "win_cumulative_confusion",
    sql("SELECT model, round(p, 6) AS p, pos, neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM cum",
        f"{HIST('scored')}, {CUM()}"),
)
def win_cumulative_confusion(spark, sf_dir):
    """TP/FP at every distinct score (scores >= p), descending, ties collapsed."""
    c = _cum(scored(spark, sf_dir))
    return round_doubles(c.select("model", "p", "pos", "neg", "tp", "fp"))


# ---- V7 ROC-AUC, V8 AP, V9 Brier ----------------------------------------------

@register(
    "eval_roc_auc",
    sql("SELECT model, round(sum(neg * (tp - pos / 2.0)) / (min(n_pos) * min(n_neg)), 6) AS roc_auc "
        "FROM cum GROUP BY model", f"{HIST('scored')}, {CUM()}"),
)
def eval_roc_auc(spark, sf_dir):
    return round_doubles(M.roc_auc(_cum(scored(spark, sf_dir))))


@register(
    "eval_average_precision",
    sql("SELECT model, round(sum(CAST(pos AS DOUBLE) / n_pos * tp / (tp + fp)), 6) AS pr_auc FROM cum GROUP BY model",
        f"{HIST('scored')}, {CUM()}"),
)
def eval_average_precision(spark, sf_dir):
    """Step-wise average precision (NOT the trapezoidal areaUnderPR)."""
    return round_doubles(M.average_precision(_cum(scored(spark, sf_dir))))


@register(
    "eval_brier",
    sql("SELECT model, round(avg((p - churn) * (p - churn)), 6) AS brier, "
        "round(avg(churn) * (1 - avg(churn)), 6) AS naive_brier FROM scored GROUP BY model"),
)
def eval_brier(spark, sf_dir):
    return round_doubles(M.brier(scored(spark, sf_dir)))


# ---- V10 / V11 curves ----------------------------------------------------------

@register(
    "eval_roc_curve",
    sql("SELECT model, round(p, 6) AS threshold, round(fp * 1.0 / n_neg, 6) AS fpr, round(tp * 1.0 / n_pos, 6) AS tpr "
        "FROM cum UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 0.0, 0.0 FROM scored",
        f"{HIST('scored')}, {CUM()}"),
)
def eval_roc_curve(spark, sf_dir):
    return round_doubles(M.roc_curve(_cum(scored(spark, sf_dir))))


@register(
    "eval_pr_curve",
    sql("SELECT model, round(p, 6) AS threshold, round(tp * 1.0 / (tp + fp), 6) AS precision, "
        "round(tp * 1.0 / n_pos, 6) AS recall, round(n_pos * 1.0 / (n_pos + n_neg), 6) AS base_rate FROM cum "
        "UNION ALL SELECT model, NULL, 1.0, 0.0, round(avg(churn), 6) FROM scored GROUP BY model",
        f"{HIST('scored')}, {CUM()}"),
)
def eval_pr_curve(spark, sf_dir):
    return round_doubles(M.pr_curve(_cum(scored(spark, sf_dir))))


# ---- V3 best threshold ----------------------------------------------------------

@register(
    "eval_best_threshold",
    sql("SELECT model, round(threshold, 6) AS threshold, round(best_score, 6) AS exact_threshold, "
        "round(best_f1, 6) AS best_f1 FROM thr", THR),
)
def eval_best_threshold(spark, sf_dir):
    """Best-F1 threshold on TRAIN scores: reference rule (one below the argmax,
    0.0 fallback) and the exact argmax."""
    t = train_thresholds(spark, sf_dir)
    return round_doubles(t.select("model", "threshold", F.col("best_score").alias("exact_threshold"), "best_f1"))


# ---- V4 / V5 / V6 point metrics, confusion, class report ---------------------------

@register("eval_point_metrics", sql(
    "SELECT model, round(threshold, 6) AS threshold, tn, fp, fn, tp, round(accuracy, 6) AS accuracy, "
    "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pm",
    f"{THR}, {TEST_COUNTS}, pm AS (SELECT model, threshold, tn, fp, fn, tp, {POINT_COLS} FROM cnt)"))
def eval_point_metrics(spark, sf_dir):
    """Accuracy / precision / recall / F1 on TEST rows at the train-fitted threshold."""
    te = scored_split(spark, sf_dir).where(F.col("split") == "test")
    thr = train_thresholds(spark, sf_dir).select("model", "threshold")
    counts = M.confusion_counts(te.join(F.broadcast(thr), "model"), F.col("threshold"))
    return round_doubles(M.point_metrics(counts).join(thr, "model"))


@register("eval_confusion", sql(
    "SELECT model, a.actual, a.predicted, CAST(CASE WHEN a.actual = 0 AND a.predicted = 0 THEN tn "
    "WHEN a.actual = 0 THEN fp WHEN a.predicted = 0 THEN fn ELSE tp END AS BIGINT) AS n "
    "FROM cnt, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) a(actual, predicted)",
    f"{THR}, {TEST_COUNTS}"))
def eval_confusion(spark, sf_dir):
    te = scored_split(spark, sf_dir).where(F.col("split") == "test")
    thr = train_thresholds(spark, sf_dir).select("model", "threshold")
    counts = M.confusion_counts(te.join(F.broadcast(thr), "model"), F.col("threshold"))
    out = M.confusion_long(counts)
    return out.select("model", F.col("actual").cast("int").alias("actual"),
                      F.col("predicted").cast("int").alias("predicted"), F.col("n").cast("long").alias("n"))


REPORT_SQL = f"""
SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM (
  SELECT model, 'No Churn' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM rp
  UNION ALL SELECT model, 'Churn', p1, r1, f1, s1 FROM rp
  UNION ALL SELECT model, 'accuracy', NULL, NULL, acc, tot FROM rp
  UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot FROM rp
  UNION ALL SELECT model, 'weighted avg', (p0 * s0 + p1 * s1) / tot, (r0 * s0 + r1 * s1) / tot,
    (f0 * s0 + f1 * s1) / tot, tot FROM rp
)"""

REPORT_CTE = (
    "r0 AS (SELECT model, tn, fp, fn, tp, "
    f"{_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1, {_div('tn', 'tn + fn')} AS p0, "
    f"{_div('tn', 'tn + fp')} AS r0, tp + fn AS s1, tn + fp AS s0, tn + fp + fn + tp AS tot, "
    f"{_div('tp + tn', 'tn + fp + fn + tp')} AS acc FROM cnt), "
    f"rp AS (SELECT *, {_div('2 * p1 * r1', 'p1 + r1')} AS f1, {_div('2 * p0 * r0', 'p0 + r0')} AS f0 FROM r0)"
)


@register("eval_class_report", sql(REPORT_SQL, f"{THR}, {TEST_COUNTS}, {REPORT_CTE}"))
def eval_class_report(spark, sf_dir):
    te = scored_split(spark, sf_dir).where(F.col("split") == "test")
    thr = train_thresholds(spark, sf_dir).select("model", "threshold")
    counts = M.confusion_counts(te.join(F.broadcast(thr), "model"), F.col("threshold"))
    rep = M.classification_report(counts)
    return round_doubles(rep.select("model", "class", "precision", "recall", "f1",
                                    F.col("support").cast("long").alias("support")))


# ---- V12 calibration ------------------------------------------------------------

CAL_BIN = " + ".join(f"CAST(p > {_lit(e)} AS INTEGER)" for e in M.CALIBRATION_EDGES)


@register("eval_calibration", sql(
    f"SELECT model, CAST({CAL_BIN} AS INTEGER) AS bin, round(avg(churn * 1.0), 6) AS frac_positive, "
    f"round(avg(p), 6) AS mean_predicted, count(*) AS n FROM scored GROUP BY model, {CAL_BIN}"))
def eval_calibration(spark, sf_dir):
    return round_doubles(M.calibration(scored(spark, sf_dir)))


# ---- J5 / V13 / V14 threshold sweeps ----------------------------------------------

def _grid_sql(grid, name="grid"):
    vals = ", ".join(f"({j}, {_lit(t)})" for j, t in enumerate(grid))
    return f"{name} AS (SELECT * FROM (VALUES {vals}) g(j, threshold))"


SWEEP_COUNTS = (
    "sw AS (SELECT s.model, g.threshold, "
    "CAST(sum(CASE WHEN s.p >= g.threshold AND s.churn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
    "CAST(sum(CASE WHEN s.p >= g.threshold AND s.churn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
    "CAST(sum(s.churn) AS BIGINT) AS n_pos, CAST(sum(1 - s.churn) AS BIGINT) AS n_neg "
    "FROM {src} s, grid g GROUP BY s.model, g.threshold)"
)


@register("join_theta_threshold_sweep", sql(
    "SELECT model, round(threshold, 6) AS threshold, tp, fp FROM sw",
    f"{_grid_sql(M.SWEEP_GRID)}, {SWEEP_COUNTS.format(src='scored')}"))
def join_theta_threshold_sweep(spark, sf_dir):
    """Every score x every grid threshold (p >= t), counted without the product."""
    gc = M.grid_counts(scored(spark, sf_dir), M.SWEEP_GRID)
    return round_doubles(gc.select("model", "threshold", "tp", "fp"))


SWEEP_METRICS_SQL = (
    "SELECT model, round(threshold, 6) AS threshold, tp, fp, n_pos - tp AS fn, n_neg - fp AS tn, "
    f"round({_div('tp + n_neg - fp', 'n_pos + n_neg')}, 6) AS accuracy, "
    f"round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('tp', 'n_pos')}, 6) AS recall, "
    f"round({_div('2 * tp', '2 * tp + fp + n_pos - tp')}, 6) AS f1 FROM sw"
)


@register("eval_threshold_sweep", sql(
    SWEEP_METRICS_SQL,
    f"{SS}, {_grid_sql(M.SWEEP_GRID)}, {SWEEP_COUNTS.format(src=_TEST_SRC)}"))
def eval_threshold_sweep(spark, sf_dir):
    """F1 (and the other point metrics) at 100 thresholds linspace(0.01, 0.99) on TEST rows."""
    te = scored_split(spark, sf_dir).where(F.col("split") == "test")
    return round_doubles(M.sweep_metrics(M.grid_counts(te, M.SWEEP_GRID)))


@register("eval_slider_table", sql(
    SWEEP_METRICS_SQL,
    f"{SS}, {_grid_sql(M.SLIDER_GRID)}, {SWEEP_COUNTS.format(src=_TEST_SRC)}"))
def eval_slider_table(spark, sf_dir):
    """Live metrics for every slider position 0.01..0.99 (step 0.01): one 99-row
    table per model from one pass; a slider move is a lookup."""
    te = scored_split(spark, sf_dir).where(F.col("split") == "test")
    return round_doubles(M.sweep_metrics(M.grid_counts(te, M.SLIDER_GRID)))


# ---- V15 composite leaderboard, V16 business impact, T1 sort, X2 union -----------

W = COMPOSITE_WEIGHTS
COMPOSITE_SQL = (f"(roc_auc * {W['roc_auc']} + pr_auc * {W['pr_auc']} + f1 * {W['f1']} + recall * {W['recall']} "
                 f"- brier * {W['brier']})")


@register("eval_composite_rank", sql(
    f"SELECT model, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(f1, 6) AS f1, "
    f"round(recall, 6) AS recall, round(brier, 6) AS brier, round({COMPOSITE_SQL}, 6) AS composite, "
    f"CAST(row_number() OVER (ORDER BY {COMPOSITE_SQL} DESC, model) AS INTEGER) AS rank FROM tm",
    TEST_METRICS))
def eval_composite_rank(spark, sf_dir):
    """0.35 AUC + 0.25 AP + 0.20 F1 + 0.15 recall - 0.05 Brier; rank 1 = best model."""
    tm = test_metrics(spark, sf_dir)
    scored_models = tm.select("model", "roc_auc", "pr_auc", "f1", "recall", "brier",
                              M.composite_score(tm).alias("composite"))
    from pyspark.sql import Window

    w = Window.orderBy(F.col("composite").desc(), F.col("model"))  # one row per model
    return round_doubles(scored_models.withColumn("rank", F.row_number().over(w).cast("int")))


@register("report_business_impact", sql(
    "SELECT model, round(threshold, 6) AS threshold, tp, fn, fp, tn, "
    f"round({_div('tp', 'tp + fn')}, 6) AS recall, round({_div('tp', 'tp + fp')}, 6) AS precision, "
    f"round({_div('fp', 'fp + tn')}, 6) AS false_alarm_rate "
    f"FROM tm ORDER BY {COMPOSITE_SQL} DESC, model LIMIT 1",
    TEST_METRICS))
def report_business_impact(spark, sf_dir):
    """Churners caught / missed and false alarms for the best model (top composite)."""
    tm = test_metrics(spark, sf_dir)
    best = tm.orderBy(M.composite_score(tm).desc(), F.col("model")).limit(1)
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    from ebbtide.functions.scalar import safe_div

    return round_doubles(best.select(
        "model", "threshold", "tp", "fn", "fp", "tn",
        safe_div(tp, tp + fn).alias("recall"), safe_div(tp, tp + fp).alias("precision"),
        safe_div(fp, fp + tn).alias("false_alarm_rate"),
    ))


@register("sort_model_leaderboard", sql(
    "SELECT model, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(f1, 6) AS f1, "
    "CAST(row_number() OVER (ORDER BY roc_auc DESC, model) AS INTEGER) AS position FROM tm",
    TEST_METRICS))
def sort_model_leaderboard(spark, sf_dir):
    """Models sorted by test ROC-AUC (descending, name as tie-break)."""
    tm = test_metrics(spark, sf_dir)
    from pyspark.sql import Window

    w = Window.orderBy(F.col("roc_auc").desc(), F.col("model"))  # one row per model
    return round_doubles(tm.select("model", "roc_auc", "pr_auc", "f1",
                                   F.row_number().over(w).cast("int").alias("position")))


@register("set_union_model_metrics", sql(
    "SELECT model, metric, round(value, 6) AS value FROM ("
    "SELECT model, 'roc_auc' AS metric, roc_auc AS value FROM tm UNION ALL SELECT model, 'pr_auc', pr_auc FROM tm "
    "UNION ALL SELECT model, 'f1', f1 FROM tm UNION ALL SELECT model, 'recall', recall FROM tm "
    "UNION ALL SELECT model, 'brier', brier FROM tm)",
    TEST_METRICS))
def set_union_model_metrics(spark, sf_dir):
    """Per-model metric records stacked into one long table (union by name)."""
    tm = test_metrics(spark, sf_dir)
    parts = [tm.select("model", F.lit(m).alias("metric"), F.col(m).alias("value"))
             for m in ("roc_auc", "pr_auc", "f1", "recall", "brier")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return round_doubles(out)


# ---- T6 extreme customers, T7 exact-n sample ------------------------------------------

@register("topk_extreme_customers", sql(
    "SELECT model, arg_max(cust_id, (p, -cust_id)) AS top_customer, round(max(p), 6) AS top_p, "
    "arg_min(cust_id, (p, cust_id)) AS bottom_customer, round(min(p), 6) AS bottom_p FROM scored GROUP BY model"))
def topk_extreme_customers(spark, sf_dir):
    """Highest- and lowest-probability customer per model (first key on ties)."""
    s = scored(spark, sf_dir)
    return round_doubles(s.groupBy("model").agg(
        F.max_by("cust_id", F.struct(F.col("p"), -F.col("cust_id"))).alias("top_customer"),
        F.max("p").alias("top_p"),
        F.min_by("cust_id", F.struct(F.col("p"), F.col("cust_id"))).alias("bottom_customer"),
        F.min("p").alias("bottom_p"),
    ))


@register("sample_exact_n", with_views(
    "SELECT cust_id, churn, round(rev_Mean, 6) AS rev_Mean FROM cust_feat "
    "ORDER BY md5('42|' || CAST(cust_id AS VARCHAR)), cust_id LIMIT 500", "cust_feat"))
def sample_exact_n(spark, sf_dir):
    """Exactly n rows without replacement, seeded: the n smallest md5(seed|key)
    (a top-k, so each task keeps only its own n candidates)."""
    f = cust_feat(spark, sf_dir)
    h = F.md5(F.concat(F.lit("42|"), F.col("cust_id").cast("string")))
    return round_doubles(f.orderBy(h, F.col("cust_id")).limit(500).select("cust_id", "churn", "rev_Mean"))
