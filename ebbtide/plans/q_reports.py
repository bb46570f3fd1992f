"""Reports: risk tiers (flagship), KPI strip, dataset summary, explorer, paging, CV pivot."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbtide.functions.constants import EXPLORER_FEATURES
from ebbtide.operators import metrics as M
from ebbtide.operators.report import explorer_table, filter_explorer, kpi_strip, page, risk_tiers
from ebbtide.operators.split import kfold
from ebbtide.plans.common import round_doubles
from ebbtide.plans.fixture_sql import with_views
from ebbtide.plans.fixtures import cust_feat, cust_split, scored
from ebbtide.plans.q_eval import (
    COMPOSITE_SQL,
    SS,
    TEST_METRICS,
    scored_split,
    sql,
    test_metrics,
    train_thresholds,
)
from ebbtide.plans.registry import register

RISK_TIERS_SQL = with_views(
    """
SELECT model, risk_level, customers, churned,
  round(CASE WHEN customers = 0 THEN 0.0 ELSE churned / customers END, 6) AS churn_share
FROM (
  SELECT model, t.risk_level,
    CAST(sum(CASE WHEN t.hit THEN 1 ELSE 0 END) AS BIGINT) AS customers,
    CAST(sum(CASE WHEN t.hit THEN churn ELSE 0 END) AS BIGINT) AS churned
  FROM scored,
  LATERAL (VALUES ('High Risk', p >= 0.70),
                  ('Medium Risk', p >= 0.40 AND p < 0.70),
                  ('Low Risk', p < 0.40)) AS t(risk_level, hit)
  GROUP BY model, t.risk_level
)
""",
    "scored",
)


@register("agg_risk_tiers", RISK_TIERS_SQL)
def agg_risk_tiers(spark, sf_dir):
    """How many customers fall in each risk tier, and what share really left."""
    return risk_tiers(scored(spark, sf_dir))


# ---------------------------------------------------------------------------
# KPI strip, dataset summary, customer explorer, filter, page, CSV export,
# CV summary and pivot, tuning summary
# ---------------------------------------------------------------------------

@register("agg_kpi_strip", sql(
    "SELECT t.model, (SELECT count(*) FROM cust_split) AS total, "
    "(SELECT round(avg(churn), 6) FROM cust_split) AS churn_rate, "
    "CAST(sum(CASE WHEN t.p >= t.threshold THEN 1 ELSE 0 END) AS BIGINT) AS pred_churners, "
    "round(avg(t.p), 6) AS mean_prob, CAST(sum(CASE WHEN t.p >= 0.70 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk, "
    "round(min(tm.roc_auc), 6) AS roc_auc, round(min(tm.f1), 6) AS f1 "
    "FROM te t JOIN tm ON t.model = tm.model GROUP BY t.model",
    TEST_METRICS))
def agg_kpi_strip(spark, sf_dir):
    """Total and churn rate of the whole table; predicted churners, mean probability,
    high-risk count, AUC and F1 of its test rows."""
    te = scored_split(spark, sf_dir).where(F.col("split") == "test")
    thr = train_thresholds(spark, sf_dir).select("model", "threshold")
    k = kpi_strip(te.join(F.broadcast(thr), "model"), F.col("threshold")).drop("total", "churn_rate")
    whole = cust_split(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.avg("churn").alias("churn_rate")).first()
    k = k.withColumns({"total": F.lit(whole["total"]), "churn_rate": F.lit(whole["churn_rate"])})
    tm = test_metrics(spark, sf_dir).select("model", "roc_auc", "f1")
    return round_doubles(k.join(tm, "model"))


SUMMARY_STATS = ("total_records", "churned", "not_churned", "train_size", "test_size", "input_features",
                 "optimal_threshold", "roc_auc", "pr_auc", "f1", "recall", "precision")

#: Width of the model matrix: 43 inputs and the text column, one column each after encoding, and 24 engineered ones.
N_MODEL_FEATURES = 68


@register("agg_dataset_summary", sql(
    f"""
SELECT statistic, round(value, 6) AS value, best_model FROM (
  SELECT b.model AS best_model, k.* FROM
    (SELECT model FROM tm ORDER BY {COMPOSITE_SQL} DESC, model LIMIT 1) b,
    (SELECT count(*) AS total_records, sum(churn) AS churned, count(*) - sum(churn) AS not_churned,
       sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS train_size,
       sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS test_size, {N_MODEL_FEATURES} AS input_features
     FROM cust_split) c,
    LATERAL (SELECT * FROM tm WHERE tm.model = b.model) m,
    LATERAL (VALUES ('total_records', c.total_records::DOUBLE), ('churned', c.churned::DOUBLE),
      ('not_churned', c.not_churned::DOUBLE), ('train_size', c.train_size::DOUBLE),
      ('test_size', c.test_size::DOUBLE), ('input_features', c.input_features::DOUBLE),
      ('optimal_threshold', m.threshold), ('roc_auc', m.roc_auc), ('pr_auc', m.pr_auc), ('f1', m.f1),
      ('recall', m.recall), ('precision', m.precision)) AS k(statistic, value)
)
""",
    TEST_METRICS))
def agg_dataset_summary(spark, sf_dir):
    """Statistic/value table: sizes, split, width of the model matrix, best model and its metrics."""
    from ebbtide.operators.models import feature_columns
    from ebbtide.operators.preprocess import ID_COLS
    from ebbtide.plans.q_models import processed

    s = cust_split(spark, sf_dir)
    sizes = s.agg(
        F.count(F.lit(1)).cast("double").alias("total_records"),
        F.sum("churn").cast("double").alias("churned"),
        (F.count(F.lit(1)) - F.sum("churn")).cast("double").alias("not_churned"),
        F.sum((F.col("split") == "train").cast("int")).cast("double").alias("train_size"),
        F.sum((F.col("split") == "test").cast("int")).cast("double").alias("test_size"),
        F.lit(float(len(feature_columns(processed(spark, sf_dir), ID_COLS)))).alias("input_features"),
        F.lit(1).alias("_k"),
    )
    tm = test_metrics(spark, sf_dir)
    best = tm.orderBy(M.composite_score(tm).desc(), F.col("model")).limit(1).select(
        F.col("model").alias("best_model"), F.col("threshold").alias("optimal_threshold"),
        "roc_auc", "pr_auc", "f1", "recall", "precision", F.lit(1).alias("_k"),
    )
    wide = sizes.join(best, "_k")  # one row each
    stack = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in SUMMARY_STATS)
    return round_doubles(wide.select(F.expr(f"stack({len(SUMMARY_STATS)}, {stack}) AS (statistic, value)"),
                                     "best_model"))


def _explorer(spark, sf_dir):
    """Explorer rows for model A's test customers at the train-fitted threshold."""
    te = scored_split(spark, sf_dir).where((F.col("split") == "test") & (F.col("model") == "A"))
    thr = train_thresholds(spark, sf_dir).where(F.col("model") == "A").select("threshold")
    feats = cust_feat(spark, sf_dir).select("cust_id", *EXPLORER_FEATURES)
    base = te.join(F.broadcast(thr.withColumn("model", F.lit("A"))), "model")  # one-row threshold table
    return explorer_table(base.join(feats, "cust_id"), "threshold", EXPLORER_FEATURES)


EXPLORER_SQL_CTE = (
    "ex AS (SELECT t.cust_id, printf('CUST-%05d', row_number() OVER (ORDER BY t.cust_id)) AS customer_no, "
    "round_even(t.p * 100 * 10.0, 0) / 10.0 AS churn_prob, "
    "CASE WHEN t.p >= t.threshold THEN 'Churn' ELSE 'No Churn' END AS predicted, "
    "CASE WHEN t.p >= 0.70 THEN 'High Risk' WHEN t.p >= 0.40 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level, "
    + ", ".join(f"round_even(f.\"{c}\" * 100.0, 0) / 100.0 AS \"{c}\"" for c in EXPLORER_FEATURES)
    + " FROM te t JOIN cust_feat f ON t.cust_id = f.cust_id WHERE t.model = 'A')"
)


@register("report_customer_explorer", sql("SELECT * FROM ex", f"{TEST_METRICS}, {EXPLORER_SQL_CTE}"))
def report_customer_explorer(spark, sf_dir):
    """Id, probability x100 (1 dp, half-even), prediction, tier and 10 key features (2 dp)."""
    return _explorer(spark, sf_dir)


@register("filter_customer_explorer", sql(
    "SELECT *, count(*) OVER () AS shown, (SELECT count(*) FROM ex) AS total, "
    "'Showing ' || format('{:,}', count(*) OVER ()) || ' of ' || format('{:,}', (SELECT count(*) FROM ex)) "
    "|| ' customers.' AS count_text FROM ex WHERE risk_level = 'Medium Risk' AND predicted = 'Churn'",
    f"{TEST_METRICS}, {EXPLORER_SQL_CTE}"))
def filter_customer_explorer(spark, sf_dir):
    """Risk AND prediction filter ('all' = no-op) with the 'n of N' count."""
    return filter_explorer(_explorer(spark, sf_dir), risk="Medium Risk", predicted="Churn")


@register("page_customer_explorer", sql(
    "SELECT * FROM ex ORDER BY churn_prob DESC, cust_id LIMIT 20 OFFSET 20",
    f"{TEST_METRICS}, {EXPLORER_SQL_CTE}"))
def page_customer_explorer(spark, sf_dir):
    """Second page (20 rows) of the explorer sorted by probability."""
    return page(_explorer(spark, sf_dir), [F.col("churn_prob").desc(), F.col("cust_id")], page_no=1)


@register("sink_csv_export", sql(
    "SELECT *, count(*) OVER () AS shown, (SELECT count(*) FROM ex) AS total, "
    "'Showing ' || format('{:,}', count(*) OVER ()) || ' of ' || format('{:,}', (SELECT count(*) FROM ex)) "
    "|| ' customers.' AS count_text FROM ex WHERE risk_level = 'High Risk'",
    f"{TEST_METRICS}, {EXPLORER_SQL_CTE}"))
def sink_csv_export(spark, sf_dir):
    """The filtered explorer view exported as CSV (header), read back with the view's types."""
    import uuid

    from ebbtide.session import scratch_path
    from ebbtide.sources.io import write_csv

    path = scratch_path(spark, f"export-{uuid.uuid4().hex[:12]}")
    view = filter_explorer(_explorer(spark, sf_dir), risk="High Risk")
    write_csv(view, path)
    return spark.read.schema(view.schema).option("header", True).csv(path)


# ---- A15 CV summary (3 folds over train rows), R1 pivot -----------------------------

def fold_metrics(spark, sf_dir):
    """Per (model, validation fold): ROC-AUC, AP and F1 at the best threshold of the
    fold's own scores, over the 3 stratified folds of the train rows."""
    tr = scored_split(spark, sf_dir).where(F.col("split") == "train")
    folds = kfold(cust_split(spark, sf_dir).where(F.col("split") == "train").select("cust_id", "churn"),
                  "cust_id", "churn", 3, seed=44).select("cust_id", F.col("fold").cast("int").alias("fold"))
    v = tr.join(folds, "cust_id")
    cum = M.cumulative_confusion(M.score_histogram(v, by=("model", "fold")), by=("model", "fold"))
    auc = M.roc_auc(cum, by=("model", "fold"))
    ap = M.average_precision(cum, by=("model", "fold"))
    thr = M.best_threshold(cum, by=("model", "fold")).select("model", "fold", "threshold")
    cnt = M.confusion_counts(v.join(F.broadcast(thr), ["model", "fold"]), F.col("threshold"), by=("model", "fold"))
    pm = M.point_metrics(cnt, by=("model", "fold")).select("model", "fold", "f1")
    return auc.join(ap, ["model", "fold"]).join(pm, ["model", "fold"])


FOLD_SQL = """
ss3 AS (
  SELECT ss.*, CAST((row_number() OVER (PARTITION BY ss.model, ss.churn
      ORDER BY md5('44|' || CAST(ss.cust_id AS VARCHAR)), ss.cust_id) - 1) % 3 AS INTEGER) AS fold
  FROM ss WHERE split = 'train'
),
h3 AS (SELECT model, fold, p, CAST(sum(churn) AS BIGINT) AS pos, CAST(sum(1 - churn) AS BIGINT) AS neg
       FROM ss3 GROUP BY model, fold, p),
c3 AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY model, fold) AS n_pos, sum(neg) OVER (PARTITION BY model, fold) AS n_neg
       FROM h3 WINDOW w AS (PARTITION BY model, fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
f3 AS (SELECT model, fold, p, CASE WHEN tp + fp + n_pos = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (tp + fp + n_pos) END AS f1
       FROM c3),
b3 AS (SELECT model, fold, p AS best FROM (SELECT *, row_number() OVER (PARTITION BY model, fold
       ORDER BY f1 DESC, p) AS rn FROM f3) WHERE rn = 1),
t3 AS (SELECT b3.model, b3.fold, coalesce(max(f3.p), 0.0) AS thr FROM b3 LEFT JOIN f3
       ON f3.model = b3.model AND f3.fold = b3.fold AND f3.p < b3.best GROUP BY b3.model, b3.fold),
m3 AS (
  SELECT a.model, a.fold, a.roc_auc, a.pr_auc, f.f1 FROM
    (SELECT model, fold, sum(neg * (tp - pos / 2.0)) / (min(n_pos) * min(n_neg)) AS roc_auc,
            sum(CAST(pos AS DOUBLE) / n_pos * tp / (tp + fp)) AS pr_auc FROM c3 GROUP BY model, fold) a
  JOIN (SELECT s.model, s.fold,
          CASE WHEN 2 * sum(CASE WHEN s.p >= t.thr AND s.churn = 1 THEN 1 ELSE 0 END)
                    + sum(CASE WHEN s.p >= t.thr AND s.churn = 0 THEN 1 ELSE 0 END)
                    + sum(CASE WHEN s.p < t.thr AND s.churn = 1 THEN 1 ELSE 0 END) = 0 THEN 0.0
               ELSE CAST(2 * sum(CASE WHEN s.p >= t.thr AND s.churn = 1 THEN 1 ELSE 0 END) AS DOUBLE) /
                    (2 * sum(CASE WHEN s.p >= t.thr AND s.churn = 1 THEN 1 ELSE 0 END)
                    + sum(CASE WHEN s.p >= t.thr AND s.churn = 0 THEN 1 ELSE 0 END)
                    + sum(CASE WHEN s.p < t.thr AND s.churn = 1 THEN 1 ELSE 0 END)) END AS f1
        FROM ss3 s JOIN t3 t ON s.model = t.model AND s.fold = t.fold GROUP BY s.model, s.fold) f
  ON a.model = f.model AND a.fold = f.fold
)"""


@register("agg_cv_summary", sql(
    "SELECT model, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS folds FROM ("
    "SELECT model, 'roc_auc' AS metric, roc_auc AS value FROM m3 UNION ALL "
    "SELECT model, 'pr_auc', pr_auc FROM m3 UNION ALL SELECT model, 'f1', f1 FROM m3) GROUP BY model, metric",
    f"{SS}, {FOLD_SQL}"))
def agg_cv_summary(spark, sf_dir):
    """Fold mean and POPULATION std of each metric; per-fold rows are kept upstream."""
    fm = fold_metrics(spark, sf_dir)
    long = fm.unpivot(["model", "fold"], ["roc_auc", "pr_auc", "f1"], "metric", "value")
    return round_doubles(long.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("folds")
    ))


@register("report_cv_pivot", sql(
    "SELECT model, round(avg(roc_auc), 6) AS roc_auc, round(avg(pr_auc), 6) AS pr_auc, round(avg(f1), 6) AS f1 "
    "FROM m3 GROUP BY model",
    f"{SS}, {FOLD_SQL}"))
def report_cv_pivot(spark, sf_dir):
    """Model x metric table (the intent of the CV results table): pivot of fold means."""
    fm = fold_metrics(spark, sf_dir)
    long = fm.unpivot(["model", "fold"], ["roc_auc", "pr_auc", "f1"], "metric", "value")
    return round_doubles(long.groupBy("model").pivot("metric", ["roc_auc", "pr_auc", "f1"]).agg(F.avg("value")))


@register("report_tuning_summary", sql(
    "SELECT model, round(avg(roc_auc), 6) AS cv_roc_auc, "
    "CAST(row_number() OVER (ORDER BY avg(roc_auc) DESC, model) AS INTEGER) AS position FROM m3 GROUP BY model",
    f"{SS}, {FOLD_SQL}"))
def report_tuning_summary(spark, sf_dir):
    """Model and best CV ROC-AUC, best first (stacked per-model records, sorted)."""
    fm = fold_metrics(spark, sf_dir)
    per = fm.groupBy("model").agg(F.avg("roc_auc").alias("cv_roc_auc"))
    w = Window.orderBy(F.col("cv_roc_auc").desc(), F.col("model"))  # one row per model
    return round_doubles(per.select("model", "cv_roc_auc", F.row_number().over(w).cast("int").alias("position")))

