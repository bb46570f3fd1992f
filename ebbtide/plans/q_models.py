"""Model queries: batch scoring, persistence, cross-validation, random search,
k-NN join, explanations (V17-V20, S7, J6, E1-E4)."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.scalar import is_missing
from ebbtide.operators import metrics as M
from ebbtide.operators.boosting import BoostedModel, Table, bin_edges, binned_table
from ebbtide.operators.explain import linear_attributions, mean_abs, tree_attributions_wide
from ebbtide.operators.features import ENGINEERED, FeatureEngineer
from ebbtide.operators.models import (
    FEATURES,
    LOGISTIC_C,
    SEARCH_SPACES,
    assemble,
    cross_validate,
    feature_columns,
    importance_table,
    knn_score,
    model_zoo,
    positive_probability,
    positive_weight,
    random_search,
    refit,
)
from ebbtide.operators.preprocess import ID_COLS, build_preprocessing_pipeline
from ebbtide.operators.split import kfold
from ebbtide.plans.common import round_doubles
from ebbtide.plans.fixture_sql import with_views
from ebbtide.plans.fixtures import NUMERIC_FEATURES, cust_split, materialized, stage_done, stage_path
from ebbtide.plans.q_features import ENGINEERED_VIEW, dirty_split
from ebbtide.plans.registry import register
from ebbtide.session import scratch_path


def with_row_id(df: DataFrame) -> DataFrame:
    """Duplicated raw rows stay rows of their own: the copies of a customer are numbered."""
    copy = F.row_number().over(Window.partitionBy("cust_id").orderBy("cust_id"))
    return df.withColumn("row_id", F.concat_ws("-", F.col("cust_id").cast("string"), copy.cast("string")))


def _train_folds(spark, sf_dir) -> DataFrame:
    """Scrubbed rows with their split, and the fold of train rows: written once, as the fit of the preprocessing
    pipeline reads them some ten times and would join them anew each time."""
    return materialized(spark, sf_dir, "train-folds", lambda: dirty_split(spark, sf_dir).withColumn(
        "fold", F.when(F.col("split") == "train", F.col("fold"))))


def processed(spark, sf_dir) -> DataFrame:
    """Preprocessed feature matrix of every row (pipeline fitted on train rows);
    written once as a stage table."""

    def build():
        d = _train_folds(spark, sf_dir)
        model = build_preprocessing_pipeline().fit(d.where(F.col("split") == "train"))
        return with_row_id(no_nulls(model.transform(d)))

    return materialized(spark, sf_dir, "processed", build)


def _matrix(spark, sf_dir):
    df = processed(spark, sf_dir)
    cols = feature_columns(df, ID_COLS)
    return df, cols


def no_nulls(df: DataFrame) -> DataFrame:
    """The frame itself; the job fails at a row with a missing value in a feature
    (the post-condition of preprocessing)."""
    missing = F.lit(False)
    for c in df.columns:
        if c not in ID_COLS:
            missing = missing | is_missing(df, c)
    return df.where(F.when(missing, F.raise_error(F.lit("preprocessing left a missing value"))).otherwise(F.lit(True)))


def _binned_train(spark, sf_dir):
    """The train rows, binned once for both searches and their refits."""
    df, cols = _matrix(spark, sf_dir)
    path = stage_path(spark, sf_dir, "binned-train")
    train = df.where(F.col("split") == "train")
    edges_at = stage_path(spark, sf_dir, "binned-edges")
    if not (stage_done(spark, path) and stage_done(spark, edges_at)):
        edges = bin_edges(train, cols)
        binned_table(train, cols, path, edges=edges)
        spark.createDataFrame(list(enumerate(edges)), "k int, edges array<double>").coalesce(1).write.mode("overwrite").parquet(edges_at)
    edges = [r["edges"] for r in spark.read.parquet(edges_at).orderBy("k").collect()]  # a row a column
    blocks = spark.read.parquet(path)
    return Table(blocks, edges, cols, blocks.agg(F.sum("n")).first()[0] or 0)


def _tuned_model(spark, sf_dir, name: str) -> BoostedModel:
    """The best draw of a search, fitted to all train rows, kept beside the stage tables."""
    path = stage_path(spark, sf_dir, f"tuned-{name}")
    if not stage_done(spark, f"{path}/metadata"):
        best = _search(spark, sf_dir, name).orderBy(F.col("cv_roc_auc").desc(), "draw").first()["draw"]
        df, _ = _matrix(spark, sf_dir)
        draw = SEARCH_SPACES[name]()[best]
        model = refit(spark, _binned_train(spark, sf_dir), draw, stage_path(spark, sf_dir, f"refit-{name}"), positive_weight(df))
        model.write().overwrite().save(path)
    return BoostedModel.load(path)


#: The tuned model that scoring and explanations take (the reference's evaluation ranks it first).
BEST = "XGBoost"


def _best_model(spark, sf_dir):
    df, cols = _matrix(spark, sf_dir)
    return _tuned_model(spark, sf_dir, BEST), df, cols


def first_saved(spark, paths):
    """The first of several saved models that is there, loaded; None if none is."""
    for path in paths:
        if stage_done(spark, f"{path}/metadata"):
            return BoostedModel.load(path)
    return None


@register("model_batch_score")
def model_batch_score(spark, sf_dir):
    """Positive-class probability of the test customers from the tuned boosted model."""
    model, df, cols = _best_model(spark, sf_dir)
    te = df.where(F.col("split") == "test").select("row_id", "cust_id", "churn", *cols)
    return round_doubles(model.transform(te).select("row_id", "cust_id", "churn", "p"))


@register("sink_model_roundtrip")
def sink_model_roundtrip(spark, sf_dir):
    """Fitted preprocessing + classifier saved with ML persistence, loaded back and
    applied to the test rows; returns each row's scores before and after the round trip."""
    d = _train_folds(spark, sf_dir)
    train = d.where(F.col("split") == "train")
    prep = build_preprocessing_pipeline().fit(train)
    base = scratch_path(spark, f"models-{uuid.uuid4().hex[:12]}")
    prep.transform(train).write.parquet(f"{base}/train")  # read by the count and each pass of the fit
    mat = spark.read.parquet(f"{base}/train")
    cols = feature_columns(mat, ID_COLS)
    clf = Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol=FEATURES, handleInvalid="keep"),
        LogisticRegression(featuresCol=FEATURES, labelCol="label", regParam=1 / (LOGISTIC_C * mat.count()), maxIter=200),
    ]).fit(mat.withColumn("label", F.col("churn").cast("double")))
    prep.write().overwrite().save(f"{base}/preprocessor")
    clf.write().overwrite().save(f"{base}/classifier")
    prep2 = PipelineModel.load(f"{base}/preprocessor")
    clf2 = PipelineModel.load(f"{base}/classifier")
    te = with_row_id(d.where(F.col("split") == "test"))
    before = positive_probability(clf.transform(prep.transform(te))).select("row_id", "cust_id", F.col("p").alias("p_before"))
    after = positive_probability(clf2.transform(prep2.transform(te))).select("row_id", F.col("p").alias("p_after"))
    return round_doubles(before.join(after, "row_id"))


def _cv_scores(spark, sf_dir, parallelism=12):
    df, cols = _matrix(spark, sf_dir)
    tr = df.where(F.col("split") == "train")
    folds = kfold(tr.select("row_id", "churn"), "row_id", "churn", 3, seed=44).select(
        "row_id", F.col("fold").cast("int").alias("cv_fold"))
    data = tr.join(folds, "row_id")
    return cross_validate(model_zoo(weight=positive_weight(df)), data, "cv_fold", 3, cols, key="row_id",
                          parallelism=parallelism)


@register("model_cv_summary")
def model_cv_summary(spark, sf_dir):
    """Six classifiers x 3 stratified folds: per fold ROC-AUC, AP and F1 at the best
    threshold of the fold's scores; mean and population std per model."""
    oof = _cv_scores(spark, sf_dir)
    by = ("model", "fold")
    cum = M.cumulative_confusion(M.score_histogram(oof, by=by), by=by)
    thr = M.best_threshold(cum, by=by).select(*by, "threshold")
    cnt = M.confusion_counts(oof.join(F.broadcast(thr), list(by)), F.col("threshold"), by=by)
    per_fold = (M.roc_auc(cum, by=by).join(M.average_precision(cum, by=by), list(by))
                .join(M.point_metrics(cnt, by=by).select(*by, "f1"), list(by)))
    long = per_fold.unpivot(list(by), ["roc_auc", "pr_auc", "f1"], "metric", "value")
    return round_doubles(long.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("folds")))


def _search(spark, sf_dir, name: str):
    """30 seeded draws of one search space, 5 stratified folds, kept as a stage table."""
    df, _ = _matrix(spark, sf_dir)
    base = stage_path(spark, sf_dir, f"search-fits-{name}")
    return materialized(spark, sf_dir, f"search-boosted-{name}", lambda: random_search(
        spark, _binned_train(spark, sf_dir), SEARCH_SPACES[name](), base, positive_weight(df)))


@register("model_random_search")
def model_random_search(spark, sf_dir):
    """The XGBoost search: 30 draws by mean CV ROC-AUC."""
    return round_doubles(_search(spark, sf_dir, "XGBoost"))


@register("model_random_search_lgb")
def model_random_search_lgb(spark, sf_dir):
    """The LightGBM search: 30 draws from its own space by mean CV ROC-AUC."""
    return round_doubles(_search(spark, sf_dir, "LightGBM"))


@register("model_tuning_result")
def model_tuning_result(spark, sf_dir):
    """Best CV ROC-AUC of each search, best model first (the tuning summary of the searches themselves)."""
    best = [
        _search(spark, sf_dir, name).agg(F.max("cv_roc_auc").alias("cv_roc_auc")).select(
            F.lit(name).alias("model"), "cv_roc_auc")
        for name in ("LightGBM", "XGBoost")
    ]
    return round_doubles(best[0].unionByName(best[1]).orderBy(F.col("cv_roc_auc").desc(), "model"))


KNN_COLS = (*NUMERIC_FEATURES, *ENGINEERED)


def _knn_sql():
    def z(c, k):
        return f"(\"{c}\" - m{k}) / CASE WHEN s{k} > 0 THEN s{k} ELSE 1 END"

    row = "[" + ", ".join(z(c, k) for k, c in enumerate(KNN_COLS)) + "]"
    stats = ", ".join(f"avg(\"{c}\") AS m{k}, stddev_pop(\"{c}\") AS s{k}" for k, c in enumerate(KNN_COLS))
    return with_views(
        f"""
WITH tr AS (SELECT * FROM engineered WHERE split = 'train'),
st AS (SELECT {stats} FROM tr),
tz AS (SELECT cust_id AS t_key, CAST(churn AS DOUBLE) AS t_y, {row} AS z FROM tr, st),
qz AS (SELECT cust_id AS q_key, {row} AS z FROM engineered, st WHERE split = 'test'),
d AS (SELECT q.q_key, t.t_key, t.t_y, list_distance(q.z, t.z) AS d FROM qz q, tz t),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY d, t_key) AS r FROM d) WHERE r <= 15)
SELECT q_key AS cust_id,
  round(CASE WHEN sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) > 0 THEN avg(CASE WHEN d = 0 THEN t_y END)
        ELSE sum(t_y / d) / sum(1 / d) END, 6) AS p
FROM top GROUP BY q_key
""",
        "cust_split",
        extra=ENGINEERED_VIEW,
    )


@register("join_knn_score", _knn_sql())
def join_knn_score(spark, sf_dir):
    """Exact 15-NN distance-weighted churn score of every test customer among the train
    customers, on all numeric columns, raw and engineered, standardised (pivot index)."""
    s = FeatureEngineer().transform(cust_split(spark, sf_dir))
    return round_doubles(knn_score(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), KNN_COLS, k=15))


# ---- explanations ------------------------------------------------------------------

def _linear(spark, sf_dir):
    df, cols = _matrix(spark, sf_dir)
    tr = df.where(F.col("split") == "train")
    lr = LogisticRegression(featuresCol=FEATURES, labelCol="churn", regParam=1 / (LOGISTIC_C * tr.count()), maxIter=200)
    model = lr.fit(assemble(tr, cols))
    te = df.where(F.col("split") == "test")
    return linear_attributions(model, tr, te, cols, key="row_id"), te, cols, model


def _local(att, scored):
    """Top 15 attributions by |value| of the rows with the highest and the lowest probability."""
    ext = scored.agg(
        F.max_by("row_id", F.struct(F.col("p"), F.col("row_id"))).alias("high"),
        F.min_by("row_id", F.struct(F.col("p"), F.col("row_id"))).alias("low"),
    ).first()  # two ids
    who = F.when(F.col("row_id") == ext["high"], "High-Risk Churner").otherwise("Safe Customer")
    w = Window.partitionBy("row_id").orderBy(F.abs("shap_value").desc(), "feature")
    two = att.where(F.col("row_id").isin(ext["high"], ext["low"]))
    return round_doubles(two.select(who.alias("who"), "*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= 15))


def _dependence(att, te, cols, means):
    """(feature value, attribution) pairs for the 3 features of largest mean |attribution|."""
    top3 = [r["feature"] for r in means.orderBy(F.col("mean_abs_shap").desc(), "feature").limit(3).collect()]
    vals = te.select("row_id", *top3).unpivot(["row_id"], top3, "feature", "feature_value")
    return round_doubles(att.where(F.col("feature").isin(*top3)).join(vals, ["row_id", "feature"]))


@register("explain_linear_global")
def explain_linear_global(spark, sf_dir):
    """Mean |attribution| per feature (exact linear SHAP: coef * (x - train mean)), top 20."""
    att, _, _, _ = _linear(spark, sf_dir)
    g = att.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
    return round_doubles(g.orderBy(F.col("mean_abs_shap").desc(), "feature").limit(20))


@register("explain_linear_local")
def explain_linear_local(spark, sf_dir):
    """Linear model: top 15 attributions of its highest- and lowest-probability rows."""
    att, te, cols, model = _linear(spark, sf_dir)
    return _local(att, positive_probability(model.transform(assemble(te, cols))).select("row_id", "p"))


@register("explain_dependence")
def explain_dependence(spark, sf_dir):
    """Linear model: dependence pairs of its 3 strongest features."""
    att, te, cols, _ = _linear(spark, sf_dir)
    return _dependence(att, te, cols, att.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap")))


def _tree(spark, sf_dir):
    """Wide tree attributions of every test row, kept as a stage table for the queries that read them."""
    model, df, cols = _best_model(spark, sf_dir)
    te = df.where(F.col("split") == "test")
    wide = materialized(spark, sf_dir, "tree-attributions",
                        lambda: tree_attributions_wide(spark, model, te, cols, key="row_id"))
    return wide, wide.unpivot(["row_id"], cols, "feature", "shap_value"), te, cols, model


@register("explain_tree_global")
def explain_tree_global(spark, sf_dir):
    """Path-dependent TreeSHAP of the boosted model on every test row; mean |SHAP| per feature, top 20."""
    wide, _, _, cols, _ = _tree(spark, sf_dir)
    return round_doubles(mean_abs(wide, cols).orderBy(F.col("mean_abs_shap").desc(), "feature").limit(20))


@register("explain_tree_local")
def explain_tree_local(spark, sf_dir):
    """Boosted model: top 15 attributions of its highest- and lowest-probability rows."""
    _, att, te, cols, model = _tree(spark, sf_dir)
    return _local(att, model.transform(te.select("row_id", *cols)).select("row_id", "p"))


@register("explain_tree_dependence")
def explain_tree_dependence(spark, sf_dir):
    """Boosted model: dependence pairs of its 3 strongest features."""
    wide, att, te, cols, _ = _tree(spark, sf_dir)
    return _dependence(att, te, cols, mean_abs(wide, cols))


@register("explain_importance")
def explain_importance(spark, sf_dir):
    """Built-in feature importances of the boosted model, top 20."""
    model, _, cols = _best_model(spark, sf_dir)
    return round_doubles(importance_table(spark, model, cols).limit(20))
