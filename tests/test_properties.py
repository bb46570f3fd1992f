"""Cross-checks with MLlib and partitioning independence."""

import math
import random

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from ebbtide.operators import metrics as M
from ebbtide.operators.encode import MixedImputer, TargetEncoderOOF


def test_auc_matches_mllib_exact_evaluator(spark):
    rng = random.Random(21)
    rows = [("m", round(rng.random(), 2), rng.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "model string, p double, churn int")
    ours = M.roc_auc(M.cumulative_confusion(M.score_histogram(df))).first()["roc_auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", metricName="areaUnderROC", numBins=0)
    theirs = ev.evaluate(df.select(F.col("p"), F.col("churn").cast("double").alias("label")))
    assert math.isclose(ours, theirs, rel_tol=1e-12)


def test_fitted_transforms_ignore_partitioning(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([1.0, 2.5, None, 7.0]), rng.randint(0, 1), i % 5)
            for i in range(400)]
    df = spark.createDataFrame(rows, "id long, cat string, x double, churn int, fold int")

    def run(d):
        imp = MixedImputer(exclude=["id", "churn", "fold"]).fit(d)
        out = imp.transform(d)
        te = TargetEncoderOOF(cols=["cat"]).fit(out)
        return sorted(tuple(r) for r in te.transform(out).select("id", "x", "cat_enc").collect())

    a = run(df.coalesce(1))
    b = run(df.repartition(7, "id"))
    assert len(a) == len(b) == 400
    assert all(x[0] == y[0] and x[1] == y[1] and math.isclose(x[2], y[2], rel_tol=1e-12) for x, y in zip(a, b))
