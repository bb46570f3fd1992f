"""Fitted feature stages: hand-worked values and properties."""

import math

import numpy as np
from pyspark.sql import functions as F

from ebbtide.operators.collinear import VIFDropper, gram_matrix, vif_from_gram
from ebbtide.operators.encode import OrdinalCategoricalEncoder, TargetEncoderOOF
from ebbtide.operators.features import FeatureEngineer, PercentileClipper
from ebbtide.operators.split import dense_rank_values, key_rank, stratified_split
from tests.conftest import SF_SMALL


def test_target_encode_full_map(spark):
    df = spark.createDataFrame([("c0", 1, 0), ("c0", 0, 0), ("c1", 1, 0), ("c1", 1, 0), ("c1", 0, 0)],
                               "cat string, churn int, fold int")
    m = TargetEncoderOOF(cols=["cat"]).fit(df)
    full = {r["value"]: r["enc"] for r in m.table.where("fold = -1").collect()}
    assert math.isclose(full["c0"], 13 / 22)
    assert math.isclose(full["c1"], 14 / 23)
    # unseen category on a test row -> the global mean
    test = spark.createDataFrame([("zz",)], "cat string")
    assert math.isclose(m.transform(test).first()["cat_enc"], 0.6)


def test_oof_value_ignores_own_fold_labels(spark):
    rows = [(f"c{i % 3}", i % 2, i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "cat string, churn int, fold int").withColumn("id", F.monotonically_increasing_id())
    enc1 = TargetEncoderOOF(cols=["cat"]).fit(df).transform(df)
    flipped = df.withColumn("churn", F.when(F.col("fold") == 0, 1 - F.col("churn")).otherwise(F.col("churn")))
    enc2 = TargetEncoderOOF(cols=["cat"]).fit(flipped).transform(flipped)
    a = {r["id"]: r["cat_enc"] for r in enc1.where("fold = 0").collect()}
    b = {r["id"]: r["cat_enc"] for r in enc2.where("fold = 0").collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)


def test_category_only_in_held_out_fold_gets_complement_mean(spark):
    rows = [("a", 1, 0), ("a", 0, 1), ("b", 1, 1), ("only0", 1, 0)]
    df = spark.createDataFrame(rows, "cat string, churn int, fold int")
    out = TargetEncoderOOF(cols=["cat"]).fit(df).transform(df).where("cat_enc IS NOT NULL")
    v = [r["cat_enc"] for r in out.collect()]
    # fold 0 complement = fold 1 rows: mean 0.5 -> 'only0' in fold 0 gets 0.5
    assert 0.5 in [round(x, 12) for x in v]


def test_ordinal_unseen_minus_one(spark):
    tr = spark.createDataFrame([("a",), ("c",)], "v string")
    te = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    m = OrdinalCategoricalEncoder().fit(tr)
    assert [r[0] for r in m.transform(te).collect()] == [0.0, -1.0, 1.0]


def test_dense_rank_values_exact(spark):
    vals = [("g", f"v{i:03d}") for i in range(200)] + [("h", "x"), ("h", "a")]
    df = spark.createDataFrame(vals, "g string, v string")
    r = {(x["g"], x["v"]): x["rank"] for x in dense_rank_values(df, "g", "v").collect()}
    assert r[("g", "v000")] == 1 and r[("g", "v199")] == 200 and r[("h", "a")] == 1 and r[("h", "x")] == 2


def test_key_rank_exact(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k"))
    ranks = {r["k"]: r["rn"] for r in key_rank(df, "k").collect()}
    assert [ranks[k] for k in sorted(ranks)] == list(range(1, 5001))


def test_clip_is_idempotent(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "x_rate double")
    m = PercentileClipper().fit(df)
    once = m.transform(df)
    twice = m.transform(once)
    assert once.collect() == twice.collect()
    lo, hi = m._get_state()["bounds"]["x_rate"]
    assert math.isclose(lo, 0.99) and math.isclose(hi, 98.01)


def test_vif_singular_column_is_infinite(spark):
    rows = [(float(i), float(i), float((i * 7) % 11)) for i in range(1, 50)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    v = vif_from_gram(gram_matrix(df, ["a", "b", "c"]))
    assert np.isinf(v[0]) and np.isinf(v[1])
    model = VIFDropper(threshold=10.0).fit(df)
    assert len(model._get_state()["dropped"]) == 1


def test_vif_matches_uncentred_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    x[:, 2] = x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.3, size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    v = vif_from_gram(gram_matrix(df, ["a", "b", "c"]))
    # direct: regress c on a, b without intercept
    beta, *_ = np.linalg.lstsq(x[:, :2], x[:, 2], rcond=None)
    rss = np.sum((x[:, 2] - x[:, :2] @ beta) ** 2)
    assert math.isclose(v[2], np.sum(x[:, 2] ** 2) / rss, rel_tol=1e-9)


def test_split_disjoint_exhaustive_balanced(spark):
    from ebbtide.plans.fixtures import build_cust_feat

    feat = build_cust_feat(spark, SF_SMALL)
    s = stratified_split(feat, "cust_id", "churn").collect()
    assert len(s) == feat.count() == len({r["cust_id"] for r in s})
    for c in (0, 1):
        cls = [r for r in s if r["churn"] == c]
        n_test = sum(1 for r in cls if r["split"] == "test")
        assert n_test == round(0.2 * len(cls))
        sizes = [sum(1 for r in cls if r["split"] == "train" and r["fold"] == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert all(r["fold"] == -1 for r in s if r["split"] == "test")


def test_engineer_adds_24_columns(spark):
    from ebbtide.plans.fixtures import build_cust_feat

    feat = build_cust_feat(spark, SF_SMALL)
    out = FeatureEngineer().transform(feat)
    assert len(out.columns) == len(feat.columns) + 24
