"""Hand-worked edge tables for the scalar functions and profile aggregates."""

import math

from pyspark.sql import functions as F

from ebbtide.functions import scalar as S
from ebbtide.functions.special import chi2_sf, t_two_sided_p
from ebbtide.operators import profile as prof


def test_round_half_even_like_numpy(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,), (-2.5,)], "x double")
    got = [r[0] for r in df.select(S.round_half_even("x", 1).alias("r")).collect()]
    assert got == [0.2, 0.4, 2.5, -2.5]
    got0 = [r[0] for r in df.select(S.round_half_even("x", 0).alias("r")).collect()]
    assert got0 == [0.0, 0.0, 2.0, -2.0]


def test_tier_edges_right_closed(spark):
    df = spark.createDataFrame([(-1.0,), (180.0,), (181.0,), (365.0,), (730.0,), (731.0,), (None,)], "x double")
    got = [r[0] for r in df.select(S.tier_cut("x").alias("t")).collect()]
    assert got == [0.0, 0.0, 1.0, 1.0, 2.0, 3.0, None]


def test_eps_ratio_and_clip_keep_null(spark):
    df = spark.createDataFrame([(2.0, 0.0), (None, 1.0)], "a double, b double")
    r = df.select(S.eps_ratio("a", "b").alias("q"), S.clip_keep_null("a", 0.0, 1.0).alias("c")).collect()
    assert math.isclose(r[0]["q"], 2e6, rel_tol=1e-9)
    assert r[0]["c"] == 1.0
    assert r[1]["c"] is None


def test_binary_map_miss_is_zero(spark):
    df = spark.createDataFrame([("Y",), ("N",), (" ",), ("T",), (None,)], "v string")
    got = [r[0] for r in df.select(S.map_lookup("v", {"Y": 1, "N": 0, " ": 0}).alias("m")).collect()]
    assert got == [1, 0, 0, 0, 0]


def test_decline_flag_null_is_zero(spark):
    df = spark.createDataFrame([(-6.0,), (-5.0,), (None,)], "x double")
    assert [r[0] for r in df.select(S.decline_flag("x")).collect()] == [1, 0, 0]


def test_log1p_defined_above_minus_one(spark):
    df = spark.createDataFrame([(-1.0,), (-2.0,), (0.0,)], "x double")
    got = [r[0] for r in df.select(S.log1p_safe("x")).collect()]
    assert got[0] is None and got[1] is None and got[2] == 0.0


def test_interpolated_quantile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (9.0,)], "x double")
    q = {r["q"]: r["value"] for r in prof.quantiles(df, ["x"], [0.01, 0.5]).collect()}
    assert math.isclose(q[0.01], 1.03)
    assert math.isclose(q[0.5], 3.5)


def test_mode_ties_take_smallest(spark):
    from ebbtide.operators.encode import MixedImputer

    df = spark.createDataFrame([("a",), ("b",), ("a",), ("b",), (None,)], "c string")
    m = MixedImputer().fit(df)
    assert m._get_state()["categorical"]["c"] == "a"


def test_width_bin_top_edge_closed(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    got = [r[0] for r in df.select(S.width_bin("x", 0.0, 10.0, 4)).collect()]
    assert got == [1, 3, 4]


def test_p_values_known():
    assert math.isclose(t_two_sided_p(2.0, 10.0), 0.07338803477074313, rel_tol=1e-7)
    assert math.isclose(chi2_sf(3.841458820694124, 1.0), 0.05, rel_tol=1e-7)
    assert math.isclose(t_two_sided_p(0.0, 5.0), 1.0)


def test_moving_average_zero_padded(spark):
    # 7 bins of density 1 -> edges divide by 7 (zero padding)
    from pyspark.sql import Window

    df = spark.createDataFrame([(1, i, 1.0) for i in range(1, 8)], "g int, bin int, d double")
    w = Window.partitionBy("g").orderBy("bin").rowsBetween(-3, 3)
    got = [r[0] for r in df.select((F.sum("d").over(w) / 7).alias("s")).orderBy(F.col("s")).collect()]
    expect = sorted([4 / 7, 5 / 7, 6 / 7, 1.0, 6 / 7, 5 / 7, 4 / 7])
    assert all(math.isclose(a, b) for a, b in zip(got, expect))
