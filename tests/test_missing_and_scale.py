"""NaN as missing, VIF on mixed scales, tied quantiles, tail probabilities, penalties."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ebbtide.functions.special import chi2_sf, t_two_sided_p
from ebbtide.operators.collinear import gram_matrix, iterative_drop, numeric_null_free, vif_from_gram
from ebbtide.operators.encode import MixedImputer
from ebbtide.operators.profile import missing_profile
from ebbtide.operators.quantile import exact_quantiles
from ebbtide.sources.io import corrupt_cells, read_csv


def test_nan_is_missing(spark):
    path = tempfile.mkdtemp(prefix="ebbtide-csv-")
    spark.createDataFrame([("x,s",), ("1.0,a",), ("NaN,b",), ("-,c",), ("abc,d",), ("4.0,e",), (",f",)], "value string").coalesce(
        1).write.mode("overwrite").text(path)
    schema = StructType([StructField("x", DoubleType()), StructField("s", StringType())])
    df = read_csv(spark, path, schema)
    got = {r["column"]: r["nulls"] for r in missing_profile(df).collect()}
    assert got == {"x": 4, "s": 0}
    assert [(r["column"], r["corrupt"]) for r in corrupt_cells(spark, path, schema).collect()] == [("x", 1)]


def test_nan_cannot_become_the_median(spark):
    df = spark.createDataFrame([(float("nan"),)] * 5 + [(1.0,), (3.0,), (None,)], "x double")
    model = MixedImputer().fit(df)
    assert sorted(r["x"] for r in model.transform(df).collect()) == [1.0] + [2.0] * 6 + [3.0]
    assert numeric_null_free(df) == []
    assert missing_profile(df).first()["nulls"] == 6


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e8, 1e11])
def test_vif_on_mixed_scales(spark, scale):
    r = np.random.default_rng(1)
    a = r.standard_normal(2000)
    x = np.column_stack([a, a + 0.1 * r.standard_normal(2000), scale * r.standard_normal(2000)])
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    g = gram_matrix(df, ["a", "b", "c"])
    want = []
    for i in range(3):
        others = np.delete(x, i, 1) / np.linalg.norm(np.delete(x, i, 1), axis=0)
        beta = np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        want.append((x[:, i] @ x[:, i]) / np.sum((x[:, i] - others @ beta) ** 2))
    assert np.allclose(vif_from_gram(g), want, rtol=1e-6)
    kept, dropped = iterative_drop(g, ["a", "b", "c"], 10.0)
    assert len(dropped) == 1 and "c" in kept


def test_vif_of_dependent_columns_is_infinite():
    r = np.random.default_rng(2)
    x = r.standard_normal((100, 3))
    x = np.column_stack([x, x[:, 0] + x[:, 1], np.zeros(100)])
    v = vif_from_gram(x.T @ x)
    assert np.isinf(v[[0, 1, 3, 4]]).all() and v[2] < 2


def test_quantiles_with_mostly_ties(spark):
    r = np.random.default_rng(3)
    x = np.where(r.random(40_000) < 0.9, 0.0, r.standard_normal(40_000))
    df = spark.createDataFrame([(float(v),) for v in x], "x double").withColumn("g", F.lit("a"))
    got = {row["q"]: row["value"] for row in exact_quantiles(df, ["g"], "x", [0.01, 0.25, 0.5, 0.97, 0.99]).collect()}
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(x, q), abs=1e-12)


@pytest.mark.parametrize("dof", [1, 10, 1e3, 1e6, 1e7])
def test_tails_converge(dof):
    # Wilson-Hilferty and normal limits for large dof, exact values for small
    assert chi2_sf(dof, dof) == pytest.approx(0.5 if dof >= 1e6 else chi2_sf(dof, dof), abs=1e-3)
    assert 0.31 < chi2_sf(dof, dof) < 0.51
    want = 2 * (1 - 0.5 * (1 + math.erf(1.96 / math.sqrt(2))))
    assert t_two_sided_p(1.96, dof) >= want - 1e-6
    if dof >= 1e3:
        assert t_two_sided_p(1.96, dof) == pytest.approx(want, abs=2e-3)
