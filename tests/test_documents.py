"""JSON documents of all shapes, and correlations by products against pandas."""

import json

import numpy as np
import pandas as pd
import pytest

from ebbtide.operators.profile import correlation_from_products, hists_by_label
from ebbtide.sources.io import map_document, metrics_document, read_json_document, records_document, write_text_document


def cells(spark, path):
    return {(r["outer"], r["inner"]): r["value"] for r in read_json_document(spark, path).collect()}


@pytest.mark.parametrize("text,want", [
    ('{"AUC": {"a": 0.5, "b": null}, "F1": {"a": 1}}', {("AUC", "a"): "0.5", ("AUC", "b"): None, ("F1", "a"): "1"}),
    ('[{"Model": "x", "AUC": 0.25},\n {"Model": "y", "AUC": 1e-3}]',
     {("0", "Model"): "x", ("0", "AUC"): "0.25", ("1", "Model"): "y", ("1", "AUC"): "0.001"}),
    ('{"SCALE": 1.5, "name": "z", "none": null}', {(None, "SCALE"): "1.5", (None, "name"): "z", (None, "none"): None}),
    ("[]", {}), ("{}", {}),
])
def test_reader_takes_every_shape(spark, tmp_path, text, want):
    (tmp_path / "doc.json").write_text(text)
    got = cells(spark, str(tmp_path / "doc.json"))
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == v or float(got[k]) == float(v)


def test_writers_and_reader_agree(spark, tmp_path):
    long = spark.createDataFrame([("AUC", "a", 0.1), ("AUC", "b", 0.2), ("F1", "a", 0.3)], "metric string, model string, value double")
    write_text_document(metrics_document(long), f"{tmp_path}/m")
    assert {k: float(v) for k, v in cells(spark, f"{tmp_path}/m").items()} == {("AUC", "a"): 0.1, ("AUC", "b"): 0.2, ("F1", "a"): 0.3}
    table = spark.createDataFrame([("y", None), ("x", 0.5)], "model string, auc double")
    write_text_document(records_document(table), f"{tmp_path}/r")
    line = spark.read.text(f"{tmp_path}/r").first()[0]
    assert json.loads(line) == [{"model": "x", "auc": 0.5}, {"model": "y", "auc": None}]
    write_text_document(map_document(spark.createDataFrame([("k", 2.0)], "key string, value double")), f"{tmp_path}/k")
    assert {k: float(v) for k, v in cells(spark, f"{tmp_path}/k").items()} == {(None, "k"): 2.0}


def test_correlations_are_pairwise_complete(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 6))
    x[:, 1] = x[:, 0] * 2 + 1e9 + r.standard_normal(300) * 0.1
    x[r.random((300, 6)) < 0.2] = np.nan
    x[:, 4], x[:, 5] = 7.0, np.nan
    cols = list("abcdef")
    rows = [tuple(None if np.isnan(v) and k % 2 else float(v) for v in row) for k, row in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    want = pd.DataFrame(x, columns=cols).corr()
    got = {(g["a"], g["b"]): g["corr"] for g in correlation_from_products(df, cols).collect()}
    assert len(got) == 36
    for a in cols[:4]:
        for b in cols[:4]:
            assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-6)
    assert all(got[a, b] is None for a in "ef" for b in "abcd")


def test_histograms_leave_missing_values_out(spark):
    df = spark.createDataFrame([(0, 0.0, None), (1, 1.0, 5.0), (1, 4.0, 5.0), (None, 9.0, 5.0), (0, None, None)], "churn int, a double, b double")
    got = {(r["feature"], r["churn"], r["bin"]): r["n"] for r in hists_by_label(df, {"a": df["a"], "b": df["b"]}, "churn", 4).collect()}
    assert got == {("a", 0, 1): 1, ("a", 1, 2): 1, ("a", 1, 4): 1, ("b", 1, 1): 2}
    assert hists_by_label(df.limit(0), {"a": df["a"]}, "churn", 4).count() == 0
