"""Exact distributed quantiles and modes against NumPy / brute force."""

import math
import random

import numpy as np

from ebbtide.operators.quantile import exact_quantiles, modes


def test_exact_quantiles_match_numpy_linear(spark):
    rng = random.Random(9)
    rows = [(g, float(rng.randint(0, 300)) / 7.0) for g in ("a", "b") for _ in range(4000)]
    rows += [("c", 5.0)] * 3 + [("d", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.97, 0.99, 1.0]
    # a small accuracy forces approximate brackets on the 4,000-row groups
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, ["g"], "v", probs, accuracy=100).collect()}
    for g in ("a", "b", "c", "d"):
        xs = np.array([v for gg, v in rows if gg == g])
        for q in probs:
            assert math.isclose(got[(g, q)], float(np.percentile(xs, q * 100)), rel_tol=1e-12, abs_tol=1e-12)


def test_modes_smallest_on_ties(spark):
    rows = [("x", "b"), ("x", "a"), ("x", "b"), ("x", "a"), ("x", None), ("y", "z")]
    df = spark.createDataFrame(rows, "g string, value string")
    got = {r["g"]: r["mode"] for r in modes(df, ["g"]).collect()}
    assert got == {"x": "a", "y": "z"}
