"""Running sums over range partitions: sizes, sums and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import metrics as M
from ebbtide.operators import scan
from ebbtide.operators.split import dense_rank_values, key_rank


def test_a_million_scores_in_a_narrow_range_meet_in_no_task(spark, monkeypatch):
    """Two models: the scores of one lie within 1e-6, those of the other spread; no window partition exceeds 4 times the bound."""
    n, rows = 1_000_000, 50_000
    wide = spark.range(n // 10).select(F.lit("wide").alias("model"), (F.col("id") / (n / 10)).alias("p"))
    hist = spark.range(n).select(F.lit("narrow").alias("model"), (0.5 + F.col("id") / n * 1e-6).alias("p")).unionByName(wide)
    hist = hist.withColumn("pos", F.lit(1).cast("long")).withColumn("neg", F.lit(2).cast("long"))
    parts = scan.range_parts(hist, ["model"], F.col("p").desc(), rows)
    sizes = [r["count"] for r in parts.groupBy("model", "_part").count().collect()]
    assert sum(sizes) == n + n // 10 and max(sizes) <= 4 * rows
    monkeypatch.setattr(scan, "SCAN_ROWS", rows)
    got = M.cumulative_confusion(hist).groupBy("model").agg(
        F.min("tp").alias("first"), F.max("tp").alias("last"), F.sum("tp").alias("sum"), F.max("n_neg").alias("neg")).collect()
    for r in got:
        m = n if r["model"] == "narrow" else n // 10
        assert (r["first"], r["last"], r["sum"], r["neg"]) == (1, m, m * (m + 1) // 2, 2 * m)


@pytest.mark.parametrize("rows", [7, 10_000])
def test_sums_ranks_and_small_groups(spark, monkeypatch, rows):
    monkeypatch.setattr(scan, "SCAN_ROWS", rows)
    r = np.random.default_rng(0)
    data = [(f"g{k % 3}" if k % 40 else "alone", int(v), int(w)) for k, (v, w) in enumerate(zip(r.permutation(200), r.integers(0, 9, 200)))]
    df = spark.createDataFrame(data, "g string, v int, w int")
    got = {(x["g"], x["v"]): (x["run"], x["all"]) for x in scan.prefix_sums(df, ["g"], F.col("v"), {"run": "w"}, {"all": "w"}).collect()}
    for g, v, _ in data:
        own = [(b, c) for a, b, c in data if a == g]
        assert got[g, v] == (sum(c for b, c in own if b <= v), sum(c for _, c in own))
    assert sorted((x["v"], x["rn"]) for x in key_rank(df, "v").collect()) == [(k, k + 1) for k in range(200)]
    codes = {(x["g"], x["w"]): x["rank"] for x in dense_rank_values(df, "g", "w").collect()}
    for g, _, w in data:
        assert codes[g, w] == 1 + len({c for a, _, c in data if a == g and c < w})
    none = scan.prefix_sums(df.limit(0), ["g"], F.col("v"), {"run": "w"})
    assert none.count() == 0 and none.columns == ["g", "v", "w", "run"]
