"""Customer rows from lines with repeated and missing keys, and what their plans carry."""

import datetime as dt

from ebbtide.plans import fixtures as X
from ebbtide.plans import q_models as Q


def tables(spark, path):
    day = dt.datetime(2000, 5, 1)
    orders = [(o, c, "F", 100.0 * o, day, "1-URGENT") for o, c in ((1, 1), (2, 1), (3, 2), (4, None))]
    lines = [(1, 7, 5, 10.0), (1, 7, 6, 20.0), (1, 7, 6, 20.0), (2, 8, None, 50.0), (2, None, 5, 1.0), (3, None, None, 2.0), (4, 9, 9, 3.0),
             (None, 9, 9, 3.0)]
    for name, rows, kind in (
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
             "o_orderpriority string"),
            ("lineitem", [(o, p, s, q, 0.05, 0.0, "N", "O") for o, p, s, q in lines], "l_orderkey long, l_partkey long, l_suppkey long, "
             "l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"),
            ("customer", [(1, 0, 1.0, "A"), (2, 0, -1.0, "B")], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"),
            ("nation", [(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
            ("region", [(0, "R")], "r_regionkey int, r_name string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_distinct_keys_are_counted_in_narrow_rows(spark, tmp_path):
    made = X.build_cust_feat(spark, tables(spark, tmp_path))
    got = {r["cust_id"]: r for r in made.collect()}
    assert sorted(got) == [1, 2]
    assert (got[1]["phones"], got[1]["models"], got[1]["mou_Mean"]) == (2.0, 2.0, 101.0 / 2)
    assert (got[2]["phones"], got[2]["models"], got[2]["mou_Mean"]) == (0.0, 0.0, 2.0)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_distinct_keys_are_dealt_out_in_bounded_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "KEY_ROWS", 5)
    made = X.build_cust_feat(spark, tables(spark, tmp_path))
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().toString()
    assert {r["cust_id"]: (r["phones"], r["models"], r["actvsubs"], r["uniqsubs"]) for r in made.collect()} == {
        1: (2.0, 2.0, 1.0, 1.0), 2: (0.0, 0.0, 1.0, 1.0)}


def test_preprocessing_reads_its_rows_from_a_written_table(spark):
    rows = Q._train_folds(spark, "/root/testdata/sf0.001")
    assert rows.inputFiles() and all("train-folds" in f for f in rows.inputFiles())
    assert rows.where("(split = 'train') = (fold IS NULL)").count() == 0
