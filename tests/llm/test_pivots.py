"""The pivot index against brute force."""

import numpy as np
import pytest

from ebbtide.llm import pivots as P


def brute(rows, cosine=P.COSINE):
    """Links of all pairs by the definition, and components by search."""
    units = []
    for _, vec, label in rows:
        fine = vec is not None and label is not None and len(vec) and all(x is not None and np.isfinite(x) for x in vec)
        v = np.array(vec, float) if fine else np.zeros(1)
        units.append(v / np.linalg.norm(v) if np.any(v) else None)
    near = [[] for _ in rows]
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= cosine:
                near[i].append(j)
                near[j].append(i)
    return near


def expected(rows):
    near, out = brute(rows), []
    for k, row in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((row[0], len(near[k]), least, row[0] == least))
    return sorted(out, key=repr)


def planted(seed=2, groups=25, d=24):
    """Near copies of several sizes, chains, exact copies and strangers under three labels."""
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        at = r.standard_normal(d)
        for _ in range(int(r.integers(1, 9))):
            rows.append((at + r.standard_normal(d) * 0.05, g % 3))
            at = at + r.standard_normal(d) * r.choice([0.02, 0.15])
        rows += [rows[-1]] * int(r.integers(0, 3))
    rows += [(r.standard_normal(d), int(r.integers(0, 3))) for _ in range(150)]
    order = r.permutation(len(rows))
    return [(int(k), [float(np.float32(x)) for x in rows[i][0]], rows[i][1]) for k, i in enumerate(order)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [P.BLOCK, 3])
def test_links_against_brute_force(spark, block):
    rows = planted()
    got = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), block=block).collect()
    want = expected(rows)
    # no link below the bound, and recall of at least 0.9: here every link is found
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(w[1] for w in want) > 300


def test_recall_at_the_bound(spark):
    """Pairs whose cosine is the bound itself, the hardest to find."""
    r = np.random.default_rng(5)
    a = P.unit_rows(r.standard_normal((1500, 64)))
    b = r.standard_normal((1500, 64))
    b = P.unit_rows(b - (b * a).sum(1, keepdims=True) * a)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate([a, 0.9302 * a + np.sqrt(1 - 0.9302 ** 2) * b]))]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r["n_links"] for r in got) / 3000 >= 0.97


def test_a_third_of_all_rows_alike(spark):
    r = np.random.default_rng(6)
    at = r.standard_normal(16)
    rows = [(k, [float(np.float32(x)) for x in at + r.standard_normal(16) * 0.01], 0) for k in range(300)]
    rows += [(300 + k, rows[0][1], 0) for k in range(100)]
    rows += [(400 + k, [float(np.float32(x)) for x in r.standard_normal(16)], 0) for k in range(800)]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), block=50).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (1, [1.0, 0.0], 2),
        (2, [1.0, 0.0], None), (7, None, 1), (8, [], 1), (9, [0.0, 0.0], 1), (10, [1.0, nan], 1), (11, [1.0, None], 1), (12, [inf, 1.0], 1),
        (13, [1.0, 0.0, 0.0], 1), (14, [1.0, 0.0, 0.1], 1), (15, [-0.0, 1.0], 3), (16, [0.0, 1.0], 3), (17, [1e300, 1e300], 4),
        (18, [1e-300, 1e-300], 4), (19, [-1.0, 0.0], 1), (20, [0.0, 0.0, 1.0], 5), (21, [0.0, 0.0, 2.0], 5),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = {}
    for r in P.near_duplicates(spark, df).collect():
        got.setdefault(r["vec_id"], []).append(tuple(r)[1:])
    assert got[5] == [(3, 3, False)] * 2 and got[3] == [(3, 3, True)]
    assert sorted(got[None], key=repr) == [(0, None, True), (3, 3, False)]
    for k in (1, 2, 7, 8, 9, 10, 11, 12, 19):
        assert got[k] == [(0, k, True)], k
    assert got[13] == [(1, 13, True)] and got[14] == [(1, 13, False)]
    assert got[15] == [(1, 15, True)] and got[16] == [(1, 15, False)]
    assert got[17] == [(1, 17, True)] and got[18] == [(1, 17, False)]
    assert got[20] == [(1, 20, True)] and got[21] == [(1, 20, False)]


def test_empty_and_unusable_tables(spark):
    none = P.contract(spark, spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns == ["vec_id", "n_links", "component_id", "kept"]
    blank = P.contract(spark, spark.createDataFrame([(4, None, 1), (2, [1.0], None)], SCHEMA))
    assert sorted(map(tuple, blank.collect())) == [(2, 0, 2, True), (4, 0, 4, True)]


def test_description_is_the_order_of_the_nearest():
    r = np.random.default_rng(3)
    x, pivots = r.standard_normal((40, 8)), P.unit_rows(r.standard_normal((30, 8)))
    got = P.describe(x, pivots, 6)
    for row, v in zip(got, x, strict=True):
        cos = pivots @ v
        assert row.tolist() == sorted(range(30), key=lambda k: -cos[k])[:6]
    assert P.describe(x, pivots[:4], 6).shape == (40, 4)


def test_pivots_are_no_copies():
    r = np.random.default_rng(3)
    near = [[1.0, 0.001 * k] for k in range(20)] + r.standard_normal((20, 2)).tolist()
    pivots = P.choose_pivots(near, 10)
    assert 1 < len(pivots) <= 10 and (np.triu(pivots @ pivots.T, 1) < P.PIVOT_COSINE).all()
