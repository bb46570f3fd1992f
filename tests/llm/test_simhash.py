"""Fingerprints against the definition, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from ebbtide.llm import simhash as S


def slow(text, size=3):
    words = []
    word = ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "ONE two", "Ä É\x0bx\x0cy z z z z", "a b c a b c d", "q " * 300])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow(text)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(random.Random(1).random()) for _ in range(500)) + " tail"
    want = S.fingerprint(text)
    monkeypatch.setattr(S, "CHUNK", 7)
    assert S.fingerprint(text) == want


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_links_and_components_are_whole(spark):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(40)]
    for base in fps[:15]:  # chains, exact copies, and neighbours of one to four bits on both sides
        x = base
        for _ in range(6):
            y = x
            for b in r.sample(range(64), r.randint(0, 4)):
                y ^= 1 << b
            fps.append(y)
            x = y
    fps += [0, 0, 7, 0xFFFFFFFF, 0xFFFFFFFE, (1 << 64) - 1]
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    nodes = df.groupBy("fp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "node")
    found = {(x["a"], x["b"]) for x in S.links(nodes).collect()}
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(f, i)
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3}
    assert found == want
    comp = {x["node"]: x["component"] for x in S.components(spark, S.links(nodes)).collect()}
    brute = brute_components(fps)
    for i, f in enumerate(fps):
        assert comp.get(first[f], first[f]) == brute[i]


def test_the_index_is_never_broadcast(spark, tmp_path):
    """66 index rows a fingerprint come from a file of some bytes a fingerprint, by which the planner judges them."""
    spark.range(2_000).selectExpr("xxhash64(id) AS fp", "id AS node").write.parquet(f"{tmp_path}/nodes")
    found = S.links(spark.read.parquet(f"{tmp_path}/nodes"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_edges_of_the_input(spark):
    rows = [(5, "the same words here", "c"), (2, "The SAME words here", None), (5, "the same words here", "d"),
            (9, None, "e"), (8, "", "f"), (None, "lost", "g"), (7, "something else entirely, quite another text", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in S.near_duplicates(spark, df).collect())
    assert [g[0] for g in got] == [-1, 2, 5, 5, 7, 8, 9]
    by = {g[0]: g for g in got}
    assert by[2][2] == by[5][2] == 2 and by[8][2] == by[9][2] == 8 and by[9][1] == "0" * 16
    kept = S.keep_one(spark, df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 7, 8]
    none = spark.createDataFrame([], df.schema)
    assert S.near_duplicates(spark, none).count() == 0 and S.keep_one(spark, none).count() == 0


def test_one_id_with_several_texts_keeps_each(spark):
    rows = [(4, "the first of two quite different texts under one id"), (4, "nothing alike stands in this other sequence of words"),
            (4, "nothing alike stands in this other sequence of words"), (3, "the first of two quite different texts under one id")]
    kept = S.keep_one(spark, spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(map(tuple, kept)) == [rows[3], rows[1]]
