"""Term counts and the audit against a slow model in Python integers."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ebbtide.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def words(r):
    pool = ["a", "The", "the", "of", "straße", "ÄRGER", "日本語", "naïve", "abcdefgh", "abcdefghi", "abcdefghijklmnop",
            "abcdefghijklmnopq", "x" * 32, "x" * 33, "ß" * 40, "y" * 200, "Éé", " ", "🙂"]
    return [r.choice(pool) for _ in range(r.randint(0, 40))]


@pytest.mark.parametrize("seed", range(8))
def test_counts_of_a_chunk(seed):
    r = random.Random(seed)
    texts = [r.choice([" ", "-", "\n", "1", "\x00", "_"]).join(words(r)) for _ in range(r.randint(1, 25))]
    groups = np.array([r.randint(0, 3) for _ in texts])
    want, docs = Counter(), Counter()
    for text, g in zip(texts, groups.tolist(), strict=True):
        found = terms_of(text)
        want.update((g, t) for t in found)
        docs.update({(g, t) for t in found})
    got = {}
    for g, term, n, d in D.count_terms([t.encode() for t in texts], groups):
        for row in zip(g.tolist(), term.tolist(), n.tolist(), d.tolist(), strict=True):
            assert (row[0], row[1].decode()) not in got
            got[row[0], row[1].decode()] = row[2:]
    assert got == {k: (want[k], docs[k]) for k in want}


def test_radix_is_a_stable_order():
    r = np.random.default_rng(1)
    for size in (1, 7, 5000):
        a, b = (r.integers(0, 1 << 63, size).astype(np.uint64) >> np.uint64(r.integers(0, 60)) for _ in range(2))
        assert D._radix([a, b]).tolist() == sorted(range(size), key=lambda k: (a[k], b[k]))


def slow(rows, min_docs, top):
    docs = defaultdict(Counter)
    counts = defaultdict(Counter)
    for lang, source, text in rows:
        found = terms_of(text)
        docs[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=lambda t: t.encode())
        v = len(kept)
        own = {s: c for (x, s), c in counts.items() if x == lang}

        def share(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * v) for t in kept}

        p = {s: share(c) for s, c in own.items()}
        q = share(sum(own.values(), Counter()))
        for s in own:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pair, None), ("term", term, top)):
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, f, k + 1) for k, (f, item) in enumerate(values[:most])]
    return sorted(out)


def corpus(seed=4, n=300):
    r = random.Random(seed)
    rows = [(r.choice(["de", "de", "fr", None, "xx"]), r.choice(["s1", "s2", "s3", None, "ü"]),
             r.choice([None, "", " ".join(words(r)), " ".join(words(r))])) for _ in range(n)]
    return rows + [("lone", "one", "word")] + [("none", f"s{k}", "rare") for k in range(3)] + rows[:20] + [
        ("big", "hot", "term " * 5000), ("big", "cold", None)] * 31


@pytest.mark.parametrize("cells", [D.CELLS, 7])
def test_audit_against_the_definition(spark, monkeypatch, cells):
    monkeypatch.setattr(D, "CELLS", cells)
    monkeypatch.setattr(D, "CHUNK_ROWS", 20)
    monkeypatch.setattr(D, "CHUNK", 700)
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "lang string, source string, text string, term string")
    got = sorted(map(tuple, D.audit(spark, df.repartition(5), min_docs=10, top=4).collect()))
    assert got == slow(rows, 10, 4)
    assert {r[2] for r in got} == {"pair", "term"}


def test_audit_against_sql(spark):
    rows = corpus(9, 900)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.execute(D.oracle()).fetchall()
    assert sorted(map(tuple, D.contract(spark, df).collect())) == sorted(want) == slow(rows, D.MIN_DOCS, D.TOP_TERMS)


def test_empty_table(spark):
    out = D.contract(spark, spark.createDataFrame([], "lang string, source string, text string"))
    assert out.collect() == [] and out.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shares_beyond_64_bits(spark):
    n = 20_000_000_000_000
    row = spark.range(1).select(D._share(D.F.lit(n), D.F.lit(3 * n), D.F.lit(7).cast("long")).alias("p")).first()
    assert row["p"] == 1 + 1_000_000_000 * (n + 5) // (3 * n + 35)
