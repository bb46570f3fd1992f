"""URL verdicts and benchmark overlaps against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import pytest

from ebbtide.llm import decontaminate as D, urls as U


def covers(masks, window, replaced):
    """Whether any placement of that many replaced words leaves one mask whole."""
    for bad in itertools.combinations(range(window), replaced):
        if not any(
            all(o + i not in bad for i, c in enumerate(m) if c == "1")
            for m in masks for o in range(window - len(m) + 1)
        ):
            return False
    return True


def test_masks_lose_no_overlap():
    assert covers(D.LONG, D.WINDOW, D.WINDOW // D.REPLACED)
    for n in range(5, D.WINDOW):
        assert covers(D.SHORT, n, n // D.REPLACED), n


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def brute(docs, items):
    out = {}
    for d, text in docs:
        if d is None:
            continue
        dw = words(text)
        for i, item in items:
            iw = words(item)
            n = min(len(iw), D.WINDOW)
            for shift in range(-len(iw), len(dw) + 1) if n else ():
                same = [0 <= q + shift < len(dw) and dw[q + shift] == w for q, w in enumerate(iw)]
                best = max(sum(same[q:q + n]) for q in range(len(iw) - n + 1))
                if best >= n - n // D.REPLACED:
                    out[d, i] = max(out.get((d, i), (0, 0)), (best, -shift))
    return {(d, i, m, -s) for (d, i), (m, s) in out.items()}


def test_overlaps_match_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(25)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 3, 4, 5, 7, 9, 10, 12, 13, 14, 20, 40]))) for i in range(40)] + [
        (50, None), (51, ""), (52, "..."), (53, "W1, w2! w3")]
    docs = []
    for d in range(60):
        text = say(r.randint(0, 60)).split()
        if d % 2:
            passage = words(r.choice(items[:40])[1])
            for k in range(len(passage)):
                if r.random() < 0.12:
                    passage[k] = "changed"
            at = r.randint(0, len(text))
            text[at:at] = passage
        docs.append((d, " ".join(text).title()))
    docs += [(3, docs[5][1]), (None, items[0][1]), (70, None), (71, "")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["matched"], x["at"]) for x in D.contract(spark, df, bench).collect()}
    assert got == brute(docs, items)
    kept = D.drop_contaminated(spark, df, bench, least_words=1)
    hit = {g[0] for g in got}
    assert kept.columns == df.columns
    assert Counter(x["doc_id"] for x in kept.collect()) == Counter(d for d, _ in docs if d not in hit)


def test_slices_lose_nothing(spark, monkeypatch):
    item = " ".join(f"k{i}" for i in range(30))
    df = spark.createDataFrame([(1, " ".join(["filler"] * 50 + [item] + ["filler"] * 50))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(D, "SLICE", 7)
    got = D.contract(spark, df, bench).collect()
    assert [(x["matched"], x["at"]) for x in got] == [(13, 50)]


def test_shuffled_seeds(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "z")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f x h i j y l m n")], "item_id long, text string")
    assert [x["doc_id"] for x in D.contract(spark, df, bench).collect()] == [1]


def test_items_without_ids_with_repeated_ids_and_of_few_words(spark):
    a, b = "one two three four five six seven", "red green blue black white brown pink"
    df = spark.createDataFrame([(1, a), (2, b), (3, "the end"), (4, "something else")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, a), (8, b), (8, "not in any text at all here"), (8, b), (9, "the")], "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"] or -1, x["matched"]) for x in D.contract(spark, df, bench).collect())
    assert got == [(1, -1, 7), (2, 8, 7), (3, 9, 1)]
    assert sorted(x["doc_id"] for x in D.drop_contaminated(spark, df, bench).collect()) == [3, 4]


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o")], "doc_id long, text string")
    empty_bench = spark.createDataFrame([], "item_id long, text string")
    bench = some.withColumnRenamed("doc_id", "item_id")
    assert D.contract(spark, none, bench).count() == 0
    assert D.contract(spark, some, empty_bench).count() == 0
    assert D.drop_contaminated(spark, some, empty_bench).count() == 1


# ---- urls -------------------------------------------------------------------

def split(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
    return host, m[2], rest


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_urls(pages):
    """Verdicts by plain Python: counts, Witten-Bell interpolation, calibration, decision."""
    order = U.ORDER
    parts = [split(u) for _, u in pages]
    rules = [rule(h, p) for h, p, _ in parts]

    def windows(rest):
        t = "\x02" * order + re.sub(r"[^!-~]", " ", rest) + "\x03"
        return [t[i:i + order + 1] for i in range(len(t) - order)]

    gram = {"allow": [Counter() for _ in range(order + 1)], "block": [Counter() for _ in range(order + 1)]}
    for (_, _, rest), (_, v) in zip(parts, rules):
        for w in windows(rest) if v else ():
            for k in range(order + 1):
                gram[v][k][w[order - k:]] += 1
    if not gram["allow"][0] or not gram["block"][0]:
        return [(i, *p[:2], r, v or "allow") for (i, _), p, (r, v) in zip(pages, parts, rules)]

    def prob(v, w):
        p = 1.0 / U.ALPHABET
        for k in range(order + 1):
            ctx = w[order - k:order]
            kids = {g: n for g, n in gram[v][k].items() if g[:k] == ctx}
            if kids:
                p = (kids.get(w[order - k:], 0) + len(kids) * p) / (sum(kids.values()) + len(kids))
        return p

    memo = {}
    scores = []
    for _, _, rest in parts:
        ws = windows(rest)
        for w in ws:
            if w not in memo:
                memo[w] = round((math.log(prob("allow", w)) - math.log(prob("block", w))) * U.SCALE)
        scores.append(math.floor(sum(memo[w] for w in ws) / len(ws)))
    step, limit = U.SCALE // U.BINS_A_UNIT, U.BIN_LIMIT * U.BINS_A_UNIT
    bins = [max(-limit, min(limit, math.floor(s / step))) for s in scores]
    a = [b for b, (_, v) in zip(bins, rules) if v == "allow"]
    r = [b for b, (_, v) in zip(bins, rules) if v == "block"]
    youden = lambda c: sum(x < c for x in r) / len(r) - sum(x < c for x in a) / len(a)
    cut = max(sorted(set(a + r)), key=lambda c: (youden(c), -c)) * step
    return [(i, *p[:2], k, v or ("block" if s < cut else "allow"))
            for (i, _), p, (k, v), s in zip(pages, parts, rules, scores)]


PAGES = (
    [(i, f"https://www.good{i % 7}.example.org/en/{2000 + 37 * i}?x=1") for i in range(60)]
    + [(100 + i, f"http://Shop{i % 5}.example.com/de/{i * 11}") for i in range(40)]
    + [(200 + i, f"https://blog.site{i % 6}.example.net/{'de' if i % 2 else 'en'}/{i * 13}#top") for i in range(40)]
    + [(300, None), (301, "no scheme"), (302, "x://"), (303, "x://org/"), (304, "x://org"), (305, "x://EXAMPLE.ORG/es/é"),
       (306, "x://example.org/en/1"), (307, "a://b://c/d"), (308, "x://com/fr/"), (309, "x://notorg/"), (310, "é://ü/ö"),
       (300, None), (307, "a://b://c/d"), (311, "x://long.example.net/" + "abc" * 3000), (312, "")]
)


def test_verdicts_match_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x", None) for i, u in PAGES], "page_id long, url string, host string, verdict string")
    got = Counter(tuple(r) for r in U.contract(spark, df).collect())
    assert got == Counter(brute_urls(PAGES))


def test_hot_windows_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(PAGES, "page_id long, url string")
    want = Counter(tuple(r) for r in U.contract(spark, df).collect())
    for hot in (1, 10**9):
        monkeypatch.setattr(U, "HOT", hot)
        assert Counter(tuple(r) for r in U.contract(spark, df).collect()) == want


@pytest.mark.parametrize("pages", [[], [(1, "x://a.net/"), (2, None)], [(1, "x://org/a"), (2, "x://b.net/c")]])
def test_without_both_models_everything_undecided_is_allowed(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string")
    assert [r["verdict"] for r in U.contract(spark, df).collect()] == ["allow"] * len(pages)
