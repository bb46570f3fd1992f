"""Toxicity, quality and language models: gradients, held-out accuracy, edge cases; LM scores against a slow model."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import gam, langid, masked_lm, toxicity
from tests.conftest import SF_SMALL

SF = SF_SMALL.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, "a"), (2, "", "en", "b"), (3, " 12 ?! ", "en", "c"), (4, "Word " * 60_000, "de", "d"),
            (1, "again", "fr", "e"), (None, "no id here", None, "f"), (5, "x" * 300_000, None, "g")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def held_out(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


# ---- toxicity ---------------------------------------------------------------

def test_toxicity_gradients(monkeypatch):
    for k, v in {"WORD_ROWS": 50, "GRAM_ROWS": 50, "EDGE_ROWS": 50, "WINDOW": 4, "STRIDE": 2}.items():
        monkeypatch.setattr(toxicity, k, v)
    words = ["alpha", "beta", "gamma", "d", "epsilon"]
    keys = toxicity.word_keys(words)
    texts = [np.array([0, 1, 2, 3, 4, 1, 2]), np.array([3, 1])]
    y, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])
    p = {k: v.astype(np.float64) for k, v in toxicity._start().items()}

    def loss():
        x = toxicity._inputs(p, keys).astype(np.float64)
        ids, offsets = np.concatenate(texts), np.array([0, 7, 9])
        index, mask, owner = toxicity._grid(ids, offsets)
        z = toxicity.window_logits(index, mask, x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"], p)
        out = 0.0
        for k in range(2):
            t = np.log(np.exp(z[owner == k]).sum())
            out += weight[k] * (np.log1p(np.exp(t)) - y[k] * t)
        return out

    g = toxicity._gradients(p, keys, texts, y, weight)
    r = np.random.default_rng(0)
    for name in p:
        flat, grad = p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for i in r.permutation(len(flat))[:3].tolist() + [int(np.argmax(np.abs(grad)))]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - grad[i]) < 3e-3 + 0.03 * abs(grad[i]), (name, i)


def test_windows_cover_every_word():
    for n in range(1, 120):
        starts = toxicity.window_starts(n)
        covered = {s + i for s in starts for i in range(min(n, toxicity.WINDOW))}
        assert covered == set(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_slices_do_not_change_scores(monkeypatch):
    p = toxicity._start() | {"scale": np.array([1.0, 0.0])}
    text = " ".join(f"w{i % 37}x" for i in range(500)).replace("0", "o")
    whole = toxicity.Scorer(p).worst([text, "short", None])
    monkeypatch.setattr(toxicity, "FLUSH_WORDS", 20)
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 5)
    assert np.allclose(toxicity.Scorer(p).worst([text, "short", None])[1:], whole[1:])


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.contract(spark, docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == held_out(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)
    clean = [r["predicted"] for r in rows if truth.get(r["doc_id"]) == 0 and r["held_out"]]
    toxic = [r["predicted"] for r in rows if truth.get(r["doc_id"]) == 1 and r["held_out"]]
    assert np.mean(clean) < 0.03 and np.mean(toxic) > 0.8


def test_toxicity_edges(spark, odd, data):
    params = toxicity.train(*data)
    got = toxicity.score(odd, params).collect()
    assert len(got) == 7 and {r["score"] for r in got if r["doc_id"] in (2, 3)} == {0.0}
    kept = toxicity.drop_toxic(odd, params)
    assert kept.columns == odd.columns and {2, 3} <= {r["doc_id"] for r in kept.collect()}
    none, labels = odd.limit(0), data[1]
    assert toxicity.contract(spark, none, labels).count() == 0
    assert toxicity.train(none, labels) is None and toxicity.train(data[0], labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


def test_toxicity_fits_long_texts(spark):
    text = lambda k, w: " ".join([f"house{'abc'[(k + i) % 3]} river" for i in range(300)] + [w])
    docs = spark.createDataFrame([(i, text(i, "vilest" if i % 2 else "stone")) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    params = toxicity.train(docs, labels)
    assert params is not None
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, params).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > max(got[i] for i in range(0, 60, 2))


def test_toxicity_gradients_in_blocks(monkeypatch):
    keys = toxicity.word_keys([f"w{'abcdefgh'[i % 8]}{'xyz' [i % 3]}" for i in range(24)])
    r = np.random.default_rng(1)
    texts, y = [r.integers(0, 24, n) for n in (200, 3, 90)], np.array([1.0, 0.0, 1.0])
    whole = toxicity._gradients(toxicity._start(), keys, texts, y, np.ones(3))
    monkeypatch.setattr(toxicity, "BLOCK_WINDOWS", 4)
    for name, g in toxicity._gradients(toxicity._start(), keys, texts, y, np.ones(3)).items():
        assert np.allclose(g, whole[name], atol=1e-5), name


# ---- quality ----------------------------------------------------------------

def test_quality_held_out(data):
    docs, labels = data
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = gam.contract(docs, labels).collect()
    assert len(rows) == docs.count()
    right = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean(right) > 0.95
    for r in rows:
        assert r["held_out"] == held_out(r["doc_id"], 4, 2) and r["predicted"] == int(r["score"] >= 0.7)


def test_quality_score_is_a_sum_of_table_entries(data):
    model = gam.train(*data)
    x = np.array([gam.features("The house of stone. THE river!!"), gam.features("a### b&&& c***"), gam.features("")])
    for row, got in zip(x, model.score(x)):
        total = model.bias
        for f in range(len(gam.FEATURES)):
            total += model.tables[f][sum(row[f] >= c for c in model.cuts[f])]
        for p, (i, j) in enumerate(model.pairs):
            total += model.pair_tables[p][sum(row[i] >= c for c in model.pair_cuts[i]), sum(row[j] >= c for c in model.pair_cuts[j])]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9


def test_quality_features_in_slices(monkeypatch):
    text = "The the the river, 12 STONES!! é\n" * 50
    want = gam.features(text)
    monkeypatch.setattr(gam, "_WORD_SLICE", 40)
    assert np.allclose(gam.features(text), want)


def test_quality_edges(odd, data):
    docs, labels = data
    model = gam.train(docs, labels)
    assert gam.score(odd, model).count() == 7
    assert gam.keep_good(odd, model).columns == odd.columns
    assert gam.contract(odd.limit(0), labels).count() == 0
    assert {r["score"] for r in gam.contract(odd, labels.limit(0)).collect()} == {0.5}
    ones = labels.where("quality = 1")
    assert all(r["score"] > 0.99 for r in gam.contract(docs.limit(5), ones).collect())


# ---- language ---------------------------------------------------------------

def test_language_held_out(data):
    docs, _ = data
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.contract(docs).collect()
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and np.mean(right) > 0.97
    assert all(r["held_out"] == held_out(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in rows)


def test_bundle_is_the_sum_of_bound_letters():
    letters = langid._letter_vectors()
    got = langid.text_vectors(["Abc, ab", None], letters)
    want = np.zeros(langid.DIMENSIONS)
    for gram in (" ab", "abc", "bc ", "c a", " ab", "ab "):
        a, b, c = (letters[ord(x) % langid.LETTERS].astype(float) for x in gram)
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert np.array_equal(got[0], want) and not got[1].any()


def test_language_edges(odd):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.contract(odd).collect()}
    assert {(2, "und"), (3, "und")} <= got and len(got) == 7
    assert {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}
    assert langid.contract(odd.limit(0)).count() == 0


# ---- masked language model --------------------------------------------------

def test_lm_scores_match_a_slow_model(spark, data):
    docs = data[0].limit(60)
    v, p = masked_lm.train(spark, docs)
    got = {r["doc_id"]: r for r in masked_lm.score(spark, docs, v, p).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = {}
    for t in texts.values():
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    top = sorted(counts, key=lambda w: (-counts[w], w))[:masked_lm.TOP_WORDS]
    size = lambda w: min(len(w), masked_lm.LENGTHS)
    for doc_id in sorted(texts)[:5]:
        words = texts[doc_id].split()[:]
        cls = [top.index(w) if w in top else masked_lm.TOP_WORDS + size(w) - 1 for w in words]
        total = 0.0
        for i, c in enumerate(cls):
            h = p["b"].astype(float).copy()
            for k, o in enumerate(masked_lm.OFFSETS):
                h += p["in"][k][cls[i + o] if 0 <= i + o < len(cls) else masked_lm.EDGE]
            z = np.tanh(h) @ p["out"] + p["c"]
            total += z[c] - z.max() - np.log(np.exp(z - z.max()).sum())
            if c >= masked_lm.TOP_WORDS:
                total -= np.log(sum(1 for w in counts if w not in top and size(w) == c - masked_lm.TOP_WORDS + 1))
        assert abs(total - got[doc_id]["log_likelihood"]) < 1e-3 * max(len(words), 1)
        assert got[doc_id]["n_words"] == len(words)


def test_lm_learns_from_both_sides():
    r = np.random.default_rng(0)
    texts = []
    for _ in range(6000):  # the middle word follows from its neighbours
        a = int(r.integers(0, 2))
        texts.append(np.array([a, 2 + a, a], np.int16))
    p = masked_lm.fit(texts)
    v = masked_lm.Vocabulary({}, np.zeros(masked_lm.CLASSES))
    right, owner = masked_lm.log_probabilities(p, v, [np.array([0, 2, 0], np.int16)])
    wrong, _ = masked_lm.log_probabilities(p, v, [np.array([0, 3, 0], np.int16)])
    assert right[1] > wrong[1] + 1 and len(owner) == 3


def test_lm_edges(spark, odd):
    got = {(r["doc_id"], r["n_words"]): r["log_likelihood"] for r in masked_lm.contract(spark, odd).collect()}
    assert got[(2, 0)] == 0.0 and got[(1, 0)] == 0.0 and (4, 60_000) in got and len(got) == 7
    assert masked_lm.contract(spark, odd.limit(0)).count() == 0


def test_lm_scores_use_the_count_of_every_word(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "COMMON_WORDS", 300)  # the others come by the join
    filler = " ".join(f"t{i:03d} " * 30 for i in range(masked_lm.TOP_WORDS))
    rows = [(1, filler), (2, "oftenword " * 9 + "rareword1 rareword1"), (3, "x oftenword y"), (4, "x rareword1 y"),
            (4, "x rareword1 y"), (None, "x rareword2 y"), (5, " "), (6, " ".join(f"z{i:07d}" for i in range(500)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = masked_lm.contract(spark, docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["log_likelihood"] for r in got}
    counts, total = {"oftenword": 10, "rareword1": 4, "rareword2": 1}, 15
    assert abs(by[3] - by[4] - np.log(10 / 4)) < 1e-3  # the same class in the same context
    assert abs(by[4] - by[None] - np.log(4 / 1)) < 1e-3 and by[5] == 0
    v = masked_lm.vocabulary(masked_lm.word_counts(spark, docs))
    assert v.counts[masked_lm.TOP_WORDS + 8] == total and v.counts.sum() == sum(len(t.split()) for _, t in rows)
    rows_ = masked_lm.classified(spark, docs, v)
    p = masked_lm.fit_all(spark, rows_, v)
    for r in rows_.collect():
        if r["doc_id"] == 2:
            logs = masked_lm._class_log_probabilities(p, [np.frombuffer(r["classes"], np.uint8)])[0].sum()
            want = logs + 9 * np.log(counts["oftenword"] / total) + 2 * np.log(counts["rareword1"] / total)
            assert abs(want - by[2]) < 1e-2


def test_lm_is_fitted_on_all_rows(spark):
    ids = spark.range(2300).selectExpr("id AS doc_id").orderBy(F.xxhash64("doc_id")).collect()
    rows = []
    for k, r in enumerate(ids):  # only rows past the first 2,000 by hash show how the middle word follows
        rows.append((r["doc_id"], "n n n" if k < 2000 else " ".join(f"{a} {a}{a} {a}" for a in "pq" * 150)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    v, p = masked_lm.train(spark, docs)
    logs = lambda t: masked_lm.log_probabilities(p, v, [v.classes(t)])[0][4]
    assert logs("q qq q p pp p q qq q") > logs("q qq q p qq p q qq q") + 1


def test_quality_stage_without_usable_labels_keeps_all(data):
    docs, labels = data
    for some in (labels.limit(0), labels.where("quality = 1"), labels.withColumn("doc_id", F.col("doc_id") + 10**9)):
        assert gam.keep_good(docs, gam.train(docs, some)).count() == docs.count()


def test_quality_sample_is_cut_after_the_join(data, monkeypatch):
    docs, labels = data
    some = docs.where("doc_id >= 60")
    monkeypatch.setattr(gam, "SAMPLE_ROWS", 40)  # the first 40 ids by hash are not all among these documents
    seen = []
    monkeypatch.setattr(gam, "fit", lambda x, y: seen.append(len(y)))
    gam.train(some.unionByName(some), labels)
    assert seen == [40]


@pytest.mark.parametrize("text", ["½ ②", "²³", "Ⅷ ৴", "12 _ 3", "٣"])
def test_numbers_are_no_letters(spark, text):
    df = spark.createDataFrame([(k, "the words of a language", "en") for k in range(9)] + [(9, text, None)],
                               "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.contract(df).collect()}[9] == "und"


def test_network_passes_a_corpus_of_any_size_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "one two three four five") for k in range(20)], "doc_id long, text string")
    v = masked_lm.vocabulary(masked_lm.word_counts(spark, docs))
    rows, sent, plain = masked_lm.classified(spark, docs, v), [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or plain(value))
    masked_lm.fit_all(spark, rows, v)
    assert [done for _, _, done in sent] == list(range(masked_lm.ROUNDS))


def test_lm_words_of_many_texts_at_once(spark, monkeypatch):
    """Counts, classes, shares and other words of runs of texts are those of each text split by itself."""
    r = np.random.default_rng(4)
    letters = ["a", "b", "é", "日", "\U0001F642", " ", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", " "]
    texts = ["".join(r.choice(letters, r.integers(0, 60))) for _ in range(150)]
    texts += [None, "", " ", " \n", "a", " a", "a ", "word " * 400, "x" * 900, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    want = Counter(w for t in texts for w in (t or "").encode().split())
    monkeypatch.setattr(masked_lm, "COMMON_WORDS", 260)
    for cut, partial in ((1 << 20, 400_000), (200, 5)):  # in the second, texts of more than 200 bytes go by themselves
        monkeypatch.setattr(masked_lm, "_SLICE", cut)
        monkeypatch.setattr(masked_lm, "PARTIAL", partial)
        counts = masked_lm.word_counts(spark, docs)
        assert {x["word"].encode(): x["n"] for x in counts.collect()} == want
        v = masked_lm.vocabulary(counts)
        assert 0 < len(v.common) < len(want)
        rows = {x["doc_id"]: x for x in masked_lm.classified(spark, docs, v).collect()}
        for k, t in enumerate(texts):
            classes, shares, others = v.read((t or "").encode())
            assert list(rows[k]["classes"]) == classes.tolist() and [w.encode() for w in rows[k]["others"]] == others
            assert rows[k]["shares"] == pytest.approx(shares, abs=1e-9)
            assert classes.tolist() == [v.kinds[v.common[w]] if w in v.common else masked_lm._length_class(w)
                                        for w in (t or "").encode().split()]
        bare = masked_lm.Vocabulary(v.top, v.spread)  # top words alone
        one = masked_lm.Known(bare).read(masked_lm.pa.array(texts, masked_lm.pa.string()))
        assert [list(c) for c in one[0].to_pylist()] == [bare.classes(t).tolist() for t in texts]
        assert one[1].to_pylist() == [0.0] * len(texts) and one[2].to_pylist() == [[]] * len(texts)


def test_lm_gradients_are_those_of_plain_sums():
    r = np.random.default_rng(6)
    ids, at, _ = masked_lm._lay_out([r.integers(0, masked_lm.CLASSES, n).astype(np.uint8) for n in (90, 0, 1, 40)])
    here = r.permutation(at)
    steps = masked_lm.Steps(masked_lm.start(np.ones(masked_lm.CLASSES)))
    found = steps.gradients(ids, here)
    p = {k: v.astype(float) for k, v in steps.p.items()}
    want = {k: np.zeros_like(v) for k, v in p.items()}
    for place in here:
        sides = [ids[place + o] for o in masked_lm.OFFSETS]
        hidden = np.tanh(sum(p["in"][k, c] for k, c in enumerate(sides)) + p["b"])
        e = np.exp(hidden @ p["out"] + p["c"])
        d = e / e.sum()
        d[ids[place]] -= 1
        back = (p["out"] @ d) * (1 - hidden**2)
        want["out"] += np.outer(hidden, d) / len(here)
        want["c"] += d / len(here)
        want["b"] += back / len(here)
        for k, c in enumerate(sides):
            want["in"][k, c] += back / len(here)
    for k in p:
        assert np.allclose(found[k], want[k], atol=1e-6)
    # laid end to end as the arrays are, so that a step copies none of them
    assert np.array_equal(steps.g, np.concatenate([found[k].ravel() for k in p]))
    assert all(np.shares_memory(found[k], steps.g) for k in p)
