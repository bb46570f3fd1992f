"""Ids against the tiktoken library, exact round trips, defined edge cases."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from ebbtide.llm import bpe


@pytest.fixture(scope="module")
def encoding():
    with open(P.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(7)
    some = ["", "hello world", "  two  blanks \n\n\tand more ", "don't we'll I'VE", "ñandú éèê ßüö Привет 你好世界 🙂🙂 ",
            "<|endoftext|> #$%& 1234567890 ½Ⅷ²", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 700, "a\x1cb \x1f c\x85d\xa0e \u2003f", "\x00\x01\x7f", "éö"]
    letters = "abcdeghilmnoprstuvéñöß "
    some += ["".join(r.choice(letters) for _ in range(r.randint(1, 400))) for _ in range(40)]
    return some


def test_ids_and_round_trip(spark, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "COMMON_WORDS", 30)  # both ways of folding
    every = texts()
    rows = [(i, t, [9], "x") for i, t in enumerate(every)] + [(100, None, None, None), (0, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n_tokens string")
    out = bpe.encode(spark, df)
    got = out.collect()
    assert len(got) == len(rows) and sorted(out.columns) == sorted(df.columns)
    for r in got:
        want = encoding.encode_ordinary(every[r["doc_id"]]) if r["doc_id"] < 100 else []
        assert r["ids"] == want, every[r["doc_id"]]
    for r in bpe.decode(spark, out).collect():
        assert bytes(r["bytes"]) == (r["text"] or "").encode()
    for r in bpe.contract(spark, df).collect():
        text = every[r["doc_id"]] if r["doc_id"] < 100 else ""
        ids = encoding.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_long_text_in_runs(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 3)
    text = "one two  three\n\n four 55 it's" * 3
    parts = list(bpe.Splitter(P.PATTERN).runs(text))
    assert len(parts) > 3 and "".join(p for run in parts for p in run) == text


@pytest.mark.parametrize("letters", ["a", "ab", "acgt", "abcdefghijklmnopqrstuvwxyz", "日本語のテキスト", "\U0001F642é"])
def test_long_pieces_from_a_heap(encoding, letters):
    r, ranks = random.Random(len(letters)), bpe.ranks(P.path(bpe.VOCABULARY))
    for n in (1, 2, 3, 7, 40, 300, 3_000):
        piece = "".join(r.choice(letters) for _ in range(n)).encode()
        assert bpe.merged(piece, ranks) == encoding._core_bpe.encode_single_piece(piece), n


def test_very_long_pieces_end(spark, encoding):
    r = random.Random(3)
    base = "".join(r.choice("ACGT") for _ in range(1_000_000))
    rows = [(1, base), (2, "x" * 700 + " " + base[:5_000] + " tail " + base[:5_000]), (3, "=" * 3_000 + " " * 3_000 + "z"),
            (4, base[:bpe.LONG_PIECE]), (5, base[:bpe.LONG_PIECE + 1]), (6, "é" * 200)]
    for row in bpe.encode(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert row["ids"] == encoding.encode_ordinary(row["text"])


def test_plain_pattern_splits_latin_alike():
    r = random.Random(1)
    split = bpe.Splitter(P.PATTERN)
    assert split.plain is not split.whole
    for _ in range(3000):
        text = "".join(chr(r.choice([r.randrange(128), r.randrange(256), 32, 39, 115, 10])) for _ in range(r.randint(0, 30)))
        assert split.plain.findall(text) == split.whole.findall(text), text


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.contract(spark, none).count() == 0


def test_ids_of_many_texts_are_put_in_order_at_once():
    r = random.Random(5)
    codes, rare, want = [], [], []
    for _ in range(60):
        words = [[r.randrange(50_000) for _ in range(r.randrange(1, 5))] for _ in range(r.randrange(4))]
        code, ids = [], []
        for _ in range(r.randrange(12)):
            k = r.randrange(len(words)) if words and r.random() < 0.4 else None
            code.append(r.randrange(50_000) if k is None else (1 << 32) - 1 - k)
            ids += code[-1:] if k is None else words[k]
        codes.append(bpe.np.array(code, "<u4").tobytes())
        rare.append(words)
        want.append(ids)
    lists = bpe.pa.array([[[1, 2]], *rare, [[3]]], bpe.pa.list_(bpe.pa.list_(bpe.pa.int64()))).slice(1, len(rare))
    ids, ends = bpe._in_order(codes, lists)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


def test_digests_do_not_depend_on_how_many_texts_are_joined_at_once(spark, monkeypatch):
    rows = [(k, ("zqxv%d Wörter " % (k * 977)) * (k % 7)) for k in range(40)] + [(40, None), (41, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, bpe.contract(spark, df).collect()))
    monkeypatch.setattr(bpe, "RUN", 2)
    assert sorted(map(tuple, bpe.contract(spark, df).collect())) == whole and len(whole) == 42


def test_first_steps_of_all_pieces_at_once(encoding, monkeypatch):
    """After any number of early steps the parts are those of the byte-pair rule, and all of them end as tiktoken's ids."""
    r, path = random.Random(11), P.path(bpe.VOCABULARY)
    ranks = bpe.ranks(path)
    pieces = ["".join(r.choice("abcdehinorstéñ日") for _ in range(r.randrange(1, 40))) for _ in range(400)] + ["a", "aaaa", "éé", ""]

    def slow(piece, steps):
        parts = [bytes([b]) for b in piece.encode()]
        for _ in range(steps):
            low, at = min(((ranks.get(a + b, bpe.NO_RANK), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))),
                          default=(bpe.NO_RANK, 0))
            if low < bpe.NO_RANK:
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    for steps in (0, 1, 3, 5, 60):
        monkeypatch.setattr(bpe, "EARLY_STEPS", steps)
        got = bpe.Starts(path)(pieces).to_pylist()
        for piece, numbers in zip(pieces, got, strict=True):
            parts = slow(piece, steps)
            at = [sum(map(len, parts[:i])) for i in range(len(parts))]
            pair = [ranks.get(a + b, bpe.NO_RANK) for a, b in zip(parts, [*parts[1:], b"\xff" * 99], strict=False)]
            assert numbers == [(p << 40) + (k << 16) + ranks[x] for p, k, x in zip(pair, at, parts, strict=True)], (piece, steps)
            if steps == 60:
                assert [ranks[x] for x in parts] == (encoding._core_bpe.encode_single_piece(piece.encode()) if piece else [])


def test_fold_does_what_the_early_steps_leave(spark, encoding, monkeypatch):
    every = texts()
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    for steps in (0, 2):
        monkeypatch.setattr(bpe, "EARLY_STEPS", steps)
        for r in bpe.encode(spark, df).collect():
            assert r["ids"] == encoding.encode_ordinary(every[r["doc_id"]])


def test_plan_does_not_spell_out_the_rank_map(spark):
    """The driver keeps the descriptions of a thousand plans; the rank map has some 300,000 numbers."""
    df = spark.createDataFrame([(1, "zqxv wörtlich")], "doc_id long, text string")
    out = bpe.contract(spark, df)
    plan = out._jdf.queryExecution()
    assert len(plan.toString()) < 100_000
    # the map is no column of a row: one projection stands between the two Arrow steps
    assert plan.executedPlan().toString().split("MapInArrow split")[0].count("Project [") == 1 and out.count() == 1
