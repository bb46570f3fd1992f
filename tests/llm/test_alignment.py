"""Diagonal runs against a set of offsets, the registered result against a slow model."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ebbtide.llm import alignment as A


@pytest.mark.parametrize("seed", range(60))
def test_runs_are_the_common_offsets(seed):
    r = random.Random(seed)
    total = r.randint(1, 400)
    keep = r.choice([0.1, 0.5, 0.9, 0.99])
    a = sorted({x for x in range(1, total) if r.random() < keep} | {total})
    b = sorted({x for x in a if r.random() < keep} | {x for x in range(1, total) if r.random() < 0.1} | {total})
    runs = A.diagonal_runs(np.array(a), np.array(b))
    got = [(i + k, j + k) for i, j, n in zip(*runs, strict=True) for k in range(n)]
    assert got == [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]
    for (i, j, n), (i2, j2) in zip(zip(*runs, strict=True), list(zip(*runs[:2], strict=True))[1:], strict=False):
        assert (i2, j2) != (i + n, j + n)  # stretches are as long as they can be


def test_runs_of_nothing_and_of_other_texts():
    assert A.diagonal_runs(np.array([]), np.array([])) == ([], [], [])
    assert A.diagonal_runs(np.array([3]), np.array([1, 2, 3])) == ([0], [2], [1])
    for other in ([1], []):
        with pytest.raises(ValueError):
            A.diagonal_runs(np.array([1, 2]), np.array(other))


def test_probing_jumps_long_stretches():
    """A one-to-one stretch costs some log n slices, not n comparisons."""

    class Counted(bytes):
        slices = 0

        def __getitem__(self, at):
            Counted.slices += 1
            return super().__getitem__(at)

    n = 100_000
    a = np.arange(1, n + 1)
    assert A._runs(memoryview(a), memoryview(a), Counted(a.tobytes()), Counted(a.tobytes())) == ([0], [0], [n])
    assert Counted.slices < 60


TEXTS = [
    "The licence of the programme, in plain words; the licence is free.", "The licence is free.", "<|endoftext|> and <s>",
    "", None, " ", "  two  blanks \n\n lines\t", "Ünïcödé ßtraße — naïve façade", "日本語のテキスト 中文", "é decomposed", "ﬁ ½ Ａ",
    "a\x00b", "🙂🙂 x", "The licence is free.", "word " * 3000, "q" * 5000, "▁ lower one eighth block", " " * 300 + "z",
]


def slow(texts):
    """Every row by the definition: offsets as sets, pairs counted one by one."""
    own = Tokenizer.from_file(public_tokenizers.path(A.FIRST))
    own.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(A.SECOND))
    byte = A._byte_level()
    rows, links = [], []
    for text in texts:
        rows.append((0, 0, 0, ""))
        links.append([])
        if not text:
            continue
        whole = (" " + text).encode()
        a, b = own.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        part_a = [bytes(byte[c] for c in own.id_to_token(x)) for x in a]
        part_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p != "<0x" and len(p) == 6 else p.replace("▁", " ").encode()
                  for p in map(pieces.id_to_piece, b)]
        if b"".join(part_a) != whole or b"".join(part_b) != whole:
            continue
        end_a = np.cumsum([len(x) for x in part_a]).tolist()
        end_b = np.cumsum([len(x) for x in part_b]).tolist()
        cuts = sorted(set(end_a) & set(end_b))
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(x) for x, e in zip(a, end_a, strict=True) if low < e <= cut) + "|"
                          + ",".join(str(x) for x, e in zip(b, end_b, strict=True) if low < e <= cut))
            low = cut
        ending = dict(zip(end_b, b, strict=True))
        links[-1] = [(x, ending[e]) for x, e in zip(a, end_a, strict=True) if e in ending]
        rows[-1] = (len(a), len(b), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = Counter(x for each in links for x in each)
    best: dict[int, int] = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(a, b, g, len(each), sum(count[x] == best[x[1]] for x in each), sum(count[x] for x in each), digest)
            for (a, b, g, digest), each in zip(rows, links, strict=True)]


@pytest.mark.parametrize("most", [A.BROADCAST_PAIRS, 0])
def test_result_against_the_definition(spark, most):
    texts = TEXTS[:14] + ["word " * 60, "q" * 700] + TEXTS[16:]
    df = spark.createDataFrame([(k % 7 if k else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, pairs string")
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in A.scored(spark, df.repartition(3), broadcast_pairs=most).collect())
    want = sorted((k % 7 if k else -1, *row) for k, row in enumerate(slow(texts)))
    assert got == want
    assert sum(r[1] > 0 for r in got) >= 8


def test_long_texts_run_in_the_other_library(monkeypatch):
    files = A._files(None)
    both = A.Tokenizers(*files)
    for text in (t for t in TEXTS if t):
        want = both.first(text).tolist()
        monkeypatch.setattr(A, "LONG", 0)
        assert both.first(text).tolist() == want
        monkeypatch.undo()
    blanks = both.align(" " * 1_000_000)  # a run that the first library can't take
    assert blanks is not None and len(blanks.a) == 1_000_001


def test_arrays_of_the_operator(spark):
    df = spark.createDataFrame([(1, "The licence is free."), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in A.alignments(spark, df).collect()}
    both = A.Tokenizers(*A._files(None))
    x = both.align("The licence is free.")
    assert rows[1]["ids_a"] == x.a.tolist() and rows[1]["ids_b"] == x.b.tolist()
    a, b = x.links()
    assert rows[1]["link_a"] == a.tolist() and rows[1]["link_b"] == b.tolist() and a[-1] == len(x.a) - 1
    assert rows[2]["ids_a"] == [] and rows[2]["link_b"] == []


def test_partial_counts_and_empty_tables(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"some words here {k % 3}") for k in range(30)], "doc_id long, text string")
    want = sorted(A.scored(spark, df).collect())
    monkeypatch.setattr(A, "PARTIAL", 3)
    assert sorted(A.scored(spark, df).collect()) == want
    none = A.contract(spark, spark.createDataFrame([], df.schema))
    assert none.collect() == []
    assert none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
