"""Cross-tokenizer alignment (11) by diagonal run skipping.

A text is encoded by two tokenizers, and the byte offsets where tokens of both
end cut them into groups.  The two lists of end offsets are walked at an index
shift: while token ``i`` of one list ends where token ``i + shift`` of the other
does, exponential probing compares ever longer slices of both lists at that
shift and halves the slice that differs, so a one-to-one stretch of n tokens
costs some log n comparisons.  Where the ends differ, the side that lags is
advanced until both end together; that irregular group gives the new shift.

Links are the pairs of tokens that end together.  ``pair_counts`` adds them up
over the corpus, and ``scored`` compares every link with the best count of its
second token.

Scale.  Texts are encoded once, in Arrow batches; they are never shuffled.  A
document keeps its distinct linked pairs with their numbers in two binary
columns of a written table.  Pair counts are added up in every task before the
shuffle (at most ``PARTIAL`` pairs at once) and by Spark after it.  The counted
pairs go to the tasks as two sorted arrays if they number at most
``BROADCAST_PAIRS`` (12 bytes each; counted first), else the documents' pairs are
joined with them; both ways give the same rows.

Tokenizers.  A is a byte-level BPE read from its ``tokenizers`` file and run as
``tiktoken`` ranks (a merged pair's id is its rank, checked when it is loaded);
texts over ``LONG`` characters go through the ``tokenizers`` library itself, whose
pattern needs no stack for long runs of blanks.  B is a ``sentencepiece`` model.
Paths are parameters; the files are read by the driver and sent to the tasks.

Defined results: null and empty texts, and texts that either tokenizer does not
give back byte by byte, have no tokens: zeros and an empty digest.  Rows with the
same or a null id keep a row each; a link that occurs n times in a document
counts n times; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import text_batches, written

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters from which the first tokenizer runs in its own library.
LONG = 200_000
#: Distinct pairs that a task holds while it adds up counts.
PARTIAL = 2_000_000
#: Distinct pairs of the corpus that may be broadcast.
BROADCAST_PAIRS = 4_000_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(FIRST), public_tokenizers.path(SECOND)


class Runs(NamedTuple):
    """Stretches of links: tokens ``a + k`` and ``b + k`` end together for k below n."""

    a: list[int]
    b: list[int]
    n: list[int]


#: Tokens of the first slice that is compared at a new shift.
FIRST_PROBE = 4


def diagonal_runs(ends_a: np.ndarray, ends_b: np.ndarray) -> Runs:
    """All offsets in both rising arrays, as stretches of equal index shift.  Both arrays end alike."""
    a, b = (np.ascontiguousarray(x, np.int64) for x in (ends_a, ends_b))
    if len(a) and len(b) and a[-1] != b[-1] or bool(len(a)) != bool(len(b)):
        raise ValueError("both token lists must cover the same bytes")
    return _runs(memoryview(a), memoryview(b), a.tobytes(), b.tobytes())


def _runs(a: memoryview, b: memoryview, raw_a: bytes, raw_b: bytes) -> Runs:
    """``raw_a`` and ``raw_b`` hold the same numbers, 8 bytes each, so that slices are compared as bytes."""
    runs = Runs([], [], [])
    total_a, total_b = len(a), len(b)
    i = j = 0
    while i < total_a and j < total_b:
        x, y = a[i], b[j]
        while x != y:  # an irregular group: the side that lags goes on
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        most = total_a - i if total_a - i < total_b - j else total_b - j
        n, probe, p, q = 1, FIRST_PROBE, i * 8 + 8, j * 8 + 8
        while n < most:  # longer and longer slices at this shift
            size = probe if probe < most - n else most - n
            wide = size * 8
            if raw_a[p:p + wide] == raw_b[q:q + wide]:
                n += size
                p += wide
                q += wide
                probe *= 2
                continue
            while size > 1:  # the first difference lies in this slice
                half = size // 2
                wide = half * 8
                if raw_a[p:p + wide] == raw_b[q:q + wide]:
                    n += half
                    p += wide
                    q += wide
                    size -= half
                else:
                    size = half
            break
        runs.a.append(i)
        runs.b.append(j)
        runs.n.append(n)
        i += n
        j += n
    return runs


class Aligned(NamedTuple):
    """Token ids of both sides and the stretches of links between them."""

    a: np.ndarray
    b: np.ndarray
    runs: Runs

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Token places of both sides, one pair a link."""
        n = np.array(self.runs.n, np.int64)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.array(self.runs.a, np.int64), n) + step, np.repeat(np.array(self.runs.b, np.int64), n) + step

    def groups(self, names: tuple[np.ndarray, np.ndarray]) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the tokens of each group, by ``written_ids`` of both sides.

        Every token is written with the mark that follows it, in its place among all tokens of both sides."""
        at_a, at_b = self.links()
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        before_a, before_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # the token's group
        out = np.empty(len(self.a) + len(self.b), np.uint64)
        ends_a, ends_b = np.concatenate([at_a + 1, [0]]), np.concatenate([[0], at_b + 1])
        out[np.arange(len(self.a)) + ends_b[before_a]] = names[0][self.a, last_a]
        out[np.arange(len(self.b)) + ends_a[before_b]] = names[1][self.b, last_b]
        letters = out.view(np.uint8)
        return letters[letters != 0][:-1].tobytes()


def written_ids(number: int, last: bytes) -> np.ndarray:
    """Decimal ids as 8 bytes, followed by a comma (column 0) or by ``last`` (column 1), filled up with zero bytes."""
    if number > 10 ** 7:
        raise ValueError("an id and its mark must fit 8 bytes")
    return np.column_stack([np.array([b"%d%s" % (k, mark) for k in range(number)], "S8").view(np.uint64) for mark in (b",", last)])


def _byte_level() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of every id, built in a task from the files' contents."""

    def __init__(self, first: str, second: bytes) -> None:
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        model = json.loads(first)["model"]
        byte = _byte_level()
        self.bytes_a = [b""] * (max(model["vocab"].values()) + 1)
        for entry, at in model["vocab"].items():
            self.bytes_a[at] = bytes(byte[c] for c in entry)
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(set(merged)):
            raise ValueError("merge ranks of the byte-level vocabulary do not follow its ids")
        self._file = first
        self._ranks = tiktoken.Encoding(
            "first", pat_str=PATTERN, mergeable_ranks={x: k for k, x in enumerate(self.bytes_a)}, special_tokens={})
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=second)
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self._pieces.is_byte(k) else p.replace("▁", " ").encode()
            for k in range(self._pieces.get_piece_size()) for p in [self._pieces.id_to_piece(k)]
        ]
        self._size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self._size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.names = written_ids(len(self.bytes_a), b"|"), written_ids(len(self.bytes_b), b";")

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.bytes_a), len(self.bytes_b)

    def first(self, text: str) -> np.ndarray:
        if len(text) <= LONG:
            return self._ranks.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(self._file)
        own.encode_special_tokens = True
        return np.array(own.encode(text, add_special_tokens=False).ids, np.int64)

    def align(self, text: str | None) -> Aligned | None:
        """The alignment of one text (A reads a blank and the text, B adds its own), None if it has no tokens."""
        if not text:
            return None
        whole = " " + text
        want = whole.encode()
        b = self._pieces.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        ids_a, ids_b = self.first(whole), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self._size_a[ids_a]), np.cumsum(self._size_b[ids_b])
        if ends_a[-1] != len(want):  # a byte-level vocabulary has every byte, so A keeps all of them
            return None
        return Aligned(ids_a, ids_b, diagonal_runs(ends_a, ends_b))


@cache
def _loaded(first: str, second: bytes) -> Tokenizers:
    return Tokenizers(first, second)


def _files(paths: tuple[str, str] | None) -> tuple[str, bytes]:
    first, second = paths or default_paths()
    with open(first, encoding="utf-8") as f, open(second, "rb") as g:
        return f.read(), g.read()


def alignments(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per input row: doc_id, ids_a, ids_b, and link_a, link_b: the token places that end together.
    Group g holds the tokens after link g - 1 up to link g, on both sides."""
    files = _files(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _loaded(*files)
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                x = both.align(text)
                for col, v in zip(cols, (x.a, x.b, *x.links()) if x else ([],) * 4, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.list_(pa.int32())) for c in cols)],
                ["doc_id", "ids_a", "ids_b", "link_a", "link_b"])

    text_batches(spark)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids_a array<int>, ids_b array<int>, link_a array<int>, link_b array<int>")


def _linked(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, files: tuple[str, bytes]) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): distinct links of every text,
    a pair as one number a * size of B + b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _loaded(*files)
        width, row = both.shape[1], TaskContext.get().partitionId() << 40
        none = (0, 0, 0, 0, "", b"", b"")
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                x = both.align(text)
                if x is None:
                    out.append(none)
                    continue
                at_a, at_b = x.links()
                pairs, times = np.unique(x.a[at_a] * width + x.b[at_b], return_counts=True)
                digest = hashlib.sha256(x.groups(both.names)).hexdigest()
                n = len(at_a)
                out.append((len(x.a), len(x.b), n, n, digest, pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
            rows = pa.array(np.arange(row, row + len(out)))
            row += len(out)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))]
                if out else [rows, batch.column(0), *(pa.array([], k) for k in kinds)],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    text_batches(spark)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "pairs binary, times binary")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times = np.empty(0, np.int64), np.empty(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pairs = np.concatenate([pairs, *(p for p, _ in held)])
            times = np.concatenate([times, *(t for _, t in held)])
            held.clear()
            distinct, place = np.unique(pairs, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, place, times)
            return distinct, total

        def rows(pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])

        waiting = 0
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((np.frombuffer(p, "<u4").astype(np.int64), np.frombuffer(t, "<u4").astype(np.int64)))
                waiting += len(p) // 4
                if waiting >= PARTIAL:
                    pairs, times = added(pairs, times)
                    waiting = 0
                    if len(pairs) >= PARTIAL:
                        yield rows(pairs, times)
                        pairs, times = pairs[:0], times[:0]
        yield rows(*added(pairs, times))

    partial = linked.select("pairs", "times").mapInArrow(run, "pair long, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("n"))


def _scored_by_arrays(spark: SparkSession, linked: DataFrame, counted: DataFrame, width: int) -> DataFrame:
    table = counted.toArrow()
    pair, n = table["pair"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(pair)
    pair, n = pair[order].astype("<u4"), n[order]
    best = np.zeros(width, np.int64)
    np.maximum.at(best, pair.astype(np.int64) % width, n)
    shared = spark.sparkContext.broadcast((pair, n, n == best[pair.astype(np.int64) % width]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, is_best = shared.value
        for batch in batches:
            n_best, count_sum = [], []
            for p, t in zip(*(batch.column(k).to_pylist() for k in ("pairs", "times")), strict=True):
                at = np.searchsorted(pair, np.frombuffer(p, "<u4"))
                times = np.frombuffer(t, "<u4").astype(np.int64)
                n_best.append(int(times[is_best[at]].sum()))
                count_sum.append(int((times * n[at]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in names), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())],
                [*names, "n_best", "count_sum"])

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = dict(linked.dtypes)
    out = linked.select(*names, "pairs", "times").mapInArrow(
        run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", n_best long, count_sum long")
    out = written(spark, out, "alignment-scored")
    shared.destroy()
    return out


def _scored_by_join(spark: SparkSession, linked: DataFrame, counted: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, p, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                pairs = np.frombuffer(p, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), row)), pa.array(pairs), pa.array(np.frombuffer(t, "<u4").astype(np.int64))],
                    ["row", "pair", "times"])

    each = linked.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long")
    best = counted.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("best"))
    told = counted.withColumn("b", F.col("pair") % width).join(best, "b").select(
        "pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    sums = each.join(told, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return linked.drop("pairs", "times").join(sums, "row", "left").drop("row").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def scored(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           paths: tuple[str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    files = _files(paths)
    shape = Tokenizers(*files).shape
    if shape[0] * shape[1] > 1 << 32:
        raise ValueError("a pair of ids must fit 32 bits")
    linked = written(spark, _linked(spark, df, id_col, text_col, files), "alignment-links")
    counted = written(spark, pair_counts(linked), "alignment-pairs")
    by = _scored_by_arrays if counted.count() <= broadcast_pairs else _scored_by_join
    return by(spark, linked, counted, shape[1]).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def contract(spark: SparkSession, df: DataFrame) -> DataFrame:
    return scored(spark, df).withColumn("doc_id", F.col("doc_id").cast("long"))
