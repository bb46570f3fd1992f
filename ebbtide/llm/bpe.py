"""Byte-level BPE encoding and decoding (3).

A text is split by the tokenizer's pattern, and every piece is encoded by
itself.  A piece that is a token is that token.  Any other piece is folded by
Spark higher-order functions: its UTF-8 bytes are the first parts (laid out by NumPy,
with the rank of each two neighbouring bytes from a table), and each step
of an ``aggregate`` merges the leftmost neighbouring pair of lowest rank until
no pair has one.  A part is one number: the rank of the pair it begins, the place
of its first byte and its id, so the smallest number is the leftmost pair of
lowest rank, and a step looks up two new pairs only.  The first ``EARLY_STEPS``
steps, which nearly every piece has, are taken by NumPy for all pieces of a batch at
once; the fold goes on from the parts they leave.

Rank map.  A constant: entry ``(left id, right id) -> rank`` for each split of a
token into two tokens, in an array addressed by the pair's hash and a second
array of displacements chosen so that no two pairs share a place.  (A map would be
searched entry by entry.)  A merged pair's rank is its id.  Both arrays are the one row
of a scalar subquery: an array literal would be spelled out, 300,000 numbers, in every
description of a plan, and the driver keeps those of a thousand plans.

Distinct words.  Pieces that are no tokens are counted over all rows.  Those at
or above the smallest count that at most ``COMMON_WORDS`` distinct pieces reach
are folded once, as a table of distinct words, and their ids are broadcast (a
bounded table).  All others are folded once for each text they stand in.  The
bound only decides where a piece is folded, never what comes out.

Long pieces.  A step of the fold copies the piece, so pieces of more than
``LONG_PIECE`` bytes (unbroken base64 or DNA, scripts without blanks) are merged in
the same order, lowest rank first and leftmost among equals, from a heap of pairs
beside linked neighbours: n log n instead of n squared, with the same result.

Around the fold, Arrow batches split texts and put the ids of their pieces in
order; texts are never shuffled.  Decoding concatenates the tokens' bytes.  The
tokenizer file is read by the driver from a path that is a parameter.

Defined results: null and empty texts have no tokens and decode to no bytes;
repeated rows are encoded one by one; an id outside the vocabulary is an error
of the caller and raises; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from ebbtide.llm.common import text_batches, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Largest number of distinct pieces folded ahead and broadcast (about 40 bytes each).
COMMON_WORDS = 400_000
#: Counts from here on are told apart no further when the smallest common count is chosen.
TOP_COUNT = 10_000
#: Pieces held at once: of a text, and distinct ones in a partial count.
RUN, PARTIAL = 200_000, 200_000
#: Bytes from which on a piece is merged from a heap.
LONG_PIECE = 256
#: Steps of the fold that are taken for all pieces of a batch at once.
EARLY_STEPS = 5
#: Places of the rank map and of its displacements (powers of two).
PLACES, SHIFTS = 1 << 18, 1 << 15
NO_RANK = 65536


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, which is also the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


# ---- the rank map -----------------------------------------------------------

@cache
def _pairs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids that make a token, as left * 65536 + right in order, and their ranks."""
    vocabulary, pairs = ranks(path), {}
    for token, rank in vocabulary.items():
        for i in range(1, len(token)):
            left, right = vocabulary.get(token[:i]), vocabulary.get(token[i:])
            if left is not None and right is not None:
                pairs[left * 65536 + right] = rank
    keys = np.fromiter(pairs, np.int64, len(pairs))
    order = np.argsort(keys)
    return keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]


@cache
def _rank_map(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The displacement array and the places (pair * 65536 + rank, negative if empty)."""
    groups: dict[int, list[tuple[int, int, int]]] = {}
    for key, rank in zip(*(x.tolist() for x in _pairs(path)), strict=True):
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42)
        groups.setdefault(h % SHIFTS, []).append((key, rank, (h >> 20) % PLACES))
    shift, places = [0] * SHIFTS, [-(1 << 20)] * PLACES
    for number, group in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
        for by in range(PLACES):
            spots = {at ^ by for _, _, at in group}
            if len(spots) == len(group) and all(places[s] < 0 for s in spots):
                break
        else:
            raise ValueError("two pairs cannot be told apart by their hash")
        shift[number] = by
        for key, rank, at in group:
            places[at ^ by] = key * 65536 + rank
    return np.array(shift, np.int32), np.array(places, np.int64)


class Starts:
    """The first parts of pieces, a number each from its id, its place and the rank of the pair it begins: the bytes,
    and what the first ``EARLY_STEPS`` steps make of them."""

    def __init__(self, path: str):
        vocabulary = ranks(path)
        self.keys, self.ranks = _pairs(path)
        self.steps = EARLY_STEPS
        self.one = np.array([vocabulary[bytes([b])] for b in range(256)], np.int64)
        self.two = np.full(1 << 16, NO_RANK, np.int64)
        for token, rank in vocabulary.items():
            if len(token) == 2:
                self.two[token[0] * 256 + token[1]] = rank

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = (left & 65535) * 65536 + (right & 65535)
        if not len(self.keys):
            return np.full(len(pair), NO_RANK, np.int64)
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], NO_RANK)

    def _step(self, parts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leftmost pair of lowest rank becomes one part in each of the pieces, none of them empty."""
        lowest = np.minimum.reduceat(parts, np.cumsum(sizes) - sizes)
        with_pair = np.flatnonzero(lowest >> 40 < NO_RANK)
        lowest[lowest >> 40 >= NO_RANK] = -1
        at = np.flatnonzero(parts == np.repeat(lowest, sizes))  # a place stands once in a piece
        made = parts[at] >> 40
        parts = np.delete(parts, at + 1)
        at -= np.arange(len(at))  # parts before it that are gone
        sizes = sizes.copy()
        sizes[with_pair] -= 1
        ends = np.cumsum(sizes)[with_pair]
        parts[at] = (NO_RANK << 40) + (parts[at] & 0xFFFFFF0000) + made
        for left in (at[at + 1 < ends], at[at > ends - sizes[with_pair]] - 1):
            parts[left] = (self._rank(parts[left], parts[left + 1]) << 40) + (parts[left] & ((1 << 40) - 1))
        return parts, sizes

    def __call__(self, pieces: list[str]) -> pa.ListArray:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        full = np.flatnonzero(sizes)
        ends = np.cumsum(sizes)
        cells = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        pair = np.full(len(cells), NO_RANK, np.int64)
        pair[:-1] = self.two[cells[:-1] * 256 + cells[1:]]
        pair[ends[full] - 1] = NO_RANK  # the last byte of a piece begins no pair
        place = np.arange(len(cells)) - np.repeat(ends - sizes, sizes)
        parts = (pair << 40) + (place << 16) + self.one[cells]
        for _ in range(self.steps if len(full) else 0):
            parts, sizes[full] = self._step(parts, sizes[full])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                        pa.array(parts, pa.int64()))


def merged(piece: bytes, vocabulary: dict[bytes, int]) -> list[int]:
    """The ids of a piece of any length, pairs taken from a heap by rank and place."""
    end = list(range(1, len(piece) + 1))  # of the part that begins at a place; 0 for places inside a part
    before = list(range(-1, len(piece)))
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and (middle := end[at]) < len(piece):
            rank = vocabulary.get(piece[at:end[middle]])
            if rank is not None:
                heap.append((rank, at, end[middle])) if filling else heapq.heappush(heap, (rank, at, end[middle]))

    filling = True
    for at in range(len(piece) - 1):
        offer(at)
    heapq.heapify(heap)
    filling = False
    while heap:
        _, at, stop = heapq.heappop(heap)
        middle = end[at]
        if not middle or middle >= len(piece) or end[middle] != stop:
            continue  # one of the two parts has been merged since
        end[at], end[middle] = stop, 0
        before[stop] = at
        offer(at)
        offer(before[at])
    out, at = [], 0
    while at < len(piece):
        out.append(vocabulary[piece[at:end[at]]])
        at = end[at]
    return out


class Fold:
    """Folds the pieces of an array column, given by their first parts, to their ids."""

    def __init__(self, spark: SparkSession, path: str):
        shift, places = (pa.array([x], pa.list_(pa.from_numpy_dtype(x.dtype))) for x in _rank_map(path))
        self.map = spark.createDataFrame(pa.table({"shift": shift, "places": places}))

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        # a column of its own until the optimizer puts the subquery in its place; bound once, outside of all other
        # lambdas, so that the plan holds one copy of the rank map
        bound = F.array(F.col("__map"))
        return df.withColumn("__map", self.map.select(F.struct("shift", "places").alias("map")).scalar()).withColumn(
            name, F.get(F.transform(bound, lambda t: F.transform(name, _Steps(t["shift"], t["places"]))), F.lit(0))
        ).drop("__map")


class _Steps:
    def __init__(self, shift: Column, places: Column):
        self.shift, self.places = shift, places

    def _rank(self, pair: Column) -> Column:
        """Rank of a pair of ids, ``NO_RANK`` if they make no token or there is no pair."""
        h = F.xxhash64(pair)
        at = F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(PLACES - 1)).cast("int").bitwiseXOR(
            F.get(self.shift, h.bitwiseAND(F.lit(SHIFTS - 1)).cast("int")))
        # the place of another pair, or an empty one, differs by 65536 or more, or is negative (made positive and large)
        return F.least((F.get(self.places, at) - pair * 65536).bitwiseAND(F.lit((1 << 62) - 1)), F.lit(NO_RANK))

    def _merge(self, parts: Column) -> Column:
        """One step: the leftmost pair of lowest rank becomes one part, whose id is that rank."""
        def found(low: Column) -> Column:
            rank = F.shiftright(low, 40)
            # (array_position throws internally to stop at a hit, which costs more than this pass)
            place = F.array(F.array_min(F.transform(parts, lambda x, i: F.when(x == low, i + 1))))
            return F.when(rank < NO_RANK, F.get(F.transform(place, lambda at: joined(low, rank, at)), F.lit(0))).otherwise(
                parts)

        def joined(low: Column, rank: Column, at: Column) -> Column:  # the pair's place, counted from 1
            before, after = F.get(parts, at - 2), F.get(parts, at + 1)
            # the part before, which now begins another pair, and the merged part (lambdas bind each pair once)
            two = F.transform(F.array(_id(before) * 65536 + rank, rank * 65536 + _id(after)), lambda pair, i: F.shiftleft(
                self._rank(pair), 40) + F.when(i == 0, before.bitwiseAND(F.lit((1 << 40) - 1))).otherwise(
                    low.bitwiseAND(F.lit(0xFFFFFF0000)) + rank))
            return F.concat(
                F.slice(parts, 1, F.greatest(at - 2, F.lit(0))),
                F.when(at > 1, two).otherwise(F.slice(two, 2, 1)),
                F.slice(parts, at + 2, F.size(parts)),
            )

        return F.get(F.transform(F.array(F.array_min(parts)), found), F.lit(0))

    def __call__(self, start: Column) -> Column:
        folded = F.aggregate(F.slice(start, 2, F.size(start)), start, lambda parts, _: self._merge(parts),
                             lambda parts: F.transform(parts, _id))
        return F.when(F.shiftright(F.array_min(start), 40) < NO_RANK, folded).otherwise(F.transform(start, _id))


def _id(part: Column) -> Column:
    return part.bitwiseAND(F.lit(65535))


# ---- pieces -----------------------------------------------------------------

def _latin(name: str) -> str:
    """The characters of a property below U+0100, escaped for a bracket of the standard library's patterns."""
    return "".join(f"\\x{ord(c):02x}" for c in regex.findall(rf"\p{{{name}}}", "".join(map(chr, range(256)))))


@cache
def _patterns(pattern: str) -> tuple[re.Pattern, re.Pattern]:
    """The pattern for texts of Latin-1 alone, its properties spelled out for the faster standard library, and for all texts."""
    whole = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    plain = whole
    for name in ("L", "N", "White_Space"):
        a, b, inside, out = rf"\p{{{name}}}", _latin(name), plain.split("["), []
        for k, part in enumerate(inside):  # within brackets the characters stand by themselves
            head, close, tail = part.partition("]") if k else ("", "", part)
            out.append(head.replace(a, b) + close + tail.replace(a, f"[{b}]"))
        plain = "[".join(out)
    plain = plain.replace(r"\P{White_Space}", f"[^{_latin('White_Space')}]")
    slow = regex.compile(whole)
    return slow if "\\p" in plain.lower() else re.compile(plain), slow


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """The tokenizer's pattern; texts of Latin-1 alone take an equal pattern that the standard library runs faster."""

    def __init__(self, pattern: str):
        self.plain, self.whole = _patterns(pattern)

    def runs(self, text: str | None) -> Iterator[list[str]]:
        """The pieces of a whole text, in runs of bounded size."""
        if not text:
            return
        pattern = self.plain if _is_latin(text) else self.whole
        if len(text) <= 4 * RUN:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while run := list(islice(found, RUN)):
            yield run


def _counted(docs: DataFrame, text_col: str, pattern: str, sent_vocabulary) -> DataFrame:
    """(piece, n) over all rows, pieces that are tokens and long pieces left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, vocabulary = Splitter(pattern), sent_vocabulary.value
        counts: Counter[str] = Counter()

        def part() -> pa.RecordBatch:
            pieces = [p for p in counts
                      if (raw := p.encode("utf-8", "surrogatepass")) not in vocabulary and len(raw) <= LONG_PIECE]
            out = pa.RecordBatch.from_arrays(
                [pa.array(pieces, pa.string()), pa.array(np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces)))], ["piece", "n"])
            counts.clear()
            return out

        for b in batches:
            for text in b.column(0):
                for pieces in split.runs(text.as_py()):
                    counts.update(pieces)
                    if len(counts) >= PARTIAL:
                        yield part()
        yield part()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "piece string, n long").groupBy(
        "piece").agg(F.sum("n").alias("n"))


def _common(counted: DataFrame, fold: Fold, sent_starts) -> pa.Table | None:
    """(piece, ids of 32 bits each) of the most frequent distinct pieces, at most ``COMMON_WORDS``."""
    heights = (
        counted.groupBy(F.least("n", F.lit(TOP_COUNT)).alias("n")).agg(F.count(F.lit(1)).alias("pieces"))
        .orderBy(F.desc("n")).collect()  # at most TOP_COUNT rows
    )
    least, total = None, 0
    for r in heights:
        total += r["pieces"]
        if total > COMMON_WORDS:
            break
        least = r["n"]
    if least is None:
        return None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.asarray(x, "<u4").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["piece", "ids"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = sent_starts.value
        for b in batches:
            one_each = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1), pa.int32()), starts(b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), one_each], ["piece", "ids"])

    return (
        fold(counted.where(F.col("n") >= least).select("piece").mapInArrow(begin, "piece string, ids array<array<bigint>>"),
             "ids")
        .select("piece", F.get("ids", F.lit(0)).alias("ids")).mapInArrow(pack, "piece string, ids binary").toArrow()  # at most COMMON_WORDS rows
    )


# ---- encoding and decoding --------------------------------------------------

def _assembled(spark: SparkSession, docs: DataFrame, text_col: str, keep: list[str], path: str, pattern: str,
               emitter: Callable[[], Callable[[np.ndarray, np.ndarray], dict]], fields: str) -> DataFrame:
    """``keep`` and what a task's emitter makes of the ids of some rows, end to end, and the places where rows end."""
    text_batches(spark)
    sent_vocabulary = spark.sparkContext.broadcast(ranks(path))
    sent_starts = spark.sparkContext.broadcast(Starts(path))
    fold = Fold(spark, path)
    counted = written(spark, _counted(docs, text_col, pattern, sent_vocabulary), "bpe-pieces")
    sent = spark.sparkContext.broadcast(_common(counted, fold, sent_starts))  # stays a table on the driver

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent_vocabulary.value
        find, starts = Splitter(pattern), sent_starts.value
        table = {t.decode("utf-8"): r.to_bytes(4, "little") for t, r in vocabulary.items() if _is_text(t)}
        if sent.value is not None:
            table.update(zip(sent.value.column(0).to_pylist(), sent.value.column(1).to_pylist(), strict=True))
        known = table.get
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                codes, rare, sizes = [], [], [0]
                for text in part.column(len(keep)):
                    new: dict[str, bytes] = {}
                    joined = []
                    for pieces in find.runs(text.as_py()):
                        out = list(map(known, pieces))
                        for i in [i for i, x in enumerate(out) if x is None] if None in out else ():
                            if len(pieces[i]) > LONG_PIECE // 4 and len(
                                    raw := pieces[i].encode("utf-8", "surrogatepass")) > LONG_PIECE:
                                x = np.array(merged(raw, vocabulary), "<u4").tobytes()
                            elif (x := new.get(pieces[i])) is None:
                                # numbers from the top of the 32 bits stand for the text's own words
                                x = new[pieces[i]] = ((1 << 32) - 1 - len(new)).to_bytes(4, "little")
                            out[i] = x
                        joined.append(b"".join(out))
                    codes.append(b"".join(joined))
                    rare += new
                    sizes.append(len(rare))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.array(codes, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), starts(rare))], [*keep, "__codes", "__rare"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = emitter()
        for b in batches:
            at = 0
            codes = b.column(len(keep)).to_pylist()
            while at < len(b):
                stop, held = at + 1, len(codes[at])
                while stop < min(len(b), at + 256) and held + len(codes[stop]) <= 4 * RUN:
                    held += len(codes[stop])
                    stop += 1
                part = b.slice(at, stop - at)
                made = emit(*_in_order(codes[at:stop], part.column(len(keep) + 1)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)],
                     *(v if isinstance(v, pa.Array) else pa.array(v, to_arrow.field(k).type) for k, v in made.items())],
                    [*keep, *made])
                at = stop

    added = StructType.fromDDL(fields)
    to_arrow = to_arrow_schema(added)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    coded = source.mapInArrow(
        split, StructType([*source.schema.fields[:-1], *StructType.fromDDL("__codes binary, __rare array<array<bigint>>")]))
    return fold(coded, "__rare").mapInArrow(join, StructType([*source.schema.fields[:-1], *added.fields]))


def _is_text(token: bytes) -> bool:
    try:
        token.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _in_order(codes: list[bytes], rare: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts, end to end, and where each text begins and the last ends: the ids of a text's own words,
    of which word k's lie in its k-th list of ``rare``, in the places that stand for them."""
    out = np.frombuffer(b"".join(codes), "<u4").astype(np.int64)
    ends = np.cumsum([0, *(len(c) // 4 for c in codes)])
    first = rare.offsets.to_numpy().astype(np.int64)
    inner = (rare.values.offsets.to_numpy() - rare.values.offsets[0].as_py()).astype(np.int64)
    begins, words = np.repeat(first[:-1], np.diff(ends)), np.repeat(np.diff(first), np.diff(ends))
    own = np.flatnonzero(out >= (1 << 32) - words)
    if not len(own):
        return out, ends
    flat = rare.values.flatten().to_numpy(zero_copy_only=False)
    number = (1 << 32) - 1 - out[own] + begins[own]
    mine = inner[number + 1] - inner[number]
    sizes = np.ones(len(out), np.int64)
    sizes[own] = mine
    stops = np.concatenate([[0], np.cumsum(sizes)])
    out = np.repeat(out, sizes)
    inside = np.arange(int(mine.sum())) - np.repeat(np.cumsum(mine) - mine, mine)
    out[np.repeat(stops[own], mine) + inside] = flat[np.repeat(inner[number], mine) + inside]
    return out, stops[ends]


def encode(spark: SparkSession, docs: DataFrame, text_col: str = "text", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """The input's columns and ``ids``, the tokens of each whole text (an input column of that name is replaced)."""
    keep = [c for c in docs.columns if c.lower() != "ids"]
    return _assembled(spark, docs, text_col, keep, path or default_vocabulary(), pattern or default_pattern(),
                      lambda: lambda ids, ends: {"ids": _lists(ids, ends)}, "ids array<int>")


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def _by_id(path: str) -> list[bytes | None]:
    vocabulary = ranks(path)
    out: list[bytes | None] = [None] * (max(vocabulary.values(), default=-1) + 1)
    for token, rank in vocabulary.items():
        out[rank] = token
    return out


def _concatenated(pieces: pa.LargeBinaryArray, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The binary pieces that ids name, one after the other (a taken array's values lie end to end), and where each begins."""
    taken = pieces.take(pa.array(ids, pa.int64()))
    if taken.null_count:
        raise ValueError("an id is not in the vocabulary")
    offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
    return memoryview(taken.buffers()[2] if len(taken) else b""), offsets


def decode(spark: SparkSession, df: DataFrame, ids_col: str = "ids", out_col: str = "bytes",
           path: str | None = None) -> DataFrame:
    """The input's columns and the bytes of each row's ids (no ids or null: no bytes)."""
    sent = spark.sparkContext.broadcast(_by_id(path or default_vocabulary()))
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(sent.value, pa.large_binary())
        for b in batches:
            texts = []
            for ids in b.column(at).to_pylist():
                data, offsets = _concatenated(tokens, np.array(ids or (), np.int64))
                texts.append(bytes(data[offsets[0]:offsets[-1]]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, out_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out_col, BinaryType())]))


def digests(spark: SparkSession, docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None,
            pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """``keep``, n_tokens, and the SHA-256 of the ids (joined by commas) and of the bytes they decode to; the ids too, if asked for."""
    path = path or default_vocabulary()
    sent = spark.sparkContext.broadcast(_by_id(path))

    def emitter() -> Callable[[np.ndarray, np.ndarray], dict]:
        tokens = pa.array(sent.value, pa.large_binary())
        names = pa.array([b"%d," % i for i in range(len(sent.value))], pa.large_binary())

        def digest(pieces: pa.LargeBinaryArray, ids: np.ndarray, ends: np.ndarray, last: int) -> list[str]:
            data, offsets = _concatenated(pieces, ids)
            cuts = offsets[ends].tolist()
            return [hashlib.sha256(data[a:max(a, b - last)]).hexdigest() for a, b in pairwise(cuts)]

        def emit(ids: np.ndarray, ends: np.ndarray) -> dict:
            return ({"ids": _lists(ids, ends)} if with_ids else {}) | {
                "n_tokens": np.diff(ends),
                "ids_sha256": digest(names, ids, ends, 1),  # but for the comma after the last id
                "decoded_sha256": digest(tokens, ids, ends, 0),
            }

        return emit

    return _assembled(spark, docs, text_col, keep, path, pattern or default_pattern(), emitter,
                      ("ids array<int>, " if with_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string")


def contract(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return digests(spark, docs, ["doc_id"])
