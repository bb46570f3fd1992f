"""SimHash near-dedup (2) by deletion-variant signatures.

A document becomes one 64-bit fingerprint of its word shingles.  Two
fingerprints are linked if at most ``max_bits`` (3) bits differ.

Candidate search.  A fingerprint is cut into ``max_bits // 2 + 1`` segments
(two of 32 bits for 3 bits), fewer than the usual ``max_bits + 1``.  By the
pigeonhole principle at least one segment of a linked pair then differs by at
most one bit.  Each segment is indexed as it is, and once more for each of its
bits with that bit replaced by a wildcard.  Two segments that differ in exactly
one bit meet under exactly one wildcard variant, one carrying 0 and the other 1
there, so the equality join pairs the zeros of a variant with its ones only;
equal segments meet under the plain key.  Every joined pair is verified on all
64 bits inside the join condition.

Scale.  Only distinct fingerprints are indexed, so exact copies, however many,
are one row (pre-aggregated before the shuffle).  An index row holds the
fingerprint and a key of a few bytes.  No pair is emitted but true links, and a
fingerprint has a bounded number of those: at most 32 * (1 + 32 + 496) + 5,489
neighbours a segment, whatever the number of documents.  Components are found
by the large-star / small-star algorithm on link tables written to the shared
checkpoint folder; nothing but two numbers a round reaches the driver.  Index and
links are joined by sorting: their size is judged by the files they are made of, a
small part of what they hold, so they would be broadcast far beyond the bound.

Defined results: null and blank texts have fingerprint zero and are linked like
any other; a text shorter than a shingle is hashed as one sequence; rows with
the same id keep a row each; a null id is no node, so a row without an id joins a
component only through the texts it shares a fingerprint with; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import text_batches, written

SHINGLE_WORDS = 3
MAX_BITS = 3
#: Shingle hashes summed at once; bounds the bit matrix to 4 MB for any text.
CHUNK = 65_536


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = max(len(words) - size + 1, 1)
    last = ends[size - 1:] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        spans = zip(starts[at:min(at + CHUNK, total)].tolist(), last[at:at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    text_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments a fingerprint is cut into."""
    n = max_bits // 2 + 1  # so one segment holds at most one of the differing bits
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _index(fps: DataFrame, max_bits: int) -> DataFrame:
    """(slot, value, side, fp, node): plain segments (side 2) and their one-wildcard variants (side = the bit left out).
    A slot is a segment and the place of its wildcard, so keys of different kinds never meet."""
    fp = F.col("fp")
    rows: list[Column] = []
    for s, (shift, width) in enumerate(_segments(max_bits)):
        mask = (1 << width) - 1
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(_signed(mask))) if shift or width < 64 else fp
        rows.append(F.struct(F.lit(s * 65).alias("slot"), value.alias("value"), F.lit(2).alias("side")))
        rows += [
            F.struct(
                F.lit(s * 65 + 1 + i).alias("slot"),
                value.bitwiseAND(F.lit(_signed(~(1 << i) & ((1 << 64) - 1)))).alias("value"),
                F.shiftrightunsigned(value, i).bitwiseAND(F.lit(1)).cast("int").alias("side"),
            )
            for i in range(width)
        ]
    return fps.select("fp", "node", F.explode(F.array(*rows)).alias("k")).select("k.*", "fp", "node")


def _sorted_in(df: DataFrame) -> DataFrame:
    """The table, never to be broadcast by a join."""
    return df.hint("merge")


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): pairs of nodes whose distinct fingerprints differ in 1 to ``max_bits`` bits."""
    index = _index(nodes, max_bits)
    left = index.where("side <> 1")
    right = index.where("side <> 0").select(
        F.col("slot").alias("slot2"), F.col("value").alias("value2"), F.col("side").alias("side2"),
        F.col("fp").alias("fp2"), F.col("node").alias("node2"),
    )
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits
    # side 2 meets side 2 (plain segments, each pair once); side 0 meets side 1 (wildcard variants)
    paired = F.when(F.col("side") == 2, (F.col("side2") == 2) & (F.col("fp") < F.col("fp2"))).otherwise(
        F.col("side2") == 1)
    return left.join(
        _sorted_in(right), (F.col("slot") == F.col("slot2")) & (F.col("value") == F.col("value2")) & paired & near
    ).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component = smallest node reachable.

    Alternating large-star and small-star rounds; each round's edges are written
    to the shared folder.  Stops when a round leaves the edges as they were.
    """
    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(
            F.col("b").alias("a"), F.col("a").alias("b"))  # (node, neighbour)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(_sorted_in(least), "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        else:
            out = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(
                least.select(F.col("a").alias("x"), F.col("m").alias("y")))
        return out.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    current = written(spark, edges.distinct(), "simhash-edges")
    before = state(current)
    while before[0]:
        current = written(spark, star(star(current, True), False), "simhash-edges")
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    fps = written(spark, fingerprints(df, id_col, text_col, size), "simhash-fingerprints")
    nodes = written(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    found = components(spark, links(nodes, max_bits))
    classes = nodes.join(_sorted_in(found), "node", "left").select(
        F.col("fp").alias("fp2"), F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, F.col("fp") == F.col("fp2"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, the one with the smallest id, with all its columns.

    Rows are told apart by id and text: an id with several texts is several rows, of which each may
    stay; rows alike in both shrink to one.  Rows with a null id stay."""
    named = docs.where(F.col(id_col).isNotNull()).withColumn("_row", F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit(""))))
    fps = written(spark, fingerprints(named, "_row", text_col, size).distinct(), "simhash-rows")
    nodes = written(spark, fps.select("fp", F.col("fp").alias("node")).distinct(), "simhash-nodes")
    found = components(spark, links(nodes, max_bits))
    of_row = fps.join(_sorted_in(found), F.col("fp") == F.col("node"), "left").select(
        F.col("doc_id").alias("_row"), F.coalesce("component", "fp").alias("_component"))
    first = named.select("_row", F.col(id_col).alias("_id")).distinct().join(of_row, "_row").groupBy("_component").agg(
        F.min(F.struct("_id", "_row"))["_row"].alias("_row"))
    kept = named.join(first.select("_row"), "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def contract(spark: SparkSession, df: DataFrame) -> DataFrame:
    return near_duplicates(spark, df)
