"""Embedding near-dedup (13) by a pivot-permutation index.

Reference points (pivots) are vectors of the table itself.  A vector is described
by the ordered list of its ``nearest`` pivots.  Inverted lists hold the vectors
of a label by pivot; two vectors are candidates if they share at least ``shared``
pivots, and every candidate is verified by its cosine in double precision.

Which lists.  All descriptions are put in one order, rarest pivot first, and a
vector enters the lists of its first ``nearest - shared + 1`` pivots only: two
vectors that share ``shared`` pivots share one of these on both sides.  A pair is
counted in the first list that both are in.

Scale.  Exact copies (equal label and vector) are one row with a number of copies
before anything is indexed.  The number of pivots is twice the square root of the
number of vectors indexed, 64 at least, and bounded by ``MAX_PIVOTS`` and ``PIVOT_VALUES`` numbers in
all, so what is sent to the tasks has a fixed size; they are picked from as many
vectors of smallest hash as twice that.  A list longer than ``BLOCK`` is cut into
blocks by hash, and every pair of blocks is a group of its own, so no task holds
more than two blocks and no pair of a long list is lost.  A group multiplies its
two blocks and returns a row per linked vector (its number of links there and the
first vector of its component there), never pairs.  Components over groups are
found by large-star / small-star on written tables.

Recall.  Vectors whose descriptions share too few pivots are missed; links found
are exact.  Measured against brute force in the tests and the README.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those without a label, link with nothing; vectors of different
lengths never link; rows with the same id keep a row each and link like others;
a row with a null id counts as a vector, and a component takes the smallest id
that is not null (null if there is none: such a row is kept); an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import written
from ebbtide.llm.simhash import components

COSINE = 0.93
#: Pivots in a description, and pivots that candidates share.
NEAREST, SHARED = 10, 3
MIN_PIVOTS, MAX_PIVOTS = 64, 4096
#: Numbers in all pivots together (8 MB).
PIVOT_VALUES = 1 << 20
#: Two pivots are no closer than this, so that copies of one vector are not several pivots.
PIVOT_COSINE = 0.8
#: Rows of a block of an inverted list.
BLOCK = 256


def _usable(col: str) -> F.Column:
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(col, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    rows = vectors.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def choose_pivots(sample: list[list[float]], number: int) -> np.ndarray:
    """At most ``number`` unit rows of a sample, none nearer than PIVOT_COSINE to an earlier one; short ones end in zeros."""
    width = max(map(len, sample))
    rows = unit_rows(np.array([v + [0.0] * (width - len(v)) for v in sample]))
    open_ = np.ones(len(rows), bool)
    chosen: list[int] = []
    for k in range(len(rows)):
        if open_[k] and len(chosen) < number:
            chosen.append(k)
            open_ &= rows @ rows[k] < PIVOT_COSINE
    return rows[chosen]


def describe(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first, ties by number."""
    width = min(vectors.shape[1], pivots.shape[1])
    # a zero start (of a vector cut to the pivots' length) is as near to all
    near = unit_rows(vectors)[:, :width] @ pivots[:, :width].T
    if nearest >= near.shape[1]:
        return np.argsort(-near, axis=1, kind="stable")
    least = -np.partition(-near, nearest - 1, axis=1)[:, nearest - 1:nearest]
    out = np.empty((len(near), nearest), np.int64)
    for k, row in enumerate(near):
        some = np.flatnonzero(row >= least[k])
        out[k] = some[np.argsort(-row[some], kind="stable")][:nearest]
    return out


def _described(reps: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """(rep, label, size, node, copies, vec, near): the vectors with a number and their descriptions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            label, vec, node, copies = (batch.column(k) for k in range(4))
            sizes = np.array([len(v) for v in vec], np.int64)
            for size in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == size))
                some = vec.take(at)
                near = describe(some.flatten().to_numpy(zero_copy_only=False).reshape(-1, size), pivots, nearest)
                n = len(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), label.take(at), pa.array(np.full(n, size, np.int32)), node.take(at),
                     copies.take(at), some,
                     pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))],
                    ["rep", "label", "size", "node", "copies", "vec", "near"])
                row += n

    label, node, real = (dict(reps.dtypes)[c] for c in ("label", "node", "vec"))
    return reps.select("label", "vec", "node", "copies").mapInArrow(
        run, f"rep long, label {label}, size int, node {node}, copies long, vec {real}, near array<int>")


def _components(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest place reachable of n places linked by (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _members(ranks: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Row x pivot matrix of ones (an empty place of a description is -1)."""
    out = np.zeros((len(ranks), len(names)), np.float32)
    row, col = np.nonzero(ranks >= 0)
    out[row, np.searchsorted(names, ranks[row, col])] = 1
    return out


def _verify(table: pa.Table, cosine: float, shared: int, first: int) -> pa.Table:
    """Links of one pair of blocks of a list: (rep, n, root) for each linked vector."""
    rep, copies, block = (table[c].to_numpy() for c in ("rep", "copies", "block"))
    i, j, at = (table[c][0].as_py() for c in ("i", "j", "list"))
    unit, ranks = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1) for c in ("vec", "ranks"))
    unit = unit_rows(unit)
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    names = np.unique(ranks)
    all_of = _members(ranks, names)
    early = _members(np.where(ranks[:, :first] < at, ranks[:, :first], -1), names)
    link = all_of[left] @ all_of[right].T >= shared  # shared-pivot counts
    link &= early[left] @ early[right].T == 0  # the pair's first common list
    link &= unit[left] @ unit[right].T >= cosine
    if i == j:
        link = np.triu(link, 1)
    a, b = np.nonzero(link)
    a, b = left[a], right[b]
    n = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
    order = np.argsort(rep)  # so that a root is the smallest number
    place = np.empty(len(rep), np.int64)
    place[order] = np.arange(len(rep))
    root = _components(place[a], place[b], len(rep))
    own = np.flatnonzero(n)
    return pa.table({"rep": rep[own], "n": n[own].astype(np.int64), "root": rep[order][root[place[own]]]})


def links(spark: SparkSession, described: DataFrame, pivots: int, cosine: float = COSINE,
          nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """(rep, n, root) per linked vector and group: its links there, copies counted, and a vector it is reached from."""
    nearest = min(nearest, pivots)
    shared = min(shared, nearest)
    first = nearest - shared + 1
    sizes = dict(described.select(F.explode("near").alias("p")).groupBy("p").count().collect())  # a row a pivot
    order = sorted(range(pivots), key=lambda p: (sizes.get(p, 0), p))
    rank = F.array(*(F.lit(r) for _, r in sorted(zip(order, range(pivots), strict=True))))
    ranked = described.withColumn("ranks", F.array_sort(F.transform("near", lambda p: F.element_at(rank, p + 1))))
    listed = ranked.select("*", F.explode(F.slice("ranks", 1, first)).alias("list")).drop("near", "node")
    long = listed.groupBy("label", "size", "list").count().where(F.col("count") > block).select(
        "label", "size", "list", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = listed.join(long, ["label", "size", "list"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = dealt.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("label", "size", "list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                         "block", "rep", "copies", "vec", "ranks")
    found = pairs.groupBy("label", "size", "list", "i", "j").applyInArrow(
        lambda table: _verify(table, cosine, shared, first), "rep long, n long, root long")
    return written(spark, found, "pivot-links")


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED,
                    block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    if not 0 < cosine <= 1 or not 1 <= shared <= nearest:
        raise ValueError("cosine lies in (0, 1], and at least one and at most all pivots of a description are shared")
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    if dict(rows.dtypes)["vec"] != "array<float>":
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    usable = rows.where(F.col("label").isNotNull() & _usable("vec"))
    reps = written(spark, usable.groupBy("label", "vec").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "pivot-vectors")
    number, width = reps.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not number:
        alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.withColumn("kept", F.lit(True))
    width = min(width, PIVOT_VALUES // MIN_PIVOTS)
    wanted = min(max(MIN_PIVOTS, 2 * math.isqrt(number)), MAX_PIVOTS, max(MIN_PIVOTS, PIVOT_VALUES // width))
    sample = reps.select(F.slice("vec", 1, width).alias("v")).where(F.exists("v", lambda x: x != 0)).orderBy(
        F.xxhash64("v"), "v").limit(2 * wanted).collect()
    pivots = choose_pivots([list(r["v"]) for r in sample], wanted) if sample else np.ones((1, 1))
    described = written(spark, _described(reps, pivots, min(nearest, len(pivots))), "pivot-descriptions")
    found = links(spark, described, len(pivots), cosine, nearest, shared, block)
    edges = found.where("rep <> root").select(F.least("rep", "root").alias("a"), F.greatest("rep", "root").alias("b"))
    reached = components(spark, edges)
    nodes = written(spark, described.select("rep", "node", "copies", "label", "vec").join(
        found.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(
            reached.withColumnRenamed("node", "rep"), "rep", "left").select(
                "label", "vec", "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component")), "pivot-nodes")
    smallest = nodes.groupBy("component").agg(F.min("node").alias("component_id"))
    told = nodes.join(smallest, "component").select("label", "vec", "n_links", "component_id")
    return rows.join(told, ["label", "vec"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def contract(spark: SparkSession, df: DataFrame) -> DataFrame:
    return near_duplicates(spark, df)
