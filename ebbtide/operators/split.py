"""Deterministic stratified train/test split and stratified k-fold.

Both need an exact row number per class in a pseudo-random order.  A window
``partitionBy(label).orderBy(hash)`` would put each class in ONE task; with a
binary label that is two tasks for the whole table.  Instead the rank is built
in two levels:

1. the order key is an md5 hex string, so its first ``d`` hex digits form an
   order-preserving bucket; count rows per (class, bucket) with a partial
   aggregate (at most classes x 16^d rows -- a proven bound, independent of
   the data size);
2. a running sum over that small table gives each bucket's offset; it is
   broadcast back (bounded by construction) and rows are ranked inside their
   (class, bucket) window, which spreads the work over 16^d x classes tasks.

The result equals ``row_number() over (partition by class order by hash, key)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.operators.scan import prefix_sums

BUCKET_DIGITS = 4  # 65,536 buckets per class


def hash_order_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def ranked(
    df: DataFrame,
    classes: Sequence[str],
    order_hash: Column,
    key: str,
    rank_col: str = "rn",
    total_col: str | None = None,
    bucket_digits: int = BUCKET_DIGITS,
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``rank_col`` = 1-based row number per ``classes`` ordered by (order_hash, key).

    ``bucket`` must be an order-preserving coarsening of ``order_hash`` with a
    bounded number of values; by default the first hex digits of the md5 text.
    Optionally add ``total_col`` = number of rows in the row's class.
    """
    classes = list(classes)
    h = "_ord_hash"
    b = "_ord_bkt"
    staged = df.withColumn(h, order_hash)
    staged = staged.withColumn(b, bucket if bucket is not None else F.substring(F.col(h), 1, bucket_digits))
    counts = staged.groupBy(*classes, b).agg(F.count(F.lit(1)).alias("_bkt_n"))
    before = Window.partitionBy(*classes).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*classes)
    offsets = counts.select(
        *classes,
        b,
        F.coalesce(F.sum("_bkt_n").over(before), F.lit(0)).alias("_bkt_off"),
        F.sum("_bkt_n").over(whole).alias("_cls_n"),
    )
    # offsets has at most (#classes x 16^bucket_digits) rows: safe to broadcast
    joined = staged.join(F.broadcast(offsets), on=[*classes, b], how="inner")
    local = Window.partitionBy(*classes, b).orderBy(F.col(h), F.col(key))
    out = joined.withColumn(rank_col, F.row_number().over(local) + F.col("_bkt_off"))
    if total_col:
        out = out.withColumn(total_col, F.col("_cls_n"))
    return out.drop(h, b, "_bkt_off", "_bkt_n", "_cls_n")


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    test_size: float = 0.2,
    n_folds: int = 5,
    split_seed: int = 42,
    fold_seed: int = 43,
) -> DataFrame:
    """Add ``split`` ('train'/'test') and ``fold`` (0..n_folds-1 on train, -1 on test).

    Within each class the first round(test_size * n_class) rows in md5 order are
    test rows, so class shares are preserved; train rows are dealt round-robin
    into folds in a second md5 order, so per-class fold sizes differ by <= 1.
    """
    with_rank = ranked(df, [label], hash_order_key(key, split_seed), key, "_rn_split", "_n_class")
    split = with_rank.withColumn(
        "split",
        F.when(F.col("_rn_split") <= F.round(F.col("_n_class") * test_size), "test").otherwise("train"),
    ).drop("_rn_split", "_n_class")
    folded = ranked(split, [label, "split"], hash_order_key(key, fold_seed), key, "_rn_fold")
    return folded.withColumn(
        "fold",
        F.when(F.col("split") == "train", F.pmod(F.col("_rn_fold") - 1, F.lit(n_folds))).otherwise(-1).cast("int"),
    ).drop("_rn_fold")


def kfold(df: DataFrame, key: str, label: str, n_folds: int, seed: int = 43) -> DataFrame:
    """Stratified k-fold column ``fold`` over all rows of ``df``."""
    r = ranked(df, [label], hash_order_key(key, seed), key, "_rn_fold")
    return r.withColumn("fold", F.pmod(F.col("_rn_fold") - 1, F.lit(n_folds)).cast("int")).drop("_rn_fold")


def key_rank(df: DataFrame, key: str, rank_col: str = "rn") -> DataFrame:
    """1-based rank of a distinct ``key`` over the whole table, without a single-partition window."""
    ones = df.withColumn("_one", F.lit(1))
    return prefix_sums(ones, [], F.col(key), {rank_col: "_one"}).drop("_one")


def dense_rank_values(df: DataFrame, group: str, value: str, rank_col: str = "rank") -> DataFrame:
    """Distinct (group, value) pairs with the 1-based rank of ``value`` in sorted
    order within ``group``, exact, without putting a group in one task."""
    ones = df.select(group, value).distinct().withColumn("_one", F.lit(1))
    return prefix_sums(ones, [group], F.col(value), {rank_col: "_one"}).drop("_one")
