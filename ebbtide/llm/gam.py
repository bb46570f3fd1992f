"""Quality classifier (10): a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles of the training sample.  Boosting
goes round the features in turn; every step fits one shallow tree (two levels)
to the logistic gradients of a single feature and adds it, shrunk, to that
feature's lookup table.  The pairs that explain most of what is left get a
two-dimensional table each, boosted the same way with one cut a side.  A score
is the intercept plus one table entry for each feature and each pair::

    sigmoid(b + sum_i f_i[bin_i] + sum_ij g_ij[bin_i, bin_j])

Spark side.  Features are computed in Arrow batches from whole texts, a row at
a time, in time linear in the text.  The model is fitted on a bounded sample of
labelled rows (``SAMPLE_ROWS``, the smallest by a hash of the id), of which only
feature rows reach the driver; scoring is one pass over all rows without a
shuffle, and the tables (a few KB) travel in the task closure.

Defined results: null and blank texts have all features zero and get the score
of those; without labelled rows of both classes every row gets the share of
ones (one half without any); conflicting labels of an id count as the larger;
repeated rows are scored one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import id_fold, text_batches

#: Largest number of labelled rows the model is fitted on.
SAMPLE_ROWS = 8_000
THRESHOLD = 0.7
FOLDS, HELD_OUT_FOLD = 4, 2
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 60, 30, 0.2, 5.0

FEATURES = (
    "log_words", "word_bytes", "upper_share", "symbols_per_word", "digit_share", "distinct_words",
    "same_as_previous", "stops_per_word", "words_per_line", "non_ascii_share", "shouts_per_word", "entropy",
    "capital_starts",
)
_WORD_SLICE = 1 << 20


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_UPPER = _class(bytes(range(65, 91)))
_LOWER = _class(bytes(range(97, 123)))
_DIGIT = _class(b"0123456789")
_SYMBOL = _class(b"#*$%&|<>{}[]\\^~_=@+")
_STOP = _class(b".,;:")
_SHOUT = _class(b"!?")
_SPACE = _class(b" \t\n\x0b\x0c\r")
_HIGH = np.arange(256) >= 128


def features(text: str | None) -> list[float]:
    """The features of one whole text, linear in its length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n_words = same = starts = 0
    distinct: set[int] = set()
    previous = b""
    at = 0
    while at < len(raw):  # slices end at white space, so no list of words outgrows a slice
        end = at + _WORD_SLICE
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        words = raw[at:end].split()
        at = end
        if words:
            n_words += len(words)
            same += (previous == words[0]) + sum(map(eq, words, words[1:]))
            starts += sum(map(bytes.istitle, words))
            previous = words[-1]
            distinct.update(map(hash, words)) if len(raw) > _WORD_SLICE else distinct.update(words)
    if not n_words:
        return [0.0] * len(FEATURES)
    solid = counts.sum() - counts[_SPACE].sum()
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + counts[_HIGH].sum()
    share = counts[counts > 0] / counts.sum()
    return [
        float(np.log1p(n_words)), solid / n_words, counts[_UPPER].sum() / max(letters, 1.0),
        counts[_SYMBOL].sum() / n_words, counts[_DIGIT].sum() / solid, len(distinct) / n_words, same / n_words,
        counts[_STOP].sum() / n_words, n_words / (counts[10] + 1.0), counts[_HIGH].sum() / solid,
        counts[_SHOUT].sum() / n_words, float(-(share * np.log2(share)).sum()), starts / n_words,
    ]


class Model(NamedTuple):
    bias: float
    cuts: list[np.ndarray]  # inner bin edges by feature
    tables: np.ndarray  # (features, BINS)
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # (pairs, PAIR_BINS, PAIR_BINS)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Vectorised bin additions."""
        total = np.full(len(x), self.bias)
        for f in range(len(self.cuts)):
            total += self.tables[f][np.searchsorted(self.cuts[f], x[:, f], side="right")]
        for p, (i, j) in enumerate(self.pairs):
            total += self.pair_tables[p][
                np.searchsorted(self.pair_cuts[i], x[:, i], side="right"),
                np.searchsorted(self.pair_cuts[j], x[:, j], side="right"),
            ]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value of each bin for a tree over consecutive bins."""
    def gain(g, h):
        return g * g / (h + RIDGE)

    if depth and len(grad) > 1:
        gl, hl = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
        gr, hr = grad.sum() - gl, hess.sum() - hl
        gains = gain(gl, hl) + gain(gr, hr) - gain(grad.sum(), hess.sum())
        cut = int(np.argmax(gains)) + 1
        if gains[cut - 1] > 1e-9:
            return np.concatenate((_tree(grad[:cut], hess[:cut], depth - 1), _tree(grad[cut:], hess[cut:], depth - 1)))
    return np.full(len(grad), grad.sum() / (hess.sum() + RIDGE))


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Best tree with one cut on each side: leaf values by cell, and its gain."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best, cells = -1.0, np.zeros_like(grad)
    for a in range(grad.shape[0] - 1):
        for b in range(grad.shape[1] - 1):
            gs = np.array([g[a, b], g[a, -1] - g[a, b], g[-1, b] - g[a, b], g[-1, -1] - g[a, -1] - g[-1, b] + g[a, b]])
            hs = np.array([h[a, b], h[a, -1] - h[a, b], h[-1, b] - h[a, b], h[-1, -1] - h[a, -1] - h[-1, b] + h[a, b]])
            got = float((gs * gs / (hs + RIDGE)).sum())
            if got > best:
                v = gs / (hs + RIDGE)
                best = got
                cells = np.empty_like(grad)
                cells[:a + 1, :b + 1], cells[:a + 1, b + 1:] = v[0], v[1]
                cells[a + 1:, :b + 1], cells[a + 1:, b + 1:] = v[2], v[3]
    return cells, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    n_features = len(FEATURES)
    tables, pair_tables = np.zeros((n_features, BINS)), np.zeros((0, PAIR_BINS, PAIR_BINS))
    ones = float(y.sum())
    if not 0 < ones < len(y):
        share = ones / len(y) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        none = [np.zeros(0)] * n_features
        return Model(float(np.log(share / (1 - share))), none, tables, none, [], pair_tables)
    cuts = [_cuts(x[:, f], BINS) for f in range(n_features)]
    pair_cuts = [_cuts(x[:, f], PAIR_BINS) for f in range(n_features)]
    bins = [np.searchsorted(cuts[f], x[:, f], side="right") for f in range(n_features)]
    pair_bins = [np.searchsorted(pair_cuts[f], x[:, f], side="right") for f in range(n_features)]
    bias = float(np.log(ones / (len(y) - ones)))
    total = np.full(len(y), bias)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(n_features):
            g, h = gradients()
            size = len(cuts[f]) + 1
            step = RATE * _tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size), 2)
            tables[f, :size] += step
            total += step[bins[f]]

    def cell_sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradients()
        cell = pair_bins[i] * PAIR_BINS + pair_bins[j]
        shape = (PAIR_BINS, PAIR_BINS)
        return (np.bincount(cell, g, PAIR_BINS**2).reshape(shape), np.bincount(cell, h, PAIR_BINS**2).reshape(shape))

    ranked = sorted(
        ((-_quadrants(*cell_sums(i, j))[1], i, j) for i in range(n_features) for j in range(i)),
    )
    pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    pair_tables = np.zeros((len(pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for p, (i, j) in enumerate(pairs):
            step = RATE * _quadrants(*cell_sums(i, j))[0]
            pair_tables[p] += step
            total += step[pair_bins[i], pair_bins[j]]
    return Model(bias, cuts, tables, pair_cuts, pairs, pair_tables)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model:
    """Fit on at most ``SAMPLE_ROWS`` rows of labelled ids outside the held-out fold that ``docs`` holds."""
    text_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    order = (F.xxhash64("_id"), "_id")
    sample = (
        labels.where(F.col(label_col).isin(0, 1) & (id_fold(F.col(id_col), FOLDS) != HELD_OUT_FOLD))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
        .join(texts.select("_id"), "_id", "left_semi").orderBy(*order).limit(SAMPLE_ROWS)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(rows, pa.list_(pa.float64()))], ["id", "label", "x"])

    rows = (
        texts.join(F.broadcast(sample), "_id")  # at most SAMPLE_ROWS ids
        .select("_id", "_text", "_label").mapInArrow(run, f"id {dict(texts.dtypes)['_id']}, label int, x array<double>")
        .orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE_ROWS)  # an id may have many rows
        .collect()
    )
    rows.sort(key=lambda r: (r["id"], r["x"]))  # the same model whatever the order of arrival
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(batch_scores(model, b.column(1)))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double")


def batch_scores(model: Model, texts: pa.Array) -> np.ndarray:
    x = np.array([features(t.as_py()) for t in texts], float).reshape(len(texts), len(FEATURES))
    return np.round(model.score(x), 9)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns.  A model that was not given
    both classes tells no row from another, so all rows stay."""
    if not any(len(c) for c in model.cuts):
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(batch_scores(model, b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select(
        "doc_id",
        (id_fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
