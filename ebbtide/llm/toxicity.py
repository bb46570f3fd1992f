"""Toxicity (6): a bidirectional gated recurrent network with attention pooling.

Input of a step is one word, lower-cased: a vector for the word itself, the mean
of vectors for its character trigrams (word edges marked) and one vector each for
its first and last four characters, all from hashed tables.  Two gated recurrent layers read a window of ``WINDOW`` words
forwards and backwards; attention pools their states and a logistic unit gives
the window's logit.  Windows start every ``STRIDE`` words, so each word is read
in two of them, and a text's logit is that of its worst window.  Training
(numpy, back-propagation through time, Adam) uses a soft maximum over the
windows of a labelled text; a final two-parameter calibration on the worst
window's logit turns it into a probability at the share of toxic texts
that the labels show.

Spark side.  The network is fitted on a bounded sample of labelled rows
(``SAMPLE_ROWS`` a class, the smallest by a hash of the id among the documents
with a letter, texts of any length, whose windows are trained block by block) by
one task of the cluster, not by the driver, which receives its arrays (about 1 MB)
and broadcasts them.  Scoring is one
pass over whole texts in Arrow batches, without a shuffle: word inputs are
projected once for each distinct word of a batch, windows of many texts go
through the network together in blocks of fixed size, and a long text is cut
into slices before its words are looked up.

Defined results: null texts and texts without a letter score 0; without
labelled rows of both classes every text scores 0; conflicting labels of an id
count as the larger; repeated rows are scored one by one; an empty table gives
an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import id_fold, text_batches

#: Largest number of labelled rows of a class the network is fitted on.
SAMPLE_ROWS = 1_200
THRESHOLD = 0.5
FOLDS, HELD_OUT_FOLD = 5, 0
WINDOW, STRIDE = 24, 16
WORD_ROWS, GRAM_ROWS, EDGE_ROWS, WORD_DIM, GRAM_DIM, EDGE_DIM, HIDDEN = 8192, 4096, 8192, 8, 12, 6, 8
#: Passes over the sample; a small sample gets as many more as make up ``LEAST_STEPS`` steps.
EPOCHS, LEAST_STEPS, BATCH_TEXTS, RATE = 6, 150, 32, 0.01
#: Windows in one forward pass; words looked up before their texts are scored; distinct words remembered.
BLOCK_WINDOWS, FLUSH_WORDS, KNOWN_WORDS = 4096, 100_000, 60_000
_WORD = re.compile(r"[^\W\d_]+")
_SLICE = 1 << 20

Params = dict[str, np.ndarray]


def word_slices(text: str | None) -> Iterator[list[str]]:
    """The lower-cased letter runs of a whole text, in slices that end between words."""
    text = text or ""
    at = 0
    while at < len(text):
        end = at + _SLICE
        while end < len(text) and text[end].isalpha():
            end += 1
        yield _WORD.findall(text[at:end].lower())
        at = end


class Keys(NamedTuple):
    """Table rows of words: whole, first and last characters, all trigrams laid end to end."""

    word: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    gram: np.ndarray
    sizes: np.ndarray  # trigrams a word

    def of(self, used: np.ndarray) -> Keys:
        starts, lens = np.cumsum(self.sizes) - self.sizes, self.sizes[used]
        first = np.cumsum(lens) - lens
        grams = self.gram[np.repeat(starts[used] - first, lens) + np.arange(lens.sum())]
        return Keys(self.word[used], self.head[used], self.tail[used], grams, lens)


def word_keys(words: list[str]) -> Keys:
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = codes.astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens + 2) - (lens + 2)
    factors = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)

    def rows(h: np.ndarray, n: int) -> np.ndarray:
        return ((h ^ (h >> np.uint64(15))) * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(40)).astype(np.int64) % n

    place = (np.arange(len(codes)) - np.repeat(starts, lens + 2)).astype(np.uint64)
    whole = np.add.reduceat((codes + np.uint64(7)) * (place * np.uint64(0x9E3779B97F4A7C15) + factors[2]), starts)
    inner = np.ones(len(codes), bool)
    inner[starts + lens] = inner[starts + lens + 1] = False
    first = np.flatnonzero(inner)
    gram = sum(codes[first + i] * factors[i] for i in range(3))
    end = starts + lens + 1
    head = sum(codes[np.minimum(starts + 1 + i, end)] * factors[i] for i in range(4))
    tail = sum(codes[np.maximum(end - 1 - i, starts)] * factors[i] for i in range(4)) + np.uint64(1)
    return Keys(rows(whole, WORD_ROWS), rows(head, EDGE_ROWS), rows(tail, EDGE_ROWS), rows(gram, GRAM_ROWS), lens)


def _inputs(p: Params, k: Keys) -> np.ndarray:
    sums = np.add.reduceat(p["grams"][k.gram], np.cumsum(k.sizes) - k.sizes, axis=0)
    return np.concatenate((p["words"][k.word], p["edges"][k.head], p["edges"][k.tail], sums / k.sizes[:, None]),
                          axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _start(seed: int = 6) -> Params:
    r = np.random.default_rng(seed)
    dim = WORD_DIM + 2 * EDGE_DIM + GRAM_DIM
    normal = lambda *s, by=0.1: (r.standard_normal(s) * by).astype(np.float32)
    p = {"words": normal(WORD_ROWS, WORD_DIM, by=0.3), "grams": normal(GRAM_ROWS, GRAM_DIM, by=0.3),
         "edges": normal(EDGE_ROWS, EDGE_DIM, by=0.3)}
    for d in "fb":
        p |= {f"w{d}": normal(dim, 3 * HIDDEN, by=0.3), f"u{d}": normal(HIDDEN, 3 * HIDDEN, by=0.3),
              f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"att": normal(2 * HIDDEN, by=0.3), "out": normal(2 * HIDDEN, by=0.3), "bias": np.zeros(1, np.float32)}


def _recur(x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """States (T, B, H) of one direction; x holds the projected inputs (T, B, 3H) in reading order."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
    for t in range(len(x)):
        a = h @ u
        zr = _sigmoid(x[t, :, :2 * HIDDEN] + a[:, :2 * HIDDEN])
        z, r, an = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, 2 * HIDDEN:]
        n = 2 * _sigmoid(2 * (x[t, :, 2 * HIDDEN:] + r * an)) - 1
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep is not None:
            keep.append((h, z, r, n, an))
        out[t] = h = new
    return out


def _pool(states: np.ndarray, p: Params, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = states @ p["att"]
    if mask is not None:
        e = np.where(mask, e, -1e9)
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    pooled = np.einsum("tb,tbh->bh", alpha, states)
    return pooled @ p["out"] + p["bias"][0], alpha, pooled


def window_logits(index: np.ndarray, mask: np.ndarray | None, forward: np.ndarray, backward: np.ndarray,
                  p: Params) -> np.ndarray:
    """Logits of windows; index (T, B) points into the projected inputs of both directions."""
    hf = _recur(forward[index], p["uf"], mask)
    hb = _recur(backward[index[::-1]], p["ub"], None if mask is None else mask[::-1])[::-1]
    return _pool(np.concatenate((hf, hb), axis=2), p, mask)[0]


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows over ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW, STRIDE)
    return np.append(starts, n - WINDOW)


def _grid(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts laid end to end: index (T, B), mask (T, B), owner text of each window."""
    index, owner, sizes = [], [], []
    for k in range(len(offsets) - 1):
        n = offsets[k + 1] - offsets[k]
        if n:
            s = window_starts(n)
            index.append(offsets[k] + s)
            owner.append(np.full(len(s), k))
            sizes.append(np.full(len(s), min(n, WINDOW)))
    if not index:
        return np.zeros((WINDOW, 0), np.int64), np.zeros((WINDOW, 0), bool), np.zeros(0, np.int64)
    start, size = np.concatenate(index), np.concatenate(sizes)
    step = np.arange(WINDOW)[:, None]
    mask = step < size
    return ids[start + np.minimum(step, size - 1)], mask, np.concatenate(owner)


# ---- training ---------------------------------------------------------------

def _backward_recur(dh_out: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs (T, B, 3H) and of u."""
    dx = np.zeros((len(kept), dh_out.shape[1], 3 * HIDDEN), np.float32)
    du, carry = np.zeros_like(u), np.zeros_like(dh_out[0])
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, an = kept[t]
        m = mask[t][:, None]
        total = dh_out[t] + carry
        dn, dz = total * (1 - z) * (1 - n * n) * m, total * (h - n) * z * (1 - z) * m
        dr = dn * an * r * (1 - r)
        dx[t] = np.concatenate((dz, dr, dn), axis=1)
        da = np.concatenate((dz, dr, dn * r), axis=1)
        du += h.T @ da
        carry = np.where(m, total * z, total) + da @ u.T
    return dx, du


def _gradients(p: Params, keys: Keys, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Params:
    ids = np.concatenate(texts)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    used, ids = np.unique(ids, return_inverse=True)
    here = keys.of(used)
    x = _inputs(p, here)
    index, mask, owner = _grid(ids, offsets)
    pf, pb = x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"]
    blocks = [slice(k, k + BLOCK_WINDOWS) for k in range(0, len(owner), BLOCK_WINDOWS)]

    def states_of(block: slice) -> tuple:
        kept_f, kept_b = [], []
        hf = _recur(pf[index[:, block]], p["uf"], mask[:, block], kept_f)
        hb = _recur(pb[index[::-1, block]], p["ub"], mask[::-1, block], kept_b)[::-1]
        states = np.concatenate((hf, hb), axis=2)
        return kept_f, kept_b, states, *_pool(states, p, mask[:, block])

    # one block is kept; of more, only the logits are, and their states are computed again
    only = states_of(blocks[0]) if len(blocks) == 1 else None
    logit = only[3] if only else np.concatenate(
        [window_logits(index[:, k], mask[:, k], pf, pb, p) for k in blocks])
    # soft maximum over the windows of a text
    top = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(top, owner, logit)
    e = np.exp(logit - top[owner])
    share = e / np.bincount(owner, e, len(texts))[owner]
    text_logit = top + np.log(np.bincount(owner, e, len(texts)))
    dlogit = (share * ((_sigmoid(text_logit) - y) * weight)[owner]).astype(np.float32)
    g: Params = {"bias": np.array([dlogit.sum()], np.float32), "out": 0, "att": 0, "uf": 0, "ub": 0}
    flat = {d: np.zeros((len(x), 3 * HIDDEN), np.float32) for d in "fb"}
    for k in blocks:
        kept_f, kept_b, states, _, alpha, pooled = only or states_of(k)
        g["out"] = g["out"] + pooled.T @ dlogit[k]
        dpool = dlogit[k][:, None] * p["out"]
        dalpha = np.einsum("bh,tbh->tb", dpool, states)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        g["att"] = g["att"] + np.einsum("tb,tbh->h", de, states)
        dstates = alpha[:, :, None] * dpool + de[:, :, None] * p["att"]
        dxf, duf = _backward_recur(dstates[:, :, :HIDDEN], kept_f, p["uf"], mask[:, k])
        dxb, dub = _backward_recur(dstates[::-1, :, HIDDEN:], kept_b, p["ub"], mask[::-1, k])
        g["uf"], g["ub"] = g["uf"] + duf, g["ub"] + dub
        for d, grad, at in (("f", dxf, index[:, k]), ("b", dxb, index[::-1, k])):
            np.add.at(flat[d], at.ravel(), grad.reshape(-1, 3 * HIDDEN))
    dx = np.zeros_like(x)
    for d in "fb":
        g[f"w{d}"], g[f"c{d}"] = x.T @ flat[d], flat[d].sum(0)
        dx += flat[d] @ p[f"w{d}"].T
    for name in ("words", "grams", "edges"):
        g[name] = np.zeros_like(p[name])
    edge = WORD_DIM + EDGE_DIM
    np.add.at(g["words"], here.word, dx[:, :WORD_DIM])
    np.add.at(g["edges"], here.head, dx[:, WORD_DIM:edge])
    np.add.at(g["edges"], here.tail, dx[:, edge:edge + EDGE_DIM])
    np.add.at(g["grams"], here.gram, np.repeat(dx[:, edge + EDGE_DIM:] / here.sizes[:, None], here.sizes, axis=0))
    return g


def fit(texts: list[str], y: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 6) -> Params | None:
    """Train on whole texts with labels; ``prior`` is the true share of ones."""
    words = [[w for part in word_slices(t) for w in part] for t in texts]
    usable = [i for i, w in enumerate(words) if w]
    y = np.asarray(y, float)[usable]
    if not 0 < y.sum() < len(y):
        return None
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for i in usable for w in words[i]))}
    ids = [np.array([vocabulary[w] for w in words[i]]) for i in usable]
    keys = word_keys(list(vocabulary))
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    p, rng = _start(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    a_pass = -(-len(y) // BATCH_TEXTS)
    epochs = max(epochs, -(-LEAST_STEPS // a_pass))
    step, steps = 0, epochs * a_pass
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH_TEXTS):
            pick = order[at:at + BATCH_TEXTS]
            g = _gradients(p, keys, [ids[i] for i in pick], y[pick], weight[pick])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k in p:
                grad = g[k] / len(pick) + (1e-5 * p[k] if k in ("words", "grams", "edges") else 0)
                m[k] += 0.1 * (grad - m[k])
                v2[k] += 0.01 * (grad * grad - v2[k])
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    # calibration of the worst window's logit, classes weighted as in the labels
    top = Scorer(p).worst([texts[i] for i in usable])
    w = np.where(y > 0, prior / y.sum(), (1 - prior) / (len(y) - y.sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * top + b)
        ga, gb = (w * (q - y) * top).sum() + 1e-3 * (a - 1), (w * (q - y)).sum()
        s = w * q * (1 - q)
        haa, hab, hbb = (s * top * top).sum() + 1e-3, (s * top).sum(), s.sum() + 1e-6
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    if not np.isfinite(a + b) or a <= 0:
        a, b = 1.0, 0.0
    p["scale"] = np.array([a, b])
    return p


# ---- scoring ----------------------------------------------------------------

class Scorer:
    """Scores texts; remembers the projected inputs of up to ``KNOWN_WORDS`` words between calls."""

    def __init__(self, p: Params):
        self.p = p
        self.known: dict[str, int] = {}
        self.forward = np.zeros((0, 3 * HIDDEN), np.float32)
        self.backward = self.forward

    def _lookup(self, words: list[str]) -> np.ndarray:
        known = self.known
        at = len(known)
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            x = _inputs(self.p, word_keys(new))
            known.update(zip(new, range(at, at + len(new)), strict=True))
            self.forward = np.concatenate((self.forward, x @ self.p["wf"] + self.p["cf"]))
            self.backward = np.concatenate((self.backward, x @ self.p["wb"] + self.p["cb"]))
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """Logit of the worst window of each text (-inf without words)."""
        out = np.full(len(texts), -np.inf)
        words: list[str] = []
        sizes: list[int] = []
        owners: list[int] = []

        def flush() -> None:
            if words:
                ids = self._lookup(words)
                np.maximum.at(out, owners, self._score(ids, sizes))
                if len(self.known) > KNOWN_WORDS:
                    self.known, self.forward = {}, np.zeros((0, 3 * HIDDEN), np.float32)
                    self.backward = self.forward
            words.clear()
            sizes.clear()
            owners.clear()

        for k, text in enumerate(texts):
            last: list[str] = []
            for part in word_slices(text):
                part = last + part  # windows overlap from slice to slice, too
                last = part[-WINDOW:]
                words += part
                sizes.append(len(part))
                owners.append(k)
                if len(words) >= FLUSH_WORDS:
                    flush()
        flush()
        return out

    def _score(self, ids: np.ndarray, sizes: list[int]) -> np.ndarray:
        out = np.full(len(sizes), -np.inf)
        index, mask, owner = _grid(ids, np.concatenate(([0], np.cumsum(sizes))))
        whole = mask.all(0)
        for chosen, masked in ((np.flatnonzero(whole), False), (np.flatnonzero(~whole), True)):
            for at in range(0, len(chosen), BLOCK_WINDOWS):
                pick = chosen[at:at + BLOCK_WINDOWS]
                logits = window_logits(index[:, pick], mask[:, pick] if masked else None, self.forward, self.backward,
                                       self.p)
                np.maximum.at(out, owner[pick], logits)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.p["scale"]
        with np.errstate(over="ignore", invalid="ignore"):
            return np.round(_sigmoid(a * self.worst(texts) + b), 9)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Params | None:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    rows = labels.where(F.col(label_col).isin(0, 1) & (id_fold(F.col(id_col), FOLDS) != HELD_OUT_FOLD)).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    share = rows.agg(F.avg("_label")).first()[0]
    if share is None or not 0 < share < 1:
        return None
    order = (F.xxhash64("_id"), "_id")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(
        F.col("_text").rlike(r"\p{L}"))
    present = rows.join(texts.select("_id"), "_id", "left_semi")
    sample = present.where("_label = 0").orderBy(*order).limit(SAMPLE_ROWS).unionByName(
        present.where("_label = 1").orderBy(*order).limit(SAMPLE_ROWS))
    texts = texts.join(F.broadcast(sample), "_id")  # at most 2 * SAMPLE_ROWS ids
    texts = texts.where("_label = 0").orderBy(*order, "_text").limit(SAMPLE_ROWS).unionByName(
        texts.where("_label = 1").orderBy(*order, "_text").limit(SAMPLE_ROWS))
    prior = float(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled = [row for b in batches for row in b.to_pylist()]  # 2 * SAMPLE_ROWS texts at most
        if sampled:
            fitted = fit([r["_text"] for r in sampled], np.array([r["_label"] for r in sampled], float), prior)
            if fitted is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(fitted)), pa.array([str(x.dtype) for x in fitted.values()]),
                     pa.array([list(x.shape) for x in fitted.values()], pa.list_(pa.int32())),
                     pa.array([x.tobytes() for x in fitted.values()], pa.binary())], ["name", "kind", "shape", "cells"])

    got = (
        texts.select("_label", F.xxhash64("_id").alias("_at"), "_id", "_text").repartition(1)
        .sortWithinPartitions("_label", "_at", "_id", "_text").select("_label", "_text")
        .mapInArrow(run, "name string, kind string, shape array<int>, cells binary").collect()  # the arrays, about 1 MB
    )
    return {r["name"]: np.frombuffer(bytes(r["cells"]), r["kind"]).reshape(r["shape"]).copy() for r in got} or None


def _scored(docs: DataFrame, params: Params | None, text_at: int, emit, schema) -> DataFrame:
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value is not None else None
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                texts = part.column(text_at).to_pylist()
                yield emit(part, scorer.scores(texts) if scorer else np.zeros(len(texts)))

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, params: Params | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    return _scored(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
        params, 1,
        lambda b, s: pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"]),
        "doc_id long, score double",
    )


def drop_toxic(docs: DataFrame, params: Params | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    return _scored(docs, params, docs.columns.index(text_col), lambda b, s: b.filter(pa.array(s < threshold)), docs.schema)


def contract(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select(
        "doc_id",
        (id_fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
