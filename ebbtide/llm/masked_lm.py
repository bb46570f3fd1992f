"""LM scoring (5): masked pseudo-likelihood of a bidirectional window network.

Every word of a text is hidden in turn and predicted from the two words on
either side.  Each neighbour's class adds a learnt vector that depends on its
place; a tanh layer and a softmax over classes follow, then the word's share of
its class::

    log p(word | both sides) = log softmax(W tanh(sum_o E_o[class of neighbour o] + b) + c)[class]
                               + log(count of the word / count of its class)

Classes: the ``TOP_WORDS`` most frequent words have one each; all other words
share one by length.  Counts are those of every word of the corpus, so a rare
word and a frequent one of equal length differ.  A text's score is the sum over
all its words; the mean per word comes beside it.  ``score`` without the table
of words spreads a class evenly over its distinct words instead.

Spark side.  Word counts cover all rows of the corpus (partial counts before
the shuffle) and stay a Spark table.  One pass turns every text into its classes,
the summed log shares of at most ``COMMON_WORDS`` most frequent words (broadcast) and
the list of its other words, and writes that; the other words meet the table in
a join by word and are summed by row.  The network is fitted on all rows: in each
of ``ROUNDS`` rounds a task takes gradient steps through its share of the round's
rows, from the same arrays (under 200 KB, broadcast), and Spark sums the tasks'
arrays, weighted by their words, to those of the next round.  A corpus of any size is
passed once.  Words go through the network in blocks of fixed size.

Defined results: null and blank texts have no words, sum and mean 0; without any
word in the corpus there is nothing to score; repeated rows are scored one by
one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import text_batches, written

TOP_WORDS, LENGTHS = 240, 16
CLASSES = TOP_WORDS + LENGTHS
#: Class of the places before and after a text.
EDGE = CLASSES
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 16
#: At most so many of the most frequent words have their shares broadcast; those of all others come by a join.
COMMON_WORDS = 20_000
EPOCHS, BATCH, RATE = 4, 512, 0.01
#: Averages of the tasks' arrays in the one pass over all rows.
ROUNDS = 5
BLOCK = 1_024
#: Distinct words in a task's partial counts.
PARTIAL = 400_000
_SLICE = 1 << 20
_SPACES = frozenset(b" \t\n\x0b\x0c\r")


class Vocabulary(NamedTuple):
    top: dict[bytes, int]
    spread: np.ndarray  # log of the number of distinct words by class
    counts: np.ndarray = np.zeros(CLASSES)  # occurrences by class
    common: dict[bytes, int] | None = None  # places in shares and kinds; the top words come first
    shares: np.ndarray = np.zeros(0)  # log(count of the word / count of its class)
    kinds: np.ndarray = np.arange(TOP_WORDS, dtype=np.int16)  # class of each common word

    def classes(self, text: str | None) -> np.ndarray:
        """Class of every word of a whole text."""
        return self.read((text or "").encode("utf-8", "surrogatepass"))[0]

    def read(self, raw: bytes | None) -> tuple[np.ndarray, float, list[bytes]]:
        """Class of every word of a whole text in UTF-8, split slice by slice, the summed shares of its common words,
        and its other words."""
        out, total, other = [], 0.0, []
        get = (self.common or self.top).get
        for words in _word_slices(raw):
            found = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
            known = found >= 0
            rare = [words[i] for i in np.flatnonzero(~known).tolist()]
            if len(self.shares):
                total += float(self.shares[found[known]].sum())
                other += rare
            here = np.empty(len(words), np.int16)
            here[known] = self.kinds[found[known]]
            here[~known] = _length_classes(rare)
            out.append(here)
        return (np.concatenate(out) if out else np.zeros(0, np.int16)), total, other


def _length_class(word: bytes) -> int:
    length = len(word) if word.isascii() else len(word.decode("utf-8", "surrogatepass"))
    return TOP_WORDS + min(length, LENGTHS) - 1


def _length_classes(words: list[bytes]) -> np.ndarray:
    joined = b" ".join(words)
    if not joined.isascii():
        words = joined.decode("utf-8", "surrogatepass").split(" ")
    return TOP_WORDS - 1 + np.minimum(np.fromiter(map(len, words), np.int64, len(words)), LENGTHS)


def _word_slices(raw: bytes | None) -> Iterator[list[bytes]]:
    """The words of a whole text in UTF-8, in slices that end between words."""
    at, raw = 0, raw or b""
    while at < len(raw):
        end = at + _SLICE
        while end < len(raw) and raw[end] not in _SPACES:
            end += 1
        yield raw[at:end].split()
        at = end


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and end row of runs of texts of up to ``_SLICE`` bytes in all; a larger text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = 0
    while at < len(sizes):
        stop, held = at + 1, sizes[at]
        while stop < len(sizes) and held + sizes[stop] <= _SLICE:
            held += sizes[stop]
            stop += 1
        yield at, stop
        at = stop


def _split(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of some texts, end to end, and how many each text has."""
    bare = pc.ascii_trim_whitespace(texts)
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, ""), pa.scalar(None, bare.type), bare))
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()


def _strings(words: list[bytes]) -> pa.StringArray:
    return pa.array(words, pa.binary()).cast(pa.string())


def word_counts(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows: counted in Arrow batches of whole texts, added up after a shuffle by word."""
    text_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def summed() -> list[pa.RecordBatch]:
            table = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return table.rename_columns(["word", "n"]).combine_chunks().to_batches()

        for b in batches:
            texts = b.column(0).cast(pa.string())
            for at, stop in _runs(texts):
                if texts[at].is_valid and stop == at + 1:
                    slices = map(_strings, _word_slices(texts[at].as_buffer().to_pybytes()))
                else:
                    slices = [_split(texts.slice(at, stop - at))[0]]
                for words in slices:
                    counts = pc.value_counts(words)
                    held.append(pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["word", "n"]))
                    if sum(map(len, held)) >= 2 * PARTIAL:
                        held = summed()
                        if sum(map(len, held)) >= PARTIAL:
                            yield from held
                            held = []
        if held:
            yield from summed()

    return written(
        spark,
        docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy(
            "word").agg(F.sum("n").alias("n")),
        "lm-words",
    )


def _size(word: str = "word"):
    return F.least(F.char_length(word), F.lit(LENGTHS))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words, and the distinct words and occurrences of each class."""
    first = counts.orderBy(F.desc("n"), "word").limit(COMMON_WORDS + 1).collect()
    below = first[COMMON_WORDS]["n"] if len(first) > COMMON_WORDS else 0  # words that tie with the first too many stay out
    top = first[:TOP_WORDS]
    common = top + [r for r in first[TOP_WORDS:] if r["n"] > below]
    by_length = counts.groupBy(_size().alias("size")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()  # at most LENGTHS rows
    distinct, total = np.ones(CLASSES), np.zeros(CLASSES)
    total[:len(top)] = [r["n"] for r in top]
    for r in by_length:
        inside = [w["n"] for w in top if min(len(w["word"]), LENGTHS) == r["size"]]
        distinct[TOP_WORDS + r["size"] - 1] = max(r["words"] - len(inside), 1)
        total[TOP_WORDS + r["size"] - 1] = r["n"] - sum(inside)
    raw = [r["word"].encode("utf-8", "surrogatepass") for r in common]
    kinds = np.array([i if i < TOP_WORDS else _length_class(w) for i, w in enumerate(raw)], np.int16)
    shares = [0.0 if i < TOP_WORDS else np.log(r["n"] / total[kinds[i]]) for i, r in enumerate(common)]
    return Vocabulary({w: i for i, w in enumerate(raw[:TOP_WORDS])}, np.log(distinct), total,
                      {w: i for i, w in enumerate(raw)}, np.array(shares), kinds)


class Known:
    """What ``Vocabulary.read`` gives for one text, for a run of texts at once."""

    def __init__(self, v: Vocabulary):
        self.v, words = v, v.common or v.top
        self.words, self.places = _strings(list(words)), np.fromiter(words.values(), np.int32, len(words))

    def read(self, texts: pa.StringArray) -> list[pa.Array]:
        """Classes, a byte a word, summed shares of the common words, and the other words of each text."""
        words, sizes = _split(texts)
        found = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        known = found >= 0
        found, rare = self.places[found[known]], words.filter(pa.array(~known))
        classes = np.empty(len(words), np.uint8)
        classes[known] = self.v.kinds[found]
        classes[~known] = TOP_WORDS - 1 + np.minimum(pc.utf8_length(rare).to_numpy(), LENGTHS)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.concatenate([[0], np.cumsum(known)])[ends]  # known words before each end
        if len(self.v.shares):
            each = self.v.shares[found]
            shares, others = [float(each[a:b].sum()) for a, b in pairwise(inside.tolist())], ends - inside
        else:
            shares, others = [0.0] * len(sizes), np.zeros(len(ends))
        return [
            pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(classes)]),
            pa.array(shares, pa.float64()),
            pa.ListArray.from_arrays(pa.array(others.astype(np.int32)), rare),
        ]


def classified(spark: SparkSession, docs: DataFrame, v: Vocabulary, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One written row for each row of docs: its number, id, classes (a byte a word), the summed shares of its
    common words and its other words."""
    text_batches(spark)
    sent = spark.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary_, known = sent.value, Known(sent.value)
        for b in batches:
            texts = b.column(2).cast(pa.string())
            for at, stop in _runs(texts):
                part = b.slice(at, stop - at)
                if texts[at].is_valid and stop == at + 1:
                    classes, shares, others = vocabulary_.read(texts[at].as_buffer().to_pybytes())
                    made = [pa.array([classes.astype(np.uint8).tobytes()], pa.binary()), pa.array([shares]),
                            pa.ListArray.from_arrays(pa.array([0, len(others)], pa.int32()), _strings(others))]
                else:
                    made = known.read(texts.slice(at, stop - at))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made],
                                                 ["row", "doc_id", "classes", "shares", "others"])

    return written(
        spark,
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                    F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run, "row long, doc_id long, classes binary, shares double, others array<string>"),
        "lm-rows",
    )


Params = dict[str, np.ndarray]


def _neighbours(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets x places: the row of each neighbour's vector, the vectors of all offsets end to end."""
    return ids.take(np.add.outer(OFFSETS, at)) + np.arange(0, len(OFFSETS) * (CLASSES + 1), CLASSES + 1, np.int16)[:, None]


def _hidden(p: Params, rows: np.ndarray) -> np.ndarray:
    """Hidden layer of places with these neighbours, and a last column of ones."""
    h = np.ones((rows.shape[1], HIDDEN + 1), np.float32)
    sums = p["in"].reshape(-1, HIDDEN).take(rows, axis=0).sum(0)
    sums += p["b"]
    np.tanh(sums, out=h[:, :HIDDEN])
    return h


def _layer(p: Params) -> tuple[np.ndarray, bool]:
    """The last layer for hidden rows that end in a one, and whether it keeps exp() of all logits in range.

    Hidden values lie in [-1, 1], which bounds the logits; they are shifted under the bound."""
    reach = np.abs(p["out"]).sum(0)
    high, low = float((p["c"] + reach).max()), float((p["c"] - reach).max())
    return np.concatenate((p["out"], (p["c"] - high)[None])), high - low < 80


def _logits(h: np.ndarray, layer: np.ndarray, bounded: bool, room: np.ndarray) -> np.ndarray:
    """The logits of each row of h, in the first rows of ``room``."""
    e = np.matmul(h, layer, out=room[:len(h)])
    if not bounded:
        e -= e.max(1, keepdims=True)
    return e


def _exponentials(e: np.ndarray) -> np.ndarray:
    """exp() of the logits in their place; returns the sum of each row."""
    np.exp(e, out=e)
    return e @ np.ones(CLASSES, np.float32)


def _lay_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with edges, the places of the words, and the text each place belongs to."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 4) - sizes - 2
    ids = np.full(int((sizes + 4).sum()), EDGE, np.int16)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    if len(at):
        ids[at] = np.concatenate(texts)
    return ids, at, owner


def log_probabilities(p: Params, v: Vocabulary, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """log p of every word given both sides, its class spread evenly, text by text, and the owner of each."""
    out, owner, target = _class_log_probabilities(p, texts)
    return out - v.spread[target], owner


def _class_log_probabilities(p: Params, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, at, owner = _lay_out(texts)
    out, layer, room = np.zeros(len(at)), _layer(p), np.empty((BLOCK, CLASSES), np.float32)
    for k in range(0, len(at), BLOCK):
        here = at[k:k + BLOCK]
        e = _logits(_hidden(p, _neighbours(ids, here)), *layer, room)
        chosen = e.ravel().take(np.arange(len(here)) * CLASSES + ids.take(here))
        out[k:k + BLOCK] = chosen - np.log(_exponentials(e))
    return out, owner, ids[at]


def start(counts: np.ndarray, seed: int = 5) -> Params:
    """Arrays before the first step; ``counts`` are the occurrences of each class."""
    r = np.random.default_rng(seed)
    p = {
        "in": (r.standard_normal((len(OFFSETS), CLASSES + 1, HIDDEN)) * 0.3).astype(np.float32),
        "b": np.zeros(HIDDEN, np.float32),
        "out": (r.standard_normal((HIDDEN, CLASSES)) * 0.1).astype(np.float32),
        "c": np.log(counts + 1.0).astype(np.float32),
    }
    p["c"] -= p["c"].max()
    return p


class Steps:
    """Adam steps on arrays that lie end to end in one (a copy of those it is given)."""

    def __init__(self, p: Params):
        self.flat = np.concatenate([x.ravel() for x in p.values()])
        self.p, self.step, at = {}, 0, 0
        for k, x in p.items():
            self.p[k] = self.flat[at:at + x.size].reshape(x.shape)
            at += x.size
        self.m, self.s, self.t, self.g = (np.zeros_like(self.flat) for _ in range(4))
        self.room = np.empty((BATCH, CLASSES), np.float32)
        self.found, at = {}, 0  # the gradients, laid out as the arrays are
        for k, x in p.items():
            self.found[k] = self.g[at:at + x.size].reshape(x.shape)
            at += x.size

    def gradients(self, ids: np.ndarray, here: np.ndarray) -> Params:
        """The gradients of the mean loss at places ``here``, in arrays that the next call writes again."""
        p, found = self.p, self.found
        rows = _neighbours(ids, here)
        h = _hidden(p, rows)
        d = _logits(h, *_layer(p), self.room)
        d *= (1 / (_exponentials(d) * len(here)))[:, None]
        d.ravel()[np.arange(len(here)) * CLASSES + ids.take(here)] -= np.float32(1 / len(here))
        last, h = h.T @ d, h[:, :HIDDEN]
        dh = (d @ p["out"].T) * (1 - h * h)
        found["out"][:], found["c"][:] = last[:HIDDEN], last[HIDDEN]
        dh.sum(0, out=found["b"])
        # a vector of HIDDEN numbers is added up as half as many complex ones
        sums, own = np.zeros(found["in"].size // 2, complex), dh.astype(np.float64).view(complex).ravel()
        for row in rows.astype(np.intp) * (HIDDEN // 2):
            np.add.at(sums, np.add.outer(row, np.arange(HIDDEN // 2)).ravel(), own)
        found["in"][:] = sums.view(np.float64).reshape(found["in"].shape)
        return found

    def take(self, ids: np.ndarray, here: np.ndarray, rate: float) -> None:
        self.step += 1
        self.gradients(ids, here)
        g, m, s, t = self.g, self.m, self.s, self.t
        np.subtract(g, m, out=t)
        t *= 0.1
        m += t
        np.multiply(g, g, out=t)
        t -= s
        t *= 0.01
        s += t
        np.multiply(s, 1 / (1 - 0.99**self.step), out=t)
        np.sqrt(t, out=t)
        t += 1e-8
        np.divide(m, t, out=t)
        t *= rate / (1 - 0.9**self.step)
        self.flat -= t


def fit(texts: list[np.ndarray], seed: int = 5) -> Params:
    """The network on texts that are all at hand."""
    r = np.random.default_rng(seed)
    ids, at, _ = _lay_out(texts)
    adam = Steps(start(np.bincount(ids[at], minlength=CLASSES)[:CLASSES], seed))
    steps = max(EPOCHS * -(-len(at) // BATCH), 1)
    for _ in range(EPOCHS):
        order = r.permutation(len(at))
        for k in range(0, len(at), BATCH):
            adam.take(ids, at[order[k:k + BATCH]], RATE * (1 - (adam.step + 1) / (steps + 1)))
    return adam.p


def fit_all(spark: SparkSession, rows: DataFrame, v: Vocabulary) -> Params:
    """The network on every row: tasks step through their rows, their arrays are summed after each round."""
    p = start(v.counts)
    if not v.counts.sum():
        return p
    for done in range(ROUNDS):
        sent = spark.sparkContext.broadcast((p, RATE * (1 - done / ROUNDS), done))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            old, rate, seed = sent.value
            adam, r, seen = Steps(old), np.random.default_rng(seed), 0
            for b in batches:
                ids, at, _ = _lay_out([np.frombuffer(c.as_py(), np.uint8) for c in b.column(0)])
                order = r.permutation(at)
                for k in range(0, len(at), BATCH):
                    adam.take(ids, order[k:k + BATCH], rate)
                seen += len(at)
            if seen:
                flat = np.concatenate([adam.p[k].ravel() for k in old] + [np.ones(1)]).astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                                                 ["at", "value"])

        share = rows.where(F.pmod(F.hash("row"), F.lit(ROUNDS)) == done).select("classes")
        sums = share.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        if sums:  # as many numbers as the arrays hold, and the words
            flat = np.zeros(len(sums))
            flat[[x["at"] for x in sums]] = [x["value"] for x in sums]
            flat, k, new = flat[:-1] / flat[-1], 0, {}
            for name, x in p.items():
                new[name] = flat[k:k + x.size].reshape(x.shape).astype(np.float32)
                k += x.size
            p = new
        sent.unpersist()
    return p


def train(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Vocabulary, Params]:
    v = vocabulary(word_counts(spark, docs, text_col))
    return v, fit_all(spark, classified(spark, docs, v, id_col, text_col), v)


def _score_rows(spark: SparkSession, rows: DataFrame, v: Vocabulary, p: Params, even: bool) -> DataFrame:
    """(row, doc_id, n_words, total): the classes' log probabilities with the shares that need no join."""
    sent = spark.sparkContext.broadcast((v, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary_, params = sent.value
        for b in batches:
            for at in range(0, len(b), 128):
                part = b.slice(at, 128)
                texts = [np.frombuffer(c.as_py(), np.uint8) for c in part.column(2)]
                logs, owner, target = _class_log_probabilities(params, texts)
                if even:
                    logs -= vocabulary_.spread[target]
                sums = np.bincount(owner, logs, len(texts)).astype(float)
                if not even:
                    sums += part.column(3).to_numpy(zero_copy_only=False)
                sizes = np.array([len(t) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array(sums)],
                                                 ["row", "doc_id", "n_words", "total"])

    return rows.select("row", "doc_id", "classes", "shares").mapInArrow(
        run, "row long, doc_id long, n_words long, total double")


def _contract_columns(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "n_words", F.round("total", 4).alias("log_likelihood"),
                         F.round(F.col("total") / F.greatest("n_words", F.lit(1)), 6).alias("mean_log_likelihood"))


def other_shares(rows: DataFrame, counts: DataFrame, v: Vocabulary) -> DataFrame:
    """(row, more): the summed log shares of the words that are not common."""
    by_length = F.array(*[F.lit(float(max(n, 1))) for n in v.counts[TOP_WORDS:]])
    share = F.log(F.col("n") / F.element_at(by_length, _size()))
    return (
        rows.select("row", F.explode("others").alias("word"))
        .join(counts.select("word", share.alias("share")), "word")
        .groupBy("row").agg(F.sum("share").alias("more"))
    )


def score(spark: SparkSession, docs: DataFrame, v: Vocabulary, p: Params, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of every row, classes spread evenly over their words."""
    return _contract_columns(_score_rows(spark, classified(spark, docs, v, id_col, text_col), v, p, even=True))


def contract(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of every row by the counts of all words."""
    counts = word_counts(spark, docs)
    v = vocabulary(counts)
    rows = classified(spark, docs, v)
    scored = _score_rows(spark, rows, v, fit_all(spark, rows, v), even=False)
    more = other_shares(rows, counts, v)
    return _contract_columns(scored.join(more, "row", "left").withColumn(
        "total", F.col("total") + F.coalesce("more", F.lit(0.0))))
