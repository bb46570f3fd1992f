"""Language ID (8) by hyperdimensional profiles.

Every letter owns a fixed random vector of +1 and -1.  An n-gram is bound by
multiplying the vectors of its letters, each rotated by its place; a text is
the bundle (sum) of its n-grams, a language the bundle of the normalised
vectors of its training texts.  A text goes to the prototype with the largest
cosine.

Spark side.  Prototypes come from all training rows: each Arrow batch adds up
its texts, so a task returns one partial sum for each language and batch and
one small grouped aggregation adds those (integers, so the order of arrival
does not matter).  Prediction is one pass without a shuffle.  A batch builds
the vectors of its distinct n-grams once and gets all texts by one matrix
product, in blocks of bounded size.

Defined results: ``und`` with score 0 for null texts and texts without a
letter, and for all texts if there is no training row; a tie goes to the
alphabetically first language; repeated rows are judged one by one; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import id_fold, text_batches

DIMENSIONS = 1024
N = 3
FOLDS, HELD_OUT_FOLD = 4, 2
#: Letters are told apart by code point modulo this prime.
LETTERS = 1021
SHARPNESS = 30.0
#: Texts bundled by one matrix product, and n-grams looked up at once.
BLOCK_TEXTS, BLOCK_GRAMS = 256, 4096
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SLICE = 1 << 20


def _letter_vectors() -> np.ndarray:
    return np.random.default_rng(8).integers(0, 2, (LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1


def letters_only(text: str) -> str:
    """The text with one blank for each run of what are no letters."""
    words = _NOT_LETTERS.sub(" ", text).strip()
    if words and not words.replace(" ", "").isalpha():  # numbers that are no digits: fractions, circled ones
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return words


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams (packed) of a whole text and their counts; words are edged by one blank."""
    keys, counts = [], []
    text = text or ""
    for at in range(0, len(text), _SLICE):  # slices share two characters
        part = text[max(at - 2, 0):at + _SLICE].lower()
        codes = np.frombuffer(f" {letters_only(part)} ".encode("utf-32-le", "surrogatepass"), "<u4")
        codes = (codes % LETTERS).astype(np.int64)
        if len(codes) < N:
            continue
        k, c = np.unique(codes[:-2] * LETTERS**2 + codes[1:-1] * LETTERS + codes[2:], return_counts=True)
        keys.append(k)
        counts.append(c)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def _bind(keys: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """n-gram vectors: rotated letter vectors multiplied."""
    first, second, third = keys // LETTERS**2, keys // LETTERS % LETTERS, keys % LETTERS
    return (np.roll(letters, 2, 1)[first] * np.roll(letters, 1, 1)[second] * letters[third]).astype(np.float32)


def text_vectors(texts: list[str | None], letters: np.ndarray) -> np.ndarray:
    """Bundled vectors, one row a text (zero without letters)."""
    grams = [gram_counts(t) for t in texts]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    row = np.repeat(np.arange(len(texts)), [len(k) for k, _ in grams])
    if not len(row):
        return out
    keys, column = np.unique(np.concatenate([k for k, _ in grams]), return_inverse=True)
    weight = np.concatenate([c for _, c in grams]).astype(np.float32)
    for at in range(0, len(keys), BLOCK_GRAMS):
        here = (column >= at) & (column < at + BLOCK_GRAMS)
        counts = np.zeros((len(texts), min(BLOCK_GRAMS, len(keys) - at)), np.float32)
        counts[row[here], column[here] - at] = weight[here]
        out += counts @ _bind(keys[at:at + BLOCK_GRAMS], letters)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    for at in range(0, len(column), BLOCK_TEXTS):
        yield at, column.slice(at, BLOCK_TEXTS).to_pylist()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language -> prototype, from all rows with a language outside the held-out fold."""
    text_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letter_vectors()
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for at, texts in _blocks(b.column(0)):
                # whole thousandths: sums of integers don't depend on the order of addition
                units = np.rint(_unit(text_vectors(texts, letters)) * 1e4).astype(np.int64)
                for lang in set(langs[at:at + len(texts)]):
                    part = units[langs[at:at + len(texts)] == lang].sum(0)
                    sums[lang] = sums.get(lang, 0) + part
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
                ["lang", "v"])

    rows = (
        docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                   & (id_fold(F.col(id_col), FOLDS) != HELD_OUT_FOLD))
        .select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .mapInArrow(run, "lang string, v array<bigint>")
        .select("lang", F.posexplode("v").alias("d", "v"))
        .groupBy("lang", "d").agg(F.sum("v").alias("v"))
        .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("v"))
        .collect()  # languages x DIMENSIONS numbers
    )
    return {r["lang"]: np.array(r["v"], float) for r in sorted(rows, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    names = [k for k, v in prototypes.items() if np.any(v)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letter_vectors()
        profile = _unit(np.array([prototypes[k] for k in names])).astype(np.float32).T if names else None
        for b in batches:
            langs, scores = [], []
            for _, texts in _blocks(b.column(1)):
                if profile is None:
                    langs += ["und"] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                vectors = text_vectors(texts, letters)
                cosines = (_unit(vectors) @ profile).astype(float)
                e = np.exp(SHARPNESS * (cosines - cosines.max(1, keepdims=True)))
                share = e / e.sum(1, keepdims=True)
                some = np.any(vectors != 0, axis=1)
                for i, best in enumerate(np.argmax(share, axis=1)):
                    langs.append(names[best] if some[i] else "und")
                    scores.append(round(float(share[i, best]), 6) if some[i] else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def contract(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs)).select(
        "doc_id", (id_fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD).alias("held_out"), "lang_pred", "score"
    )
