"""Source divergence audit (12): how far the sources of a language stray from each other and from the language.

Terms are runs of ASCII letters and non-ASCII characters, with only A-Z
lower-cased.  A language keeps the terms of at least ``min_docs`` of its
documents; smoothed integer shares of the kept terms are compared between the
sources of a language and with the language as a whole.

Counting by length-bucketed packing.  A task takes whole texts as one byte
array, finds terms by a byte table, and sorts them in buckets of their length in
bytes: terms up to 8 bytes are one 64-bit word, up to 16 bytes two, and both are
sorted by stable radix passes over 16-bit digits; longer terms go to buckets of
doubling widths (17 to 32, 33 to 64, ...) that are sorted by their bytes.  Runs of
equal terms give occurrences, and runs of a document within them the number of
documents.  Documents lie in the order of their (language, source) group, so the
stable sort leaves each term's groups in runs too.

Scale.  A task sends one row per distinct (language, source, term) of each
``CHUNK`` bytes.  One exchange by (language, term) serves the sums by source and
the document counts.  The kept terms and their counts by source are written; all
later steps start there.  The pair part deals a language's terms into chunks of
some ``CHUNK_ROWS`` counts by hash; a chunk becomes a sources x terms matrix, cut
into tiles of ``CELLS``, and emits one partial sum per pair of sources, as many
rows as the result has.  The term part ranks after Spark's per-task limit of a
group's first ranks.

Arithmetic is in integers; products that may pass 64 bits are decimals.

Defined results: null text, lang and source are empty strings; a group without
terms has count 0 everywhere; a language without kept terms has pair values 0 and
no term rows; a language with one source has no pair rows; repeated rows count
again, as documents too; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import text_batches, written

MIN_DOCS = 30
TOP_TERMS = 50
#: Bytes of text counted at once.
CHUNK = 16 << 20
#: Counts by source in a chunk of the pair part, and cells of a matrix tile.
CHUNK_ROWS, CELLS = 200_000, 2_000_000

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_TERM = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _radix(words: list[np.ndarray]) -> np.ndarray:
    """Stable order by 64-bit words, the last word the least: one pass for each 16-bit digit that differs."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for digits in word.view("<u2").reshape(-1, 4).T:
            if (digits != digits[0]).any():
                order = order[np.argsort(digits[order], kind="stable")]
    return order


def _buckets(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, keys) of each length bucket: places of the terms in key order, and the ordered keys as bytes."""
    at = np.ndarray((len(text) - 7,), "<u8", text.data, 0, (1,))  # the 8 bytes from each place
    short, middle = np.flatnonzero(size <= 8), np.flatnonzero((size > 8) & (size <= 16))
    if len(short):
        word = at[start[short]] & _KEEP[size[short]]
        order = _radix([word])
        yield short[order], word[order].view("S8")
    if len(middle):
        words = [at[start[middle]], at[start[middle] + 8] & _KEEP[size[middle] - 8]]
        order = _radix(words)
        yield middle[order], np.column_stack([w[order] for w in words]).view("S16")[:, 0]
    width = 32
    rest = np.flatnonzero(size > 16)
    while len(rest):
        here, rest = rest[size[rest] <= width], rest[size[rest] > width]
        if len(here):
            keys = np.array([text[s:s + n].tobytes() for s, n in zip(start[here], size[here], strict=True)], f"S{width}")
            order = np.argsort(keys, kind="stable")
            yield here[order], keys[order]
        width *= 2


def count_terms(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents) of UTF-8 texts, per distinct group and term, one bucket at a time."""
    by_group = np.argsort(groups, kind="stable")
    groups = groups[by_group]
    joined = b" " + b" ".join([texts[k] for k in by_group]) + b" " * 16
    text = _LOWER[np.frombuffer(joined, np.uint8)]
    inside = _TERM[text]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, size = edge[::2], edge[1::2] - edge[::2]
    first = np.cumsum([1] + [len(texts[k]) + 1 for k in by_group])[:-1]  # where each document begins
    doc = np.searchsorted(first, start, "right") - 1
    for place, key in _buckets(text, start, size):
        own = doc[place]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (groups[own[1:]] != groups[own[:-1]])
        new_doc = new.copy()
        new_doc[1:] |= own[1:] != own[:-1]
        runs = np.flatnonzero(new)
        yield groups[own[runs]], key[runs], np.diff(runs, append=len(key)), np.add.reduceat(new_doc, runs, dtype=np.int64)


def term_counts(df: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) from (lang, source, text) without nulls: a row per task, chunk and distinct term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        names: dict[tuple[str, str], int] = {}
        groups: list[int] = []
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            lang, source = (np.array(x, object) for x in zip(*names, strict=True))
            for group, term, n, docs in count_terms(texts, np.array(groups)):
                for a in range(0, len(term), 50_000):
                    b = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lang[group[b]], pa.string()), pa.array(source[group[b]], pa.string()),
                         pa.array(term[b].tolist(), pa.binary()).cast(pa.string()), pa.array(n[b], pa.int64()),
                         pa.array(docs[b], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                    batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                groups.append(names.setdefault((lang, source), len(names)))
                texts.append(text)
                held += len(text) + 1
                if held >= CHUNK:
                    yield from counted()
                    texts, groups, names, held = [], [], {}, 0
        if texts:
            yield from counted()

    text_batches(df.sparkSession)
    return df.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1000000000 * (count + 5) / (total + 5 * terms)), exact."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")
    below = (total + 5 * terms).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, below)


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, n, by): terms of at least min_docs documents of their language, and their counts by source."""
    dealt = term_counts(docs).repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"),
    ).where(F.col("docs") >= min_docs).drop("docs")


def _pair_sums(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): sums of |p - q| over the terms of a chunk for its ordered pairs of sources.
    Rows with a null term give the share of a source's absent terms."""

    def run(table: pa.Table) -> pa.Table:
        term = table["term"]
        absent = np.flatnonzero(term.is_null().to_numpy())
        present = np.flatnonzero(term.is_valid().to_numpy())
        share = table["share"].to_numpy()
        source = table["source"].to_numpy(zero_copy_only=False)
        names, at = np.unique(source[absent], return_index=True)
        rest = share[absent][at]
        row = np.searchsorted(names, source[present])
        _, column = np.unique(term.take(pa.array(present)).to_numpy(zero_copy_only=False), return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column, value = row[order], column[order], share[present][order]
        n, total = len(names), int(column.max()) + 1 if len(column) else 0
        sums = np.zeros((n, n), np.int64)
        step = max(1, CELLS // n)
        for a in range(0, total, step):
            own = slice(*np.searchsorted(column, [a, a + step]))
            tile = np.repeat(rest[:, None], min(step, total - a), axis=1)
            tile[row[own], column[own] - a] = value[own]
            for k in range(n):
                sums[k] += np.abs(tile - tile[k]).sum(axis=1)
        i, j = np.nonzero(~np.eye(n, dtype=bool))
        lang = pa.array([table["lang"][0].as_py()] * len(i), pa.string())
        return pa.table({"lang": lang, "source": pa.array(names[i], pa.string()), "item": pa.array(names[j], pa.string()),
                         "value": pa.array(sums[i, j])})

    sums = rows.groupBy("lang", "chunk").applyInArrow(run, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(spark: SparkSession, df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: see the module."""
    docs = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
                       for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = written(spark, kept_terms(docs, min_docs), "divergence-kept")
    counts = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("by").alias("g")).select(
        "lang", "term", "lang_n", "g.source", "g.n")
    langs = kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"),
        F.ceil(F.sum(F.size("by")) / CHUNK_ROWS).cast("long").alias("chunks"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = written(spark, docs.select("lang", "source").distinct().join(langs, "lang", "left").join(
        totals, ["lang", "source"], "left").select(
            "lang", "source", *(F.coalesce(F.col(c), zero).alias(c) for c in ("terms", "lang_total", "chunks", "total"))),
        "divergence-groups")

    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("share"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("lang_share"),
        F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"))
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("share > lang_share").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (F.col("share") - F.col("lang_share")).alias("value")).withColumn("rank", F.row_number().over(by_rank)).where(
            F.col("rank") <= top)

    absent = groups.where("terms > 0").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), _share(zero, F.col("total"), F.col("terms")).alias("share"),
        F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("chunk"))
    sums = _pair_sums(shares.select(*absent.columns).unionByName(absent))
    bare = groups.where("terms = 0").select("lang", "source")  # the result has a row for each of these pairs
    zeros = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select(
        "lang", "source", "item", zero.alias("value"))
    pairs = sums.unionByName(zeros).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_rank).alias("rank"))
    return pairs.unionByName(terms)


def contract(spark: SparkSession, df: DataFrame) -> DataFrame:
    return audit(spark, df)


def oracle() -> str:
    """The audit in DuckDB SQL."""
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents
), terms AS (
  SELECT d, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM docs)
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= {MIN_DOCS}
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN kept k ON k.lang = t.lang AND k.term = t.term
  GROUP BY t.lang, t.source, t.term
), totals AS (
  SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (l.lang_total + 5 * l.v)::HUGEINT AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS s, y.source AS o, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3
  ) f ON f.lang = a.lang AND f.s = a.source AND f.o = b.source
), told AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT,
    row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, r::INTEGER AS rank FROM told WHERE part = 'pair' OR r <= {TOP_TERMS}
"""
