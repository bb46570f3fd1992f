"""Benchmark decontamination (7) by spaced-seed hashing.

Words are lower-cased runs of letters and digits.  A text overlaps an item if
some ``WINDOW`` (13) words of the item, or all of a shorter item, stand in it at
the same distances with at most one word in five replaced (two of 13).

Seeds.  A mask keeps fixed positions of a run of words and ignores the others;
its hash therefore survives substitutions at ignored positions.  The masks of a
family cover every way of placing the allowed substitutions in a window (found
by exhaustive search, tested), so no overlap is lost:

* ``LONG``, six words each, for items of at least 13 words;
* ``SHORT`` for items of 5 to 12 words;
* items of fewer than five words are hashed whole and must occur exactly.

A family is only hashed if the benchmark has items for it.

Spark side, all Spark SQL functions.  Seed hashes of every position of every
text meet the item seeds in an equality join.  The item side is broadcast if its
counted rows stay within ``BROADCAST_ROWS`` and shuffled otherwise.  Hits shrink
to distinct (text, item, offset) alignments before their shuffle, and only
texts with a hit are read again to compare words around the hits.  Texts are
seeded in slices of ``SLICE`` words, so a long one needs no more memory.

Defined results: null and blank texts and items match nothing; items of equal
text each report; repeated rows of an id are searched together and reported
once; rows with a null id are not searched, as nothing could name them; an empty
table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import written

WINDOW = 13
#: One word in this many may be replaced.
REPLACED = 5
LONG = ("11101011", "110100111")
SHORT = ("111", "11011")
#: Item seeds that may be broadcast (about 40 bytes each).
#: Words of the shortest item for which a document is dropped; a shorter one stands in any text.
LEAST_WORDS = 5
BROADCAST_ROWS = 500_000
SLICE = 4096


def tokens(text: Column) -> Column:
    clean = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def _with_pairs(df: DataFrame, words: str) -> DataFrame:
    """Adds ``_pairs``, the hash of each word's hash and the next one's (the last word's: of its own alone)."""
    following = F.slice(words, 2, F.size(words))
    return df.withColumn("_pairs", F.zip_with(words, following, lambda a, b: F.xxhash64(a, b)))


def _seeds(words: Column, pairs: Column, masks: tuple[tuple[int, str], ...]) -> Column:
    """Array of (mask, at, key) over all positions of an array of word hashes.
    Neighbouring kept words enter a key by their pair's hash, which the masks share."""
    def one(number: int, mask: str) -> Column:
        kept, i = [], 0
        while i < len(mask):
            if mask[i] == "1":
                paired = mask[i:i + 2] == "11"
                kept.append((pairs if paired else words, i))
                i += paired
            i += 1
        return F.when(
            F.size(words) >= len(mask),
            F.transform(
                F.sequence(F.lit(0), F.size(words) - len(mask)),
                lambda p: F.struct(
                    F.lit(number).alias("mask"), p.alias("at"),
                    F.xxhash64(*[F.get(of, p + i) for of, i in kept]).alias("key"),
                ),
            ),
        ).otherwise(F.array().cast("array<struct<mask:int,at:int,key:bigint>>"))

    parts = [one(n, m) for n, m in masks]
    return F.concat(*parts) if parts else F.array().cast("array<struct<mask:int,at:int,key:bigint>>")


def _masks(sizes: set[int]) -> tuple[tuple[int, str], ...]:
    """Masks for items of these sizes (sizes from ``WINDOW`` on are told as ``WINDOW``); the number names the family."""
    out: list[tuple[int, str]] = []
    if WINDOW in sizes:
        out += [(100 + i, m) for i, m in enumerate(LONG)]
    if any(5 <= n < WINDOW for n in sizes):
        out += [(200 + i, m) for i, m in enumerate(SHORT)]
    return (*out, *((n, "1" * n) for n in sorted(sizes) if 0 < n < 5))


def _of_item(mask: Column, size: Column) -> Column:
    """Whether an item of this many words is searched by this mask."""
    return F.when(size >= WINDOW, mask.between(100, 199)).when(size >= 5, mask >= 200).otherwise(mask == size)


def overlaps(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", least_words: int = 1) -> DataFrame:
    """(doc_id, item_id, matched, window, at): contaminated pairs; the best window's
    matching words, its size and the item's place in the text (in words).  Items under
    ``least_words`` words are not looked for."""
    # an item is its id and its words: ids may be null or repeat
    bench = items.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("iw")).where(
        F.size("iw") >= least_words).select("*", F.size("iw").alias("size"), F.xxhash64("item_id", "iw").alias("item")).dropDuplicates(["item"])
    sizes = {r[0] for r in bench.select(F.least("size", F.lit(WINDOW))).distinct().collect()}  # at most 13 numbers
    masks = _masks(sizes)
    hashes = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    seeds = (
        _with_pairs(bench.withColumn("ih", hashes(F.col("iw"))), "ih")
        .select("item", "size", F.explode(_seeds(F.col("ih"), F.col("_pairs"), masks)).alias("s"))
        .where(_of_item(F.col("s.mask"), F.col("size")))
        .select("item", F.col("s.mask").alias("mask"), F.col("s.key").alias("key"), F.col("s.at").alias("item_at"))
    )
    seeds = written(spark, seeds, "decontamination-seeds")
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    longest = max((len(m) for _, m in masks), default=1)
    slices = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("dh") - 1, F.lit(0)), F.lit(SLICE)),
        lambda at: F.struct(at.alias("first"), F.slice("dh", at + 1, SLICE + longest - 1).alias("dh")),
    )
    pieces = (
        texts.select("doc_id", tokens(F.col("text")).alias("dw"))
        .select("doc_id", hashes(F.col("dw")).alias("dh"))
        .select("doc_id", F.explode(slices).alias("part"))
        .select("doc_id", "part.first", "part.dh")
    )
    placed = (
        _with_pairs(pieces, "dh")
        .select("doc_id", "first", F.explode(_seeds(F.col("dh"), F.col("_pairs"), masks)).alias("s"))
        .where(F.col("s.at") < SLICE)
        .select("doc_id", F.col("s.mask").alias("mask"), F.col("s.key").alias("key"),
                (F.col("first") + F.col("s.at")).alias("doc_at"))
    )
    hits = (
        placed.join(seeds, ["mask", "key"])
        .select("doc_id", "item", (F.col("doc_at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    # a text's alignments are bounded by its own length; each text with a hit is split into words once
    by_text = hits.groupBy("doc_id").agg(F.collect_list(F.struct("item", "shift")).alias("hits"))
    aligned = (
        texts.join(written(spark, by_text, "decontamination-hits"), "doc_id")
        .select("doc_id", tokens(F.col("text")).alias("dw"), "hits")
        .select("doc_id", "dw", F.explode("hits").alias("hit"))
        .select("doc_id", "dw", "hit.item", "hit.shift")
        .join(bench, "item")
    )
    n = F.least("size", F.lit(WINDOW))
    same = F.transform("iw", lambda w, q: F.coalesce(
        F.when(q + F.col("shift") >= 0, F.get("dw", q + F.col("shift"))) == w, F.lit(False)).cast("int"))
    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.col("size") - n),
        lambda q: F.aggregate(F.slice("same", q + 1, n), F.lit(0), lambda acc, x: acc + x),
    ))
    return (
        aligned.select("doc_id", "item", "item_id", "shift", "size", same.alias("same"))
        .select("doc_id", "item", "item_id", "shift", n.alias("window"), best.alias("matched"))
        .where(F.col("matched") >= F.col("window") - F.floor(F.col("window") / REPLACED))
        .groupBy("doc_id", "item", "item_id")
        .agg(F.max(F.struct(F.col("matched"), F.col("window"), (-F.col("shift")).alias("back"))).alias("b"))
        .select("doc_id", "item_id", F.col("b.matched").alias("matched"), F.col("b.window").alias("window"),
                (-F.col("b.back")).alias("at"))
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows that overlap no item of at least ``least_words`` words, with all their columns (rows without an id stay)."""
    found = overlaps(spark, docs, items, id_col, text_col, least_words=least_words).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(found, F.col(id_col) == F.col("_hit"), "left_anti")


def contract(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    return overlaps(spark, docs, items).select(
        "doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("window").cast("long").alias("window"),
        F.col("at").cast("long").alias("at"),
    )


def oracle() -> str:
    """Brute force in DuckDB: every equal word of every text and item votes for an alignment."""
    def words(name: str, key: str) -> str:
        return f"""{name} AS (
          SELECT {key}, generate_subscripts(ws, 1) - 1 AS p, unnest(ws) AS w, len(ws) AS n
          FROM (SELECT {key}, string_split(t, ' ') AS ws FROM (
            SELECT {key}, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t
            FROM {'documents' if name == 'd' else 'benchmark'}) WHERE t <> ''))"""

    return f"""
    WITH {words('d', 'doc_id')}, {words('i', 'item_id')},
    v AS (
      SELECT doc_id, item_id, d.p - i.p AS shift, i.p AS q, least(i.n, {WINDOW}) AS n FROM d JOIN i USING (w)
    ), c AS (
      SELECT doc_id, item_id, shift FROM v GROUP BY ALL HAVING count(*) >= max(n) - max(n) // {REPLACED}
    ), m AS (
      SELECT doc_id, item_id, shift, n,
             count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q
                            RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS matched
      FROM v JOIN c USING (doc_id, item_id, shift)
    )
    SELECT doc_id, item_id, max(least(matched, n)) AS matched, max(n) AS "window",
           arg_min(shift, {{'m': -least(matched, n), 's': shift}}) AS "at"
    FROM m WHERE matched >= n - n // {REPLACED} GROUP BY doc_id, item_id"""
