"""Quality rules (4): a threshold table compiled into one projection.

Every rule compares an integer measure with a share of another one, so both
sides stay whole numbers and no rounding can tip a verdict::

    100 * measure  <=  per_cent * base      (op "max")
    100 * measure  >=  per_cent * base      (op "min")

``RULES`` is data: adding a row adds a predicate to the projection.  Everything
is built from Spark SQL functions; there is no user function and no shuffle, a
row is judged by itself however long it is.

Defined results: a null or blank text has zero of everything and fails the base
rule; repeated rows and ids are judged one by one; an empty table gives an
empty table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import SPACES, ascii_words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by",
    "der", "die", "und", "den", "das", "von", "zu", "ist", "mit", "ein", "für", "auf",
    "le", "la", "les", "de", "et", "des", "en", "un", "une", "que", "qui", "dans", "pour",
    "el", "los", "las", "y", "del", "se", "por", "con", "no", "para",
)


class Rule(NamedTuple):
    name: str
    measure: str
    op: str  # "min" or "max"
    per_cent: int
    base: str


#: 100 * measure <= (or >=) per_cent * base; base "one" makes it a plain bound.
RULES = (
    Rule("enough_words", "n_words", "min", 5_000, "one"),
    Rule("few_repeated_words", "n_repeat_words", "max", 50, "n_words"),
    Rule("word_length_low", "word_chars", "min", 200, "n_words"),
    Rule("word_length_high", "word_chars", "max", 1_200, "n_words"),
    Rule("few_symbols", "n_symbols", "max", 10, "n_words"),
    Rule("stop_words", "n_stop_words", "min", 2, "n_words"),
    Rule("few_duplicate_lines", "n_dup_lines", "max", 30, "n_lines"),
    Rule("few_shouted_words", "n_upper_words", "max", 30, "n_words"),
)
#: The part of the table that makes up the base verdict.
BASE_RULES = ("enough_words", "few_repeated_words")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper_words",
            "n_lines")


def measured(df: DataFrame, text_col: str, keep: tuple[Column, ...]) -> DataFrame:
    """``keep`` plus the measures of the rule table.

    Repeated 3-word windows are keyed by a chained 64-bit hash of their words.
    Texts without one (most) stop after a hash-set pass; the others sort
    (hash, position) once and look at their neighbours, so the cost stays
    n log n for any length.  The helper columns are staged, because an
    expression named inside a lambda would be evaluated for every element.
    """
    text, words, lines = F.col("_text"), F.col("_words"), F.col("_lines")
    keys, ranked = F.col("_keys"), F.col("_ranked")
    n = F.size(words)
    marked = F.transform(
        ranked,
        lambda r, j: F.when(
            F.coalesce(r["k"] == F.get(ranked, j - 1)["k"], F.lit(False))
            | F.coalesce(r["k"] == F.get(ranked, j + 1)["k"], F.lit(False)),
            F.array(r["i"], r["i"] + 1, r["i"] + 2),
        ).otherwise(F.array().cast("array<int>")),
    )
    staged = (
        df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .withColumns({
            "_words": ascii_words(text),
            "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        })
        .withColumn("_keys", F.when(n >= 3, F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        )).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_ranked", F.when(
            F.size(F.array_distinct(keys)) < F.size(keys),
            F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<k:bigint,i:int>>")))
    )
    kept = [c for c in staged.columns if not c.startswith("_")]
    return staged.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(marked))).cast("long").alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(words, lambda w: (F.char_length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)))
        .cast("long").alias("n_upper_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )


def _passes(rule: Rule) -> Column:
    base = F.lit(1) if rule.base == "one" else F.col(rule.base)
    left, right = 100 * F.col(rule.measure), rule.per_cent * base
    return left >= right if rule.op == "min" else left <= right


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the measures, ``base_failed``, the names of the
    ``failed`` rules and the verdict ``kept``."""
    base = [r for r in rules if r.name in BASE_RULES]
    table = measured(df, text_col, (F.col(id_col).alias("doc_id"),))
    failed = F.filter(
        F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    base_ok = F.lit(True)
    for r in base:
        base_ok = base_ok & _passes(r)
    return table.select(
        "doc_id", *MEASURES, (~base_ok).alias("base_failed"), failed.alias("failed"),
        (F.size(failed) == 0).alias("kept"),
    )


def contract(df: DataFrame) -> DataFrame:
    return judge(df).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_rule(rule: Rule) -> str:
    base = "1" if rule.base == "one" else rule.base
    return f"100 * {rule.measure} {'>=' if rule.op == 'min' else '<='} {rule.per_cent} * {base}"


def oracle() -> str:
    """The contract's rows in DuckDB."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    base = " AND ".join(_sql_rule(r) for r in RULES if r.name in BASE_RULES)
    all_rules = " AND ".join(_sql_rule(r) for r in RULES)
    return f"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
      FROM documents
    ), w AS (
      SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d
    ), g AS (
      SELECT doc_id, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)
    ), r AS (
      SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL
    ), rep AS (
      SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (
        SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r WHERE c >= 2) GROUP BY doc_id
    ), m AS (
      SELECT d.doc_id, len(ws) AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
             len(list_filter(ws, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS n_upper_words
      FROM d LEFT JOIN rep USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           NOT ({base}) AS base_failed, ({all_rules}) AS kept
    FROM m"""
