"""Licence scans (1): lines, paragraphs and whole texts against licence templates.

A unit of text is normalised (lower case, runs of anything but letters and
digits become one blank) and compared with each template by the Dice
coefficient over their sets of word bigrams::

    dice = 2 * |A and B| / (|A| + |B|)

Size bounds prune first.  With a threshold t, two sets can only reach it if
the larger is at most (2 - t) / t times the smaller, so a unit whose word count
is out of reach of every template is dropped before any bigram is built, and
each template only meets units within its own bounds.

One projection over Spark SQL functions: no user function, no shuffle, no join;
the templates are literals of a fixed size.

Defined results: null, empty and one-word texts have no bigrams and no match;
of equally good templates the alphabetically first is the best; a repeated line
counts once per text; repeated rows are scanned one by one; an empty table
gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dice threshold in per cent.
MIN_DICE = 80

# Customary wording of public licence notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This work is released into the public domain.",
}


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _bigrams(text: str) -> list[str]:
    w = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def size_bounds(n: int, per_cent: int = MIN_DICE) -> tuple[int, int]:
    """Smallest and largest bigram-set size that can reach the threshold against ``n`` bigrams."""
    return -(-n * per_cent // (200 - per_cent)), n * (200 - per_cent) // per_cent


def _normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _against(sets: Column, name: str, grams: list[str], per_cent: int) -> Column:
    """Matches-to-be of one template: the units within its size bounds, scored."""
    lo, hi = size_bounds(len(grams), per_cent)
    literal = F.array(*[F.lit(g) for g in grams])
    return F.transform(
        F.filter(sets, lambda s: F.size(s["b"]).between(lo, hi)),
        lambda s: F.struct(
            F.lit(name).alias("license"),
            (F.size(F.array_intersect(s["b"], literal)) * 2 / (F.size(s["b"]) + len(grams))).alias("dice"),
            s["span"].alias("span"),
        ),
    )


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
         per_cent: int = MIN_DICE) -> DataFrame:
    """One row per input row: ``matches`` (array of licence, dice and the matching
    normalised span) and the best ``license`` with its ``dice`` (null if none)."""
    table = {k: _bigrams(v) for k, v in sorted((TEMPLATES if templates is None else templates).items())}
    table = {k: v for k, v in table.items() if v}
    most = max((size_bounds(len(v), per_cent)[1] for v in table.values()), default=0)
    least = min((size_bounds(len(v), per_cent)[0] for v in table.values()), default=0)

    text = F.col("_text")
    lines = F.split(text, "\n")
    paragraphs = F.split(text, r"\n[ \t\r]*\n\s*")
    # |distinct bigrams| <= words - 1; a unit with more words may repeat itself, so only the
    # lower bound on words is safe before the bigrams are built, the upper one after
    words = F.col("_units")
    bigrams = F.transform(
        words,
        lambda u: F.struct(
            u.alias("span"),
            F.array_distinct(F.zip_with(
                F.slice(F.split(u, " "), 1, F.greatest(F.size(F.split(u, " ")) - 1, F.lit(0))),
                F.slice(F.split(u, " "), 2, F.size(F.split(u, " "))),
                lambda a, b: F.concat(a, F.lit(" "), b),
            )).alias("b"),
        ),
    )
    blanks = lambda u: F.char_length(u) - F.char_length(F.replace(u, F.lit(" "), F.lit("")))
    staged = (
        df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .withColumn("_units", F.array_distinct(F.filter(
            F.transform(F.concat(lines, paragraphs, F.array(text)), _normalised),
            lambda u: blanks(u) >= least,
        )))
        .withColumn("_sets", F.filter(bigrams, lambda s: F.size(s["b"]).between(least, most)))
    )
    hits = [_against(F.col("_sets"), name, grams, per_cent) for name, grams in table.items()]
    empty = F.array().cast("array<struct<license:string,dice:double,span:string>>")
    found = F.when(F.size("_sets") == 0, empty).otherwise(
        F.filter(F.concat(empty, *hits), lambda m: 100 * m["dice"] >= per_cent)
    )
    best = F.get(F.array_sort(F.transform(
        F.col("matches"), lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("l"))
    )), F.lit(0))
    return (
        staged.select("doc_id", found.alias("matches"))
        .select("doc_id", "matches", best["l"].alias("license"), (-best["d"]).alias("dice"))
    )


def contract(df: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (distinct, sorted, comma-joined), license, dice."""
    return scan(df).select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias(
            "licenses"),
        "license",
        F.round("dice", 6).alias("dice"),
    )


def oracle() -> str:
    rows = ",\n".join(
        "('{}', [{}])".format(k, ", ".join(f"'{g}'" for g in _bigrams(v))) for k, v in sorted(TEMPLATES.items())
    )
    return f"""
    WITH t(license, tb) AS (VALUES {rows}),
    d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    u AS (
      SELECT DISTINCT doc_id, trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS span FROM (
        SELECT doc_id, unnest(list_concat(string_split(t, chr(10)),
                              regexp_split_to_array(t, '\\n[ \\t\\r]*\\n\\s*'), [t])) AS x FROM d)
    ), b AS (
      SELECT doc_id, span, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ub
      FROM (SELECT doc_id, span, string_split(span, ' ') AS w FROM u) WHERE len(w) BETWEEN 2 AND 100000
    ), m AS (
      SELECT doc_id, license, 2 * len(list_intersect(ub, tb)) / (len(ub) + len(tb)) AS dice
      FROM b, t
      WHERE 200 * len(list_intersect(ub, tb)) >= {MIN_DICE} * (len(ub) + len(tb))
    ), s AS (
      SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
             arg_min(license, {{'d': -dice, 'l': license}}) AS license, round(max(dice), 6) AS dice
      FROM m GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, license, dice
    FROM d LEFT JOIN s USING (doc_id)"""
