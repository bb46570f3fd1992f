"""Sources/sinks, projections, predicates, scalar functions, lookups, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ebbtide.functions.constants import BINARY_MAPS, DROP_COLS
from ebbtide.functions.scalar import at_threshold, log1p_safe, map_lookup, round_half_even, tier_cut, try_numeric
from ebbtide.operators.profile import dtype_split
from ebbtide.plans.common import round_doubles, sql_round_replace
from ebbtide.plans.fixture_sql import with_views
from ebbtide.plans.fixtures import NUMERIC_FEATURES, cust_dirty, cust_feat, cust_split, scored
from ebbtide.plans.registry import register
from ebbtide.session import scratch_path
from ebbtide.sources.io import (
    map_document,
    metrics_document,
    read_csv,
    read_json_document,
    read_metrics_document,
    read_parquet,
    records_document,
    scrub_null_tokens,
    write_csv,
    write_parquet,
    write_text_document,
)


def _fresh(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


DIRTY_SCHEMA = StructType(
    [StructField("cust_id", LongType()), StructField("churn", IntegerType())]
    + [StructField(c, DoubleType()) for c in NUMERIC_FEATURES]
    + [
        StructField(c, StringType())
        for c in (
            "prizm_social_one", "area", "dwlltype", "crclscod", "marital", "refurb_new", "hnd_webcap",
            "asl_flag", "creditcd", "ownrent", "dualband", "ethnic", "infobase", "rev_text",
        )
    ]
)


# ---- S1 CSV scan -------------------------------------------------------------

@register(
    "src_csv_roundtrip",
    with_views(
        f"""
SELECT * REPLACE ({sql_round_replace()},
  CASE WHEN prizm_social_one IN ('NULL','null','NaN','missing','-') THEN NULL ELSE prizm_social_one END
    AS prizm_social_one,
  CASE WHEN crclscod IN ('NULL','null','NaN','missing','-') THEN NULL ELSE crclscod END AS crclscod),
  round(TRY_CAST(rev_text AS DOUBLE), 6) AS rev_num
FROM cust_dirty
""",
        "cust_dirty",
    ),
)
def src_csv_roundtrip(spark, sf_dir):
    """Write the dirty customer table as CSV, scan it back with an explicit schema,
    scrub null tokens and coerce the text column to a number."""
    path = _fresh(spark, "csv")
    write_csv(cust_dirty(spark, sf_dir), path)
    back = scrub_null_tokens(read_csv(spark, path, DIRTY_SCHEMA), tokens=("NULL", "null", "NaN", "missing", "-"))
    # the empty-string cell of a written blank (" ") survives: CSV keeps quoted whitespace
    return round_doubles(back.withColumn("rev_num", try_numeric("rev_text")))


# ---- S2 Parquet scan ---------------------------------------------------------

@register("src_parquet_scan", with_views(f"SELECT * REPLACE ({sql_round_replace()}) FROM cust_feat", "cust_feat"))
def src_parquet_scan(spark, sf_dir):
    """The customer view built from the Parquet tables, all columns."""
    return round_doubles(cust_feat(spark, sf_dir))


# ---- S3 Parquet sink, partitioned by split, read back with partition pruning --

@register(
    "src_parquet_roundtrip",
    with_views(f"SELECT * REPLACE ({sql_round_replace()}) FROM cust_split WHERE split = 'test'", "cust_split"),
)
def src_parquet_roundtrip(spark, sf_dir):
    path = _fresh(spark, "split")
    write_parquet(cust_split(spark, sf_dir), path, partition_by=["split"])
    back = read_parquet(spark, path).where(F.col("split") == "test")  # partition filter: only test files read
    return round_doubles(back.select(*[c for c in back.columns]))


# ---- S4 / S5 JSON metric documents --------------------------------------------

def _model_metrics(spark, sf_dir):
    s = scored(spark, sf_dir)
    wide = s.groupBy("model").agg(
        F.avg("p").alias("mean_p"),
        F.avg(F.pow(F.col("p") - F.col("churn"), 2)).alias("brier"),
        F.avg("churn").alias("base_rate"),
    )
    return wide.select(
        "model", F.expr("stack(3, 'mean_p', mean_p, 'brier', brier, 'base_rate', base_rate) AS (metric, value)")
    )


METRICS_SQL = """
SELECT metric, model, round(value, 6) AS value FROM (
  SELECT model, 'mean_p' AS metric, avg(p) AS value FROM scored GROUP BY model
  UNION ALL SELECT model, 'brier', avg((p - churn) * (p - churn)) FROM scored GROUP BY model
  UNION ALL SELECT model, 'base_rate', avg(churn) FROM scored GROUP BY model
)
"""


@register("src_json_metrics", with_views(METRICS_SQL, "scored"))
def src_json_metrics(spark, sf_dir):
    """Metric document ``{metric: {model: value}}`` written as JSON and read back long."""
    path = _fresh(spark, "metrics-json")
    write_text_document(metrics_document(_model_metrics(spark, sf_dir)), path)
    return round_doubles(read_metrics_document(spark, path))


@register("sink_json_metrics", with_views(METRICS_SQL, "scored"))
def sink_json_metrics(spark, sf_dir):
    """The document ``{metric: {model: value}}`` as it was written, read by the reader of all shapes."""
    path = _fresh(spark, "metrics-doc")
    write_text_document(metrics_document(_model_metrics(spark, sf_dir)), path)
    return round_doubles(read_json_document(spark, path).select(
        F.col("outer").alias("metric"), F.col("inner").alias("model"), F.col("value").cast("double").alias("value")))


@register("sink_json_records", with_views(
    """
SELECT CAST(row_number() OVER (ORDER BY model) - 1 AS VARCHAR) AS record, model,
  round(avg((p - churn) * (p - churn)), 6) AS brier FROM scored GROUP BY model
""",
    "scored",
))
def sink_json_records(spark, sf_dir):
    """A model table written as an array of records (the tuning summary's shape) and read back."""
    path = _fresh(spark, "records-doc")
    wide = scored(spark, sf_dir).groupBy("model").agg(F.avg(F.pow(F.col("p") - F.col("churn"), 2)).alias("brier"))
    write_text_document(records_document(wide.select("model", "brier")), path)
    cells = read_json_document(spark, path)
    return round_doubles(cells.groupBy(F.col("outer").alias("record")).agg(
        F.max(F.when(F.col("inner") == "model", F.col("value"))).alias("model"),
        F.max(F.when(F.col("inner") == "brier", F.col("value").cast("double"))).alias("brier")))


@register("sink_json_config", with_views(
    "SELECT 'SCALE_POS_WEIGHT' AS key, round((1 - avg(churn)) / avg(churn), 6) AS value FROM cust_feat", "cust_feat"))
def sink_json_config(spark, sf_dir):
    """The class weight written as ``{key: value}`` (the configuration's shape) and read back."""
    path = _fresh(spark, "config-doc")
    m = F.avg("churn")
    weight = cust_feat(spark, sf_dir).agg(((1 - m) / m).alias("value")).select(F.lit("SCALE_POS_WEIGHT").alias("key"), "value")
    write_text_document(map_document(weight), path)
    return round_doubles(read_json_document(spark, path).where(F.col("outer").isNull()).select(
        F.col("inner").alias("key"), F.col("value").cast("double").alias("value")))


# ---- P1 drop the low-signal column set -----------------------------------------

@register(
    "proj_drop_low_signal",
    with_views(f"SELECT * EXCLUDE (rev_text) REPLACE ({sql_round_replace()}) FROM cust_dirty", "cust_dirty"),
)
def proj_drop_low_signal(spark, sf_dir):
    """Drop the fixed low-signal set; names absent from the table are ignored.
    The raw layout carries the key as ``Customer_ID`` plus a few totals that the
    list removes."""
    d = cust_dirty(spark, sf_dir)
    raw = d.select(
        "*",
        F.col("cust_id").alias("Customer_ID"),
        (F.col("mou_Mean") * F.col("months")).alias("totmou"),
        (F.col("rev_Mean") * F.col("months")).alias("totrev"),
        F.col("rev_text").alias("adjrev"),
    ).drop("rev_text")
    return round_doubles(raw.drop(*DROP_COLS))


# ---- P2 null tokens ----------------------------------------------------------

@register(
    "proj_null_tokens",
    with_views(
        f"""
SELECT * REPLACE ({sql_round_replace()},
  CASE WHEN prizm_social_one IN ('NULL','null','NaN','missing','-') THEN NULL ELSE prizm_social_one END
    AS prizm_social_one,
  CASE WHEN crclscod IN ('NULL','null','NaN','missing','-') THEN NULL ELSE crclscod END AS crclscod,
  CASE WHEN rev_text IN ('NULL','null','NaN','missing','-') THEN NULL ELSE rev_text END AS rev_text)
FROM cust_dirty
""",
        "cust_dirty",
    ),
)
def proj_null_tokens(spark, sf_dir):
    return round_doubles(scrub_null_tokens(cust_dirty(spark, sf_dir)))


# ---- P3 select by dtype ----------------------------------------------------------

@register(
    "proj_dtype_split",
    with_views(
        """
SELECT column_name AS "column",
  CASE WHEN column_type IN ('DOUBLE','BIGINT','INTEGER','FLOAT','SMALLINT','HUGEINT') THEN 'numeric'
       ELSE 'categorical' END AS kind
FROM (DESCRIBE SELECT * FROM cust_dirty)
WHERE column_name <> 'churn'
""",
        "cust_dirty",
    ),
)
def proj_dtype_split(spark, sf_dir):
    return dtype_split(spark, cust_dirty(spark, sf_dir), target="churn")


# ---- P6 / P8 filter by label, folded into conditional aggregates ------------------

@register(
    "filter_by_label",
    with_views(
        """
SELECT churn, count(*) AS customers,
  round(avg(rev_Mean), 6) AS avg_rev, round(avg(mou_Mean), 6) AS avg_mou,
  count(rev_Mean) AS rev_present
FROM cust_dirty GROUP BY churn
""",
        "cust_dirty",
    ),
)
def filter_by_label(spark, sf_dir):
    """``churn == v`` subsets without two scans: one grouped pass; nulls skipped per column."""
    d = cust_dirty(spark, sf_dir)
    return round_doubles(
        d.groupBy("churn").agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg("rev_Mean").alias("avg_rev"),
            F.avg("mou_Mean").alias("avg_mou"),
            F.count("rev_Mean").alias("rev_present"),
        )
    )


# ---- P10 threshold predicate ---------------------------------------------------

@register(
    "pred_threshold",
    with_views(
        "SELECT model, cust_id, churn, round(p, 6) AS p, CAST(p >= 0.5 AS INTEGER) AS pred FROM scored", "scored"
    ),
)
def pred_threshold(spark, sf_dir):
    s = scored(spark, sf_dir)
    return round_doubles(s.select("model", "cust_id", "churn", "p", at_threshold("p", 0.5).alias("pred")))


# ---- P11 post-condition checks ------------------------------------------------

def _null_cells_expr(cols):
    return sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))


@register(
    "check_no_nulls",
    with_views(
        """
SELECT 'cust_feat' AS table_name, count(*) AS row_count,
  CAST(sum({feat_nulls}) AS BIGINT) AS null_cells
FROM cust_feat
UNION ALL
SELECT 'cust_dirty', count(*), CAST(sum({dirty_nulls}) AS BIGINT) FROM cust_dirty
UNION ALL
SELECT 'processed_' || split, count(*), CAST(0 AS BIGINT)
FROM cust_dirty d JOIN (SELECT cust_id, split FROM cust_split) s ON d.cust_id = s.cust_id GROUP BY split
""".replace(
            "{feat_nulls}", " + ".join(f'CAST("{c}" IS NULL AS BIGINT)' for c in NUMERIC_FEATURES)
        ).replace(
            "{dirty_nulls}",
            " + ".join(
                f'CAST("{c}" IS NULL AS BIGINT)' for c in (*NUMERIC_FEATURES, "prizm_social_one", "crclscod", "rev_text")
            ),
        ),
        "cust_dirty", "cust_split",
    ),
)
def check_no_nulls(spark, sf_dir):
    """Null cells per table: the raw views, and both splits that preprocessing wrote, which
    must have none in any column (its job fails at the first row that has one)."""
    from ebbtide.operators.preprocess import ID_COLS
    from ebbtide.plans.q_models import processed

    feat = cust_feat(spark, sf_dir)
    dirty = cust_dirty(spark, sf_dir)
    done = processed(spark, sf_dir)
    a = feat.agg(F.count(F.lit(1)).alias("row_count"), F.sum(_null_cells_expr(NUMERIC_FEATURES)).alias("null_cells"))
    b = dirty.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(_null_cells_expr((*NUMERIC_FEATURES, "prizm_social_one", "crclscod", "rev_text"))).alias("null_cells"),
    )
    return a.select(F.lit("cust_feat").alias("table_name"), "*").unionByName(
        b.select(F.lit("cust_dirty").alias("table_name"), "*")
    ).unionByName(
        done.groupBy(F.concat(F.lit("processed_"), "split").alias("table_name")).agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum(_null_cells_expr([c for c in done.columns if c not in ID_COLS])).alias("null_cells"))
    )


# ---- J1 binary map lookup --------------------------------------------------------

def _binary_case_sql(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in mapping.items())
    return f"CAST(CASE {whens} ELSE 0 END AS INTEGER) AS {col}"


@register(
    "join_binary_map",
    with_views(
        "SELECT cust_id, " + ", ".join(_binary_case_sql(c, m) for c, m in BINARY_MAPS.items()) + " FROM cust_dirty",
        "cust_dirty",
    ),
)
def join_binary_map(spark, sf_dir):
    """Left lookup into a tiny literal map with default 0 on a miss (T, NULL -> 0)."""
    d = cust_dirty(spark, sf_dir)
    return d.select("cust_id", *[map_lookup(c, m).alias(c) for c, m in BINARY_MAPS.items()])


# ---- J3 features with label and score ---------------------------------------

@register(
    "join_features_label",
    with_views(
        """
SELECT s.model, f.cust_id, f.churn, round(s.p, 6) AS p, round(f.rev_Mean, 6) AS rev_Mean,
  round(f.mou_Mean, 6) AS mou_Mean, round(f."months", 6) AS "months", f.area
FROM cust_feat f JOIN scored s ON f.cust_id = s.cust_id
""",
        "scored",
    ),
)
def join_features_label(spark, sf_dir):
    """Key-aligned join of scores to features (never positional)."""
    f = cust_feat(spark, sf_dir)
    s = scored(spark, sf_dir, f).drop("churn")
    j = f.select("cust_id", "churn", "rev_Mean", "mou_Mean", "months", "area").join(s, "cust_id")
    return round_doubles(j.select("model", "cust_id", "churn", "p", "rev_Mean", "mou_Mean", "months", "area"))


# ---- J4 fold members: in-fold vs out-of-fold, by subtraction --------------------

@register(
    "join_fold_semi_anti",
    with_views(
        """
WITH t AS (SELECT count(*) AS n, CAST(sum(churn) AS BIGINT) AS pos FROM cust_split WHERE split = 'train'),
f AS (SELECT fold, count(*) AS n_in, CAST(sum(churn) AS BIGINT) AS pos_in FROM cust_split WHERE split = 'train'
      GROUP BY fold)
SELECT fold, n_in, t.n - n_in AS n_out, pos_in, t.pos - pos_in AS pos_out FROM f, t
""",
        "cust_split",
    ),
)
def join_fold_semi_anti(spark, sf_dir):
    """Per fold: rows in it (semi join) and outside it (anti join), as total - fold."""
    tr = cust_split(spark, sf_dir).where(F.col("split") == "train")
    per = tr.groupBy("fold").agg(F.count(F.lit(1)).alias("n_in"), F.sum("churn").alias("pos_in"))
    from pyspark.sql import Window

    whole = Window.partitionBy()  # over the per-fold table: k rows
    return per.select(
        "fold",
        F.col("n_in"),
        (F.sum("n_in").over(whole) - F.col("n_in")).alias("n_out"),
        F.col("pos_in").cast("long").alias("pos_in"),
        (F.sum("pos_in").over(whole) - F.col("pos_in")).cast("long").alias("pos_out"),
    )


# ---- X3 split disjoint and exhaustive ------------------------------------------

@register(
    "set_split_disjoint",
    with_views(
        """
SELECT
  (SELECT count(*) FROM cust_split WHERE split = 'train') AS n_train,
  (SELECT count(*) FROM cust_split WHERE split = 'test') AS n_test,
  (SELECT count(*) FROM (SELECT cust_id FROM cust_split WHERE split = 'train'
                         INTERSECT SELECT cust_id FROM cust_split WHERE split = 'test')) AS n_both,
  (SELECT count(*) FROM (SELECT cust_id FROM cust_feat
                         EXCEPT SELECT cust_id FROM cust_split)) AS n_missing
""",
        "cust_split",
    ),
)
def set_split_disjoint(spark, sf_dir):
    s = cust_split(spark, sf_dir)
    feat = cust_feat(spark, sf_dir)
    tr = s.where(F.col("split") == "train").select("cust_id")
    te = s.where(F.col("split") == "test").select("cust_id")
    counts = s.groupBy().agg(
        F.sum((F.col("split") == "train").cast("long")).alias("n_train"),
        F.sum((F.col("split") == "test").cast("long")).alias("n_test"),
    )
    both = tr.intersect(te).agg(F.count(F.lit(1)).alias("n_both"))
    missing = feat.select("cust_id").exceptAll(s.select("cust_id")).agg(F.count(F.lit(1)).alias("n_missing"))
    one = F.lit(1).alias("_k")
    return (
        counts.select("*", one)
        .join(both.select("*", one), "_k")
        .join(missing.select("*", one), "_k")
        .drop("_k")
    )


# ---- F1 try numeric, F2 log1p, F4 tier cut, F8 half-even, F14 float32 ------------

@register(
    "fn_try_numeric",
    with_views("SELECT cust_id, rev_text, round(TRY_CAST(rev_text AS DOUBLE), 6) AS rev_num FROM cust_dirty",
               "cust_dirty"),
)
def fn_try_numeric(spark, sf_dir):
    d = cust_dirty(spark, sf_dir)
    return round_doubles(d.select("cust_id", "rev_text", try_numeric("rev_text").alias("rev_num")))


@register(
    "fn_log1p",
    with_views(
        """
SELECT cust_id, round(change_mou, 6) AS change_mou,
  round(CASE WHEN change_mou > -1 THEN ln(1 + change_mou) END, 6) AS log1p_change_mou,
  round(CASE WHEN rev_Mean > -1 THEN ln(1 + rev_Mean) END, 6) AS log1p_rev
FROM cust_dirty
""",
        "cust_dirty",
    ),
)
def fn_log1p(spark, sf_dir):
    d = cust_dirty(spark, sf_dir)
    return round_doubles(
        d.select(
            "cust_id", "change_mou",
            log1p_safe("change_mou").alias("log1p_change_mou"),
            log1p_safe("rev_Mean").alias("log1p_rev"),
        )
    )


@register(
    "fn_tier_cut",
    with_views(
        """
SELECT cust_id, eqpdays,
  CASE WHEN eqpdays <= 180 THEN 0.0::DOUBLE WHEN eqpdays <= 365 THEN 1.0::DOUBLE
       WHEN eqpdays <= 730 THEN 2.0::DOUBLE WHEN eqpdays IS NOT NULL THEN 3.0::DOUBLE END AS device_age_tier
FROM cust_dirty
""",
        "cust_dirty",
    ),
)
def fn_tier_cut(spark, sf_dir):
    d = cust_dirty(spark, sf_dir)
    return d.select("cust_id", "eqpdays", tier_cut("eqpdays").alias("device_age_tier"))


@register(
    "fn_round_half_even",
    with_views(
        """
SELECT model, cust_id, round_even(p * 100 * 10.0, 0) / 10.0 AS prob_pct FROM scored
""",
        "scored",
    ),
)
def fn_round_half_even(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("model", "cust_id", round_half_even(F.col("p") * 100, 1).alias("prob_pct"))


@register(
    "fn_round_half_even_ties",
    with_views("SELECT cust_id, eqpdays, round_even(eqpdays / 4 * 10.0, 0) / 10.0 AS quarter_1dp FROM cust_dirty", "cust_dirty"),
)
def fn_round_half_even_ties(spark, sf_dir):
    """Exact binary ties (x.25, x.75) round to even, like NumPy: 0.25 -> 0.2."""
    d = cust_dirty(spark, sf_dir)
    return d.select("cust_id", "eqpdays", round_half_even(F.col("eqpdays") / 4, 1).alias("quarter_1dp"))


@register(
    "fn_cast_float32",
    with_views(
        "SELECT cust_id, " + ", ".join(f'CAST("{c}" AS FLOAT) AS "{c}"' for c in NUMERIC_FEATURES)
        + " FROM cust_feat",
        "cust_feat",
    ),
)
def fn_cast_float32(spark, sf_dir):
    """Narrow model inputs to float32 (half the memory of double)."""
    f = cust_feat(spark, sf_dir)
    return f.select("cust_id", *[F.col(c).cast("float").alias(c) for c in NUMERIC_FEATURES])


