"""Split, feature and encoder queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.functions.constants import BINARY_MAPS, HIGH_CARD_CATS
from ebbtide.operators.collinear import VIFDropper, gram_long, numeric_null_free, vif_table
from ebbtide.operators.encode import MixedImputer, OrdinalCategoricalEncoder, TargetEncoderOOF
from ebbtide.operators.features import (
    ENGINEERED,
    BinaryMapEncoder,
    FeatureEngineer,
    PercentileClipper,
    StandardScaler,
    ratio_columns,
)
from ebbtide.operators.preprocess import ID_COLS, build_preprocessing_pipeline
from ebbtide.operators.split import kfold
from ebbtide.plans.common import round_doubles
from ebbtide.plans.fixture_sql import with_views
from ebbtide.plans.fixtures import NUMERIC_FEATURES, STRING_FEATURES, cust_clean, cust_feat, cust_split
from ebbtide.plans.registry import register

EPS_SQL = "0.000001"


def dirty_split(spark, sf_dir):
    """Scrubbed dirty rows with the split/fold of their customer."""
    s = cust_split(spark, sf_dir).select("cust_id", "split", "fold")
    return cust_clean(spark, sf_dir).join(s, "cust_id")


DIRTY_SPLIT_SQL = """
dirty_split AS (
  SELECT c.*, s.split, s.fold FROM cust_clean c JOIN (SELECT cust_id, split, fold FROM cust_split) s
  ON c.cust_id = s.cust_id
)"""


def _views(body, *names, extra=None):
    return with_views(body, *names, extra=extra)


# ---- M9 / M10 splits ------------------------------------------------------------

@register("split_train_test", _views("SELECT cust_id, churn, split, fold FROM cust_split", "cust_split"))
def split_train_test(spark, sf_dir):
    """Stratified 80/20 split (md5 order per class) and 5 stratified folds on train."""
    return cust_split(spark, sf_dir).select("cust_id", "churn", "split", "fold")


@register(
    "split_kfold",
    _views(
        """
SELECT cust_id, churn, CAST((row_number() OVER (PARTITION BY churn
  ORDER BY md5('44|' || CAST(cust_id AS VARCHAR)), cust_id) - 1) % 3 AS INTEGER) AS cv_fold
FROM cust_split WHERE split = 'train'
""",
        "cust_split",
    ),
)
def split_kfold(spark, sf_dir):
    """3-fold stratified assignment of the train rows (baseline cross-validation)."""
    tr = cust_split(spark, sf_dir).where(F.col("split") == "train").select("cust_id", "churn")
    return kfold(tr, "cust_id", "churn", 3, seed=44).select(
        "cust_id", "churn", F.col("fold").cast("int").alias("cv_fold")
    )


# ---- M1 imputer -------------------------------------------------------------------

IMPUTED_NUM = NUMERIC_FEATURES
IMPUTED_CAT = (*STRING_FEATURES, "rev_text")


def _mode_sql(c):
    return (f"(SELECT v FROM (SELECT \"{c}\" AS v, count(*) AS n FROM dirty_split WHERE split = 'train' "
            f"AND \"{c}\" IS NOT NULL GROUP BY \"{c}\") ORDER BY n DESC, v LIMIT 1)")


@register(
    "feat_impute",
    _views(
        "SELECT cust_id, split, "
        + ", ".join(
            f"round(coalesce(\"{c}\", (SELECT quantile_cont(\"{c}\", 0.5) FROM dirty_split WHERE split = 'train')), 6)"
            f" AS \"{c}\"" for c in IMPUTED_NUM
        )
        + ", "
        + ", ".join(f"coalesce(\"{c}\", {_mode_sql(c)}) AS \"{c}\"" for c in IMPUTED_CAT)
        + " FROM dirty_split",
        "cust_clean", "cust_split",
        extra=DIRTY_SPLIT_SQL,
    ),
)
def feat_impute(spark, sf_dir):
    """Median / mode imputation fitted on train rows, applied to all rows."""
    d = dirty_split(spark, sf_dir).select("cust_id", "split", *IMPUTED_NUM, *IMPUTED_CAT)
    model = MixedImputer(exclude=["cust_id", "split"]).fit(d.where(F.col("split") == "train"))
    return round_doubles(model.transform(d))


# ---- M2 engineer ------------------------------------------------------------------

def _r(a, b):
    return f"\"{a}\" / (\"{b}\" + {EPS_SQL})"


ENGINEER_SQL_EXPR = {
    "call_completion_rate": _r("comp_vce_Mean", "plcd_vce_Mean"),
    "drop_rate": _r("drop_vce_Mean", "plcd_vce_Mean"),
    "block_rate": _r("blck_vce_Mean", "plcd_vce_Mean"),
    "short_call_ratio": _r("inonemin_Mean", "plcd_vce_Mean"),
    "dropped_or_blocked_rate": f"(drop_vce_Mean + blck_vce_Mean) / (plcd_vce_Mean + {EPS_SQL})",
    "unanswered_rate": _r("unan_vce_Mean", "plcd_vce_Mean"),
    "data_to_voice_ratio": _r("plcd_dat_Mean", "plcd_vce_Mean"),
    "voice_mou_per_call": _r("mou_cvce_Mean", "comp_vce_Mean"),
    "revenue_per_minute": _r("rev_Mean", "mou_Mean"),
    "overage_ratio": _r("ovrmou_Mean", "mou_Mean"),
    "custcare_rate": _r("custcare_Mean", "months"),
    "peak_usage_share": f"peak_vce_Mean / (peak_vce_Mean + opk_vce_Mean + {EPS_SQL})",
    "roam_to_total_ratio": _r("roam_Mean", "plcd_vce_Mean"),
    "revenue_per_subscriber": _r("rev_Mean", "actvsubs"),
    "customer_ltv": "totmrc_Mean * \"months\"",
    "mou_momentum": _r("avg3mou", "avg6mou"),
    "rev_momentum": _r("avg3rev", "avg6rev"),
    "lifetime_vs_recent_mou": _r("avg3mou", "avgmou"),
    "revenue_stability": _r("avg3rev", "avgrev"),
    "active_sub_ratio": _r("actvsubs", "uniqsubs"),
    "models_per_phone": _r("models", "phones"),
    "device_age_tier": "CASE WHEN eqpdays <= 180 THEN 0.0::DOUBLE WHEN eqpdays <= 365 THEN 1.0::DOUBLE "
                       "WHEN eqpdays <= 730 THEN 2.0::DOUBLE WHEN eqpdays IS NOT NULL THEN 3.0::DOUBLE END",
    "mou_declining_flag": "CAST(coalesce(change_mou < -5, false) AS INTEGER)",
    "revenue_declining_flag": "CAST(coalesce(change_rev < -5, false) AS INTEGER)",
}
assert tuple(ENGINEER_SQL_EXPR) == ENGINEERED
ROUNDABLE = tuple(c for c in ENGINEERED if not c.endswith("_flag"))

ENGINEERED_VIEW = (
    "engineered AS (SELECT *, "
    + ", ".join(f"{e} AS {n}" for n, e in ENGINEER_SQL_EXPR.items())
    + " FROM cust_split)"
)


@register(
    "feat_engineer",
    _views(
        "SELECT cust_id, "
        + ", ".join(f"round({n}, 6) AS {n}" if n in ROUNDABLE else n for n in ENGINEERED)
        + " FROM engineered",
        "cust_split",
        extra=ENGINEERED_VIEW,
    ),
)
def feat_engineer(spark, sf_dir):
    """The 24 engineered columns in one projection."""
    out = FeatureEngineer().transform(cust_feat(spark, sf_dir))
    return round_doubles(out.select("cust_id", *ENGINEERED))


# ---- M3 clipper ---------------------------------------------------------------------

CLIPPED = tuple(ratio_columns(ENGINEERED))


def _clip_sql(c):
    lo = f"(SELECT quantile_cont({c}, 0.01) FROM engineered WHERE split = 'train')"
    hi = f"(SELECT quantile_cont({c}, 0.99) FROM engineered WHERE split = 'train')"
    return (f"floor((CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END) * 100.0 + 0.5) / 100.0"
            f" AS {c}")


@register(
    "feat_clip",
    _views("SELECT cust_id, split, " + ", ".join(_clip_sql(c) for c in CLIPPED) + " FROM engineered",
           "cust_split", extra=ENGINEERED_VIEW),
)
def feat_clip(spark, sf_dir):
    """Ratio-named columns clipped at the train 1st / 99th percentiles."""
    eng = FeatureEngineer().transform(cust_split(spark, sf_dir)).select("cust_id", "split", *CLIPPED)
    model = PercentileClipper().fit(eng.where(F.col("split") == "train"))
    # epsilon ratios reach 1e11 (zero denominators): interpolated bounds agree to ~1e-4
    # across engines, so the comparison is at 2 decimals
    return round_doubles(model.transform(eng), 2, floor_mode=True)


# ---- M4 binary maps ------------------------------------------------------------------

def _binary_sql(col, mapping):
    whens = " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in mapping.items())
    return f"CAST(CASE {whens} ELSE 0 END AS INTEGER) AS {col}"


@register(
    "feat_binary_map",
    _views("SELECT cust_id, " + ", ".join(_binary_sql(c, m) for c, m in BINARY_MAPS.items()) + " FROM cust_clean",
           "cust_clean"),
)
def feat_binary_map(spark, sf_dir):
    d = cust_clean(spark, sf_dir).select("cust_id", *BINARY_MAPS)
    return BinaryMapEncoder().transform(d)


# ---- M5 target encoding ---------------------------------------------------------------

TE_BASE = """
tr AS (SELECT * FROM cust_split WHERE split = 'train'),
fm AS (SELECT fold, count(*) AS n, sum(churn) AS y FROM tr GROUP BY fold),
tot AS (SELECT sum(n) AS nn, sum(y) AS yy FROM fm),
g AS (SELECT fold, (yy - y) / (nn - n) AS gm FROM fm, tot UNION ALL SELECT -1, yy / nn FROM tot),
v AS ({unpivot}),
per AS (SELECT col, value, fold, count(*) AS n_f, sum(churn) AS y_f FROM v GROUP BY col, value, fold),
t AS (SELECT col, value, sum(n_f) AS n_t, sum(y_f) AS y_t FROM per GROUP BY col, value),
map AS (
  SELECT per.col, per.value, per.fold, (t.y_t - per.y_f + 20 * g.gm) / (t.n_t - per.n_f + 20) AS enc
  FROM per JOIN t ON per.col = t.col AND per.value = t.value JOIN g ON per.fold = g.fold
  UNION ALL
  SELECT col, value, -1, (y_t + 20 * (SELECT gm FROM g WHERE fold = -1)) / (n_t + 20) FROM t
)""".replace(
    "{unpivot}",
    " UNION ALL ".join(f"SELECT fold, churn, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM tr"
                       for c in HIGH_CARD_CATS),
)


@register(
    "feat_target_encode_full",
    _views("SELECT col AS \"column\", value, round(enc, 6) AS enc FROM map WHERE fold = -1", "cust_split",
           extra=TE_BASE),
)
def feat_target_encode_full(spark, sf_dir):
    """Full-train smoothed map (k = 20) per high-cardinality column."""
    tr = cust_split(spark, sf_dir).where(F.col("split") == "train")
    model = TargetEncoderOOF().fit(tr)
    return round_doubles(model.table.where(F.col("fold") == -1).select("column", "value", "enc"))


@register(
    "feat_target_encode_oof",
    _views(
        """
rows_ AS (
  SELECT s.cust_id, s.split, CASE WHEN s.split = 'train' THEN s.fold ELSE -1 END AS f, u.col, u.value
  FROM cust_split s, LATERAL (VALUES {vals}) AS u(col, value)
)
SELECT r.cust_id, r.split, r.col AS "column", round(coalesce(m.enc, g.gm), 6) AS enc
FROM rows_ r LEFT JOIN map m ON m.col = r.col AND m.value = r.value AND m.fold = r.f
JOIN g ON g.fold = r.f
""".replace("{vals}", ", ".join(f"('{c}', CAST(s.{c} AS VARCHAR))" for c in HIGH_CARD_CATS)),
        "cust_split",
        extra=TE_BASE,
    ).replace("\nrows_ AS", ",\nrows_ AS", 1),
)
def feat_target_encode_oof(spark, sf_dir):
    """ONE transform: out-of-fold encodings on train rows, full-train map on test rows."""
    s = cust_split(spark, sf_dir)
    model = TargetEncoderOOF().fit(s.where(F.col("split") == "train"))
    enc = model.transform(s.withColumn("fold", F.when(F.col("split") == "train", F.col("fold"))))
    cols = [f"{c}_enc" for c in HIGH_CARD_CATS]
    long = enc.select("cust_id", "split", *cols).unpivot(["cust_id", "split"], cols, "column", "enc")
    return round_doubles(long.select("cust_id", "split", F.regexp_replace("column", "_enc$", "").alias("column"),
                                     "enc"))


# ---- M6 ordinal encoding ---------------------------------------------------------------

ORDINAL_COLS = (*STRING_FEATURES, "rev_text")


@register(
    "feat_ordinal_encode",
    _views(
        """
codes AS (
  SELECT col, value, CAST(dense_rank() OVER (PARTITION BY col ORDER BY value) - 1 AS DOUBLE) AS code
  FROM (SELECT DISTINCT col, value FROM ({unpivot}) WHERE value IS NOT NULL)
)
SELECT cust_id, split, {cols} FROM dirty_split
""".replace(
            "{unpivot}",
            " UNION ALL ".join(f"SELECT '{c}' AS col, \"{c}\" AS value FROM dirty_split WHERE split = 'train'"
                               for c in ORDINAL_COLS),
        ).replace(
            "{cols}",
            ", ".join(
                f"coalesce((SELECT code FROM codes WHERE col = '{c}' AND value = dirty_split.\"{c}\"), -1.0) AS \"{c}\""
                for c in ORDINAL_COLS
            ),
        ),
        "cust_clean", "cust_split",
        extra=DIRTY_SPLIT_SQL,
    ).replace("\ncodes AS", ",\ncodes AS", 1),
)
def feat_ordinal_encode(spark, sf_dir):
    """Sorted-category codes fitted on train; unseen (and NULL) values -> -1."""
    d = dirty_split(spark, sf_dir).select("cust_id", "split", *ORDINAL_COLS)
    model = OrdinalCategoricalEncoder(exclude=["cust_id", "split"]).fit(d.where(F.col("split") == "train"))
    return model.transform(d)


# ---- M11 standard scaler ---------------------------------------------------------------

SCALED = NUMERIC_FEATURES


@register(
    "feat_standardize",
    _views(
        "WITH st AS (SELECT " + ", ".join(
            f"avg(\"{c}\") AS m{k}, CASE WHEN stddev_pop(\"{c}\") > 0 THEN stddev_pop(\"{c}\") ELSE 1 END AS s{k}"
            for k, c in enumerate(SCALED)) + " FROM cust_split WHERE split = 'train') SELECT cust_id, split, "
        + ", ".join(f"round((\"{c}\" - m{k}) / s{k}, 6) AS \"{c}\"" for k, c in enumerate(SCALED))
        + " FROM cust_split, st",
        "cust_split",
    ),
)
def feat_standardize(spark, sf_dir):
    """Train mean / population std, applied to both splits."""
    s = cust_split(spark, sf_dir).select("cust_id", "split", *SCALED)
    model = StandardScaler(inputCols=SCALED).fit(s.where(F.col("split") == "train"))
    return round_doubles(model.transform(s))


# ---- M7 / M8 VIF -----------------------------------------------------------------

GRAM_COLS = (*NUMERIC_FEATURES, *ENGINEERED)  # every numeric column; none holds a null

GRAM_SQL = """
long AS (
  SELECT cust_id, split, k, v FROM (
    SELECT cust_id, split, unnest(range({d})) AS k, unnest([{values}]) AS v FROM engineered)
),
sums AS (
  SELECT x.k AS i, y.k AS j, sum(x.v * y.v) AS g FROM long x JOIN long y ON x.cust_id = y.cust_id
  WHERE {where} GROUP BY x.k, y.k
),
gram AS (
  SELECT s.i, s.j, CASE WHEN a.g > 0 AND b.g > 0 THEN s.g / sqrt(a.g) / sqrt(b.g) ELSE 0 END AS g
  FROM sums s JOIN sums a ON a.i = s.i AND a.j = s.i JOIN sums b ON b.i = s.j AND b.j = s.j
)"""


def _gram_views(body, where="true"):
    values = ", ".join(f"CAST(\"{c}\" AS DOUBLE)" for c in GRAM_COLS)
    gram = GRAM_SQL.replace("{d}", str(len(GRAM_COLS))).replace("{values}", values).replace("{where}", where)
    names = "[" + ", ".join(f"'{c}'" for c in GRAM_COLS) + "]"
    return _views(body.replace("{names}", names), "cust_split", extra=ENGINEERED_VIEW + "," + gram)


@register("feat_vif_gram", _gram_views("SELECT ({names})[i + 1] AS a, ({names})[j + 1] AS b, round(g, 6) AS g FROM gram WHERE i <= j"))
def feat_vif_gram(spark, sf_dir):
    """X'X of all numeric columns, raw and engineered, scaled to a unit diagonal (the only distributed step of VIF)."""
    eng = FeatureEngineer().transform(cust_feat(spark, sf_dir))
    long = gram_long(eng, GRAM_COLS)
    own = long.where("a = b")
    of_a, of_b = (own.select(F.col("a").alias(c), F.col("g").alias(f"g_{c}")) for c in ("a", "b"))
    scaled = F.when((F.col("g_a") > 0) & (F.col("g_b") > 0), F.col("g") / F.sqrt("g_a") / F.sqrt("g_b")).otherwise(0.0)
    return round_doubles(long.join(of_a, "a").join(of_b, "b").select("a", "b", scaled.alias("g")))


def _engineered_numeric(spark, sf_dir):
    s = cust_split(spark, sf_dir)
    return FeatureEngineer().transform(s)


def _sweep_sql(column, sign):
    """The matrix (a list of d * d numbers) swept on a column."""
    d, k = len(GRAM_COLS), column
    i, j = f"(x // {d})", f"(x % {d})"
    cell = f"a[x + 1] - a[{i} * {d} + {k} + 1] * a[{k} * {d} + {j} + 1] / a[{k} * {d} + {k} + 1]"
    return (f"[CASE WHEN {i} = {k} AND {j} = {k} THEN -1 / a[x + 1] WHEN {i} = {k} OR {j} = {k} "
            f"THEN {sign} * a[x + 1] / a[{k} * {d} + {k} + 1] ELSE {cell} END FOR x IN range({d * d})]")


def _vifs_sql():
    d = len(GRAM_COLS)
    return (f"[CASE WHEN st[k + 1] = 3 THEN -1 WHEN st[k + 1] = 2 OR list_bool_or([st[e + 1] = 2 AND abs(a[k * {d} + e + 1]) > 1e-7 "
            f"FOR e IN range({d})]) THEN 'inf'::DOUBLE ELSE -a[k * {d} + k + 1] END FOR k IN range({d})]")


def _vif_sql(threshold):
    """Elimination as a recursive query over one row: matrix a, st per column (0 open, 1 swept, 2 dependent, 3 dropped).

    A step sweeps the next column, or a dependent column that has come free, or drops the worst column."""
    d = len(GRAM_COLS)
    residual = f"a[k * {d} + k + 1] > 1e-9"
    return f"""
start AS (SELECT list(g ORDER BY i, j) AS a FROM gram),
steps AS (
  WITH RECURSIVE r AS (
    SELECT 0 AS step, a, [0 FOR k IN range({d})] AS st, -1 AS dropped, 0.0::DOUBLE AS v, false AS done FROM start
    UNION ALL
    SELECT step + 1, CASE kind WHEN 'in' THEN {_sweep_sql('c', 1)} WHEN 'out' THEN {_sweep_sql('c', -1)} ELSE a END,
      [CASE WHEN k = c THEN to_state ELSE st[k + 1] END FOR k IN range({d})],
      CASE WHEN to_state = 3 THEN c ELSE -1 END, CASE WHEN to_state = 3 THEN vifs[c + 1] ELSE 0 END, c < 0
    FROM (
      SELECT *, CASE WHEN step < {d} THEN step WHEN free >= 0 THEN free WHEN left_ >= 2 AND vifs[worst + 1] > {threshold} THEN worst ELSE -1 END AS c,
        CASE WHEN step < {d} THEN CASE WHEN a[step * {d} + step + 1] > 1e-9 THEN 'in' ELSE '' END WHEN free >= 0 THEN 'in'
          WHEN left_ >= 2 AND vifs[worst + 1] > {threshold} AND st[worst + 1] = 1 THEN 'out' ELSE '' END AS kind,
        CASE WHEN step < {d} THEN CASE WHEN a[step * {d} + step + 1] > 1e-9 THEN 1 ELSE 2 END WHEN free >= 0 THEN 1 ELSE 3 END AS to_state
      FROM (
        SELECT *, coalesce(list_min([k FOR k IN range({d}) IF st[k + 1] = 2 AND {residual}]), -1) AS free,
          len([k FOR k IN range({d}) IF st[k + 1] <> 3]) AS left_,
          list_sort([{{'v': -vifs[k + 1], 'name': ({{names}})[k + 1], 'k': k}} FOR k IN range({d})])[1].k AS worst
        FROM (SELECT *, {_vifs_sql()} AS vifs FROM r WHERE NOT done AND step < 400)
      )
    )
  ) SELECT * FROM r
)"""


def _vif_views(threshold, body, where="true"):
    return _gram_views("WITH " + _vif_sql(threshold).lstrip() + body, where)


@register("feat_vif", _vif_views("'inf'::DOUBLE", """
SELECT ({names})[k + 1] AS feature, round(vifs[k + 1], 3) AS vif FROM (
  SELECT vifs, unnest(range(len(vifs))) AS k FROM (
    SELECT {vif} AS vifs FROM steps WHERE step = {d}))
""".replace("{d}", str(len(GRAM_COLS))).replace("{vif}", _vifs_sql())))
def feat_vif(spark, sf_dir):
    """VIF of every null-free numeric feature (uncentred R^2), highest first."""
    eng = _engineered_numeric(spark, sf_dir)
    cols = numeric_null_free(eng, exclude=ID_COLS)
    return round_doubles(vif_table(spark, eng, cols), 3)


@register("feat_vif_drop", _vif_views("10", """,
gone AS (SELECT dropped AS k, v, row_number() OVER (ORDER BY step) - 1 AS n FROM steps WHERE dropped >= 0)
SELECT ({names})[c.k + 1] AS feature, CASE WHEN g.k IS NULL THEN 'kept' ELSE 'dropped' END AS decision,
  round(g.v, 3) AS vif, CAST(g.n AS INTEGER) AS step
FROM (SELECT unnest(range({d})) AS k) c LEFT JOIN gone g ON g.k = c.k
""".replace("{d}", str(len(GRAM_COLS))), "x.split = 'train'"))
def feat_vif_drop(spark, sf_dir):
    """Columns the iterative VIF dropper removes (threshold 10) and keeps."""
    eng = _engineered_numeric(spark, sf_dir)
    model = VIFDropper(threshold=10.0, exclude=ID_COLS).fit(eng.where(F.col("split") == "train"))
    st = model._get_state()
    rows = [(c, "dropped", float(v), i) for i, (c, v) in enumerate(st["dropped"])]
    rows += [(c, "kept", None, None) for c in st["kept"]]
    return round_doubles(spark.createDataFrame(rows, "feature string, decision string, vif double, step int"), 3)


# ---- M12 pipeline -------------------------------------------------------------------

def _pipeline_output(spark, sf_dir, which):
    d = dirty_split(spark, sf_dir)
    d = d.withColumn("fold", F.when(F.col("split") == "train", F.col("fold"))).cache()  # reused by every fit
    model = build_preprocessing_pipeline().fit(d.where(F.col("split") == "train"))
    return round_doubles(model.transform(d.where(F.col("split") == which)))


@register("feat_pipeline_train")
def feat_pipeline_train(spark, sf_dir):
    """Preprocessed train rows (out-of-fold target encodings)."""
    return _pipeline_output(spark, sf_dir, "train")


@register("feat_pipeline_test")
def feat_pipeline_test(spark, sf_dir):
    """Preprocessed test rows (same fitted pipeline, full-train encodings)."""
    return _pipeline_output(spark, sf_dir, "test")
