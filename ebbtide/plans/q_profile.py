"""Profiling and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.functions.constants import BOX_FEATURES, KEY_NUMERIC, TTEST_FEATURES
from ebbtide.functions.scalar import log1p_safe
from ebbtide.operators import profile as prof
from ebbtide.operators.stats import chi2_independence, welch_t
from ebbtide.plans.common import round_doubles
from ebbtide.plans.fixture_sql import with_views
from ebbtide.plans.fixtures import MODEL_SEEDS, NUMERIC_FEATURES, cust_clean, cust_dirty, cust_feat, scored
from ebbtide.plans.registry import register

CLEAN_COLS = ("cust_id", "churn", *NUMERIC_FEATURES,
              "prizm_social_one", "area", "dwlltype", "crclscod", "marital", "refurb_new", "hnd_webcap",
              "asl_flag", "creditcd", "ownrent", "dualband", "ethnic", "infobase", "rev_text")
CATEGORICALS = ("prizm_social_one", "area", "dwlltype", "crclscod", "marital", "refurb_new", "hnd_webcap",
                "asl_flag", "creditcd", "ownrent", "dualband", "ethnic", "infobase", "rev_text")
FIRST10_CATS = CATEGORICALS[:10]
BOX_PRESENT = tuple(c for c in BOX_FEATURES if c in NUMERIC_FEATURES)
KEY_PRESENT = tuple(c for c in KEY_NUMERIC if c in NUMERIC_FEATURES)
TTEST_PRESENT = tuple(c for c in TTEST_FEATURES if c in NUMERIC_FEATURES)


def _values_sql(cols, id_cols=("churn",), cast="DOUBLE", var="feature", view="cust_clean"):
    ids = ", ".join(id_cols)
    sep = ", " if ids else ""
    return " UNION ALL ".join(
        f"SELECT {ids}{sep}'{c}' AS {var}, CAST(\"{c}\" AS {cast}) AS value FROM {view}" for c in cols
    )


# ---- A1 duplicates -----------------------------------------------------------

@register(
    "agg_duplicate_rows",
    with_views(
        """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cust_dirty)) AS BIGINT) AS duplicate_rows,
       CAST(count(*) AS BIGINT) AS "rows"
FROM cust_dirty
""",
        "cust_dirty",
    ),
)
def agg_duplicate_rows(spark, sf_dir):
    """Counted on the raw table, before tokens become NULL (reference order)."""
    return prof.duplicate_rows(cust_dirty(spark, sf_dir))


# ---- A2 missing profile --------------------------------------------------------

@register(
    "agg_missing_profile",
    with_views(
        "SELECT \"column\", CAST(nulls AS BIGINT) AS nulls, round(nulls / rows_, 6) AS null_rate FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count(\"{c}\") AS nulls, count(*) AS rows_ FROM cust_clean"
            for c in CLEAN_COLS
        )
        + ")",
        "cust_clean",
    ),
)
def agg_missing_profile(spark, sf_dir):
    return round_doubles(prof.missing_profile(cust_clean(spark, sf_dir), CLEAN_COLS))


@register(
    "agg_missing_heatmap",
    with_views(
        "SELECT row_bucket, \"column\", round(nulls / rows_, 6) AS null_rate FROM ("
        + " UNION ALL ".join(
            f"SELECT CAST(CAST('0x' || substr(md5(CAST(cust_id AS VARCHAR)), 1, 8) AS BIGINT) % 20 AS INTEGER) "
            f"AS row_bucket, '{c}' AS \"column\", count(*) - count(\"{c}\") AS nulls, count(*) AS rows_ "
            f"FROM cust_clean GROUP BY 1"
            for c in CLEAN_COLS
        )
        + ")",
        "cust_clean",
    ),
)
def agg_missing_heatmap(spark, sf_dir):
    """The missing-value heat map at scale: null rate per (row bucket, column)."""
    return round_doubles(prof.missing_by_row_bucket(cust_clean(spark, sf_dir), "cust_id", CLEAN_COLS, 20))


# ---- A3 class share, A4 class weight ------------------------------------------------

@register(
    "agg_class_share",
    with_views(
        "SELECT churn, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share "
        "FROM cust_feat WHERE churn IS NOT NULL GROUP BY churn",
        "cust_feat",
    ),
)
def agg_class_share(spark, sf_dir):
    return round_doubles(prof.class_share(cust_feat(spark, sf_dir), "churn"))


@register(
    "agg_class_weight",
    with_views(
        """
SELECT count(*) AS "rows", CAST(sum(churn) AS BIGINT) AS positives, round(avg(churn), 6) AS target_mean,
  round(1 - avg(churn), 6) AS complement, round((1 - avg(churn)) / avg(churn), 6) AS scale_pos_weight
FROM cust_feat
""",
        "cust_feat",
    ),
)
def agg_class_weight(spark, sf_dir):
    """Weight on the FULL table before the split (reference scope)."""
    return round_doubles(prof.class_weight(cust_feat(spark, sf_dir), "churn"))


# ---- A6 crosstab, A7 category by label -------------------------------------------

@register(
    "agg_crosstab",
    with_views(
        "SELECT \"column\", value, churn, count(*) AS n FROM ("
        + _values_sql(FIRST10_CATS, cast="VARCHAR", var='"column"')
        + ") WHERE value IS NOT NULL GROUP BY \"column\", value, churn",
        "cust_clean",
    ),
)
def agg_crosstab(spark, sf_dir):
    """Contingency tables of the first ten categorical columns against the label."""
    return prof.crosstab(cust_clean(spark, sf_dir), FIRST10_CATS, "churn")


@register(
    "agg_category_by_label",
    with_views(
        """
SELECT crclscod, churn, CASE churn WHEN 0 THEN 'No Churn' ELSE 'Churn' END AS churn_label, count(*) AS n
FROM cust_clean WHERE crclscod IS NOT NULL GROUP BY crclscod, churn
""",
        "cust_clean",
    ),
)
def agg_category_by_label(spark, sf_dir):
    """``groupby([col, 'churn']).size()`` with NULL keys dropped (pandas default)."""
    d = cust_clean(spark, sf_dir)
    return (
        d.where(F.col("crclscod").isNotNull())
        .groupBy("crclscod", "churn")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("crclscod", "churn", F.when(F.col("churn") == 0, "No Churn").otherwise("Churn").alias("churn_label"),
                "n")
    )


# ---- A8 box statistics ---------------------------------------------------------

BOX_SQL = with_views(
    f"""
WITH v AS ({_values_sql(BOX_PRESENT)}),
q AS (
  SELECT feature, churn, count(*) AS n, avg(value) AS mean,
    quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM v WHERE value IS NOT NULL GROUP BY feature, churn
),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.feature, f.churn, f.n, round(f.mean, 6) AS mean, round(f.q1, 6) AS q1, round(f.median, 6) AS median,
  round(f.q3, 6) AS q3,
  round(min(CASE WHEN v.value BETWEEN f.lo AND f.hi THEN v.value END), 6) AS whisker_lo,
  round(max(CASE WHEN v.value BETWEEN f.lo AND f.hi THEN v.value END), 6) AS whisker_hi,
  CAST(sum(CASE WHEN v.value BETWEEN f.lo AND f.hi THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM f JOIN v ON f.feature = v.feature AND f.churn = v.churn AND v.value IS NOT NULL
GROUP BY f.feature, f.churn, f.n, f.mean, f.q1, f.median, f.q3
""",
    "cust_clean",
)


@register("agg_box_stats", BOX_SQL)
def agg_box_stats(spark, sf_dir):
    return round_doubles(prof.box_stats(cust_clean(spark, sf_dir), BOX_PRESENT, "churn"))


# ---- A11 quantiles ----------------------------------------------------------------

QUANTILE_COLS = NUMERIC_FEATURES


@register(
    "agg_quantiles",
    with_views(
        "WITH v AS (" + _values_sql(QUANTILE_COLS, id_cols=()) + ") "
        + " UNION ALL ".join(
            f"SELECT feature, {q}::DOUBLE AS q, round(quantile_cont(value, {q}), 6) AS value "
            "FROM v WHERE value IS NOT NULL GROUP BY feature"
            for q in (0.01, 0.25, 0.5, 0.75, 0.99)
        ),
        "cust_clean",
    ),
)
def agg_quantiles(spark, sf_dir):
    """Linear-interpolated quantiles (pandas ``quantile``) for several columns in one job."""
    return round_doubles(prof.quantiles(cust_clean(spark, sf_dir), QUANTILE_COLS, (0.01, 0.25, 0.5, 0.75, 0.99)))


# ---- A13 correlation matrix -------------------------------------------------------

def _corr_sql(cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, corr(\"{a}\", \"{b}\") AS c FROM cust_clean")
    diag = [
        f"SELECT '{c}' AS a, '{c}' AS b, CASE WHEN stddev_samp(\"{c}\") > 0 THEN 1.0 END AS c FROM cust_clean"
        for c in cols
    ]
    return f"""
WITH u AS ({' UNION ALL '.join(parts)})
SELECT a, b, round(c, 6) AS corr FROM u
UNION ALL SELECT b, a, round(c, 6) FROM u
UNION ALL SELECT a, b, c FROM ({' UNION ALL '.join(diag)})
"""


@register("agg_correlation_matrix", with_views(_corr_sql(KEY_PRESENT), "cust_clean"))
def agg_correlation_matrix(spark, sf_dir):
    """Pairwise-complete Pearson matrix of the key numeric columns (one aggregate)."""
    return round_doubles(prof.correlation_matrix(cust_clean(spark, sf_dir), KEY_PRESENT))


CORR_LONG_SQL = """
numbered AS (SELECT *, row_number() OVER () AS rid FROM cust_clean),
long AS (SELECT rid, unnest([{names}]) AS feature, unnest([{values}]) AS v FROM numbered),
top AS (SELECT feature FROM long GROUP BY feature HAVING var_samp(v) IS NOT NULL ORDER BY var_samp(v) DESC, feature LIMIT {limit})
SELECT a.feature AS a, b.feature AS b, round(CASE WHEN a.feature = b.feature THEN 1 ELSE corr(a.v, b.v) END, 6) AS corr
FROM long a JOIN long b ON a.rid = b.rid AND a.v IS NOT NULL AND b.v IS NOT NULL
WHERE a.feature IN (FROM top) AND b.feature IN (FROM top) GROUP BY a.feature, b.feature
""".replace("{names}", ", ".join(f"'{c}'" for c in NUMERIC_FEATURES)).replace(
    "{values}", ", ".join(f'CAST("{c}" AS DOUBLE)' for c in NUMERIC_FEATURES))


def _corr_long(limit):
    return with_views("WITH " + CORR_LONG_SQL.replace("{limit}", str(limit)).lstrip(), "cust_clean")


@register("agg_correlation_all", _corr_long(len(NUMERIC_FEATURES)))
def agg_correlation_all(spark, sf_dir):
    """Pairwise-complete Pearson matrix of every numeric column, by products of values and presence."""
    return round_doubles(prof.correlation_from_products(cust_clean(spark, sf_dir), NUMERIC_FEATURES))


@register("agg_correlation_top_variance", _corr_long(20))
def agg_correlation_top_variance(spark, sf_dir):
    """The dashboard's heat map: correlations of the 20 numeric columns of largest variance."""
    d = cust_clean(spark, sf_dir)
    top = [r["feature"] for r in prof.variance_topk(d, NUMERIC_FEATURES, 20).collect()]  # 20 names
    return round_doubles(prof.correlation_from_products(d, top))


# ---- T3 top variance ------------------------------------------------------------

@register(
    "topk_variance_columns",
    with_views(
        "SELECT feature, round(variance, 2) AS variance FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp(\"{c}\") AS variance FROM cust_feat"
                             for c in NUMERIC_FEATURES)
        + ") WHERE variance IS NOT NULL ORDER BY variance DESC, feature LIMIT 20",
        "cust_feat",
    ),
)
def topk_variance_columns(spark, sf_dir):
    """The 20 numeric columns of largest variance (feeds the correlation heat map)."""
    # variances reach 1e9: compare at 2 decimals (summation order differs across engines)
    return round_doubles(prof.variance_topk(cust_feat(spark, sf_dir), NUMERIC_FEATURES, 20), 2)


# ---- A19 histogram by label ------------------------------------------------------

HIST_SQL = """
v2 AS (SELECT {by}, churn, x FROM ({values}) WHERE x IS NOT NULL AND churn IS NOT NULL),
r AS (SELECT {by}, min(x) AS lo, max(x) AS hi FROM v2 GROUP BY {by}),
b AS (
  SELECT v2.{by}, churn, CASE WHEN hi = lo THEN 1
                     ELSE CAST(least(floor((x - lo) / ((hi - lo) / {n})) + 1, {n}) AS INTEGER) END AS bin, lo, hi
  FROM v2 JOIN r ON v2.{by} = r.{by}
)
SELECT {by}, churn, bin, count(*) AS n, round(min(lo) + (bin - 1) * (min(hi) - min(lo)) / {n}, 6) AS bin_lo
FROM b GROUP BY {by}, churn, bin
"""


def _hist_sql(by, values, n):
    return "WITH " + HIST_SQL.replace("{by}", by).replace("{values}", values).replace("{n}", str(n)).lstrip()


@register(
    "agg_hist_by_label",
    with_views(
        _hist_sql("feature", " UNION ALL ".join(
            f"SELECT '{c}' AS feature, churn, CASE WHEN \"{c}\" > -1 THEN ln(1 + \"{c}\") END AS x FROM cust_clean"
            for c in KEY_PRESENT), 20),
        "cust_clean",
    ),
)
def agg_hist_by_label(spark, sf_dir):
    """20 equal-width bins of log1p of every key numeric column, shared by both labels (two scans for all columns)."""
    d = cust_clean(spark, sf_dir)
    return round_doubles(prof.hists_by_label(d, {c: log1p_safe(c) for c in KEY_PRESENT}, "churn", 20))


@register(
    "agg_score_hist_by_label",
    with_views(_hist_sql("model", "SELECT model, churn, p AS x FROM scored", 40), "scored"),
)
def agg_score_hist_by_label(spark, sf_dir):
    """Probability histograms of both models, 40 bins by label (dashboard overview chart data)."""
    models = sorted(MODEL_SEEDS)
    s = scored(spark, sf_dir)
    of = {m: F.when(F.col("model") == m, F.col("p")) for m in models}
    return round_doubles(prof.hists_by_label(s, of, "churn", 40).withColumnRenamed("feature", "model"))


# ---- W1 density + moving average ----------------------------------------------------

@register(
    "win_density_smooth",
    with_views(
        """
WITH v AS (SELECT churn, rev_Mean AS x FROM cust_clean WHERE rev_Mean IS NOT NULL AND churn IS NOT NULL),
s AS (SELECT churn, quantile_cont(x, 0.97) AS cap, min(x) AS xmin, count(*) AS n FROM v GROUP BY churn),
s2 AS (SELECT churn, cap, n, least(xmin, cap) AS lo, cap AS hi FROM s),
c AS (
  SELECT v.churn, CASE WHEN hi = lo THEN 1
    ELSE CAST(least(floor((least(x, cap) - lo) / ((hi - lo) / 80)) + 1, 80) AS INTEGER) END AS bin, count(*) AS c
  FROM v JOIN s2 ON v.churn = s2.churn GROUP BY 1, 2
),
spine AS (SELECT s2.churn, g.bin, lo, hi, n FROM s2, range(1, 81) g(bin)),
d AS (
  SELECT spine.churn, spine.bin, lo + (spine.bin - 0.5) * (hi - lo) / 80 AS center,
    CASE WHEN hi = lo THEN NULL ELSE coalesce(c.c, 0) / (n * (hi - lo) / 80) END AS density
  FROM spine LEFT JOIN c ON spine.churn = c.churn AND spine.bin = c.bin
)
SELECT churn, CAST(bin AS INTEGER) AS bin, round(center, 6) AS center, round(density, 6) AS density,
  round(sum(density) OVER (PARTITION BY churn ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 6)
    AS smooth
FROM d
""",
        "cust_clean",
    ),
)
def win_density_smooth(spark, sf_dir):
    return round_doubles(prof.density_smooth(cust_clean(spark, sf_dir), "rev_Mean", "churn"))


# ---- V1 Welch t, V2 chi-square ---------------------------------------------------

@register(
    "stat_welch_t",
    with_views(
        f"""
WITH v AS ({_values_sql(TTEST_PRESENT)}),
m AS (
  SELECT feature,
    count(*) FILTER (WHERE churn = 0) AS n0, count(*) FILTER (WHERE churn = 1) AS n1,
    avg(value) FILTER (WHERE churn = 0) AS m0, avg(value) FILTER (WHERE churn = 1) AS m1,
    var_samp(value) FILTER (WHERE churn = 0) AS v0, var_samp(value) FILTER (WHERE churn = 1) AS v1
  FROM v WHERE value IS NOT NULL GROUP BY feature
)
SELECT feature, n0, n1, round(m0, 6) AS mean0, round(m1, 6) AS mean1,
  round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6) AS t,
  round(pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)), 6) AS dof
FROM m
""",
        "cust_clean",
    ),
)
def stat_welch_t(spark, sf_dir):
    """Welch t and degrees of freedom for every tested feature in one job."""
    r = welch_t(cust_clean(spark, sf_dir), TTEST_PRESENT, "churn", with_p=False)
    return round_doubles(r.select("feature", "n0", "n1", "mean0", "mean1", "t", "dof"))


@register(
    "stat_chi2",
    with_views(
        f"""
WITH v AS ({_values_sql(FIRST10_CATS, cast="VARCHAR", var='"column"')}),
cells AS (
  SELECT "column", value, count(*) FILTER (WHERE churn = 0) AS o0, count(*) FILTER (WHERE churn = 1) AS o1
  FROM v WHERE value IS NOT NULL AND churn IS NOT NULL GROUP BY "column", value
),
m AS (
  SELECT *, o0 + o1 AS row_n, sum(o0) OVER (PARTITION BY "column") AS c0, sum(o1) OVER (PARTITION BY "column") AS c1,
    count(*) OVER (PARTITION BY "column") AS r
  FROM cells
),
e AS (
  SELECT "column", (r - 1) * ((CASE WHEN c0 > 0 THEN 1 ELSE 0 END) + (CASE WHEN c1 > 0 THEN 1 ELSE 0 END) - 1) AS dof,
    o0, o1, row_n * c0 / (c0 + c1) AS e0, row_n * c1 / (c0 + c1) AS e1
  FROM m
),
t AS (
  SELECT "column", dof,
    CASE WHEN e0 > 0 THEN pow(CASE WHEN dof = 1 THEN abs(o0 - e0) - least(0.5, abs(o0 - e0)) ELSE abs(o0 - e0) END, 2)
         / e0 ELSE 0 END
    + CASE WHEN e1 > 0 THEN pow(CASE WHEN dof = 1 THEN abs(o1 - e1) - least(0.5, abs(o1 - e1)) ELSE abs(o1 - e1) END, 2)
         / e1 ELSE 0 END AS part
  FROM e
)
SELECT "column", round(sum(part), 6) AS chi2, CAST(min(dof) AS BIGINT) AS dof FROM t GROUP BY "column"
""",
        "cust_clean",
    ),
)
def stat_chi2(spark, sf_dir):
    """Chi-square independence (Yates when dof = 1) for the first ten categoricals."""
    r = chi2_independence(cust_clean(spark, sf_dir), FIRST10_CATS, "churn", with_p=False)
    return round_doubles(r.select("column", "chi2", F.col("dof").cast("long").alias("dof")))


@register("stat_tests_pvalues")
def stat_tests_pvalues(spark, sf_dir):
    """p-values of both tests (rows-only check; the tail functions are unit-tested)."""
    d = cust_clean(spark, sf_dir)
    t = welch_t(d, TTEST_PRESENT, "churn").select(
        F.lit("welch_t").alias("test"), F.col("feature").alias("column"), F.col("t").alias("statistic"), "p_value"
    )
    c = chi2_independence(d, FIRST10_CATS, "churn").select(
        F.lit("chi2").alias("test"), "column", F.col("chi2").alias("statistic"), "p_value"
    )
    return round_doubles(t.unionByName(c))
