"""URL filters (9): rules first, then a ratio of character language models.

Rules (host, path) decide the URLs they fit: the host itself and its subdomains,
with a path that starts with the rule's; the longest rule wins.  All other URLs
are judged by two variable-order Markov models over characters, one counted
from the URLs the rules accept and one from those they block.  A character's
probability interpolates contexts of 0 to ``ORDER`` characters by Witten-Bell
smoothing, longer contexts where they have been seen.  The log-likelihood
difference, divided by the number of characters, is compared with a threshold
calibrated on the rule-decided URLs (largest Youden index over score bins).

Spark side, all Spark SQL functions.  Equal windows of characters are counted
before they are shuffled, models live in tables keyed by context (a context has
at most ``ALPHABET`` successors), and every distinct window is scored once.
URLs meet their windows' scores in an equality join; windows that make up more
than 1 / ``HOT`` of all characters (so at most ``HOT`` of them, such as those of
``https``) are broadcast instead, which leaves no hot key to the shuffle.
Scores are whole micro-units, so sums do not depend on the order of arrival.

Defined results: a null URL or one without ``://`` has empty host and path and
is judged as an empty string; if either model has no URL to learn from, every
undecided URL is allowed; repeated rows are judged one by one, repeated ids get
each their own verdict; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import written

ORDER = 3
#: Printable ASCII, one sign for anything else, and the end sign.
ALPHABET = 96
HOT = 1_000
SCALE = 1_000_000
#: Score bins for the calibration: this many a unit of log likelihood, within +-``BIN_LIMIT`` units.
BINS_A_UNIT, BIN_LIMIT = 200, 5

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_START, _END = "\x02", "\x03"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, everything after ``://``) of a URL."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.greatest(F.length(url), F.lit(1)))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), rest


def _rule(host: Column, path: Column) -> Column:
    """The longest fitting (length, rule, verdict), or null."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in RULES
    ]
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))


def _padded(rest: Column) -> Column:
    """Array of a URL's characters between start and end signs."""
    chars = F.split(F.regexp_replace(rest, r"[^!-~]", " "), "")
    return F.concat(F.array(*[F.lit(_START)] * ORDER), F.filter(chars, lambda c: c != ""), F.array(F.lit(_END)))


def _model(counts: DataFrame, order: int) -> DataFrame:
    """Context -> successors with their counts for both classes (``a`` accepted, ``r`` rejected), and totals."""
    gram = counts.select(
        F.substring("w", ORDER + 1 - order, order).alias("context"), F.substring("w", ORDER + 1, 1).alias("c"), "a", "r")
    return (
        gram.groupBy("context", "c").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        .groupBy(F.col("context").alias(f"context{order}"))
        .agg(
            F.collect_list(F.struct("c", "a", "r")).alias(f"next{order}"),  # at most ALPHABET entries
            F.sum("a").alias(f"a{order}"), F.sum("r").alias(f"r{order}"),
            F.sum((F.col("a") > 0).cast("long")).alias(f"ka{order}"),
            F.sum((F.col("r") > 0).cast("long")).alias(f"kr{order}"),
        )
    )


def _window_scores(counts: DataFrame, distinct: DataFrame) -> DataFrame:
    """(w, n, s): score of every distinct window in whole micro-units."""
    out = distinct.select("w", "n", F.lit(1.0 / ALPHABET).alias("pa"), F.lit(1.0 / ALPHABET).alias("pr"))
    for order in range(ORDER + 1):
        model = _model(counts, order)
        if order <= 1:  # at most ALPHABET + 1 contexts of at most ALPHABET successors
            model = F.broadcast(model)
        out = out.join(model, F.substring("w", ORDER + 1 - order, order) == F.col(f"context{order}"), "left")
        hit = F.get(F.filter(f"next{order}", lambda x: x["c"] == F.substring("w", ORDER + 1, 1)), F.lit(0))
        p = []
        for k in "ar":
            total, kinds = F.col(f"{k}{order}").cast("double"), F.col(f"k{k}{order}").cast("double")
            seen = F.coalesce(hit[k], F.lit(0)).cast("double")
            smoothed = (seen + kinds * F.col(f"p{k}")) / (total + kinds)
            p.append(F.when(total > 0, smoothed).otherwise(F.col(f"p{k}")).alias(f"p{k}"))
        out = out.select("w", "n", *p)
    return out.select("w", "n", F.round((F.log("pa") - F.log("pr")) * SCALE).cast("long").alias("s"))


def judge(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score is the mean
    log-likelihood difference in micro-units (null for URLs that a rule decides)."""
    host, path, rest = parts(F.col(url_col))
    # distinct URLs are scored once, however often they are repeated
    urls = (
        pages.select(host.alias("host"), path.alias("path"), rest.alias("rest"))
        .groupBy("host", "path", "rest").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("fit", _rule(F.col("host"), F.col("path")))
        .select("host", "path", "rest", "n", "fit.rule", "fit.verdict")
    )
    urls = written(spark, urls, "urls-distinct")
    padded = urls.withColumn("padded", _padded(F.col("rest")))
    at = padded.select(
        "rest", "n", "verdict",
        F.explode(F.transform(
            F.sequence(F.lit(0), F.size("padded") - ORDER - 1),
            lambda i: F.concat(*[F.get("padded", i + k) for k in range(ORDER + 1)]),
        )).alias("w"),
    )
    weight = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0))
    counted = written(
        spark,
        at.groupBy("w").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), weight("allow").alias("a"),
                            weight("block").alias("r")),
        "urls-windows",
    )
    totals = counted.agg(F.sum("rows").alias("rows"), F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    seen = counted.where("a + r > 0").select("w", "a", "r")
    if not (totals["a"] and totals["r"]):
        scored = urls.withColumn("score", F.lit(None).cast("long"))
        threshold = 0
    else:
        table = written(spark, _window_scores(seen, counted.select("w", F.col("rows").alias("n"))), "urls-scores")
        hot = F.broadcast(table.where(F.col("n") * HOT > totals["rows"]).select("w", F.col("s").alias("hot")))
        cold = table.where(F.col("n") * HOT <= totals["rows"]).select("w", F.col("s").alias("cold"))
        split = at.select("rest", "w").join(hot, "w", "left")
        each = split.where("hot IS NOT NULL").select("rest", F.col("hot").alias("s")).unionByName(
            split.where("hot IS NULL").join(cold, "w").select("rest", F.col("cold").alias("s")))
        sums = each.groupBy("rest").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("length"))
        scored = written(
            spark,
            urls.join(sums, "rest").withColumn("score", F.floor(F.col("s") / F.col("length"))).drop("s", "length"),
            "urls-judged",
        )
        threshold = _threshold(scored)
    verdicts = scored.select(
        F.col("rest").alias("_rest"), "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("score") < threshold, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("verdict").isNull(), F.col("score")).alias("score"),
    )
    return pages.select(F.col(id_col).alias("page_id"), rest.alias("_key")).join(
        verdicts, F.col("_key") == F.col("_rest"), "left"
    ).select("page_id", "host", "path", "rule", "verdict", "score")


def _threshold(scored: DataFrame) -> int:
    """Largest Youden index over the rule-decided URLs; at most 2 * BIN_LIMIT * BINS_A_UNIT + 1 bins reach the driver."""
    step = SCALE // BINS_A_UNIT
    limit = BIN_LIMIT * BINS_A_UNIT
    rows = (
        scored.where("verdict IS NOT NULL")
        .groupBy(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(F.col("score") / step))).alias("bin"))
        .agg(F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("a"),
             F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("r"))
        .orderBy("bin").collect()
    )
    a, r = sum(x["a"] for x in rows), sum(x["r"] for x in rows)
    best, below_a, below_r, cut = -2.0, 0, 0, 0
    for x in rows:  # cutting at a bin's lower end
        youden = below_r / r - below_a / a
        if youden > best:
            best, cut = youden, x["bin"] * step
        below_a, below_r = below_a + x["a"], below_r + x["r"]
    return int(cut)


def contract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(spark, pages).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """The contract's rows in DuckDB, models and calibration included."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    models, prob = [], {"a": str(1.0 / ALPHABET), "r": str(1.0 / ALPHABET)}
    joins, columns = [], []
    for k in range(ORDER + 1):
        ctx, gram = f"substr(w, {ORDER + 1 - k}, {k})", f"substr(w, {ORDER + 1 - k}, {k + 1})"
        models.append(f"""
    g{k} AS (SELECT {gram} AS g, any_value({ctx}) AS c, sum(a) AS a, sum(r) AS r FROM seen GROUP BY 1),
    m{k} AS (SELECT c, sum(a) AS ta, sum(r) AS tr, count(*) FILTER (a > 0) AS ka, count(*) FILTER (r > 0) AS kr
             FROM g{k} GROUP BY c)""")
        joins.append(f"LEFT JOIN g{k} ON g{k}.g = {gram} LEFT JOIN m{k} ON m{k}.c = {ctx}")
        for x in "ar":
            here = prob[x] if k == 0 else f"p{x}{k - 1}"
            columns.append(
                f"CASE WHEN m{k}.t{x} > 0 THEN (coalesce(g{k}.{x}, 0)::DOUBLE + m{k}.k{x}::DOUBLE * {here})"
                f" / (m{k}.t{x}::DOUBLE + m{k}.k{x}::DOUBLE) ELSE {here} END AS p{x}{k}")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    limit, step = BIN_LIMIT * BINS_A_UNIT, SCALE // BINS_A_UNIT
    return f"""
    WITH rules(verdict, h, p) AS (VALUES {rules}),
    parts AS (
      SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages)
    ), fit AS (
      SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
      FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
        ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      GROUP BY host, path
    ), u AS (
      SELECT host, path, rest, n, rule, verdict
      FROM (SELECT host, path, rest, count(*) AS n FROM parts GROUP BY ALL) LEFT JOIN fit USING (host, path)
    ), pad AS (
      SELECT rest, n, verdict, repeat(chr(2), {ORDER}) || regexp_replace(rest, '[^!-~]', ' ', 'g') || chr(3) AS t FROM u
    ), places AS (
      SELECT rest, n, verdict, substr(t, i + 1, {ORDER + 1}) AS w FROM (
        SELECT rest, n, verdict, t, unnest(range(length(t) - {ORDER})) AS i FROM pad)
    ), counted AS (
      SELECT w, coalesce(sum(n) FILTER (verdict = 'allow'), 0) AS a, coalesce(sum(n) FILTER (verdict = 'block'), 0) AS r
      FROM places GROUP BY w
    ), seen AS (SELECT * FROM counted WHERE a + r > 0),{",".join(models)},
    scores AS (
      SELECT counted.w, {", ".join(columns)},
             round((ln(pa{ORDER}) - ln(pr{ORDER})) * {SCALE})::BIGINT AS s
      FROM counted {" ".join(joins)}
    ), total AS (SELECT sum(a) AS a, sum(r) AS r FROM counted),
    judged AS (
      SELECT rest, floor(sum(s) / count(*))::BIGINT AS score FROM places JOIN scores USING (w) GROUP BY rest
    ), bins AS (
      SELECT greatest({-limit}, least({limit}, floor(score / {step})::BIGINT)) AS bin,
             sum(CASE WHEN verdict = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN verdict = 'block' THEN n ELSE 0 END) AS r
      FROM u JOIN judged USING (rest) WHERE verdict IS NOT NULL GROUP BY 1
    ), cut AS (
      SELECT arg_min(bin, {{'y': -y, 'b': bin}}) * {step} AS cut FROM (
        SELECT bin, coalesce(sum(r) OVER w, 0)::DOUBLE / (SELECT sum(r) FROM bins)
                    - coalesce(sum(a) OVER w, 0)::DOUBLE / (SELECT sum(a) FROM bins) AS y
        FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    )
    SELECT page_id, parts.host, parts.path, rule,
           coalesce(verdict, CASE WHEN (SELECT a > 0 AND r > 0 FROM total) AND score < (SELECT cut FROM cut)
                                  THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts JOIN u USING (rest) JOIN judged USING (rest)"""
