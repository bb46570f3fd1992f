"""Customer-level views derived from the driver's star-schema tables.

``cust_feat``   one row per customer with an order before the cut-off date; the
                usage/revenue/device columns the churn analysis works on, built
                from orders and lines before the cut-off; ``churn`` = no order
                on or after it.
``cust_dirty``  ``cust_feat`` with deterministic nulls, null tokens, a text
                column and duplicated rows (input of profiling and cleaning).
``cust_split``  ``cust_feat`` plus a stratified ``split`` and ``fold``.
``scored``      deterministic, tie-rich positive-class scores for two models.

Plan shape (what scales): lines are joined to the pre-cut-off orders on the
order key (sort-merge join, both sides hash-partitioned on it) and reduced per
customer with partial aggregation; orders are reduced per customer in the same
way; the two per-customer results are joined on the customer key, and the two
tiny dimension tables (nation, region) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions.constants import EPS
from ebbtide.functions.scalar import md5_int
from ebbtide.operators.split import stratified_split
from ebbtide.session import scratch_path
from ebbtide.sources.tables import table

CUTOFF = "2001-02-15"
SINCE_3M = "2000-11-17"
SINCE_6M = "2000-08-19"
SINCE_12M = "2000-02-16"


def _ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


KEY_ROWS = 1_000_000  # (customer, key) rows of a task when distinct keys are counted, about
STAGE_VERSION = "3"  # bump when a stage table's definition changes


def _source_signature(spark: SparkSession, sf_dir: str) -> str:
    """Fingerprint of the input files (paths, sizes, times) for stage-table reuse, taken
    through the Hadoop file system, so that it follows the data on any store."""
    import hashlib

    path, fs = _hadoop(spark, sf_dir)
    h = hashlib.sha1(f"{STAGE_VERSION}|{path}".encode())
    files = fs.listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    h.update("\n".join(sorted(found)).encode())
    return h.hexdigest()[:16]


def _hadoop(spark: SparkSession, path: str):
    """(qualified path, file system) of a path on whatever store it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(p), fs


def stage_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    return scratch_path(spark, f"stage/{_source_signature(spark, sf_dir)}/{name}")


def stage_done(spark: SparkSession, path: str) -> bool:
    done, fs = _hadoop(spark, f"{path}/_SUCCESS")
    return fs.exists(done)


def materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Stage table: built once per input folder, written as Parquet under the
    cluster's shared checkpoint folder and read back.  Cuts lineage (a lost
    executor re-reads files instead of recomputing joins) and lets every later
    query start from the written table."""
    path = stage_path(spark, sf_dir, name)
    if not stage_done(spark, path):  # never written, or not to the end
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cust_feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "cust_feat", lambda: build_cust_feat(spark, sf_dir))


def build_cust_feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus"
    )
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")

    pre = F.col("o_orderdate") < _ts(CUTOFF)
    date = F.col("o_orderdate")
    price = F.col("o_totalprice")

    # one pass over all orders: pre-cut-off statistics + "ordered again" flag
    per_cust = (
        orders.groupBy(F.col("o_custkey").alias("cust_id"))
        .agg(
            _count_if(pre).alias("n"),
            F.max(F.when(date >= _ts(CUTOFF), 1).otherwise(0)).alias("active"),
            F.sum(F.when(pre, price)).alias("rev_sum"),
            F.min(F.when(pre, price)).alias("rev_min"),
            F.sum(F.when(pre & (date >= _ts(SINCE_3M)), price).otherwise(0.0)).alias("rev3"),
            F.sum(F.when(pre & (date >= _ts(SINCE_6M)), price).otherwise(0.0)).alias("rev6"),
            F.min(F.when(pre, date)).alias("first_date"),
            F.max(F.when(pre, date)).alias("last_date"),
            F.max(
                F.when(pre, F.struct(date, F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")))
            ).alias("last_order"),
        )
        .where(F.col("n") > 0)
    )
    priorities = (
        orders.where(pre & F.col("o_orderpriority").isNotNull())
        .groupBy(F.col("o_custkey").alias("cust_id"), "o_orderpriority")
        .agg(F.max(F.when(date >= _ts(SINCE_12M), 1).otherwise(0)).alias("recent"))
        .groupBy("cust_id").agg(F.sum("recent").alias("actvsubs"), F.count(F.lit(1)).alias("uniqsubs"))
    )

    pre_orders = orders.where(pre).select(
        "o_orderkey", F.col("o_custkey").alias("cust_id"),
        (F.col("o_orderdate") >= _ts(SINCE_3M)).alias("in3"),
        (F.col("o_orderdate") >= _ts(SINCE_6M)).alias("in6"),
    )
    q = F.col("l_quantity")
    rf = F.col("l_returnflag")
    ls = F.col("l_linestatus")
    lines = lineitem.join(pre_orders, lineitem.l_orderkey == pre_orders.o_orderkey)
    line_sums = lines.groupBy("cust_id").agg(
        F.count(F.lit(1)).alias("lines"),
        _count_if(rf == "N").alias("l_comp"),
        _count_if(rf == "R").alias("l_drop"),
        _count_if((rf == "A") & (ls == "F")).alias("l_blck"),
        _count_if((rf == "A") & (ls == "O")).alias("l_unan"),
        _count_if(q < 10).alias("l_short"),
        _count_if(F.col("l_discount") >= 0.05).alias("l_dat"),
        F.sum(F.when(rf == "N", q).otherwise(0.0)).alias("q_comp"),
        F.sum(q).alias("q_all"),
        F.sum(F.greatest(q - 40, F.lit(0.0))).alias("q_over"),
        _count_if(F.col("l_tax") >= 0.06).alias("l_care"),
        _count_if(ls == "O").alias("l_peak"),
        _count_if(ls == "F").alias("l_offpeak"),
        F.sum(F.when(F.col("in3"), q).otherwise(0.0)).alias("q3"),
        F.sum(F.when(F.col("in6"), q).otherwise(0.0)).alias("q6"),
    )
    # distinct suppliers and parts in narrow rows of their own: beside the sums, every (customer, supplier) and
    # (customer, part) would carry all the sums' buffers; nearly all are distinct, so they are dealt out by customer first
    seen = F.array(F.struct(F.lit(True).alias("supp"), F.col("l_suppkey").cast("long").alias("k")),
                   F.struct(F.lit(False).alias("supp"), F.col("l_partkey").cast("long").alias("k")))
    line_keys = (
        lines.select("cust_id", F.explode(seen).alias("s")).select("cust_id", "s.supp", "s.k").where(F.col("k").isNotNull())
        .repartition(max(1, -(-2 * lineitem.count() // KEY_ROWS)), "cust_id").distinct().groupBy("cust_id").agg(_count_if(F.col("supp")).alias("n_supp"), _count_if(~F.col("supp")).alias("n_part"))
    )
    per_cust_lines = line_sums.join(line_keys, "cust_id", "left")

    geo = F.broadcast(
        nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", "n_name", "r_name"
        )
    )

    base = (
        per_cust.join(priorities, "cust_id", "left")
        .join(per_cust_lines, "cust_id", "left")
        .join(customer, F.col("cust_id") == F.col("c_custkey"))
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    )

    n = F.col("n").cast("double")

    def per_order(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("double") / n

    months = F.datediff(_ts(CUTOFF).cast("date"), F.col("first_date").cast("date")).cast("double") / 30.0
    avg3rev = F.col("rev3") / 3.0
    avg6rev = F.col("rev6") / 6.0
    avg3mou = F.coalesce(F.col("q3"), F.lit(0.0)) / 3.0
    avg6mou = F.coalesce(F.col("q6"), F.lit(0.0)) / 6.0
    ck = F.col("cust_id")
    return base.select(
        ck.alias("cust_id"),
        (1 - F.col("active")).cast("int").alias("churn"),
        (F.col("rev_sum") / n).alias("rev_Mean"),
        F.col("rev_min").alias("totmrc_Mean"),
        avg3rev.alias("avg3rev"),
        avg6rev.alias("avg6rev"),
        (F.col("rev_sum") / (months + EPS)).alias("avgrev"),
        (avg3rev - avg6rev).alias("change_rev"),
        months.alias("months"),
        F.datediff(_ts(CUTOFF).cast("date"), F.col("last_date").cast("date")).cast("double").alias("eqpdays"),
        F.coalesce(F.col("actvsubs"), F.lit(0)).cast("double").alias("actvsubs"),
        F.coalesce(F.col("uniqsubs"), F.lit(0)).cast("double").alias("uniqsubs"),
        per_order("lines").alias("plcd_vce_Mean"),
        per_order("l_comp").alias("comp_vce_Mean"),
        per_order("l_drop").alias("drop_vce_Mean"),
        per_order("l_blck").alias("blck_vce_Mean"),
        per_order("l_unan").alias("unan_vce_Mean"),
        per_order("l_short").alias("inonemin_Mean"),
        per_order("l_dat").alias("plcd_dat_Mean"),
        per_order("q_comp").alias("mou_cvce_Mean"),
        per_order("q_all").alias("mou_Mean"),
        per_order("q_over").alias("ovrmou_Mean"),
        per_order("l_care").alias("custcare_Mean"),
        per_order("l_peak").alias("peak_vce_Mean"),
        per_order("l_offpeak").alias("opk_vce_Mean"),
        per_order("n_supp").alias("roam_Mean"),
        F.coalesce(F.col("n_supp"), F.lit(0)).cast("double").alias("phones"),
        F.coalesce(F.col("n_part"), F.lit(0)).cast("double").alias("models"),
        avg3mou.alias("avg3mou"),
        avg6mou.alias("avg6mou"),
        (F.coalesce(F.col("q_all"), F.lit(0.0)) / (months + EPS)).alias("avgmou"),
        (avg3mou - avg6mou).alias("change_mou"),
        F.col("c_mktsegment").alias("prizm_social_one"),
        F.col("n_name").alias("area"),
        F.col("r_name").alias("dwlltype"),
        F.col("last_order.o_orderpriority").alias("crclscod"),
        F.col("last_order.o_orderstatus").alias("marital"),
        F.when(F.col("n") % 2 == 1, "R").otherwise("N").alias("refurb_new"),
        F.concat(F.lit("W"), (ck % 7).cast("string")).alias("hnd_webcap"),
        F.when(F.col("c_acctbal") < 0, "Y").otherwise("N").alias("asl_flag"),
        F.when(F.col("c_acctbal") >= 5000, "Y").otherwise("N").alias("creditcd"),
        F.element_at(F.array(F.lit("R"), F.lit("U"), F.lit("O")), (ck % 3 + 1).cast("int")).alias("ownrent"),
        F.element_at(
            F.array(F.lit("Y"), F.lit("N"), F.lit(" "), F.lit("T"), F.lit("Y")), (ck % 5 + 1).cast("int")
        ).alias("dualband"),
        F.substring(F.col("n_name"), -1, 1).alias("ethnic"),
        F.when(ck % 2 == 0, "M").otherwise("N").alias("infobase"),
    )


NUMERIC_FEATURES = (
    "rev_Mean", "totmrc_Mean", "avg3rev", "avg6rev", "avgrev", "change_rev", "months", "eqpdays",
    "actvsubs", "uniqsubs", "plcd_vce_Mean", "comp_vce_Mean", "drop_vce_Mean", "blck_vce_Mean",
    "unan_vce_Mean", "inonemin_Mean", "plcd_dat_Mean", "mou_cvce_Mean", "mou_Mean", "ovrmou_Mean",
    "custcare_Mean", "peak_vce_Mean", "opk_vce_Mean", "roam_Mean", "phones", "models",
    "avg3mou", "avg6mou", "avgmou", "change_mou",
)
STRING_FEATURES = (
    "prizm_social_one", "area", "dwlltype", "crclscod", "marital", "refurb_new", "hnd_webcap",
    "asl_flag", "creditcd", "ownrent", "dualband", "ethnic", "infobase",
)


def _rule(value: Column, *rules: tuple[int, object]) -> Column:
    """First matching ``cust_id % m == 0`` rule wins; otherwise keep ``value``."""
    ck = F.col("cust_id")
    out = None
    for m, replacement in rules:
        cond = ck % m == 0
        rep = F.lit(None) if replacement is None else F.lit(replacement)
        out = F.when(cond, rep) if out is None else out.when(cond, rep)
    return out.otherwise(value)


def cust_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    feat = cust_feat(spark, sf_dir)
    ck = F.col("cust_id")
    rev = _rule(F.col("rev_Mean"), (11, None)).cast("double")
    replaced = {
        "rev_Mean": rev,
        "mou_Mean": _rule(F.col("mou_Mean"), (7, None)).cast("double"),
        "change_mou": _rule(F.col("change_mou"), (5, None)).cast("double"),
        "eqpdays": _rule(F.col("eqpdays"), (9, None)).cast("double"),
        "prizm_social_one": _rule(F.col("prizm_social_one"), (13, "-"), (17, "NULL"), (19, "missing")),
        "crclscod": _rule(F.col("crclscod"), (23, "null"), (29, "NaN"), (31, None)).cast("string"),
    }
    cols = [replaced.get(c, F.col(c)).alias(c) for c in feat.columns]
    rev_text = (
        F.when(ck % 37 == 0, F.lit("n/a")).when(rev.isNotNull(), F.format_string("%.6f", rev)).alias("rev_text")
    )
    dirty = feat.select(*cols, rev_text)
    return dirty.unionByName(dirty.where(ck % 50 == 0))


def cust_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(
        spark, sf_dir, "cust_split",
        lambda: stratified_split(cust_feat(spark, sf_dir), key="cust_id", label="churn"),
    )


MODEL_SEEDS = {"A": (42, 81, 19), "B": (43, 91, 9)}


def scored(spark: SparkSession, sf_dir: str, feat: DataFrame | None = None) -> DataFrame:
    """(model, cust_id, churn, p) for the two deterministic score models."""
    feat = feat if feat is not None else cust_feat(spark, sf_dir)
    entries = []
    for model, (seed, mod, lift) in MODEL_SEEDS.items():
        h = md5_int(F.concat(F.lit(f"{seed}|"), F.col("cust_id").cast("string")))
        p = (h % mod + lift * F.col("churn")) / 100.0
        entries.append(F.struct(F.lit(model).alias("model"), p.alias("p")))
    # one pass over the customers, one output row per (customer, model)
    return feat.select("cust_id", "churn", F.explode(F.array(*entries)).alias("s")).select(
        "s.model", "cust_id", "churn", "s.p"
    )


def cust_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cust_dirty`` after the null-token scrub (every string column)."""
    from ebbtide.sources.io import scrub_null_tokens

    return scrub_null_tokens(cust_dirty(spark, sf_dir))
