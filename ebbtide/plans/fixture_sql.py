"""The fixture views written independently in SQL (DuckDB dialect) for the oracle.

``with_views(body, *names)`` prefixes a query with the CTEs it needs, in
dependency order, so each oracle string is self-contained over the raw tables.
"""

from __future__ import annotations

CUST_FEAT = """
cust_feat AS (
  WITH oc AS (
    SELECT o_custkey AS cust_id,
      sum(CASE WHEN o_orderdate < TIMESTAMP '2001-02-15' THEN 1 ELSE 0 END) AS n,
      max(CASE WHEN o_orderdate >= TIMESTAMP '2001-02-15' THEN 1 ELSE 0 END) AS active,
      sum(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '2001-02-15') AS rev_sum,
      min(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '2001-02-15') AS rev_min,
      coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '2001-02-15'
                                     AND o_orderdate >= TIMESTAMP '2000-11-17'), 0) AS rev3,
      coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '2001-02-15'
                                     AND o_orderdate >= TIMESTAMP '2000-08-19'), 0) AS rev6,
      min(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '2001-02-15') AS first_date,
      max(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '2001-02-15') AS last_date,
      count(DISTINCT o_orderpriority) FILTER (WHERE o_orderdate < TIMESTAMP '2001-02-15'
                                     AND o_orderdate >= TIMESTAMP '2000-02-16') AS actvsubs,
      count(DISTINCT o_orderpriority) FILTER (WHERE o_orderdate < TIMESTAMP '2001-02-15') AS uniqsubs,
      arg_max(o_orderpriority, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0'))
          FILTER (WHERE o_orderdate < TIMESTAMP '2001-02-15') AS last_prio,
      arg_max(o_orderstatus, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0'))
          FILTER (WHERE o_orderdate < TIMESTAMP '2001-02-15') AS last_status
    FROM orders GROUP BY o_custkey
  ),
  lc AS (
    SELECT o.o_custkey AS cust_id,
      count(*) AS lines,
      sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS l_comp,
      sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS l_drop,
      sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS l_blck,
      sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS l_unan,
      sum(CASE WHEN l_quantity < 10 THEN 1 ELSE 0 END) AS l_short,
      sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS l_dat,
      sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS q_comp,
      sum(l_quantity) AS q_all,
      sum(greatest(l_quantity - 40, 0)) AS q_over,
      sum(CASE WHEN l_tax >= 0.06 THEN 1 ELSE 0 END) AS l_care,
      sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS l_peak,
      sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS l_offpeak,
      count(DISTINCT l_suppkey) AS n_supp,
      count(DISTINCT l_partkey) AS n_part,
      sum(CASE WHEN o.o_orderdate >= TIMESTAMP '2000-11-17' THEN l_quantity ELSE 0 END) AS q3,
      sum(CASE WHEN o.o_orderdate >= TIMESTAMP '2000-08-19' THEN l_quantity ELSE 0 END) AS q6
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    WHERE o.o_orderdate < TIMESTAMP '2001-02-15'
    GROUP BY o.o_custkey
  ),
  b AS (
    SELECT oc.*, lc.* EXCLUDE (cust_id), c.c_acctbal, c.c_mktsegment, na.n_name, r.r_name,
      date_diff('day', CAST(oc.first_date AS DATE), DATE '2001-02-15') / 30.0 AS mo
    FROM oc LEFT JOIN lc ON oc.cust_id = lc.cust_id
    JOIN customer c ON oc.cust_id = c.c_custkey
    JOIN nation na ON c.c_nationkey = na.n_nationkey
    JOIN region r ON na.n_regionkey = r.r_regionkey
    WHERE oc.n > 0
  )
  SELECT cust_id,
    CAST(1 - active AS INTEGER) AS churn,
    rev_sum / n AS rev_Mean,
    rev_min AS totmrc_Mean,
    rev3 / 3.0 AS avg3rev,
    rev6 / 6.0 AS avg6rev,
    rev_sum / (mo + 1e-6) AS avgrev,
    rev3 / 3.0 - rev6 / 6.0 AS change_rev,
    mo AS "months",
    CAST(date_diff('day', CAST(last_date AS DATE), DATE '2001-02-15') AS DOUBLE) AS eqpdays,
    CAST(actvsubs AS DOUBLE) AS actvsubs,
    CAST(uniqsubs AS DOUBLE) AS uniqsubs,
    coalesce(lines, 0) / n AS plcd_vce_Mean,
    coalesce(l_comp, 0) / n AS comp_vce_Mean,
    coalesce(l_drop, 0) / n AS drop_vce_Mean,
    coalesce(l_blck, 0) / n AS blck_vce_Mean,
    coalesce(l_unan, 0) / n AS unan_vce_Mean,
    coalesce(l_short, 0) / n AS inonemin_Mean,
    coalesce(l_dat, 0) / n AS plcd_dat_Mean,
    coalesce(q_comp, 0) / n AS mou_cvce_Mean,
    coalesce(q_all, 0) / n AS mou_Mean,
    coalesce(q_over, 0) / n AS ovrmou_Mean,
    coalesce(l_care, 0) / n AS custcare_Mean,
    coalesce(l_peak, 0) / n AS peak_vce_Mean,
    coalesce(l_offpeak, 0) / n AS opk_vce_Mean,
    coalesce(n_supp, 0) / n AS roam_Mean,
    CAST(coalesce(n_supp, 0) AS DOUBLE) AS phones,
    CAST(coalesce(n_part, 0) AS DOUBLE) AS models,
    coalesce(q3, 0) / 3.0 AS avg3mou,
    coalesce(q6, 0) / 6.0 AS avg6mou,
    coalesce(q_all, 0) / (mo + 1e-6) AS avgmou,
    coalesce(q3, 0) / 3.0 - coalesce(q6, 0) / 6.0 AS change_mou,
    c_mktsegment AS prizm_social_one,
    n_name AS area,
    r_name AS dwlltype,
    last_prio AS crclscod,
    last_status AS marital,
    CASE WHEN n % 2 = 1 THEN 'R' ELSE 'N' END AS refurb_new,
    'W' || CAST(cust_id % 7 AS VARCHAR) AS hnd_webcap,
    CASE WHEN c_acctbal < 0 THEN 'Y' ELSE 'N' END AS asl_flag,
    CASE WHEN c_acctbal >= 5000 THEN 'Y' ELSE 'N' END AS creditcd,
    ['R', 'U', 'O'][cust_id % 3 + 1] AS ownrent,
    ['Y', 'N', ' ', 'T', 'Y'][cust_id % 5 + 1] AS dualband,
    right(n_name, 1) AS ethnic,
    CASE WHEN cust_id % 2 = 0 THEN 'M' ELSE 'N' END AS infobase
  FROM b
)"""

CUST_DIRTY = """
cust_dirty AS (
  WITH d AS (
    SELECT * REPLACE (
      CASE WHEN cust_id % 11 = 0 THEN NULL ELSE rev_Mean END AS rev_Mean,
      CASE WHEN cust_id % 7 = 0 THEN NULL ELSE mou_Mean END AS mou_Mean,
      CASE WHEN cust_id % 5 = 0 THEN NULL ELSE change_mou END AS change_mou,
      CASE WHEN cust_id % 9 = 0 THEN NULL ELSE eqpdays END AS eqpdays,
      CASE WHEN cust_id % 13 = 0 THEN '-' WHEN cust_id % 17 = 0 THEN 'NULL'
           WHEN cust_id % 19 = 0 THEN 'missing' ELSE prizm_social_one END AS prizm_social_one,
      CASE WHEN cust_id % 23 = 0 THEN 'null' WHEN cust_id % 29 = 0 THEN 'NaN'
           WHEN cust_id % 31 = 0 THEN NULL ELSE crclscod END AS crclscod
    ) FROM cust_feat
  ),
  d2 AS (
    SELECT *, CASE WHEN cust_id % 37 = 0 THEN 'n/a' ELSE printf('%.6f', rev_Mean) END AS rev_text FROM d
  )
  SELECT * FROM d2 UNION ALL SELECT * FROM d2 WHERE cust_id % 50 = 0
)"""

CUST_SPLIT = """
cust_split AS (
  WITH s1 AS (
    SELECT *,
      row_number() OVER (PARTITION BY churn ORDER BY md5('42|' || CAST(cust_id AS VARCHAR)), cust_id) AS rn1,
      count(*) OVER (PARTITION BY churn) AS ncls
    FROM cust_feat
  ),
  s2 AS (
    SELECT * EXCLUDE (rn1, ncls),
      CASE WHEN rn1 <= round(ncls * 0.2) THEN 'test' ELSE 'train' END AS split
    FROM s1
  ),
  s3 AS (
    SELECT *, row_number() OVER (PARTITION BY churn, split
              ORDER BY md5('43|' || CAST(cust_id AS VARCHAR)), cust_id) AS rn2
    FROM s2
  )
  SELECT * EXCLUDE (rn2),
    CAST(CASE WHEN split = 'train' THEN (rn2 - 1) % 5 ELSE -1 END AS INTEGER) AS fold
  FROM s3
)"""

SCORED = """
scored AS (
  SELECT 'A' AS model, cust_id, churn,
    ((CAST('0x' || substr(md5('42|' || CAST(cust_id AS VARCHAR)), 1, 8) AS BIGINT) % 81) + 19 * churn) / 100.0 AS p
  FROM cust_feat
  UNION ALL
  SELECT 'B' AS model, cust_id, churn,
    ((CAST('0x' || substr(md5('43|' || CAST(cust_id AS VARCHAR)), 1, 8) AS BIGINT) % 91) + 9 * churn) / 100.0 AS p
  FROM cust_feat
)"""

CUST_CLEAN = """
cust_clean AS (
  SELECT * REPLACE (
    CASE WHEN prizm_social_one IN ('NULL','null','NaN','missing','-') THEN NULL ELSE prizm_social_one END
      AS prizm_social_one,
    CASE WHEN crclscod IN ('NULL','null','NaN','missing','-') THEN NULL ELSE crclscod END AS crclscod,
    CASE WHEN rev_text IN ('NULL','null','NaN','missing','-') THEN NULL ELSE rev_text END AS rev_text)
  FROM cust_dirty
)"""

_VIEWS = {
    "cust_clean": (CUST_CLEAN, ("cust_dirty",)),
    "cust_feat": (CUST_FEAT, ()),
    "cust_dirty": (CUST_DIRTY, ("cust_feat",)),
    "cust_split": (CUST_SPLIT, ("cust_feat",)),
    "scored": (SCORED, ("cust_feat",)),
}


def with_views(body: str, *names: str, extra: str | None = None) -> str:
    """Self-contained SQL: ``WITH <needed fixture CTEs>[, extra] <body>``."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in _VIEWS[n][1]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = [_VIEWS[n][0].strip() for n in order]
    if extra:
        ctes.append(extra.strip())
    body = body.strip()
    if body[:5].upper() == "WITH ":
        # merge the body's own CTE list into ours
        ctes.append(body[5:].lstrip())
        return "WITH " + ",\n".join(ctes)
    return "WITH " + ",\n".join(ctes) + "\n" + body
