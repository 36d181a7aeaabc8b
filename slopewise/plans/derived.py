"""Inputs the operators need, derived from the given tables, once as DataFrames and once as SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import elapsed_days, hash_uniform, hash_word, is_palindrome
from ..functions.probability import normal_two_sided_p, normal_two_sided_p_sql
from ..operators import longitudinal as lg
from .registry import Tables, hu, hw

DAY0 = 19723  # 2024-01-01

# ---- visits -----------------------------------------------------------------


def visits(t: Tables) -> DataFrame:
    """Long visit table: subject, visit code, time in days, score, state, assay name."""
    e = t.events
    e = e.select("event_id", "user_id", elapsed_days(e, "ts").alias("t"), "value", "event_type")
    d = F.floor(F.col("t") - DAY0)
    code = (F.when(d < 2, "SC").when(d < 7, "BL").when(F.col("event_id") % 17 == 0, "U01")
            .otherwise(F.concat(F.lit("V"), F.lpad(F.floor(d / 7).cast("string"), 2, "0"))))
    state = F.when(F.col("event_id") % 10 != 0, F.when(F.col("value") < 30, 1).when(F.col("value") < 80, 2).otherwise(3))
    return e.withColumns({"visit": code, "state": state})


VISITS = f"""visits AS (
  SELECT event_id, user_id, t, value, event_type,
         CASE WHEN floor(t - {DAY0}) < 2 THEN 'SC' WHEN floor(t - {DAY0}) < 7 THEN 'BL' WHEN event_id % 17 = 0 THEN 'U01'
              ELSE 'V' || lpad(CAST(CAST(floor(floor(t - {DAY0}) / 7) AS BIGINT) AS VARCHAR), 2, '0') END AS visit,
         CASE WHEN event_id % 10 <> 0 THEN CASE WHEN value < 30 THEN 1 WHEN value < 80 THEN 2 ELSE 3 END END AS state
  FROM (SELECT *, epoch_us(ts) / 86400000000.0::DOUBLE AS t FROM events))"""


def slopes(t: Tables) -> DataFrame:
    return lg.subject_slopes(visits(t), "user_id", "t", "value", "event_id")


SLOPES = VISITS + """, slopes AS (
  SELECT user_id, count(*) AS n_visits, count(DISTINCT event_id) AS n_events, max(t) - min(t) AS span,
         avg(value) AS mean_y, regr_sxx(value, t) AS sxx,
         CASE WHEN count(*) >= 3 AND regr_sxx(value, t) > 0 THEN regr_slope(value, t) END AS ols_slope,
         CASE WHEN count(*) >= 3 AND regr_sxx(value, t) > 0 THEN
           greatest(regr_syy(value, t) - regr_sxy(value, t) * regr_sxy(value, t) / regr_sxx(value, t), 0)
           / (count(*) - 2) / regr_sxx(value, t) END AS slope_var,
         regr_slope(value, t) FILTER (WHERE rn > 1) AS slope_excl_first
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM visits) GROUP BY user_id)"""

MIN_EVENTS, MIN_SPAN = 4, 20.0


def eligible(t: Tables) -> DataFrame:
    return lg.eligible(slopes(t), MIN_EVENTS, MIN_SPAN)


ELIGIBLE = SLOPES + f""", eligible AS (
  SELECT * FROM slopes WHERE n_events >= {MIN_EVENTS} AND span >= {MIN_SPAN} AND slope_var IS NOT NULL)"""

PARAMS = ELIGIBLE + """, params AS (
  SELECT avg(ols_slope) AS mu, greatest(0, var_samp(ols_slope) - avg(slope_var)) AS tau2, avg(slope_var) AS residual_var,
         count(*) AS n_used FROM eligible)"""

# ---- scored rows --------------------------------------------------------------


def scored(t: Tables) -> DataFrame:
    """Rows with a truth, two predictions, a label and a probability: one per order."""
    o = t.orders
    u = hash_uniform("o_orderkey", F.lit("u"))
    y = F.col("o_totalprice") / 100000.0
    return o.select(
        "o_orderkey", (F.col("o_custkey") % 3).cast("int").alias("seed"), (F.col("o_orderkey") % 5).cast("int").alias("fold"),
        y.alias("y"), (0.5 * y + 2.0 * u).alias("pred_base"), (0.7 * y + 0.3 * u).alias("pred_aug"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.round(F.least(F.lit(1.0), 0.1 * y + 0.4 * u), 3).alias("prob"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_custkey") % 97).cast("double")).alias("age"))


SCORED = f"""scored AS (
  SELECT o_orderkey, CAST(o_custkey % 3 AS INTEGER) AS seed, CAST(o_orderkey % 5 AS INTEGER) AS fold, y,
         0.5::DOUBLE * y + 2.0::DOUBLE * u AS pred_base, 0.7::DOUBLE * y + 0.3::DOUBLE * u AS pred_aug,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, round(least(1.0::DOUBLE, 0.1::DOUBLE * y + 0.4::DOUBLE * u), 3) AS prob,
         o_orderpriority AS priority, o_orderstatus AS status,
         CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey % 97 AS DOUBLE) END AS age
  FROM (SELECT *, o_totalprice / 100000.0::DOUBLE AS y, {hu("o_orderkey", "'u'")} AS u FROM orders))"""

# ---- subjects with features -----------------------------------------------------


def customer_features(t: Tables) -> DataFrame:
    """One row per customer: outcome-like slope with variance, a few features, and its site (nation)."""
    o = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg(F.col("o_totalprice") / 100000.0).alias("avg_price"),
        F.max(F.col("o_totalprice") / 100000.0).alias("max_price"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share_f"))
    c = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"))
    noise = hash_uniform("c_custkey", F.lit("y")) - 0.5
    return c.select(
        "c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") / 1000.0).alias("acctbal"),
        F.col("n_orders").cast("double").alias("n_orders"), "avg_price", "max_price", "share_f",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 1000.0).alias("gappy"),
        (0.3 * F.col("avg_price") + 0.05 * F.col("c_acctbal") / 1000.0 + 2.0 * noise).alias("slope"),
        (0.01 + 0.2 / F.col("n_orders")).alias("var"),
        (F.col("avg_price") + 4.0 * noise > 2.5).cast("int").alias("label"))


CUSTOMERS = f"""cust AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal / 1000.0::DOUBLE AS acctbal, CAST(n_orders AS DOUBLE) AS n_orders,
         avg_price, max_price, share_f, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 1000.0::DOUBLE END AS gappy,
         0.3::DOUBLE * avg_price + 0.05::DOUBLE * c_acctbal / 1000.0::DOUBLE + 2.0::DOUBLE * ({hu("c_custkey", "'y'")} - 0.5::DOUBLE) AS slope,
         0.01::DOUBLE + 0.2::DOUBLE / n_orders AS var,
         CASE WHEN avg_price + 4.0::DOUBLE * ({hu("c_custkey", "'y'")} - 0.5::DOUBLE) > 2.5 THEN 1 ELSE 0 END AS label
  FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice / 100000.0::DOUBLE) AS avg_price,
                             max(o_totalprice / 100000.0::DOUBLE) AS max_price, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS share_f
                      FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey)"""

# ---- association tables -----------------------------------------------------------
# One variant per part; platform a / b by line status. Exposure: a part-specific multiple of the quantity plus the price as
# noise, on quantity. Outcome: a smaller multiple plus the discount as noise, on quantity.
EXP_Y = ("l_quantity * 0.01 * (l_partkey % 7 + 3) * CASE WHEN l_partkey % 3 = 0 THEN -1.0 ELSE 1.0 END + l_extendedprice / 100000.0")
OUT_Y = ("l_quantity * 0.002 * (l_partkey % 5 - 2) * CASE WHEN l_partkey % 3 = 0 THEN -1.0 ELSE 1.0 END + l_discount * 10.0")


def _as_double(text: str) -> str:
    """Decimal literals as doubles, so that both engines compute in floating point."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)", r"CAST(\1 AS DOUBLE)", text)


def _allele(k: Column, first: bool) -> Column:
    pairs = ["AC", "AG", "CT", "GT", "AT", "CG"]
    return F.substring(F.element_at(F.array(*[F.lit(p) for p in pairs]), (k % 6 + 1).cast("int")), 1 if first else 2, 1)


def _regression(t: Tables, y: Column, keys: list[str]) -> DataFrame:
    rows = t.lineitem.select("l_partkey", "l_linestatus", F.col("l_quantity").alias("x"), y.alias("y"))
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"),
                                F.regr_sxy("y", "x").alias("sxy"))
    return g.withColumn("b", F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")))


def _se() -> Column:
    return F.when((F.col("n") > 2) & (F.col("sxx") > 0),
                  F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx")))


def _se_sql() -> str:
    return "CASE WHEN n > 2 AND sxx > 0 THEN sqrt(greatest(syy - b * sxy, 0) / (n - 2) / sxx) END"


def exposures(t: Tables) -> DataFrame:
    """Summary statistics with the columns of an instrument table, before any filter."""
    g = _regression(t, F.expr(_as_double(EXP_Y)), ["l_partkey", "l_linestatus"])
    g = g.select("l_partkey", "l_linestatus", "n", F.col("b").alias("beta"), _se().alias("se"),
                 *[hash_word("l_partkey", F.lit(s)).alias(f"h_{s}") for s in ("al", "ef", "id")])
    h, h2, h3 = F.col("h_al"), F.col("h_ef"), F.col("h_id")
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("protein"))
    chrom = F.pmod(F.col("l_partkey"), F.lit(22)) + 1
    rows = g.join(p, "l_partkey").select(
        "protein", F.when(F.col("l_linestatus") == "F", "a").otherwise("b").alias("platform"), "l_partkey",
        F.concat(F.lit("var"), F.col("l_partkey").cast("string")).alias("Name"),
        F.when(h3 % 13 == 0, F.lit(None)).when(h3 % 13 == 1, F.lit("NA"))
        .otherwise(F.concat(F.lit("rs"), F.col("l_partkey").cast("string"), F.when(h3 % 3 == 0, ",rs0").otherwise(""))).alias("rsids"),
        F.when(chrom == 22, "X").otherwise(chrom.cast("string")).alias("chrom"), (F.col("l_partkey") * 1000 + 1000).alias("pos"),
        _allele(h, True).alias("effectAllele"), F.when(h2 % 29 == 0, "!").otherwise(_allele(h, False)).alias("otherAllele"),
        (0.02 + 0.96 * (h2 % 1000) / 1000.0).alias("eaf"), "n", "beta", "se")
    rows = rows.filter(F.col("se").isNotNull() & (F.col("se") > 0))
    return rows.withColumn("pval", normal_two_sided_p(F.col("beta") / F.col("se")))


EXPOSURES = f"""exposures AS (
  SELECT *, {normal_two_sided_p_sql("beta / se")} AS pval FROM (
  SELECT p_brand AS protein, CASE WHEN l_linestatus = 'F' THEN 'a' ELSE 'b' END AS platform, l_partkey, 'var' || l_partkey AS "Name",
         CASE WHEN h3 % 13 = 0 THEN NULL WHEN h3 % 13 = 1 THEN 'NA'
              ELSE 'rs' || l_partkey || CASE WHEN h3 % 3 = 0 THEN ',rs0' ELSE '' END END AS rsids,
         CASE WHEN l_partkey % 22 + 1 = 22 THEN 'X' ELSE CAST(l_partkey % 22 + 1 AS VARCHAR) END AS chrom, l_partkey * 1000 + 1000 AS pos,
         substr(al, 1, 1) AS "effectAllele", CASE WHEN h2 % 29 = 0 THEN '!' ELSE substr(al, 2, 1) END AS "otherAllele",
         0.02::DOUBLE + 0.96::DOUBLE * (h2 % 1000) / 1000.0::DOUBLE AS eaf, n, b AS beta, {_se_sql()} AS se
  FROM (SELECT *, ['AC','AG','CT','GT','AT','CG'][({hw("l_partkey", "'al'")}) % 6 + 1] AS al, {hw("l_partkey", "'ef'")} AS h2,
               {hw("l_partkey", "'id'")} AS h3
        FROM (SELECT l_partkey, l_linestatus, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy,
                     regr_sxy(y, x) AS sxy
              FROM (SELECT l_partkey, l_linestatus, l_quantity AS x, {_as_double(EXP_Y)} AS y FROM lineitem)
              GROUP BY l_partkey, l_linestatus)) JOIN part ON p_partkey = l_partkey)
  WHERE se > 0)"""

FIRST_RSID = "CASE WHEN trim(rsids) IN ('NA', '.', 'nan', '') THEN NULL ELSE trim(split_part(trim(rsids), ',', 1)) END"
PALINDROME = 'upper("effectAllele" || "otherAllele") IN (\'AT\', \'TA\', \'CG\', \'GC\')'


def instruments(t: Tables) -> DataFrame:
    """Exposures after the quality filters, with first rsid and palindrome flag."""
    from ..operators import variants as vr

    return vr.add_flags(vr.strong_instruments(exposures(t)))


INSTRUMENTS = EXPOSURES + f""", instruments AS (
  SELECT *, (beta / se) * (beta / se) AS "F", {PALINDROME} AS palindromic, {FIRST_RSID} AS rsid
  FROM exposures WHERE "otherAllele" <> '!' AND se > 0 AND (beta / se) * (beta / se) > 10)"""


def outcomes(t: Tables) -> DataFrame:
    """Outcome associations: some swapped, some in lower case, some mismatched, some without rsid, some missing."""
    g = _regression(t, F.expr(_as_double(OUT_Y)), ["l_partkey"])
    g = g.select("l_partkey", "b", _se().alias("se"), *[hash_word("l_partkey", F.lit(s)).alias(f"h_{s}") for s in ("al", "ef", "out")])
    al, hf, h = F.col("h_al"), F.col("h_ef"), F.col("h_out")
    first, second = _allele(al, True), _allele(al, False)
    eaf = 0.02 + 0.96 * (hf % 1000) / 1000.0
    near = F.greatest(F.lit(0.01), F.least(F.lit(0.99), eaf + (h % 100 - 50) / 1000.0))
    kind = F.pmod(h, F.lit(10))
    swap = kind.isin(6, 7)
    chrom = F.pmod(F.col("l_partkey"), F.lit(22)) + 1
    rows = g.filter((F.pmod(h, F.lit(17)) != 0) & (F.col("se") > 0)).select(
        F.when(F.pmod(h, F.lit(11)) != 0, F.concat(F.lit("rs"), F.col("l_partkey").cast("string"))).alias("rsid_out"),
        F.when(chrom == 22, "23").otherwise(chrom.cast("string")).alias("chrom_out"), (F.col("l_partkey") * 1000 + 1000).alias("pos_out"),
        F.when(swap, second).when(kind == 8, F.lower(first)).when(kind == 9, F.lit("N")).otherwise(first).alias("ea_out"),
        F.when(swap, first).when(kind == 8, F.lower(second)).otherwise(second).alias("oa_out"),
        F.when(swap, -F.col("b")).otherwise(F.col("b")).alias("beta_out"), F.col("se").alias("se_out"),
        F.when(swap | (kind == 5), 1.0 - near).otherwise(near).alias("eaf_out"))
    return rows


OUTCOMES = f"""outcomes AS (
  SELECT CASE WHEN h % 11 <> 0 THEN 'rs' || l_partkey END AS rsid_out,
         CASE WHEN l_partkey % 22 + 1 = 22 THEN '23' ELSE CAST(l_partkey % 22 + 1 AS VARCHAR) END AS chrom_out, l_partkey * 1000 + 1000 AS pos_out,
         CASE WHEN h % 10 IN (6, 7) THEN substr(al, 2, 1) WHEN h % 10 = 8 THEN lower(substr(al, 1, 1)) WHEN h % 10 = 9 THEN 'N' ELSE substr(al, 1, 1) END AS ea_out,
         CASE WHEN h % 10 IN (6, 7) THEN substr(al, 1, 1) WHEN h % 10 = 8 THEN lower(substr(al, 2, 1)) ELSE substr(al, 2, 1) END AS oa_out,
         CASE WHEN h % 10 IN (6, 7) THEN -b ELSE b END AS beta_out, se AS se_out,
         CASE WHEN h % 10 IN (5, 6, 7) THEN 1.0::DOUBLE - near ELSE near END AS eaf_out
  FROM (SELECT *, greatest(0.01::DOUBLE, least(0.99::DOUBLE, 0.02::DOUBLE + 0.96::DOUBLE * (hf % 1000) / 1000.0::DOUBLE + (h % 100 - 50) / 1000.0::DOUBLE)) AS near
  FROM (SELECT l_partkey, b, {_se_sql()} AS se, ['AC','AG','CT','GT','AT','CG'][({hw("l_partkey", "'al'")}) % 6 + 1] AS al,
               {hw("l_partkey", "'ef'")} AS hf, {hw("l_partkey", "'out'")} AS h
        FROM (SELECT l_partkey, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy
              FROM (SELECT l_partkey, l_quantity AS x, {_as_double(OUT_Y)} AS y FROM lineitem) GROUP BY l_partkey)))
  WHERE h % 17 <> 0 AND se > 0)"""


def harmonised(t: Tables) -> DataFrame:
    from ..operators import harmonise as hz

    return hz.harmonise(instruments(t), outcomes(t))


JOINED = INSTRUMENTS + ", " + OUTCOMES + """, joined AS (
  SELECT i.*, o.*, 'rsid' AS matched_by FROM instruments i JOIN outcomes o ON i.rsid = o.rsid_out
  UNION ALL
  SELECT i.*, o.*, 'position' AS matched_by FROM instruments i JOIN outcomes o
    ON CASE WHEN i.chrom = 'X' THEN '23' ELSE i.chrom END = o.chrom_out AND i.pos = o.pos_out
  WHERE NOT EXISTS (SELECT 1 FROM outcomes x WHERE x.rsid_out = i.rsid))"""

ALIGNED = JOINED + """, matched AS (
  SELECT *, CASE WHEN upper("effectAllele") = upper(ea_out) AND upper("otherAllele") = upper(oa_out) THEN 'direct'
                 WHEN upper("effectAllele") = upper(oa_out) AND upper("otherAllele") = upper(ea_out) THEN 'swapped' ELSE 'incompatible' END AS m
  FROM joined), aligned AS (
  SELECT * REPLACE (CASE WHEN m = 'swapped' THEN -beta_out ELSE beta_out END AS beta_out,
                    CASE WHEN m = 'swapped' THEN 1.0 - eaf_out ELSE eaf_out END AS eaf_out) FROM matched WHERE m <> 'incompatible')"""

HARMONISED = ALIGNED + """, distances AS (
  SELECT *, abs(eaf - eaf_out) AS dc, abs(eaf - (1.0 - eaf_out)) AS df, eaf >= 0.42 AND eaf <= 0.58 AS band FROM aligned),
harmonised AS (
  SELECT protein, platform, rsid, chrom, pos, "effectAllele", "otherAllele", eaf AS eaf_exp, beta AS beta_exp, se AS se_exp, se_out,
         CASE WHEN palindromic AND NOT band AND df + 0.05 < dc THEN -beta_out ELSE beta_out END AS beta_out,
         CASE WHEN palindromic AND NOT band AND df + 0.05 < dc THEN 1.0 - eaf_out ELSE eaf_out END AS eaf_out, palindromic,
         NOT palindromic OR (NOT band AND (dc + 0.05 < df OR df + 0.05 < dc)) AS strand_resolved, pos AS vid
  FROM distances)"""
