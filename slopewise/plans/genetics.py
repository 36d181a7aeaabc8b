"""Variants, harmonisation, estimates, colocalization, linkage disequilibrium."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.probability import normal_two_sided_p, normal_two_sided_p_sql
from ..operators import coloc, harmonise as hz, ld, mr, variants as vr
from ..session import cut_lineage
from . import derived as dv
from .registry import hw, query

# ---- windows and filters ------------------------------------------------------------


def _genes(t):
    """Gene spans: one per brand, from its parts; several candidate rows per symbol."""
    return t.part.select(
        F.col("p_brand").alias("protein"), (F.pmod("p_partkey", F.lit(22)) + 1).cast("string").alias("chrom"),
        (F.col("p_partkey") * 1000).alias("gene_start"), (F.col("p_partkey") * 1000 + F.col("p_size") * 100).alias("gene_end"),
        F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1).alias("strand"), F.col("p_partkey"))


PAD = 40_000
WINDOWS = f"""genes AS (SELECT p_brand AS protein, CAST(p_partkey % 22 + 1 AS VARCHAR) AS chrom, p_partkey * 1000 AS gene_start, p_partkey * 1000 + p_size * 100 AS gene_end,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
  windows AS (SELECT protein, chrom, gene_start, gene_end, greatest(0, gene_start - {PAD}) AS cis_start, gene_end + {PAD} AS cis_end FROM genes WHERE rn = 1)"""


@query("cis_windows", "protein:s chrom:s gene_start:i gene_end:i cis_start:i cis_end:i", f"WITH {WINDOWS} SELECT * FROM windows")
def _(t):
    return vr.make_windows(_genes(t), "protein", ["p_partkey"], PAD)


@query("window_variants", "window_protein:s Name:s platform:s chrom:s pos:i",
       f"""WITH {WINDOWS}, {dv.EXPOSURES} SELECT w.protein AS window_protein, e."Name", e.platform, e.chrom, e.pos FROM exposures e JOIN windows w
           ON e.chrom = w.chrom AND e.pos BETWEEN w.cis_start AND w.cis_end""")
def _(t):
    w = vr.make_windows(_genes(t), "protein", ["p_partkey"], PAD).withColumnRenamed("protein", "window_protein").drop(
        "gene_start", "gene_end", "strand")
    return vr.within_windows(dv.exposures(t), w, bin_width=100_000)


@query("missing_symbols", "protein:s",
       f"""WITH {WINDOWS} SELECT DISTINCT p_type AS protein FROM part WHERE p_type NOT IN (SELECT protein FROM windows)""")
def _(t):
    w = vr.make_windows(_genes(t), "protein", ["p_partkey"], PAD)
    return vr.missing_symbols(w, t.part.select(F.col("p_type").alias("protein")).distinct(), "protein")


@query("instrument_qc", "protein:s platform:s Name:s rsid:s F:d4 palindromic:b rare:b",
       f"""WITH {dv.INSTRUMENTS}, ann AS (SELECT 'var' || p_partkey AS "Name", CASE WHEN p_size > 1 THEN 0.001::DOUBLE * p_size END AS eaf2 FROM part),
           block AS (SELECT 'var' || s_suppkey * 7 AS "Name" FROM supplier)
           SELECT i.*, eaf2 < 0.01 AS rare FROM instruments i JOIN ann USING ("Name") WHERE eaf2 IS NOT NULL AND "Name" NOT IN (SELECT "Name" FROM block)""")
def _(t):
    name = F.concat(F.lit("var"), F.col("p_partkey").cast("string"))
    ann = t.part.select(name.alias("Name"), "p_partkey", F.when(F.col("p_size") > 1, 0.001 * F.col("p_size")).alias("eaf"))
    block = t.supplier.select(F.concat(F.lit("var"), (F.col("s_suppkey") * 7).cast("string")).alias("Name"))
    strong = vr.strong_instruments(vr.drop_blocklisted(dv.exposures(t).drop("eaf"), block, "Name"))
    return vr.add_flags(vr.lookup_eaf(strong, ann, "Name", ["p_partkey"]))


@query("significance_with_relaxation", "protein:s platform:s Name:s p_threshold:d9",
       f"""WITH {dv.EXPOSURES}, w AS (SELECT *, pow(pval, 0.05) AS p FROM exposures), a AS (SELECT *, bool_or(p < 0.02) OVER (PARTITION BY protein, platform) AS strict FROM w)
           SELECT protein, platform, "Name", CASE WHEN strict THEN 0.02 ELSE 0.2 END AS p_threshold FROM a WHERE p < CASE WHEN strict THEN 0.02 ELSE 0.2 END""")
def _(t):
    e = dv.exposures(t).withColumn("p", F.pow("pval", F.lit(0.05)))
    return vr.significant(e, "p", ["protein", "platform"], 0.02, 0.2)


@query("pseudo_p", "protein:s platform:s Name:s log10_p:d4",
       f"""WITH {dv.INSTRUMENTS}, z AS (SELECT *, CASE WHEN pval < 1e-12 THEN 0 ELSE pval END AS p0 FROM instruments)
           SELECT protein, platform, "Name", log10(CASE WHEN p0 = 0 THEN row_number() OVER (PARTITION BY protein, platform, p0 = 0 ORDER BY "F" DESC, pos DESC, "Name") * 1e-300::DOUBLE ELSE p0 END) AS log10_p FROM z""")
def _(t):
    i = dv.instruments(t).withColumn("p0", F.when(F.col("pval") < 1e-12, 0.0).otherwise(F.col("pval")))
    return vr.pseudo_p(i, ["protein", "platform"], "p0", "F", "pos", "Name").withColumn("log10_p", F.log10("pval_for_clump"))


@query("p_from_log10", "l_orderkey:i l_linenumber:i l_extendedprice:d p:d9",
       "SELECT l_orderkey, l_linenumber, l_extendedprice, pow(10.0::DOUBLE, -l_quantity / 10) AS p FROM lineitem WHERE l_quantity > 7.30103")
def _(t):
    rows = t.lineitem.filter(F.col("l_quantity") > vr.LOG10P_GENOME_WIDE).withColumn("q", F.col("l_quantity") / 10)
    return rows.withColumn("p", vr.p_from_log10("q"))


@query("sample_size_repair", "protein:s platform:s n_locus:i total_n:i",
       f"""WITH {dv.EXPOSURES}, r AS (SELECT protein, platform, coalesce(TRY_CAST(CASE WHEN l_partkey % 5 = 0 THEN 'x' ELSE CAST(CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE n END AS VARCHAR) END AS BIGINT), 54000) AS n2 FROM exposures)
           SELECT protein, platform, CAST(floor(coalesce(quantile_cont(n2, 0.5) FILTER (WHERE n2 > 0), 35000)) AS BIGINT) AS n_locus, sum(n2) AS total_n FROM r GROUP BY protein, platform""")
def _(t):
    raw = F.when(F.col("l_partkey") % 5 == 0, "x").otherwise(F.when(F.col("l_partkey") % 3 == 0, 0).otherwise(F.col("n")).cast("string"))
    r = vr.repair_n(dv.exposures(t).select("protein", "platform", raw.alias("raw")), "raw", "n2")
    return vr.locus_n(r, ["protein", "platform"], "n2").join(r.groupBy("protein", "platform").agg(F.sum("n2").alias("total_n")), ["protein", "platform"])


@query("log_odds", "l_orderkey:i l_linenumber:i l_extendedprice:d beta:d se:d",
       """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_discount > 0 THEN ln(l_discount * 10) END AS beta, CASE WHEN l_discount > 0 THEN (l_tax + 0.01) / (l_discount * 10) END AS se FROM lineitem""")
def _(t):
    beta, se = vr.log_odds(F.col("l_discount") * 10, F.col("l_tax") + 0.01)
    return t.lineitem.withColumns({"beta": beta, "se": se})


@query("rsid_lookup", "Name:s platform:s rsid:s",
       f"""WITH {dv.EXPOSURES}, m AS (SELECT 'var' || l_partkey AS "Name", min(l_orderkey) AS k FROM lineitem WHERE l_quantity > 20 AND l_partkey % 4 <> 0 GROUP BY 1)
           SELECT e."Name", platform, CASE WHEN k IS NOT NULL THEN 'rs' || k END AS rsid FROM exposures e LEFT JOIN m USING ("Name")""")
def _(t):
    m = t.lineitem.filter((F.col("l_quantity") > 20) & (F.col("l_partkey") % 4 != 0)).select(
        F.concat(F.lit("var"), F.col("l_partkey").cast("string")).alias("Name"), "l_orderkey", F.concat(F.lit("rs"), F.col("l_orderkey").cast("string")).alias("rsid"))
    return vr.lookup_rsid(dv.exposures(t), m, "Name", ["l_orderkey"])


@query("instrument_gate", "protein:s n_instruments:i strong:b dropped:b",
       f"""WITH {dv.INSTRUMENTS}, w AS (SELECT DISTINCT p_brand AS protein FROM part UNION SELECT 'Brand#none'),
           g AS (SELECT protein, count(*) AS n, bool_or("F" > 1000) AS s FROM instruments GROUP BY protein)
           SELECT protein, coalesce(n, 0) AS n_instruments, coalesce(s, false) AS strong, n IS NULL AS dropped FROM w LEFT JOIN g USING (protein)""")
def _(t):
    wanted = t.part.select(F.col("p_brand").alias("protein")).distinct().unionByName(
        t.region.filter(F.col("r_regionkey") == 0).select(F.lit("Brand#none").alias("protein")))
    return vr.instrument_gate(dv.instruments(t), wanted, "protein", min_f=1000.0)


@query("lead_variant", "protein:s platform:s Name:s pos:i",
       f"""WITH {dv.INSTRUMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY protein, platform ORDER BY pval, -"F", -pos, "Name") AS rn FROM instruments)
           SELECT protein, platform, "Name", pos FROM r WHERE rn = 1""")
def _(t):
    return vr.strongest(dv.instruments(t), ["protein", "platform"], vr.clump_order("pval", "F", "pos", "Name"), ["Name", "pos"])


@query("study_choice", "disease:s id:s size:i first_choice:b",
       """WITH c AS (SELECT 'doc-' || doc_id AS id, coalesce(lang, '') || ' ' || source AS trait, CASE WHEN lang = 'en' THEN 'European' ELSE 'Mixed' END AS population,
                       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS ncase, n_chars * 2 AS sample_size FROM documents),
          d AS (SELECT * FROM (VALUES ('english one', '^en src1'), ('french', '^FR'), ('any two', 'src2$'), ('none', 'zzz')) v(disease, pattern)),
          m AS (SELECT disease, id, coalesce(nullif(ncase, 0), sample_size, 0) AS size, coalesce(ncase, 0) >= 500 AND lower(population) LIKE 'euro%' AS first, coalesce(sample_size, 0) > 2000 AS second
                FROM c JOIN d ON regexp_matches(trait, '(?i)' || pattern) WHERE NOT regexp_matches(trait, '(?i)src19')),
          r AS (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY CAST(first AS INT) DESC, size DESC, id DESC) AS rn FROM m WHERE first OR second)
          SELECT disease, id, size, first AS first_choice FROM r WHERE rn = 1""")
def _(t):
    c = t.documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), "source").alias("trait"),
        F.when(F.col("lang") == "en", "European").otherwise("Mixed").alias("population"),
        F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("ncase"), (F.col("n_chars") * 2).alias("sample_size"))
    return vr.choose_studies(c, {"english one": "^en src1", "french": "^FR", "any two": "src2$", "none": "zzz"}, "src19")


# ---- harmonisation ------------------------------------------------------------------------


@query("prune_outcome", "chrom_out:s pos_out:i rsid_out:s",
       f"""WITH {dv.INSTRUMENTS}, {dv.OUTCOMES}, x AS (SELECT * FROM instruments)
           SELECT chrom_out, pos_out, rsid_out FROM outcomes o WHERE rsid_out IN (SELECT rsid FROM x WHERE rsid IS NOT NULL)
             OR EXISTS (SELECT 1 FROM x WHERE CASE WHEN x.chrom = 'X' THEN '23' ELSE x.chrom END = o.chrom_out AND x.pos = o.pos_out)""")
def _(t):
    return hz.prune_outcome(dv.outcomes(t), dv.instruments(t))


@query("join_with_fallback", "protein:s platform:s Name:s rsid:s rsid_out:s pos_out:i matched_by:s", f"WITH {dv.JOINED} SELECT * FROM joined")
def _(t):
    return hz.join_with_fallback(*hz.prepared_sides(dv.instruments(t), dv.outcomes(t)))


ROUTE = dv.INSTRUMENTS + ", " + dv.OUTCOMES + """, routed AS (SELECT *, CASE WHEN protein = 'Brand#1' THEN 'x_study' ELSE 'main' END AS src FROM instruments),
  tagged AS (SELECT *, 'main' AS src_o FROM outcomes UNION ALL SELECT *, 'x_study' FROM outcomes WHERE pos_out % 3000 = 1000)"""


@query("routed_join", "protein:s platform:s Name:s outcome_source:s matched_by:s",
       f"""WITH {ROUTE} SELECT protein, platform, "Name", src AS outcome_source, 'rsid' AS matched_by FROM routed i JOIN tagged o ON i.rsid = o.rsid_out AND src = src_o UNION ALL
           SELECT protein, platform, "Name", src, 'position' FROM routed i JOIN tagged o ON CASE WHEN i.chrom = 'X' THEN '23' ELSE i.chrom END = o.chrom_out AND i.pos = o.pos_out AND src = src_o
           WHERE NOT EXISTS (SELECT 1 FROM tagged x WHERE x.rsid_out = i.rsid AND x.src_o = i.src)""")
def _(t):
    routed = hz.route_outcomes(dv.instruments(t), {"Brand#1": "x_study"}, "main")
    o = dv.outcomes(t)
    tagged = o.withColumn("outcome_source", F.lit("main")).unionByName(o.filter(F.col("pos_out") % 3000 == 1000).withColumn("outcome_source", F.lit("x_study")))
    return hz.join_with_fallback(*hz.prepared_sides(routed, tagged), ["outcome_source"])


@query("absent_instruments", "protein:s platform:s n_absent:i",
       f"""WITH {dv.INSTRUMENTS}, {dv.OUTCOMES} SELECT protein, platform, count(*) AS n_absent FROM instruments i WHERE NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.rsid_out = i.rsid)
             AND NOT EXISTS (SELECT 1 FROM outcomes o WHERE CASE WHEN i.chrom = 'X' THEN '23' ELSE i.chrom END = o.chrom_out AND i.pos = o.pos_out) GROUP BY protein, platform""")
def _(t):
    return hz.absent_instruments(*hz.prepared_sides(dv.instruments(t), dv.outcomes(t)), ["protein", "platform"])


@query("alignment_counts", "protein:s platform:s n_direct:i n_swapped:i n_incompatible:i",
       f"""WITH {dv.ALIGNED} SELECT protein, platform, count(*) FILTER (WHERE m = 'direct') AS n_direct, count(*) FILTER (WHERE m = 'swapped') AS n_swapped,
           count(*) FILTER (WHERE m = 'incompatible') AS n_incompatible FROM matched GROUP BY protein, platform""")
def _(t):
    return hz.alignment_counts(hz.join_with_fallback(*hz.prepared_sides(dv.instruments(t), dv.outcomes(t))), ["protein", "platform"])


@query("harmonised_pairs", "protein:s platform:s rsid:s pos:i eaf_exp:d eaf_out:d beta_exp:d beta_out:d8 se_out:d8 palindromic:b strand_resolved:b",
       f"WITH {dv.HARMONISED} SELECT * FROM harmonised")
def _(t):
    return dv.harmonised(t)


# ---- estimates ------------------------------------------------------------------------------

MR = dv.HARMONISED + """, mr AS (
  SELECT *, exp(theta) AS "or", exp(theta - 1.96 * se_theta) AS ci_low, exp(theta + 1.96 * se_theta) AS ci_high, exp((1.96 + 0.842) * se_theta) AS min_detectable_or_80
  FROM (SELECT protein, platform, count(*) AS n_instruments, avg((beta_exp / se_exp)^2) AS "F", CASE WHEN count(*) = 1 THEN 'wald' ELSE 'ivw' END AS method,
          sum(beta_exp * beta_out / se_out^2) / sum(beta_exp^2 / se_out^2) AS theta, sqrt(1 / sum(beta_exp^2 / se_out^2)) AS se_theta,
          bool_or(NOT strand_resolved) AS has_strand_ambiguous FROM harmonised GROUP BY protein, platform)),
  mrv AS (SELECT *, CASE WHEN ci_low > 1 OR ci_high < 1 THEN 'positive' WHEN ci_low > 0.91 AND ci_high < 1.10 THEN 'null' ELSE 'inconclusive' END AS verdict FROM mr)"""


@query("mr_estimates", "protein:s platform:s n_instruments:i F:d4 method:s or:d ci_low:d ci_high:d min_detectable_or_80:d verdict:s has_strand_ambiguous:b",
       f"WITH {MR} SELECT * FROM mrv")
def _(t):
    return mr.estimates(dv.harmonised(t))


@query("mr_single_instruments", "protein:s platform:s pos:i n_instruments:i method:s or:d verdict:s",
       f"""WITH {dv.HARMONISED} SELECT *, CASE WHEN lo > 1 OR hi < 1 THEN 'positive' WHEN lo > 0.91 AND hi < 1.10 THEN 'null' ELSE 'inconclusive' END AS verdict FROM (
             SELECT protein, platform, pos, 1 AS n_instruments, 'wald' AS method, exp(beta_out / beta_exp) AS "or", exp(beta_out / beta_exp - 1.96 * abs(se_out / beta_exp)) AS lo,
                    exp(beta_out / beta_exp + 1.96 * abs(se_out / beta_exp)) AS hi FROM harmonised)""")
def _(t):
    return mr.estimates(dv.harmonised(t), ["protein", "platform", "pos"])


@query("mr_not_testable", "protein:s platform:s n_instruments:i ci_high:d verdict:s",
       f"""WITH {MR} SELECT protein, platform, n_instruments, ci_high, verdict FROM mrv UNION ALL SELECT p, 'both', 0, 0.0, 'not_testable' FROM (SELECT p_type AS p FROM part UNION SELECT p_brand FROM part) WHERE p NOT IN (SELECT protein FROM mrv)""")
def _(t):
    expected = t.part.select(F.col("p_type").alias("protein")).unionByName(t.part.select(F.col("p_brand").alias("protein")))
    return mr.with_not_testable(mr.estimates(dv.harmonised(t)), expected)


LOO = dv.HARMONISED + """, s AS (SELECT *, beta_exp^2 / se_out^2 AS w, beta_exp * beta_out / se_out^2 AS wy FROM harmonised),
  w AS (SELECT *, sum(w) OVER g AS tw, sum(wy) OVER g AS twy, count(*) OVER g AS n FROM s WINDOW g AS (PARTITION BY protein, platform)),
  l AS (SELECT *, (twy - wy) / (tw - w) AS t, sqrt(1 / (tw - w)) AS s1 FROM w WHERE n >= 2),
  loo AS (SELECT protein, platform, pos, w / tw AS weight_frac, beta_out / beta_exp AS wald_ratio, exp(t) AS loo_or, exp(t - 1.96 * s1) AS loo_ci_low, exp(t + 1.96 * s1) AS loo_ci_high,
    NOT (exp(t - 1.96 * s1) < 1 AND exp(t + 1.96 * s1) > 1) AS loo_excludes_null, NOT (exp(twy / tw - 1.96 * sqrt(1 / tw)) < 1 AND exp(twy / tw + 1.96 * sqrt(1 / tw)) > 1) AS full_excludes_null FROM l)"""


@query("leave_one_out", "protein:s platform:s pos:i weight_frac:d wald_ratio:d loo_or:d loo_ci_low:d loo_ci_high:d loo_excludes_null:b", f"WITH {LOO} SELECT * FROM loo")
def _(t):
    return mr.leave_one_out(dv.harmonised(t), ident="pos")


@query("instrument_influence", "protein:s platform:s loo_max_weight_frac:d loo_max_weight_id:i loo_verdict_stable:b",
       f"""WITH {LOO} SELECT protein, platform, max(weight_frac) AS loo_max_weight_frac, arg_max(pos, weight_frac) AS loo_max_weight_id,
           bool_and(loo_excludes_null = full_excludes_null) AS loo_verdict_stable FROM loo GROUP BY protein, platform""")
def _(t):
    return mr.influence(mr.leave_one_out(dv.harmonised(t), ident="pos"), ident="pos")


# p of Student's t with whole degrees of freedom, as its finite trigonometric series
EGGER = dv.HARMONISED + """, e AS (SELECT protein, platform, count(*) AS n, sum(w) AS s0, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * y * y) AS syy
    FROM (SELECT protein, platform, abs(beta_exp) AS x, CASE WHEN beta_exp < 0 THEN -beta_out ELSE beta_out END AS y, 1 / se_out^2 AS w FROM harmonised) GROUP BY protein, platform HAVING count(*) >= 3),
  d AS (SELECT *, (s0 * sxy - sx * sy) / (s0 * sxx - sx^2) AS slope, (sxx * sy - sx * sxy) / (s0 * sxx - sx^2) AS icept FROM e),
  v AS (SELECT *, (syy - icept * sy - slope * sxy) / (n - 2) AS s2 FROM d),
  tt AS (SELECT *, sqrt(s2 * s0 / (s0 * sxx - sx^2)) AS slope_se, icept / sqrt(s2 * sxx / (s0 * sxx - sx^2)) AS tv, n - 2 AS df FROM v),
  a AS (SELECT *, atan(tv / sqrt(df::DOUBLE)) AS th FROM tt),
  ser AS (SELECT protein, platform, sum(CASE WHEN df % 2 = 0 THEN exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) * cos(th)^(2 * k)
                                        ELSE exp(lgamma(0.5) + lgamma(k + 1.0) - lgamma(k + 1.5)) / 2 * cos(th)^(2 * k + 1) END) AS s
          FROM (SELECT *, unnest(range(0, CASE WHEN df % 2 = 0 THEN df // 2 ELSE (df - 1) // 2 END)) AS k FROM a) GROUP BY protein, platform)"""


@query("mr_egger", "protein:s platform:s n:i egger_slope:d egger_slope_se:d egger_intercept:d egger_intercept_p:d",
       f"""WITH {EGGER} SELECT a.protein, a.platform, n, slope AS egger_slope, slope_se AS egger_slope_se, icept AS egger_intercept,
           1 - abs(CASE WHEN df % 2 = 0 THEN sin(th) * s ELSE 2 / pi() * (th + CASE WHEN df > 1 THEN sin(th) * s ELSE 0 END) END) AS egger_intercept_p
           FROM a LEFT JOIN ser USING (protein, platform)""")
def _(t):
    return mr.egger(dv.harmonised(t))


WM = dv.HARMONISED + """, x AS (SELECT *, beta_out / beta_exp AS ratio, (beta_exp / se_out)^2 AS w FROM harmonised),
  c AS (SELECT *, sum(w) OVER (PARTITION BY protein, platform ORDER BY ratio, pos ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY protein, platform) AS cum, count(*) OVER (PARTITION BY protein, platform) AS n FROM x)"""


@query("weighted_median", "protein:s platform:s n:i wmedian_theta:d wmedian_or:d",
       f"""WITH {WM} SELECT protein, platform, max(n) AS n, min(ratio) AS wmedian_theta, exp(min(ratio)) AS wmedian_or FROM c WHERE cum >= 0.5 AND n >= 3 GROUP BY protein, platform""")
def _(t):
    return mr.weighted_median(dv.harmonised(t), ident="pos")


@query("weighted_median_bootstrap", "protein:s platform:s n_boot:i wmedian_se:d8",
       f"""WITH {dv.HARMONISED}, x AS (SELECT protein, platform, beta_out / beta_exp AS ratio, (beta_exp / se_out)^2 AS w, count(*) OVER (PARTITION BY protein, platform) AS n,
             row_number() OVER (PARTITION BY protein, platform ORDER BY beta_out / beta_exp, pos) AS d FROM harmonised),
           k AS (SELECT protein, platform, rep, {hw("protein", "platform", "rep", "d", "'wm'")} % n + 1 AS d, count(*) AS times FROM x, (SELECT unnest(range(1, 1001)) AS rep) WHERE n >= 3 GROUP BY ALL),
           p AS (SELECT k.*, ratio, w * times AS w FROM k JOIN x USING (protein, platform, d)),
           c AS (SELECT *, sum(w) OVER (PARTITION BY protein, platform, rep ORDER BY d ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY protein, platform, rep) AS cum FROM p),
           m AS (SELECT protein, platform, rep, min(ratio) AS theta FROM c WHERE cum >= 0.5 GROUP BY ALL)
           SELECT protein, platform, count(*) AS n_boot, stddev_samp(theta) AS wmedian_se FROM m GROUP BY protein, platform""")
def _(t):
    return mr.weighted_median_se(dv.harmonised(t), ident="pos", reps=1000)


def _studies(t):
    """Several outcome studies: the outcome table, scaled and thinned per study."""
    o = dv.outcomes(t)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("study"), F.lit(m).alias("m")) for s, m in (("cognitive", 1.0), ("motor", -0.5), ("composite", 0.25))]))
    return o.withColumn("e", each).filter(F.col("rsid_out").isNotNull()).select(
        F.col("e.study").alias("disease"), "rsid_out", "ea_out", "oa_out", (F.col("beta_out") * F.col("e.m")).alias("beta_out"), "se_out")


def _scan_sql(source: str) -> str:
    return dv.INSTRUMENTS + ", " + dv.OUTCOMES + f""", lead AS ({source}),
      st AS (SELECT disease, i.protein, i.platform, i.beta AS bx, o.se_out, CASE WHEN upper(i."effectAllele") = upper(ea_out) AND upper(i."otherAllele") = upper(oa_out) THEN 1
               WHEN upper(i."effectAllele") = upper(oa_out) AND upper(i."otherAllele") = upper(ea_out) THEN -1 END * beta_out * m0 AS by_
             FROM lead i JOIN outcomes o ON i.rsid = o.rsid_out, (VALUES ('cognitive', 1.0::DOUBLE), ('motor', -0.5), ('composite', 0.25)) v(disease, m0)),
      scan AS (SELECT protein, platform, disease, count(*) AS n_snp, sum(bx * by_ / se_out^2) / sum(bx^2 / se_out^2) AS beta, sqrt(1 / sum(bx^2 / se_out^2)) AS se FROM st WHERE by_ IS NOT NULL GROUP BY protein, platform, disease),
      scanp AS (SELECT *, exp(beta) AS "or", {normal_two_sided_p_sql("beta / se")} AS p FROM scan)"""


ALL_INST = "SELECT * FROM instruments"
LEAD = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY protein, platform ORDER BY pval, -\"F\", -pos, \"Name\") AS rn FROM instruments WHERE rsid IS NOT NULL) WHERE rn = 1"


@query("two_sample_scan", "protein:s platform:s disease:s n_snp:i beta:d se:d p:d8", f"WITH {_scan_sql(ALL_INST)} SELECT * FROM scanp")
def _(t):
    return mr.wald_scan(dv.instruments(t), _studies(t), ["protein", "platform", "disease"])


def _lead(t):
    i = dv.instruments(t).filter(F.col("rsid").isNotNull())
    return vr.strongest(i, ["protein", "platform"], vr.clump_order("pval", "F", "pos", "Name"), ["rsid", "beta", "se", "effectAllele", "otherAllele"])


def _phewas(t):
    return mr.wald_scan(_lead(t), _studies(t), ["protein", "platform", "disease"], n_tests=F.lit(3 * 2))


@query("phewas_scan", "protein:s platform:s disease:s or:d p:d8 hit:b", f"WITH {_scan_sql(LEAD)} SELECT *, p < 0.05 / 6 AS hit FROM scanp")
def _(t):
    return _phewas(t)


@query("pleiotropy_flags", "protein:s pleiotropy_flag:b pleiotropy_notes:s",
       f"""WITH {_scan_sql(LEAD)}, g AS (SELECT protein, bool_or(p < 0.05) AS f,
             string_agg(CASE WHEN p < 0.05 THEN printf('%s (OR=%.3f, p=%.4f)', disease, "or", p) END, '; ' ORDER BY disease) AS notes FROM scanp WHERE platform = 'a' GROUP BY protein)
           SELECT protein, f AS pleiotropy_flag, CASE WHEN f IS NULL THEN 'not in scan' WHEN f THEN notes ELSE 'no significant hits' END AS pleiotropy_notes
           FROM (SELECT DISTINCT p_brand AS protein FROM part UNION SELECT DISTINCT p_type FROM part) LEFT JOIN g USING (protein)""")
def _(t):
    wanted = t.part.select(F.col("p_brand").alias("protein")).unionByName(t.part.select(F.col("p_type").alias("protein")))
    return mr.pleiotropy(_phewas(t).filter("platform = 'a'"), wanted)


@query("power_bounds", "protein:s platform:s mde_or:d excludes_control_scale:s",
       f"""WITH {MR} SELECT protein, platform, exp((1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE) * se_theta) AS mde_or,
           CASE WHEN exp((1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE) * se_theta) < 1.01 THEN 'YES' ELSE 'NO' END AS excludes_control_scale FROM mrv""")
def _(t):
    return mr.power_bounds(mr.estimates(dv.harmonised(t)), 1.01)


@query("control_gate", "recovers_a:b recovers_b:b gate_applied:b gate_prespecified:b",
       f"""WITH {MR}, g AS (SELECT coalesce(bool_or("or" > 1 AND ci_low > 1) FILTER (WHERE platform = 'a'), false) AS a, coalesce(bool_or("or" > 1 AND ci_low > 1) FILTER (WHERE platform = 'b'), false) AS b FROM mrv WHERE protein = 'Brand#3')
           SELECT a AS recovers_a, b AS recovers_b, a AS gate_applied, a AND b AS gate_prespecified FROM g""")
def _(t):
    e = mr.estimates(dv.harmonised(t)).filter(F.col("protein") == "Brand#3")
    return mr.control_gate(e, "a", ["a", "b"])


# ---- colocalization ----------------------------------------------------------------------------


def _coloc_pairs(t):
    return _pairs_by_rsid(hz.join_with_fallback(*hz.prepared_sides(dv.instruments(t).filter(F.col("rsid").isNotNull()), dv.outcomes(t))))


def _pairs_by_rsid(joined):
    j = hz.align_alleles(joined.filter(F.col("matched_by") == "rsid"), drop_palindromic=True)
    return j.withColumnsRenamed({"beta": "b0", "se": "s0"}).withColumns({"beta_exp": F.col("b0") / 10, "se_exp": F.col("s0") / 3, "se_out": F.col("se_out") * 2})


COLOC = dv.ALIGNED + """, cp AS (SELECT protein, platform, pos, "Name", beta / 10 AS beta_exp, se / 3 AS se_exp, beta_out, se_out * 2 AS se_out FROM aligned WHERE matched_by = 'rsid' AND NOT palindromic),
  lb AS (SELECT *, 0.5 * (ln(1 - 0.0225 / (0.0225 + se_exp^2)) + 0.0225 / (0.0225 + se_exp^2) * (beta_exp / se_exp)^2) AS l1,
           0.5 * (ln(1 - 0.04 / (0.04 + se_out^2)) + 0.04 / (0.04 + se_out^2) * (beta_out / se_out)^2) AS l2 FROM cp),
  mx AS (SELECT *, max(l1) OVER g AS m1, max(l2) OVER g AS m2, max(l1 + l2) OVER g AS m3 FROM lb WINDOW g AS (PARTITION BY protein, platform)),
  ls AS (SELECT protein, platform, count(*) AS n_variants, max(m1) + ln(sum(exp(l1 - m1))) AS a1, max(m2) + ln(sum(exp(l2 - m2))) AS a2, max(m3) + ln(sum(exp(l1 + l2 - m3))) AS a3 FROM mx GROUP BY protein, platform),
  pk AS (SELECT *, greatest(0, a1, a2, a1 + a2, a3) AS pk FROM ls),
  ws AS (SELECT *, exp(-pk) AS w0, 1e-4 * exp(a1 - pk) AS w1, 1e-4 * exp(a2 - pk) AS w2, 1e-8 * greatest(0, exp(a1 + a2 - pk) - exp(a3 - pk)) AS w3, 1e-5 * exp(a3 - pk) AS w4 FROM pk),
  coloc AS (SELECT protein, platform, n_variants, n_variants >= 2 AS pp4_estimable, CASE WHEN n_variants >= 2 THEN w0 / (w0 + w1 + w2 + w3 + w4) END AS pp0, CASE WHEN n_variants >= 2 THEN w1 / (w0 + w1 + w2 + w3 + w4) END AS pp1,
    CASE WHEN n_variants >= 2 THEN w2 / (w0 + w1 + w2 + w3 + w4) END AS pp2, CASE WHEN n_variants >= 2 THEN w3 / (w0 + w1 + w2 + w3 + w4) END AS pp3,
    CASE WHEN n_variants >= 2 THEN w4 / (w0 + w1 + w2 + w3 + w4) ELSE 0 END AS pp4 FROM ws)"""


@query("coloc_pairs", "protein:s platform:s Name:s beta_exp:d beta_out:d8", f"WITH {COLOC} SELECT * FROM cp")
def _(t):
    return _coloc_pairs(t)


@query("coloc_posteriors", "protein:s platform:s n_variants:i pp4_estimable:b pp0:d pp1:d pp2:d pp3:d pp4:d", f"WITH {COLOC} SELECT * FROM coloc")
def _(t):
    return coloc.posteriors(_coloc_pairs(t), ["protein", "platform"])


CREDIBLE = COLOC + """, sm AS (SELECT protein, platform, "Name", pos, exp(l1 - m1) / sum(exp(l1 - m1)) OVER (PARTITION BY protein, platform) AS pp, l1 FROM mx),
  cc AS (SELECT *, sum(pp) OVER (PARTITION BY protein, platform ORDER BY l1 DESC, "Name" ROWS UNBOUNDED PRECEDING) AS cum_pp FROM sm), cs AS (SELECT * FROM cc WHERE cum_pp - pp < 0.95)"""


_BOTH_SETS = CREDIBLE + """, sm2 AS (SELECT protein, platform, "Name", l2, exp(l2 - m2) / sum(exp(l2 - m2)) OVER (PARTITION BY protein, platform) AS pp FROM mx),
  cc2 AS (SELECT *, sum(pp) OVER (PARTITION BY protein, platform ORDER BY l2 DESC, "Name" ROWS UNBOUNDED PRECEDING) AS cum_pp FROM sm2), cs2 AS (SELECT * FROM cc2 WHERE cum_pp - pp < 0.95)"""


@query("coloc_routing", "protein:s platform:s n_signals:i method_asked:s method_label:s estimable:b",
       f"""WITH {_BOTH_SETS}, sg AS (SELECT protein, platform, count(*) AS n_signals FROM instruments WHERE pval < 1e-9 GROUP BY 1, 2),
           h AS (SELECT protein, platform, count(*) AS nh, count(*) FILTER (se > 0 AND se_out > 0 AND beta IS NOT NULL AND beta_out IS NOT NULL) AS nu FROM aligned GROUP BY 1, 2),
           pn AS (SELECT protein, platform, count(*) AS np FROM instruments WHERE chrom IN ('1', '2', '3') GROUP BY 1, 2),
           ns AS (SELECT cs.protein, cs.platform, count(*) AS ns FROM cs JOIN cs2 USING (protein, platform, "Name") GROUP BY 1, 2),
           r AS (SELECT protein, platform, n_signals, CASE WHEN n_signals > 1 THEN 'multi_signal' ELSE 'abf' END AS method_asked, coalesce(nh, 0) AS nh, coalesce(nu, 0) AS nu, coalesce(ns, 0) AS ns,
                   CASE WHEN n_signals > 1 AND coalesce(np, 0) < 10 THEN 'abf_fallback' WHEN n_signals > 1 THEN 'multi_signal' ELSE 'abf' END AS used
                 FROM sg LEFT JOIN h USING (protein, platform) LEFT JOIN pn USING (protein, platform) LEFT JOIN ns USING (protein, platform)),
           l AS (SELECT *, CASE WHEN nh < 5 THEN method_asked || '_nodata' WHEN nu = 0 THEN used || '_error' WHEN used = 'multi_signal' AND ns = 0 THEN 'multi_signal_noCS' ELSE used END AS method_label FROM r)
           SELECT protein, platform, n_signals, method_asked, method_label, NOT regexp_matches(method_label, '_(nodata|error|noCS)$') AS estimable FROM l""")
def _(t):
    # Instruments and pruned outcomes are written once, and so are the joined rows; all counts and pairs come from them.
    keys, (i, o) = ["protein", "platform"], hz.prepared_sides(dv.instruments(t), dv.outcomes(t))
    joined = cut_lineage(hz.join_with_fallback(i, o))
    sg = coloc.signal_counts(i.filter(F.col("pval") < 1e-9), keys)
    good = (F.col("se") > 0) & (F.col("se_out") > 0) & F.col("beta").isNotNull() & F.col("beta_out").isNotNull()
    h = hz.align_alleles(joined).groupBy(*keys).agg(F.count(F.lit(1)).alias("nh"), F.count_if(good).alias("nu"))
    pn = i.filter(F.col("chrom").isin("1", "2", "3")).groupBy(*keys).agg(F.count(F.lit(1)).alias("np"))
    pairs = cut_lineage(_pairs_by_rsid(joined).select(*keys, "Name", "beta_exp", "se_exp", "beta_out", "se_out"))
    shared = coloc.set_overlap(coloc.credible_sets(pairs, keys, "Name", "beta_exp", "se_exp"),
                               coloc.credible_sets(pairs, keys, "Name", "beta_out", "se_out", coloc.SD_BINARY), keys, "Name").withColumnRenamed("n_shared", "ns")
    loci = sg.join(h, keys, "left").join(pn, keys, "left").join(shared, keys, "left")
    return coloc.route_method(loci, "n_signals", "nh", "np", "nu", "ns").withColumn("estimable", coloc.estimable(F.col("method_label"), F.lit(0.0)))


@query("platform_union", "platform:s n:i n_proteins:i", f"""WITH {dv.INSTRUMENTS} SELECT platform, count(*) AS n, count(DISTINCT protein) AS n_proteins FROM instruments GROUP BY platform""")
def _(t):
    i = dv.instruments(t)
    each = {p: i.filter(F.col("platform") == p).drop("platform") for p in ("a", "b")}
    return hz.union_platforms(**each).groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("protein").alias("n_proteins"))


@query("credible_sets", "protein:s platform:s Name:s pp:d cum_pp:d", f"WITH {CREDIBLE} SELECT * FROM cs")
def _(t):
    return coloc.credible_sets(_coloc_pairs(t), ["protein", "platform"], "Name", "beta_exp", "se_exp")


@query("credible_set_overlap", "protein:s n_shared:i",
       f"""WITH {CREDIBLE} SELECT a.protein, count(*) AS n_shared FROM cs a JOIN cs b ON a.protein = b.protein AND a."Name" = b."Name" AND a.platform = 'a' AND b.platform = 'b' GROUP BY a.protein""")
def _(t):
    cs = coloc.credible_sets(_coloc_pairs(t), ["protein", "platform"], "Name", "beta_exp", "se_exp")
    return coloc.set_overlap(cs.filter(F.col("platform") == "a"), cs.filter(F.col("platform") == "b"), ["protein"], "Name")


@query("causal_calls", "protein:s platforms_tested:i a_verdict:s b_verdict:s a_or:d b_or:d a_pp4:d b_pp4:d causal_call:s",
       f"""WITH {COLOC}, {MR[MR.index("distances AS"):]},
           p AS (SELECT DISTINCT p_brand AS protein FROM part),
           m AS (SELECT protein, max(verdict) FILTER (WHERE platform = 'a') AS a_verdict, max(verdict) FILTER (WHERE platform = 'b') AS b_verdict, max("or") FILTER (WHERE platform = 'a') AS a_or,
                   max("or") FILTER (WHERE platform = 'b') AS b_or FROM mrv GROUP BY protein),
           c AS (SELECT protein, max(pp4) FILTER (WHERE platform = 'a') AS a_pp4, max(pp4) FILTER (WHERE platform = 'b') AS b_pp4 FROM coloc GROUP BY protein),
           gates AS (SELECT (SELECT coalesce(bool_or("or" > 1 AND ci_low > 1), false) FROM mrv WHERE protein = 'Brand#3' AND platform = 'a')
                            AND (SELECT coalesce(bool_or(pp4 >= 0.8), false) FROM coloc WHERE protein = 'Brand#3') AS ok)
           SELECT *, CAST(a_verdict IS NOT NULL AS INT) + CAST(b_verdict IS NOT NULL AS INT) AS platforms_tested,
             CASE WHEN a_verdict IS NOT NULL AND b_verdict IS NOT NULL THEN
               CASE WHEN a_verdict = 'null' AND b_verdict = 'null' THEN CASE WHEN coalesce(a_pp4, 0) < 0.8 AND coalesce(b_pp4, 0) < 0.8 AND gates.ok THEN 'null' ELSE 'inconclusive' END
                    WHEN a_verdict = b_verdict THEN CASE WHEN a_verdict = 'positive' AND greatest(coalesce(a_pp4, 0), coalesce(b_pp4, 0)) >= 0.8 THEN 'positive' ELSE 'inconclusive' END
                    ELSE 'discordant' END
             WHEN coalesce(a_verdict, b_verdict) = 'positive' AND coalesce(a_pp4, b_pp4, 0) >= 0.8 THEN 'positive' ELSE 'inconclusive' END AS causal_call
           FROM (p LEFT JOIN m USING (protein) LEFT JOIN c USING (protein)), gates""")
def _(t):
    est = mr.estimates(dv.harmonised(t))
    cl = coloc.posteriors(_coloc_pairs(t), ["protein", "platform"])
    control = F.col("protein") == "Brand#3"
    recovered = mr.control_gate(est.filter(control), "a", ["a", "b"]).select("gate_applied").scalar()
    shared = cl.filter(control).agg(F.coalesce(F.bool_or(F.col("pp4") >= 0.8), F.lit(False))).scalar()
    return mr.causal_call(est, cl, t.part.select(F.col("p_brand").alias("protein")), "a", "b", recovered, shared)


# ---- linkage disequilibrium: embedding dimensions as variants, vectors as samples -----------------------

KB = 12


def _variants(t):
    """One variant per dimension, from the widest vector: position = dimension * 1000 on one chromosome of four."""
    top = t.embeddings.agg(F.max(F.size("embedding")).alias("w"))
    return top.select(F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("dim")).select(
        F.col("dim").alias("variant"), (F.col("dim") * 1000).cast("long").alias("pos"), F.floor(F.col("dim") / 16).cast("string").alias("chrom"))


def _dosages(t):
    return t.embeddings.select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("variant", "dosage"))


def _edges(t, min_r2=0.0):
    v = _variants(t).withColumn("pos", F.col("pos") % 16000)
    return ld.ld_pairs(_dosages(t), v, KB, min_r2=min_r2)


LD = f"""d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
  ld AS (SELECT a.dim AS a, b.dim AS b, a.dim // 16 AS locus, count(*) AS n, corr(a.x, b.x) AS r, corr(a.x, b.x)^2 AS r2 FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.dim < b.dim
           AND a.dim // 16 = b.dim // 16 AND b.dim - a.dim <= {KB} GROUP BY a.dim, b.dim)"""


@query("ld_pairs", "a:i b:i n:i r:d r2:d", f"WITH {LD} SELECT * FROM ld")
def _(t):
    return _edges(t)


def _assoc(t):
    """Association of each dimension with the label."""
    e = t.embeddings.select("label", F.posexplode("embedding").alias("variant", "x"))
    g = e.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("label", "x").alias("beta"), F.regr_sxx("label", "x").alias("sxx"),
                                 F.regr_syy("label", "x").alias("syy"), F.regr_sxy("label", "x").alias("sxy"))
    se = F.sqrt((F.col("syy") - F.col("beta") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    g = g.withColumn("se", se).withColumns({"F": (F.col("beta") / F.col("se")) * (F.col("beta") / F.col("se")), "pval": normal_two_sided_p(F.col("beta") / F.col("se"))})
    return g.select("variant", F.floor(F.col("variant") / 16).alias("locus"), (F.col("variant") % 16 * 1000).alias("pos"), "F", "pval")


ASSOC = LD + f""", g AS (SELECT dim, count(*) AS n, regr_slope(label, x) AS beta, regr_sxx(label, x) AS sxx, regr_syy(label, x) AS syy, regr_sxy(label, x) AS sxy FROM d JOIN embeddings USING (vec_id) GROUP BY dim),
  assoc AS (SELECT dim, dim // 16 AS locus, (beta / se)^2 AS "F", {normal_two_sided_p_sql("beta / se")} AS pval FROM (SELECT *, sqrt((syy - beta * sxy) / (n - 2) / sxx) AS se FROM g))"""
R2_CUT = 0.003
CLUMP = ASSOC.replace("d AS (", "RECURSIVE d AS (", 1) + f""", nb AS (SELECT v, list(o) AS near FROM (SELECT a AS v, b AS o FROM ld WHERE r2 >= {R2_CUT} UNION ALL SELECT b, a FROM ld WHERE r2 >= {R2_CUT}) GROUP BY v),
  ord AS (SELECT dim, locus, coalesce(near, []) AS near, row_number() OVER (ORDER BY pval, -"F", -(dim % 16 * 1000), dim) AS k FROM assoc LEFT JOIN nb ON v = dim WHERE pval <= 0.9),
  go AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT ord.k, CASE WHEN list_has_any(go.kept, ord.near) THEN go.kept ELSE list_append(go.kept, ord.dim) END FROM go JOIN ord ON ord.k = go.k + 1),
  idx AS (SELECT unnest(kept) AS variant FROM go WHERE k = (SELECT max(k) FROM ord))"""


def _clumped(t):
    return ld.clump(_assoc(t), _edges(t, R2_CUT), "locus", "variant", vr.clump_order("pval", "F", "pos", "variant"), p="pval", p1=0.9, r2=R2_CUT)


@query("ld_clump", "locus:i variant:i", f"WITH {CLUMP} SELECT variant // 16 AS locus, variant FROM idx")
def _(t):
    return _clumped(t)


@query("clump_with_fallback", "locus:i variant:i fallback:b",
       f"""WITH {CLUMP.replace("WHERE pval <= 0.9", "WHERE pval <= 0.9 AND locus <> 2")}
           SELECT variant // 16 AS locus, variant, false AS fallback FROM idx UNION ALL SELECT 2, arg_max(dim, "F"), true FROM assoc WHERE locus = 2""")
def _(t):
    panel = _variants(t).select(F.col("variant").cast("int").alias("variant")).filter(F.floor(F.col("variant") / 16) != 2)
    return ld.clump_or_strongest(_assoc(t), _edges(t, R2_CUT), panel, "locus", "variant", vr.clump_order("pval", "F", "pos", "variant"),
                                 p="pval", strength="F", p1=0.9, r2=R2_CUT)


@query("signal_counts", "locus:i n_signals:i", f"WITH {CLUMP} SELECT variant // 16 AS locus, count(*) AS n_signals FROM idx GROUP BY 1")
def _(t):
    return coloc.signal_counts(_clumped(t), ["locus"])


CROSS = ASSOC + """, x AS (SELECT a, b, r2, a % 3 AS pa, b % 3 AS pb FROM ld WHERE a % 3 <> b % 3)"""


def _cross(t):
    inst = _assoc(t).withColumn("platform", F.concat(F.lit("p"), (F.col("variant") % 3).cast("string")))
    return ld.cross_platform_ld(_edges(t), inst, strong=0.01), inst


@query("cross_platform_ld", "a:i b:i platform_a:s platform_b:s r2:d strong:b", f"WITH {CROSS} SELECT a, b, 'p' || pa AS platform_a, 'p' || pb AS platform_b, r2, r2 > 0.01 AS strong FROM x")
def _(t):
    return _cross(t)[0]


@query("best_cross_partner", "platform:s variant:i F:d max_cross_r2:d",
       f"""WITH {CROSS}, top AS (SELECT 'p' || dim % 3 AS platform, arg_max(dim, "F") AS variant, max("F") AS "F" FROM assoc GROUP BY 1)
           SELECT platform, variant, max(top."F") AS "F", max(r2) AS max_cross_r2 FROM top LEFT JOIN x ON a = variant OR b = variant GROUP BY platform, variant""")
def _(t):
    cross, inst = _cross(t)
    return ld.best_partner(cross, inst)


def _annotation(t):
    """Annotation table from the event log: an event's variant, its transcripts and their consequence terms."""
    terms = F.array(*[F.lit(x) for x in ("intron_variant", "missense_variant", "stop_gained", "synonymous_variant", "upstream_gene_variant")])
    term = F.element_at(terms, (F.floor("value") % 5 + 1).cast("int"))
    width = t.embeddings.agg(F.max(F.size("embedding"))).scalar()
    rows = t.events.select((F.col("user_id") % width).alias("variant"), F.col("event_id") % 4, term.alias("term"))
    tr = rows.groupBy("variant", "(event_id % 4)").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return tr.groupBy("variant").agg(F.collect_list(F.struct("terms")).alias("transcripts"))


ANN = """an AS (SELECT user_id % (SELECT max(len(embedding)) FROM embeddings) AS variant, array_to_string(list_sort(list(DISTINCT ['intron_variant', 'missense_variant', 'stop_gained', 'synonymous_variant', 'upstream_gene_variant'][CAST(floor(value) AS BIGINT) % 5 + 1])), ',') AS terms,
    bool_or(CAST(floor(value) AS BIGINT) % 5 IN (1, 2)) AS coding FROM events GROUP BY 1)"""


def _annotated(t):
    return ld.annotate_consequences(_cross(t)[1].withColumn("platform", F.when(F.col("variant") % 3 == 0, "a").otherwise("b")), _annotation(t))


@query("consequence_annotation", "variant:i platform:s terms:s coding:b",
       f"WITH {ANN} SELECT i.variant, CASE WHEN i.variant % 3 = 0 THEN 'a' ELSE 'b' END AS platform, terms, coding FROM (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS variant) i LEFT JOIN an USING (variant)")
def _(t):
    return _annotated(t).withColumn("terms", F.array_join("consequences", ","))


@query("coding_verdict", "n_annotated:i coding_a:i coding_b:i verdict:s",
       f"""WITH {ANN}, c AS (SELECT count(coding) AS n_annotated, count(*) FILTER (WHERE coding AND i.variant % 3 = 0) AS coding_a, count(*) FILTER (WHERE coding AND i.variant % 3 <> 0) AS coding_b
             FROM (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS variant) i LEFT JOIN an USING (variant))
           SELECT *, CASE WHEN coding_a = 0 AND coding_b = 0 THEN 'none_coding' WHEN coding_a > coding_b THEN 'concentrated_on_a' ELSE 'coding_present' END AS verdict FROM c""")
def _(t):
    return ld.coding_verdict(_annotated(t), "a", "b")
