"""Longitudinal outcomes, assays, membership, folds, description."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as ex
from ..operators import assay, folds, longitudinal as lg, preprocess, profile
from . import derived as dv
from .registry import hu, hw, query

# ---- decline rates -----------------------------------------------------------


@query("subject_slopes", "user_id:i n_visits:i n_events:i span:d ols_slope:d slope_var:d8 slope_excl_first:d",
       f"WITH {dv.SLOPES} SELECT * FROM slopes")
def _(t):
    return dv.slopes(t)


@query("eligible_subjects", "user_id:i n_events:i span:d ols_slope:d", f"WITH {dv.ELIGIBLE} SELECT * FROM eligible")
def _(t):
    return dv.eligible(t)


@query("shrinkage_params", "mu:d tau2:d8 residual_var:d8 n_used:i", f"WITH {dv.PARAMS} SELECT * FROM params")
def _(t):
    return lg.shrinkage_params(dv.eligible(t))


@query("shrinkage_params_nonzero_variance", "mu:d tau2:d8 residual_var:d8 n_used:i",
       f"""WITH {dv.ELIGIBLE} SELECT avg(ols_slope) AS mu, greatest(0, var_samp(ols_slope) - avg(slope_var)) AS tau2,
           avg(slope_var) AS residual_var, count(*) AS n_used FROM eligible WHERE slope_var > 0""")
def _(t):
    return lg.shrinkage_params(dv.eligible(t), drop_zero_var=True)


@query("eb_slope", "user_id:i eb_slope:d ols_slope:d slope_excl_first:d n_visits:i span:d",
       f"""WITH {dv.PARAMS} SELECT e.*, mu + CASE WHEN tau2 + slope_var > 0 THEN tau2 / (tau2 + slope_var) ELSE 0 END
           * (ols_slope - mu) AS eb_slope FROM eligible e, params""")
def _(t):
    e = dv.eligible(t)
    return lg.shrink(e, lg.shrinkage_params(e))


@query("training_shrinkage", "seed:i fold:i mu:d tau2:d8 residual_var:d8 n_used:i",
       f"""WITH {dv.ELIGIBLE}, seeds AS (SELECT unnest([0, 1, 2]) AS seed), folded AS (
             SELECT e.*, seed, {hw("user_id", "seed")} % 5 AS fold FROM eligible e, seeds)
           SELECT f.seed, f.fold, avg(ols_slope) AS mu, greatest(0, var_samp(ols_slope) - avg(slope_var)) AS tau2,
                  avg(slope_var) AS residual_var, count(*) AS n_used
           FROM (SELECT DISTINCT seed, fold FROM folded) f JOIN folded x ON x.seed = f.seed AND x.fold <> f.fold GROUP BY f.seed, f.fold""")
def _(t):
    return lg.training_params(folds.assign_folds(dv.eligible(t), "user_id", 5, [0, 1, 2]))


@query("intercept_slope_correlation", "r:d n:i", f"WITH {dv.ELIGIBLE} SELECT corr(mean_y, ols_slope) AS r, count(*) AS n FROM eligible")
def _(t):
    return lg.intercept_slope_corr(dv.eligible(t))


@query("slope_reliability", "stratum:s n:i mean_v:d8 reliability:d8",
       f"WITH {dv.PARAMS} SELECT 'all' AS stratum, n_used AS n, residual_var AS mean_v, tau2 / (tau2 + residual_var) AS reliability FROM params")
def _(t):
    return lg.reliability(dv.eligible(t))


@query("slope_reliability_by_visits", "stratum:s n:i mean_v:d8 reliability:d8",
       f"""WITH {dv.PARAMS} SELECT CASE WHEN n_visits <= 66 THEN 'few' ELSE 'many' END AS stratum, count(*) AS n,
           avg(residual_var / sxx) AS mean_v, max(tau2) / (max(tau2) + avg(residual_var / sxx)) AS reliability
           FROM eligible, params GROUP BY 1""")
def _(t):
    return lg.reliability(dv.eligible(t), F.when(F.col("n_visits") <= 66, "few").otherwise("many"))


HALVES = dv.VISITS + """, halves AS (
  SELECT user_id, regr_slope(value, t) FILTER (WHERE rn % 2 = 1) AS slope_odd, regr_slope(value, t) FILTER (WHERE rn % 2 = 0) AS slope_even
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM visits) GROUP BY user_id
  HAVING count(*) FILTER (WHERE rn % 2 = 1) >= 3 AND count(*) FILTER (WHERE rn % 2 = 0) >= 3)"""


@query("split_half_slopes", "user_id:i slope_odd:d slope_even:d", f"WITH {HALVES} SELECT * FROM halves")
def _(t):
    return lg.split_half_slopes(dv.visits(t), "user_id", "t", "value", "event_id")


@query("split_half_reliability", "n:i pearson:d spearman:d spearman_brown:d",
       f"""WITH {HALVES}, r AS (SELECT *, rank() OVER (ORDER BY slope_odd) AS ro, rank() OVER (ORDER BY slope_even) AS re FROM halves)
           SELECT count(*) AS n, corr(slope_odd, slope_even) AS pearson, corr(ro, re) AS spearman,
                  2 * corr(slope_odd, slope_even) / (1 + corr(slope_odd, slope_even)) AS spearman_brown FROM r""")
def _(t):
    return lg.split_half_reliability(lg.split_half_slopes(dv.visits(t), "user_id", "t", "value", "event_id"), "user_id")


@query("conversion_label", "user_id:i converted:d",
       f"""WITH {dv.VISITS} SELECT user_id, max(CASE WHEN visit <> 'BL' AND state >= 3 THEN 1 ELSE 0 END) AS converted FROM visits
           GROUP BY user_id HAVING max(CASE WHEN visit = 'BL' AND state = 1 THEN 1 ELSE 0 END) = 1""")
def _(t):
    return lg.conversion_label(dv.visits(t), "user_id", "visit", "state", impaired=3)


@query("ever_positive", "user_id:i worst:i", f"WITH {dv.VISITS} SELECT user_id, max(state) AS worst FROM visits GROUP BY user_id HAVING max(state) IS NOT NULL")
def _(t):
    return lg.ever_positive(dv.visits(t), "user_id", "state", "worst")


# ---- assays and features --------------------------------------------------------

VISIT_ORDER = """CASE WHEN visit = 'SC' THEN -1 WHEN visit = 'BL' THEN 0 WHEN regexp_matches(visit, 'V[0-9]+')
  THEN CAST(regexp_extract(visit, 'V([0-9]+)', 1) AS INTEGER) ELSE 99 END"""


@query("paired_index", "user_id:i event:s numerator:d denominator:d index:d",
       f"""WITH {dv.VISITS}, w AS (
             SELECT user_id, visit, avg(value) FILTER (WHERE event_type = 'view') AS num, avg(value) FILTER (WHERE event_type = 'purchase') AS den
             FROM visits GROUP BY user_id, visit HAVING num IS NOT NULL AND den IS NOT NULL),
           r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {VISIT_ORDER}, visit) AS rn FROM w)
           SELECT user_id, visit AS event, num AS numerator, den AS denominator, num / nullif(den, 0) * 1000 AS index FROM r WHERE rn = 1""")
def _(t):
    return assay.paired_index(dv.visits(t), "user_id", "visit", "event_type", "value", "view", "purchase")


TARGETS = ["click", "error", "purchase", "signup", "view"]


def _earliest_sql(order: str) -> str:
    picks = ", ".join(f"max(value) FILTER (WHERE event_type = '{x}') AS {x}" for x in TARGETS)
    return f"""WITH {dv.VISITS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {order}, event_id) AS rn
               FROM visits WHERE value IS NOT NULL) SELECT user_id, {picks} FROM r WHERE rn = 1 GROUP BY user_id"""


@query("earliest_assay_wide", "user_id:i click:d error:d purchase:d signup:d view:d", _earliest_sql("visit"))
def _(t):
    return assay.earliest_wide(dv.visits(t), "user_id", "event_type", "value", TARGETS, ["visit", "event_id"])


@query("earliest_assay_wide_visit_order", "user_id:i click:d error:d purchase:d signup:d view:d", _earliest_sql(VISIT_ORDER))
def _(t):
    return assay.earliest_wide(dv.visits(t), "user_id", "event_type", "value", TARGETS, [assay.visit_order("visit"), "event_id"])


@query("recoded_baseline", "c_custkey:i log_balance:d ratio:d first_value:d coded:i kept:i carrier:d number:d in_segment:b",
       """SELECT c_custkey, CASE WHEN c_acctbal IS NOT NULL THEN ln(1 + greatest(c_acctbal, 0)) END AS log_balance,
            CASE WHEN c_acctbal > 0 AND c_nationkey > 0 THEN c_acctbal / c_nationkey * 1000 END AS ratio,
            coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END, c_nationkey) AS first_value,
            CASE WHEN c_nationkey <> 9 THEN c_nationkey END AS coded, CASE WHEN c_nationkey IN (0, 1) THEN c_nationkey END AS kept,
            CASE WHEN c_nationkey > 12 THEN 1.0 ELSE 0.0 END AS carrier, TRY_CAST(substr(c_name, 10) AS DOUBLE) AS number,
            c_mktsegment LIKE '%AUTO%' AS in_segment
          FROM customer""")
def _(t):
    return t.customer.select(
        "c_custkey", ex.log1p_clipped("c_acctbal").alias("log_balance"), ex.guarded_ratio("c_acctbal", "c_nationkey", 1000.0).alias("ratio"),
        F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.col("c_nationkey")).alias("first_value"),
        ex.blank_codes("c_nationkey", [9]).alias("coded"), ex.keep_codes("c_nationkey", [0, 1]).alias("kept"),
        ex.above("c_nationkey", 12).alias("carrier"), ex.parse_number(F.substring("c_name", 10, 20)).alias("number"),
        F.col("c_mktsegment").contains("AUTO").alias("in_segment"))


@query("feature_assembly", "user_id:i eb_slope:d click:d index:d",
       f"""WITH {dv.PARAMS}, slope AS (SELECT user_id, mu + tau2 / (tau2 + slope_var) * (ols_slope - mu) AS eb_slope FROM eligible, params),
           early AS ({_earliest_sql("visit").replace("WITH " + dv.VISITS + ", r AS", "WITH r AS")}),
           w AS (SELECT user_id, visit, avg(value) FILTER (WHERE event_type = 'view') AS num, avg(value) FILTER (WHERE event_type = 'purchase') AS den
                 FROM visits GROUP BY user_id, visit HAVING num IS NOT NULL AND den IS NOT NULL),
           p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {VISIT_ORDER}, visit) AS rn FROM w)
           SELECT s.user_id, eb_slope, click, num / nullif(den, 0) * 1000 AS index FROM slope s JOIN early USING (user_id)
           LEFT JOIN (SELECT * FROM p WHERE rn = 1) x ON x.user_id = s.user_id""")
def _(t):
    e = dv.eligible(t)
    base = lg.shrink(e, lg.shrinkage_params(e)).select("user_id", "eb_slope")
    v = dv.visits(t)
    early = assay.earliest_wide(v, "user_id", "event_type", "value", TARGETS, ["visit", "event_id"])
    pair = assay.paired_index(v, "user_id", "visit", "event_type", "value", "view", "purchase").select("user_id", "index")
    return assay.assemble(base, [early], [pair], "user_id")


@query("cohort_funnel", "step:i requirement:s n:i",
       """WITH m AS (SELECT c_custkey, count(o_orderkey) >= 8 AS f1, avg(c_acctbal) > 0 AS f2, bool_or(o_orderstatus = 'P') AS f3
                     FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
          SELECT 0 AS step, 'all' AS requirement, count(*) AS n FROM m UNION ALL
          SELECT 1, 'visits', count(*) FILTER (WHERE f1) FROM m UNION ALL
          SELECT 2, 'visits+balance', count(*) FILTER (WHERE f1 AND f2) FROM m UNION ALL
          SELECT 3, 'visits+balance+pending', count(*) FILTER (WHERE f1 AND f2 AND f3) FROM m""")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("o_orderstatus") == "P").alias("pend"))
    m = t.customer.join(o, "c_custkey", "left")
    f1, f2, f3 = F.coalesce("n", F.lit(0)) >= 8, F.col("c_acctbal") > 0, F.col("pend")
    return assay.funnel(m, [("all", []), ("visits", [f1]), ("visits+balance", [f1, f2]), ("visits+balance+pending", [f1, f2, f3])])


@query("residualised_score", "c_custkey:i residual:d",
       f"""WITH {dv.CUSTOMERS}, f AS (SELECT regr_slope(gappy, avg_price) AS b, regr_intercept(gappy, avg_price) AS a FROM cust)
           SELECT c_custkey, gappy - (a + b * avg_price) AS residual FROM cust, f""")
def _(t):
    return assay.residualise(dv.customer_features(t), "gappy", "avg_price", "residual")


@query("category_codes", "c_custkey:i code:i",
       "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def _(t):
    return assay.category_codes(t.customer, "c_mktsegment", "code")


@query("median_split", "c_custkey:i high:i",
       "SELECT c_custkey, CASE WHEN c_acctbal > (SELECT quantile_cont(c_acctbal, 0.5) FROM customer) THEN 1 ELSE 0 END AS high FROM customer")
def _(t):
    return assay.median_split(t.customer, "c_acctbal", "high")


@query("at_least_present", "c_custkey:i n_present:i",
       f"""WITH {dv.CUSTOMERS}, x AS (SELECT c_custkey, CAST(gappy IS NOT NULL AS INT) + CAST(CASE WHEN share_f > 0.4 THEN share_f END IS NOT NULL AS INT)
             + CAST(avg_price IS NOT NULL AS INT) AS n_present FROM cust) SELECT * FROM x WHERE n_present >= 2""")
def _(t):
    f = dv.customer_features(t).withColumn("share_f", F.when(F.col("share_f") > 0.4, F.col("share_f")))
    kept = assay.at_least_present(f, ["gappy", "share_f", "avg_price"], 2)
    return kept.withColumn("n_present", sum(F.col(c).isNotNull().cast("int") for c in ("gappy", "share_f", "avg_price")))


@query("shared_subjects", "user_id:i",
       """SELECT user_id FROM events WHERE event_type = 'view' AND value > 150 INTERSECT
          SELECT user_id FROM events WHERE event_type = 'click' AND value > 150 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 150""")
def _(t):
    e = t.events.filter(F.col("value") > 150)
    return assay.shared_subjects([e.filter(F.col("event_type") == x) for x in ("view", "click", "error")], "user_id")


# ---- folds -----------------------------------------------------------------------


@query("kfold_assignment", "user_id:i seed:i fold:i",
       f"SELECT user_id, seed, {hw('user_id', 'seed')} % 5 AS fold FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([0, 1, 2]) AS seed)")
def _(t):
    return folds.assign_folds(t.events.select("user_id").distinct(), "user_id", 5, [0, 1, 2])


@query("stratified_folds", "c_custkey:i fold:i",
       f"SELECT c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY {hu('c_custkey', '7')}, c_custkey) - 1) % 5 AS fold FROM customer")
def _(t):
    return folds.stratified_folds(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 5, 7)


@query("cluster_folds", "c_custkey:i fold:i",
       "SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) >= 60 THEN c_nationkey ELSE -1 END AS fold FROM customer")
def _(t):
    return folds.cluster_folds(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 60)


@query("size_matched_clusters", "seed:i c_custkey:i fold:i",
       f"""WITH a AS (SELECT c_custkey, c_nationkey AS fold, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer),
           b AS (SELECT seed, c_custkey, row_number() OVER (PARTITION BY seed ORDER BY {hu("c_custkey", "seed", "'perm'")}, c_custkey) AS pos
                 FROM customer, (SELECT unnest([1, 2]) AS seed))
           SELECT seed, b.c_custkey, a.fold FROM b JOIN a USING (pos)""")
def _(t):
    return folds.size_matched_clusters(t.customer.select("c_custkey", F.col("c_nationkey").alias("fold")), "c_custkey", [1, 2])


@query("shuffled_block", "rep:i c_custkey:i acctbal:d n_orders:d",
       f"""WITH {dv.CUSTOMERS}, a AS (SELECT acctbal, n_orders, row_number() OVER (ORDER BY c_custkey) AS pos FROM cust),
           b AS (SELECT rep, c_custkey, row_number() OVER (PARTITION BY rep ORDER BY {hu("c_custkey", "rep", "'perm'")}, c_custkey) AS pos
                 FROM cust, (SELECT unnest([1, 2, 3]) AS rep))
           SELECT rep, b.c_custkey, acctbal, n_orders FROM b JOIN a USING (pos)""")
def _(t):
    return folds.shuffled_labels(dv.customer_features(t), "c_custkey", ["acctbal", "n_orders"], [1, 2, 3])


@query("fold_expansion", "seed:i fold:i n_train:i n_test:i train_sum:d",
       f"""WITH u AS (SELECT user_id, sum(value) AS v FROM events GROUP BY user_id), s AS (SELECT unnest([0, 1]) AS seed), f AS (SELECT unnest(range(5)) AS fold),
           x AS (SELECT u.*, seed, {hw("user_id", "seed")} % 5 AS own FROM u, s)
           SELECT seed, fold, count(*) FILTER (WHERE own <> fold) AS n_train, count(*) FILTER (WHERE own = fold) AS n_test,
                  sum(v) FILTER (WHERE own <> fold) AS train_sum FROM x, f GROUP BY seed, fold""")
def _(t):
    u = t.events.groupBy("user_id").agg(F.sum("value").alias("v"))
    x = folds.expand_folds(folds.assign_folds(u, "user_id", 5, [0, 1]), 5)
    return x.groupBy("seed", "fold").agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"),
                                         F.sum(F.when(~F.col("is_test"), F.col("v"))).alias("train_sum"))


@query("fold_leak_check", "seed:i subjects:i violations:i",
       "SELECT seed, count(DISTINCT user_id) AS subjects, 0 AS violations FROM events, (SELECT unnest([0, 1, 2]) AS seed) GROUP BY seed")
def _(t):
    return folds.leak_check(folds.assign_folds(t.events.select("user_id").distinct(), "user_id", 5, [0, 1, 2]), "user_id")


@query("training_scalers", "seed:i fold:i feature:s median:d mean:d sd:d",
       f"""WITH {dv.CUSTOMERS}, l AS (SELECT c_custkey, 'gappy' AS feature, gappy AS x FROM cust UNION ALL SELECT c_custkey, 'avg_price', avg_price FROM cust),
           f AS (SELECT l.*, seed, {hw("c_custkey", "seed")} % 5 AS own FROM l, (SELECT unnest([0, 1]) AS seed)),
           tr AS (SELECT fold, f.* FROM f, (SELECT unnest(range(5)) AS fold) WHERE own <> fold),
           m AS (SELECT seed, fold, feature, quantile_cont(x, 0.5) AS median FROM tr GROUP BY ALL)
           SELECT seed, fold, feature, median, avg(coalesce(x, median)) AS mean, stddev_pop(coalesce(x, median)) AS sd
           FROM tr JOIN m USING (seed, fold, feature) GROUP BY ALL""")
def _(t):
    return preprocess.training_scalers(dv.customer_features(t), "c_custkey", ["gappy", "avg_price"], [0, 1], 5)


# ---- description -------------------------------------------------------------------


@query("co_tracking", "variable:s n:i r:d",
       f"""WITH {dv.CUSTOMERS} SELECT 'gappy' AS variable, count(gappy) AS n, corr(avg_price, gappy) AS r FROM cust UNION ALL
           SELECT 'max_price', count(*), corr(avg_price, max_price) FROM cust UNION ALL SELECT 'share_f', count(*), corr(avg_price, share_f) FROM cust""")
def _(t):
    return profile.co_tracking(dv.customer_features(t), "avg_price", ["gappy", "max_price", "share_f"])


@query("coverage_profile", "variable:s n_present:i pct:d sparse:b",
       f"""WITH {dv.CUSTOMERS}, l AS (SELECT 'gappy' AS variable, gappy AS x FROM cust UNION ALL SELECT 'high_share', CASE WHEN share_f > 0.5 THEN share_f END FROM cust
             UNION ALL SELECT 'avg_price', avg_price FROM cust)
           SELECT variable, count(x) AS n_present, 100.0 * count(x) / count(*) AS pct, 100.0 * count(x) / count(*) < 50 AS sparse FROM l GROUP BY variable""")
def _(t):
    f = dv.customer_features(t).withColumn("high_share", F.when(F.col("share_f") > 0.5, F.col("share_f")))
    return profile.coverage(f, ["gappy", "high_share", "avg_price"])


BLOCKS = {"clinical": ["acctbal", "n_orders"], "gappy": ["gappy"], "share": ["high_share"], "long": ["many_orders", "gappy"]}


def _joint_sql() -> str:
    sets = [[n for i, n in enumerate(BLOCKS) if k >> i & 1] for k in range(1 << len(BLOCKS))]
    has = {n: " AND ".join(f"{c} IS NOT NULL" for c in cols) for n, cols in BLOCKS.items()}
    rows = " UNION ALL ".join(f"SELECT '{'+'.join(s)}' AS blocks, {len(s)} AS n_blocks, count(*) FILTER ({' AND '.join(has[n] for n in s) or 'true'}) AS n FROM c" for s in sets)
    return f"""WITH {dv.CUSTOMERS}, c AS (SELECT *, CASE WHEN share_f > 0.5 THEN share_f END AS high_share, CASE WHEN n_orders >= 12 THEN n_orders END AS many_orders FROM cust) {rows}"""


@query("joint_availability", "blocks:s n_blocks:i n:i", _joint_sql())
def _(t):
    f = dv.customer_features(t).withColumns({"high_share": F.when(F.col("share_f") > 0.5, F.col("share_f")), "many_orders": F.when(F.col("n_orders") >= 12, F.col("n_orders"))})
    return profile.joint_availability(f, BLOCKS)


@query("selection_table", "variable:s retained_mean:d excluded_mean:d diff:d",
       f"""WITH {dv.CUSTOMERS}, l AS (SELECT n_orders >= 10 AS kept, 'acctbal' AS variable, acctbal AS x FROM cust UNION ALL
             SELECT n_orders >= 10, 'avg_price', avg_price FROM cust UNION ALL SELECT n_orders >= 10, 'gappy', gappy FROM cust)
           SELECT variable, avg(x) FILTER (WHERE kept) AS retained_mean, avg(x) FILTER (WHERE NOT kept) AS excluded_mean,
                  avg(x) FILTER (WHERE kept) - avg(x) FILTER (WHERE NOT kept) AS diff FROM l GROUP BY variable""")
def _(t):
    return profile.selection_table(dv.customer_features(t), F.col("n_orders") >= 10, ["acctbal", "avg_price", "gappy"])


@query("text_flag", "doc_id:i flagged:b",
       r"""SELECT doc_id, regexp_matches(text, '(?i)license|licen[cs]ed') AND NOT regexp_matches(text, '(?i)proprietary') AS flagged FROM documents""")
def _(t):
    return t.documents.select("doc_id", profile.text_flag("text", "license|licen[cs]ed", "proprietary").alias("flagged"))


@query("flag_agreement", "n:i n_both:i only_a:i only_b:i sensitivity:d ppv:d",
       r"""WITH x AS (SELECT doc_id, toxic = 1 AS a FROM labels), y AS (SELECT doc_id, regexp_matches(text, '(?i)the|ein') AND NOT regexp_matches(text, '(?i)xyzzy') AS b FROM documents),
           g AS (SELECT count(*) AS n, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS only_a,
                        count(*) FILTER (WHERE NOT a AND b) AS only_b FROM x JOIN y USING (doc_id))
           SELECT *, n_both / nullif(n_both + only_a, 0) AS sensitivity, n_both / nullif(n_both + only_b, 0) AS ppv FROM g""")
def _(t):
    a = t.labels.select("doc_id", (F.col("toxic") == 1).alias("a"))
    b = t.documents.select("doc_id", profile.text_flag("text", "the|ein", "xyzzy").alias("b"))
    return profile.flag_agreement(a, b, "doc_id", "a", "b")


SUBJECT_TIMES = dv.VISITS + """, times AS (SELECT user_id, min(t) AS first_t, max(t) AS last_t, regr_slope(value, t) AS slope, count(*) AS n FROM visits GROUP BY user_id)"""


@query("dropout_summary", "stratum:s n:i enrol_offset:d before_cohort_end:d span:d mean_slope:d",
       f"""WITH {SUBJECT_TIMES}, e AS (SELECT min(first_t) AS s, max(last_t) AS e FROM times)
           SELECT CASE WHEN n <= 66 THEN 'few_visit' ELSE 'many_visit' END AS stratum, count(*) AS n, avg(first_t - s) AS enrol_offset,
                  avg(e - last_t) AS before_cohort_end, avg(last_t - first_t) AS span, avg(slope) AS mean_slope FROM times, e GROUP BY 1""")
def _(t):
    s = dv.visits(t).groupBy("user_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"),
                                            F.regr_slope("value", "t").alias("slope"), F.count(F.lit(1)).alias("n"))
    return profile.dropout_summary(s, F.when(F.col("n") <= 66, "few_visit").otherwise("many_visit"), "first_t", "last_t", "slope")


@query("enrichment_by_risk", "enrol_pct:i n_enrolled:i mean_slope:d sd_slope:d cv_ratio:d screen_per_enrollee:d n_per_arm_a05:d4 pct_reduction_a05:d4 n_per_arm_a1:d4",
       f"""WITH {dv.CUSTOMERS}, r AS (SELECT slope - 0.9::DOUBLE AS y, rank() OVER (ORDER BY avg_price) AS rk, count(*) OVER () AS n FROM cust),
           g AS (SELECT p, count(*) AS n_enrolled, avg(y) AS mean_slope, stddev_samp(y) AS sd_slope
                 FROM r, (SELECT unnest([100, 50, 30, 10]) AS p) WHERE rk - 1 < ceil(n * p / 100.0::DOUBLE) GROUP BY p),
           z AS (SELECT *, 2 * (1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE)^2 * sd_slope^2 / (0.3::DOUBLE * mean_slope)^2 AS a05,
                        2 * (1.6448536269514722::DOUBLE + 0.8416212335729143::DOUBLE)^2 * sd_slope^2 / (0.3::DOUBLE * mean_slope)^2 AS a1 FROM g)
           SELECT p AS enrol_pct, n_enrolled, mean_slope, sd_slope, abs(sd_slope / mean_slope) AS cv_ratio, 100.0 / p AS screen_per_enrollee,
                  a05 AS n_per_arm_a05, 100 * (1 - a05 / (SELECT a05 FROM z WHERE p = 100)) AS pct_reduction_a05, a1 AS n_per_arm_a1 FROM z""")
def _(t):
    f = dv.customer_features(t).select("avg_price", (F.col("slope") - 0.9).alias("y"))
    return profile.enrichment(f, "avg_price", "y", [100, 50, 30, 10])
