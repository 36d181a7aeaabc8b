"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, meta, metrics, resample
from . import derived as dv
from .registry import hu, query

S = f"WITH {dv.SCORED}"


def _arms(t):
    """(arm, seed, fold, y, pred) rows of four closed-form predictors."""
    s = dv.scored(t)
    parts = {"ref": F.col("pred_base"), "ref_other": 0.55 * F.col("y") + 1.5 * (F.col("pred_aug") - 0.7 * F.col("y")),
             "rich_one": F.col("pred_aug"), "rich_two": (F.col("pred_aug") + F.col("pred_base")) / 2}
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), p.alias("pred")) for a, p in parts.items()]))
    return s.select("seed", "fold", "y", each.alias("e")).select("seed", "fold", "y", "e.arm", "e.pred")


ARMS = S + """, arms AS (
  SELECT 'ref' AS arm, seed, fold, y, pred_base AS pred FROM scored UNION ALL
  SELECT 'ref_other', seed, fold, y, 0.55::DOUBLE * y + 1.5::DOUBLE * (pred_aug - 0.7::DOUBLE * y) FROM scored UNION ALL
  SELECT 'rich_one', seed, fold, y, pred_aug FROM scored UNION ALL SELECT 'rich_two', seed, fold, y, (pred_aug + pred_base) / 2 FROM scored),
per_seed AS (SELECT arm, seed, count(*) AS n, 1 - sum((y - pred)^2) / regr_syy(y, y) AS r2 FROM arms GROUP BY arm, seed)"""


@query("regression_metrics", "priority:s status:s n:i r2:d mae:d rmse:d",
       f"""{S} SELECT priority, status, count(*) AS n, 1 - sum((y - pred_base)^2) / regr_syy(y, y) AS r2, avg(abs(y - pred_base)) AS mae,
           sqrt(avg((y - pred_base)^2)) AS rmse FROM scored GROUP BY priority, status""")
def _(t):
    return metrics.regression_metrics(dv.scored(t), ["priority", "status"], pred="pred_base")


@query("repeat_summary", "arm:s r2:d repeat_lo:d repeat_hi:d n_repeats:i n:i r2_fold_mean:d",
       f"""{ARMS}, f AS (SELECT arm, avg(r) AS r2_fold_mean FROM (SELECT arm, fold, 1 - sum((y - pred)^2) / regr_syy(y, y) AS r FROM arms WHERE seed = 0 GROUP BY arm, fold) GROUP BY arm)
           SELECT arm, max(r2) FILTER (WHERE seed = 0) AS r2, min(r2) AS repeat_lo, max(r2) AS repeat_hi, count(*) AS n_repeats,
                  max(n) FILTER (WHERE seed = 0) AS n, max(r2_fold_mean) AS r2_fold_mean FROM per_seed JOIN f USING (arm) GROUP BY arm""")
def _(t):
    return metrics.repeat_summary(_arms(t), ["arm"], 0)


@query("paired_increment_scores", "n:i r2_base:d r2_aug:d dr2:d dr2_lo:d dr2_hi:d",
       f"""{S}, p AS (SELECT seed, count(*) AS n, 1 - sum((y - pred_base)^2) / regr_syy(y, y) AS b, 1 - sum((y - pred_aug)^2) / regr_syy(y, y) AS a FROM scored GROUP BY seed)
           SELECT max(n) FILTER (WHERE seed = 0) AS n, max(b) FILTER (WHERE seed = 0) AS r2_base, max(a) FILTER (WHERE seed = 0) AS r2_aug,
                  max(a - b) FILTER (WHERE seed = 0) AS dr2, min(a - b) AS dr2_lo, max(a - b) AS dr2_hi FROM p""")
def _(t):
    return metrics.increment_range(metrics.paired_increment(dv.scored(t), "pred_base", "pred_aug", ["seed"]), 0)


@query("auc_tie_averaged", "priority:s n_pos:i n_neg:i auc:d8",
       f"""{S}, r AS (SELECT priority, label, rank() OVER (PARTITION BY priority ORDER BY prob) + (count(*) OVER (PARTITION BY priority, prob) - 1) / 2.0::DOUBLE AS rk FROM scored)
           SELECT priority, sum(label) AS n_pos, sum(1 - label) AS n_neg,
                  (sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * sum(1 - label)) AS auc FROM r GROUP BY priority""")
def _(t):
    return metrics.auc(dv.scored(t), ["priority"], "label", "prob")


@query("auc_ordinal", "n_pos:i n_neg:i auc:d8",
       f"""{S}, r AS (SELECT label, row_number() OVER (ORDER BY prob, o_orderkey) AS rk FROM scored)
           SELECT sum(label) AS n_pos, sum(1 - label) AS n_neg,
                  (sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * sum(1 - label)) AS auc FROM r""")
def _(t):
    return metrics.auc_ordinal(dv.scored(t), [], "label", "prob", "o_orderkey")


@query("brier_score", "priority:s brier:d", f"{S} SELECT priority, avg((prob - label)^2) AS brier FROM scored GROUP BY priority")
def _(t):
    return metrics.brier(dv.scored(t), ["priority"], "label", "prob")


BINS = S + """, bins AS (SELECT status, least(floor(prob * 10), 9) AS bin, count(*) AS n, avg(prob) AS mean_pred, avg(label::DOUBLE) AS mean_true FROM scored GROUP BY 1, 2)"""


@query("reliability_bins", "status:s bin:i n:i bin_lo:d bin_hi:d mean_pred:d mean_true:d",
       f"{BINS} SELECT *, bin / 10.0 AS bin_lo, (bin + 1) / 10.0 AS bin_hi FROM bins")
def _(t):
    return metrics.reliability_bins(dv.scored(t), ["status"], "label", "prob")


@query("expected_calibration_error", "status:s n:i ece:d",
       f"{BINS} SELECT status, sum(n) AS n, sum(n * abs(mean_pred - mean_true)) / sum(n) AS ece FROM bins GROUP BY status")
def _(t):
    return metrics.ece(dv.scored(t), ["status"], "label", "prob")


@query("calibration_line", "priority:s n:i cal_slope:d cal_slope_se:d8 cal_intercept:d citl:d",
       f"""{S} SELECT priority, count(*) AS n, regr_slope(y, pred_base) AS cal_slope,
           sqrt((regr_syy(y, pred_base) - regr_slope(y, pred_base) * regr_sxy(y, pred_base)) / (count(*) - 2) / regr_sxx(y, pred_base)) AS cal_slope_se,
           regr_intercept(y, pred_base) AS cal_intercept, avg(pred_base) - avg(y) AS citl FROM scored GROUP BY priority""")
def _(t):
    return metrics.calibration_line(dv.scored(t), ["priority"], pred="pred_base")


@query("calibration_curve", "bin:i n:i mean_pred:d mean_obs:d",
       f"""{S}, e AS (SELECT [{", ".join(f"quantile_cont(pred_base, {i}.0::DOUBLE / 10)" for i in range(11))}] AS e FROM scored),
           b AS (SELECT y, pred_base, {" + ".join(f"(pred_base >= e[{i + 1}])::INT" for i in range(1, 10))} AS bin FROM scored, e)
           SELECT bin, count(*) AS n, avg(pred_base) AS mean_pred, avg(y) AS mean_obs FROM b GROUP BY bin""")
def _(t):
    return metrics.quantile_bins(dv.scored(t), "y", "pred_base")


@query("conformal_leave_one_out", "status:s n:i coverage:d mean_width:d",
       f"""{S}, r AS (SELECT status, abs(y - pred_aug) AS res, row_number() OVER (PARTITION BY status ORDER BY abs(y - pred_aug), o_orderkey) AS i,
                      count(*) OVER (PARTITION BY status) AS n FROM scored),
           h AS (SELECT *, (n - 2) * least(1.0::DOUBLE, ceil(round(n * 0.9::DOUBLE, 9)) / (n - 1)) AS h FROM r),
           k AS (SELECT *, floor(h) AS j, least(floor(h) + 1, n - 2) AS j2, h - floor(h) AS g FROM h),
           st AS (SELECT status, max(CASE WHEN i = j + 1 THEN res END) AS a1, max(CASE WHEN i = j + 2 THEN res END) AS a2, max(CASE WHEN i = j2 + 1 THEN res END) AS b1,
                         max(CASE WHEN i = j2 + 2 THEN res END) AS b2 FROM k GROUP BY status),
           ab AS (SELECT k.*, CASE WHEN i > j + 1 THEN a1 ELSE a2 END AS a, CASE WHEN i > j2 + 1 THEN b1 ELSE b2 END AS b FROM k JOIN st USING (status)),
           q AS (SELECT status, n, res, a + g * (b - a) AS q FROM ab)
           SELECT status, max(n) AS n, avg(CASE WHEN res <= q THEN 1.0::DOUBLE ELSE 0 END) AS coverage, avg(2 * q) AS mean_width FROM q GROUP BY status""")
def _(t):
    return metrics.conformal_loo(dv.scored(t), ["status"], pred="pred_aug")


@query("conformal_by_stratum", "priority:s n:i stratum_q:d stratum_width:d marginal_q:d coverage_at_marginal:d",
       f"""{S}, r AS (SELECT priority, abs(y - pred_aug) AS res FROM scored), m AS (SELECT quantile_cont(res, 0.9) AS mq FROM r)
           SELECT priority, count(*) AS n, quantile_cont(res, 0.9) AS stratum_q, 2 * quantile_cont(res, 0.9) AS stratum_width, max(mq) AS marginal_q,
                  avg(CASE WHEN res <= mq THEN 1.0::DOUBLE ELSE 0 END) AS coverage_at_marginal FROM r, m GROUP BY priority""")
def _(t):
    return metrics.conformal_strata(dv.scored(t), "priority", pred="pred_aug")


def _audit(t):
    s = dv.scored(t)
    return metrics.subgroup_audit(s, {
        "status": F.concat(F.lit("status="), "status"), "age_tertile": metrics.tertile_axis(s, "age", "age"),
        "priority": F.when(F.col("priority") < "3", "urgent").otherwise("other"),
        "rare": F.when(F.col("o_orderkey") % 2500 == 0, "rare").otherwise("common")}, pred="pred_base")


AUDIT = S + """, cuts AS (SELECT quantile_cont(age, 1.0::DOUBLE / 3) AS a, quantile_cont(age, 2.0::DOUBLE / 3) AS b FROM scored),
  long AS (SELECT 'status' AS axis, 'status=' || status AS level, y, pred_base AS p FROM scored UNION ALL
    SELECT 'age_tertile', CASE WHEN age <= a THEN 'age_low' WHEN age <= b THEN 'age_mid' ELSE 'age_high' END, y, pred_base FROM scored, cuts WHERE age IS NOT NULL UNION ALL
    SELECT 'priority', CASE WHEN priority < '3' THEN 'urgent' ELSE 'other' END, y, pred_base FROM scored UNION ALL
    SELECT 'rare', CASE WHEN o_orderkey % 2500 = 0 THEN 'rare' ELSE 'common' END, y, pred_base FROM scored),
  audit AS (SELECT axis, level, count(*) AS n, CASE WHEN count(*) >= 10 THEN 1 - sum((y - p)^2) / regr_syy(y, y) END AS r2,
    CASE WHEN count(*) >= 10 THEN sqrt(avg((y - p)^2)) END AS rmse, CASE WHEN count(*) >= 10 THEN regr_slope(y, p) END AS cal_slope,
    CASE WHEN count(*) >= 10 THEN regr_intercept(y, p) END AS cal_intercept FROM long GROUP BY axis, level)"""


@query("subgroup_audit", "axis:s level:s n:i r2:d rmse:d cal_slope:d cal_intercept:d", f"{AUDIT} SELECT * FROM audit")
def _(t):
    return _audit(t)


@query("subgroup_disparity", "axis:s r2_spread:d worst_cal_slope_dev:d",
       f"""{AUDIT} SELECT axis, CASE WHEN count(r2) >= 2 THEN max(r2) - min(r2) END AS r2_spread, max(abs(cal_slope - 1)) AS worst_cal_slope_dev FROM audit GROUP BY axis""")
def _(t):
    return metrics.disparity(_audit(t))


@query("outcome_gradient", "level:s n:i mean:d sd:d pct_below:d variance_ratio:d",
       f"""{S}, cuts AS (SELECT quantile_cont(age, 1.0::DOUBLE / 3) AS a, quantile_cont(age, 2.0::DOUBLE / 3) AS b FROM scored), v AS (SELECT var_pop(y) AS v FROM scored)
           SELECT CASE WHEN age <= a THEN 'age_low' WHEN age <= b THEN 'age_mid' ELSE 'age_high' END AS level, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS sd,
                  100 * avg(CASE WHEN y < 1.5 THEN 1.0::DOUBLE ELSE 0 END) AS pct_below, var_pop(y) / max(v) AS variance_ratio FROM scored, cuts, v WHERE age IS NOT NULL GROUP BY 1""")
def _(t):
    s = dv.scored(t)
    return metrics.outcome_gradient(s.withColumn("level", metrics.tertile_axis(s, "age", "age")), "level", "y", 1.5)


STRATA = S + """, st AS (SELECT *, (CASE WHEN status = 'P' THEN 'p_' ELSE 'x_' END) || (CASE WHEN age <= 48 THEN 'few' ELSE 'many' END) AS stratum FROM scored),
  cells AS (SELECT stratum, count(*) AS n, (sum((y - pred_base)^2) - sum((y - pred_aug)^2)) / regr_syy(y, y) AS dr2, sqrt(avg((y - pred_base)^2)) AS rmse_base,
    sqrt(avg((y - pred_aug)^2)) AS rmse_aug, sqrt(avg((y - pred_base)^2)) - sqrt(avg((y - pred_aug)^2)) AS rmse_gain,
    100 * (sqrt(avg((y - pred_base)^2)) - sqrt(avg((y - pred_aug)^2))) / stddev_samp(y) AS rmse_gain_pct_sd, stddev_samp(y) AS outcome_sd FROM st GROUP BY stratum)"""


def _strata(t):
    s = dv.scored(t).withColumn("stratum", F.concat(F.when(F.col("status") == "P", "p_").otherwise("x_"),
                                                    F.when(F.col("age") <= 48, "few").otherwise("many")))
    return metrics.strata_increment(s, "stratum", "pred_base", "pred_aug")


@query("stratified_increment", "stratum:s n:i dr2:d rmse_base:d rmse_aug:d rmse_gain:d rmse_gain_pct_sd:d outcome_sd:d", f"{STRATA} SELECT * FROM cells")
def _(t):
    return _strata(t)


@query("surviving_gap", "gap_rest:d gap_pending:d surviving:d4",
       f"""{STRATA}, g AS (SELECT max(dr2) FILTER (WHERE stratum = 'x_few') - max(dr2) FILTER (WHERE stratum = 'x_many') AS gap_rest,
             max(dr2) FILTER (WHERE stratum = 'p_few') - max(dr2) FILTER (WHERE stratum = 'p_many') AS gap_pending FROM cells)
           SELECT *, gap_pending / gap_rest AS surviving FROM g""")
def _(t):
    return metrics.surviving_gap(_strata(t), "stratum", {"rest": ("x_few", "x_many"), "pending": ("p_few", "p_many")})


@query("equivalence_verdict", "best_arm:s best_minus_reference:d range_lo:d range_hi:d seed_range_width:d margin:d status:s",
       f"""{ARMS}, b AS (SELECT arm AS best_arm FROM per_seed WHERE seed = 0 AND arm NOT IN ('ref', 'ref_other') ORDER BY r2 DESC LIMIT 1),
           d AS (SELECT seed, max(r2) FILTER (WHERE arm = best_arm) - max(r2) FILTER (WHERE arm = 'ref') AS diff, max(best_arm) AS best_arm FROM per_seed, b GROUP BY seed)
           SELECT max(best_arm) AS best_arm, max(diff) FILTER (WHERE seed = 0) AS best_minus_reference, min(diff) AS range_lo, max(diff) AS range_hi,
                  max(diff) - min(diff) AS seed_range_width, 0.02 AS margin,
                  CASE WHEN max(diff) < 0.02 THEN 'equivalent' WHEN min(diff) >= 0.02 THEN 'superior' ELSE 'inconclusive' END AS status FROM d""")
def _(t):
    return evaluate.equivalence(metrics.regression_metrics(_arms(t), ["arm", "seed"]), "ref", ["ref_other"])


@query("gain_decomposition", "model_class_effect:d feature_set_effect_one:d feature_set_effect_two:d",
       f"""{ARMS}, r AS (SELECT max(r2) FILTER (WHERE arm = 'ref') AS a, max(r2) FILTER (WHERE arm = 'ref_other') AS b, max(r2) FILTER (WHERE arm = 'rich_one') AS c,
             max(r2) FILTER (WHERE arm = 'rich_two') AS d FROM per_seed WHERE seed = 0)
           SELECT b - a AS model_class_effect, c - b AS feature_set_effect_one, d - b AS feature_set_effect_two FROM r""")
def _(t):
    r = metrics.regression_metrics(_arms(t), ["arm", "seed"]).filter(F.col("seed") == 0)
    return evaluate.decompose(r, "ref", "ref_other", {"one": "rich_one", "two": "rich_two"})


@query("replication_summary", "runs:i smallest_gain:d largest_gain:d all_clear_margin:b",
       f"""{ARMS}, g AS (SELECT seed, max(r2) FILTER (WHERE arm = 'rich_one') - max(r2) FILTER (WHERE arm = 'ref') AS gain FROM per_seed GROUP BY seed)
           SELECT count(*) AS runs, min(gain) AS smallest_gain, max(gain) AS largest_gain, bool_and(gain >= 0.02) AS all_clear_margin FROM g""")
def _(t):
    r = metrics.regression_metrics(_arms(t), ["arm", "seed"]).groupBy("seed").agg(
        (F.max(F.when(F.col("arm") == "rich_one", F.col("r2"))) - F.max(F.when(F.col("arm") == "ref", F.col("r2")))).alias("gain"))
    return evaluate.replication(r)


# ---- resampling ---------------------------------------------------------------------

REPS = 200


def _scrambled(x: str) -> str:
    """SQL for `scrambled`, as nested selects are not needed for one expression of 32-bit numbers in 64 bits."""
    a = f"xor({x}, {x} >> 16) * 2246822507::UBIGINT & 4294967295"
    return f"list_reduce([({a})::UBIGINT, 0, 1], lambda h, k: CASE WHEN k = 0 THEN xor(h, h >> 13) * 3266489909::UBIGINT & 4294967295 ELSE xor(h, h >> 16) END)"


BOOT = S + f""", rw AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n, y, pred_base, pred_aug FROM scored),
  ky AS (SELECT rep, {_scrambled("inner_")} AS key FROM (SELECT rep, {_scrambled("rep")} AS inner_ FROM (SELECT unnest(range({REPS}))::UBIGINT AS rep))),
  dr AS (SELECT rep, ({_scrambled("place_")} * n::UBIGINT >> 32)::BIGINT AS pos FROM (SELECT rep, (pos::UBIGINT + key) & 4294967295 AS place_, n FROM ky, (SELECT pos, n FROM rw))),
  reps AS (SELECT rep::BIGINT AS rep, count(*) AS n, (sum((y - pred_base)^2) - sum((y - pred_aug)^2)) / (sum(y * y) - sum(y)^2 / count(*)) AS dr2,
    1 - sum((y - pred_base)^2) / (sum(y * y) - sum(y)^2 / count(*)) AS r2_base,
    1 - sum((y - pred_aug)^2) / (sum(y * y) - sum(y)^2 / count(*)) AS r2_aug FROM dr JOIN rw USING (pos) GROUP BY rep)"""


@query("bootstrap_increment", "rep:i n:i r2_base:d r2_aug:d dr2:d", f"{BOOT} SELECT * FROM reps")
def _(t):
    return resample.bootstrap_increment(dv.scored(t), "o_orderkey", "pred_base", "pred_aug", REPS)


@query("bootstrap_interval", "n_reps:i mean:d median:d ci_lo:d ci_hi:d",
       f"""{BOOT} SELECT count(*) AS n_reps, avg(dr2) AS mean, quantile_cont(dr2, 0.5) AS median, quantile_cont(dr2, 0.025) AS ci_lo, quantile_cont(dr2, 0.975) AS ci_hi FROM reps""")
def _(t):
    return resample.percentile_ci(resample.bootstrap_increment(dv.scored(t), "o_orderkey", "pred_base", "pred_aug", REPS), "dr2")


@query("gaussian_block", "c_custkey:i rep:i noise0:d noise1:d",
       "SELECT c_custkey, rep, " + ", ".join(
           f"sqrt(-2 * ln({hu('c_custkey', 'rep', chr(39) + f'noise{i}' + chr(39))})) * cos(6.283185307179586::DOUBLE * {hu('c_custkey', 'rep', chr(39) + f'noise{i}' + chr(39), word=1)}) AS noise{i}"
           for i in range(2)) + " FROM customer, (SELECT unnest([1, 2]) AS rep)")
def _(t):
    return evaluate.gaussian_block(t.customer.select("c_custkey"), "c_custkey", 2, [1, 2])


# ---- groups and sites ------------------------------------------------------------------


def _normal_p(z: str) -> str:
    from ..functions.probability import normal_two_sided_p_sql
    return normal_two_sided_p_sql(z)


MW = S + f""", g AS (SELECT priority, label, prob, rank() OVER (PARTITION BY priority ORDER BY prob) + (count(*) OVER (PARTITION BY priority, prob) - 1) / 2.0::DOUBLE AS rk FROM scored),
  ties AS (SELECT priority, sum(c * c * c - c) AS ties FROM (SELECT priority, prob, count(*)::DOUBLE AS c FROM scored GROUP BY 1, 2) GROUP BY 1),
  u AS (SELECT priority, sum(label) AS n1, sum(1 - label) AS n0, sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE AS u FROM g GROUP BY 1),
  z AS (SELECT *, greatest(abs(u - n1 * n0 / 2.0::DOUBLE) - 0.5, 0) / sqrt(n1 * n0 / 12.0::DOUBLE * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1.0::DOUBLE)))) AS z FROM u JOIN ties USING (priority))"""


@query("mann_whitney", "priority:s n1:i n0:i u:d p:d8", f"{MW} SELECT priority, n1, n0, u, least(1.0, {_normal_p('z')}) AS p FROM z")
def _(t):
    return meta.mann_whitney(dv.scored(t), ["priority"], "label", "prob")


FISHER = """, k AS (SELECT *, n11 + n10 AS r, n11 + n01 AS c, n11 + n10 + n01 + n00 AS n FROM cells),
  pm AS (SELECT key, x, r, c, n, n11, lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(c - x + 1) - lgamma(n - r - c + x + 1)
           - lgamma(n + 1) + lgamma(c + 1) + lgamma(n - c + 1) AS lp
         FROM (SELECT *, unnest(range(greatest(0, r + c - n)::BIGINT, (least(r, c) + 1)::BIGINT))::DOUBLE AS x FROM k)),
  fp AS (SELECT key, sum(exp(lp)) FILTER (WHERE lp <= o + 1e-7) AS p FROM (SELECT *, max(lp) FILTER (WHERE x = n11) OVER (PARTITION BY key) AS o FROM pm) GROUP BY key)"""


@query("fisher_exact", "priority:s n11:i n10:i n01:i n00:i rate1:d rate0:d p:d",
       f"""{S}, cells AS (SELECT priority AS key, count(*) FILTER (WHERE e = 1 AND label = 1) AS n11, count(*) FILTER (WHERE e = 1 AND label = 0) AS n10,
             count(*) FILTER (WHERE e = 0 AND label = 1) AS n01, count(*) FILTER (WHERE e = 0 AND label = 0) AS n00
           FROM (SELECT *, CASE WHEN age > 60 THEN 1 ELSE 0 END AS e FROM scored WHERE age IS NOT NULL) GROUP BY priority) {FISHER}
           SELECT key AS priority, n11, n10, n01, n00, n11 / (n11 + n10) AS rate1, n01 / (n01 + n00) AS rate0, p FROM cells JOIN fp USING (key)""")
def _(t):
    s = dv.scored(t).withColumn("e", F.when(F.col("age").isNotNull(), (F.col("age") > 60).cast("int")))
    return meta.two_by_two(s, ["priority"], "e", "label")


@query("carrier_effect", "priority:s n:i prevalence:d mean_carrier:d mean_other:d difference:d cohens_d:d r2_ceiling:d8",
       f"""{S}, g AS (SELECT priority, count(*) AS n, avg(label::DOUBLE) AS prevalence, avg(y) FILTER (WHERE label = 1) AS mean_carrier, avg(y) FILTER (WHERE label = 0) AS mean_other,
             var_samp(y) AS v FROM scored GROUP BY priority)
           SELECT *, mean_carrier - mean_other AS difference, (mean_carrier - mean_other) / sqrt(v) AS cohens_d,
                  prevalence * (1 - prevalence) * (mean_carrier - mean_other)^2 / v AS r2_ceiling FROM g""")
def _(t):
    return meta.carrier_effect(dv.scored(t), ["priority"], "label", "y")


@query("group_medians", "priority:s n:i median:d", f"{S} SELECT priority, count(*) AS n, quantile_cont(y, 0.5) AS median FROM scored GROUP BY priority")
def _(t):
    return meta.group_medians(dv.scored(t), "priority", "y")


@query("rank_correlation", "n:i spearman:d",
       f"""{S}, r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS b FROM scored)
           SELECT count(*) AS n, corr(a, b) AS spearman FROM r""")
def _(t):
    return meta.rank_correlation(dv.scored(t), "y", "prob")


SITES = f"""WITH {dv.CUSTOMERS}, sites AS (SELECT c_nationkey, count(*) AS n, regr_slope(slope, avg_price) AS cal_slope,
  sqrt((regr_syy(slope, avg_price) - regr_slope(slope, avg_price) * regr_sxy(slope, avg_price)) / (count(*) - 2) / regr_sxx(slope, avg_price)) AS se
  FROM cust GROUP BY c_nationkey HAVING count(*) >= 20),
f AS (SELECT sum(cal_slope / se^2) / sum(1 / se^2) AS fixed, count(*) AS k, sum(1 / se^2) AS sw, sum(1 / se^4) AS sww FROM sites),
q AS (SELECT sum((cal_slope - fixed)^2 / se^2) AS q, max(k) AS k, max(sw) AS sw, max(sww) AS sww FROM sites, f),
h AS (SELECT k, greatest(0, (q - (k - 1)) / (sw - sww / sw)) AS tau2, greatest(0, (q - (k - 1)) / q) * 100 AS i2_percent FROM q),
p AS (SELECT max(k) AS k, max(tau2) AS tau2, max(i2_percent) AS i2_percent, sum(cal_slope / (se^2 + tau2)) / sum(1 / (se^2 + tau2)) AS estimate, sqrt(1 / sum(1 / (se^2 + tau2))) AS se FROM sites, h)"""


@query("random_effects_pooling", "k:i estimate:d se:d8 ci_lo:d ci_hi:d tau2:d8 i2_percent:d pi_lo:d pi_hi:d",
       # 2.068658 = t quantile 0.975 at 23 degrees of freedom: all 25 nations qualify as sites
       f"""{SITES} SELECT *, estimate - 1.96 * se AS ci_lo, estimate + 1.96 * se AS ci_hi,
           estimate - 2.0686576104190406::DOUBLE * sqrt(tau2 + se^2) AS pi_lo, estimate + 2.0686576104190406::DOUBLE * sqrt(tau2 + se^2) AS pi_hi FROM p""")
def _(t):
    sites = metrics.calibration_line(dv.customer_features(t), ["c_nationkey"], y="slope", pred="avg_price").filter(F.col("n") >= 20)
    return meta.random_effects(sites, [], "cal_slope", "cal_slope_se")
