"""Cross-validated models, controls, ablations, site validation, nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform
from ..operators import evaluate, folds, linear, logistic, meta, metrics
from ..operators.linear import Arm, Outcome
from . import derived as dv
from .registry import hu, hw, permuted_sql, query
from .solve_sql import AUC, dot, linear_cv_sql, logistic_cv_sql, newton_sql, repeated_auc_sql

EB = Outcome("slope", "var")
BASE, AUG = ["avg_price"], ["acctbal"]

_GRID = ", ".join(f"{a!r}::DOUBLE" for a in linear.RIDGE_GRID)


def ridge_sql(rows: str, grid: str = _GRID, inner_k: int = 5, y: str = "mu + tau2 / (tau2 + v) * (b - mu)") -> str:
    """Cross-validated ridge on one (p) and two (p, q) columns in closed form: training shrinkage, scaling, inner penalty choice.

    `rows` is SQL text that ends in a table x(id, seed, b, v, p, q, o, g); seed may be any run label.
    """
    n_grid = grid.count("::DOUBLE")
    pick = """SELECT seed, f, min(ai) FILTER (WHERE rb >= tb - 1e-12) AS ib, min(ai) FILTER (WHERE ra >= ta - 1e-12) AS ia
              FROM (SELECT *, max(rb) OVER w AS tb, max(ra) OVER w AS ta FROM av WINDOW w AS (PARTITION BY seed, f)) GROUP BY seed, f"""
    if n_grid == 1:
        pick = "SELECT DISTINCT seed, f, 0 AS ib, 0 AS ia FROM sets"
    return f"""{rows}, ff AS (SELECT DISTINCT seed, o AS f FROM x),
  pr AS (SELECT x.seed, f, avg(b) AS mu, greatest(0, var_samp(b) - avg(v)) AS tau2, avg(p) AS mp, stddev_pop(p) AS sp, avg(q) AS mq, stddev_pop(q) AS sq FROM x JOIN ff ON x.seed = ff.seed AND o <> f GROUP BY x.seed, f),
  z AS (SELECT id, seed, f, o, g, o = f AS test, {y} AS y, (p - mp) / sp AS a, (q - mq) / sq AS c FROM x JOIN pr USING (seed)),
  gr AS (SELECT unnest([{grid}]) AS alpha, unnest(range({n_grid})) AS ai),
  sets AS (SELECT seed, f, h, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(c) AS mc, var_pop(a) * count(*) AS saa, var_pop(c) * count(*) AS scc, covar_pop(a, c) * count(*) AS sac,
             covar_pop(a, y) * count(*) AS say, covar_pop(c, y) * count(*) AS scy FROM z, (SELECT unnest(range({inner_k + 1})) AS h) WHERE NOT test AND g <> h GROUP BY seed, f, h),
  fit AS (SELECT seed, f, h, ai, my, ma, mc, say / (saa + alpha) AS b1, ((scc + alpha) * say - sac * scy) / ((saa + alpha) * (scc + alpha) - sac^2) AS a1, ((saa + alpha) * scy - sac * say) / ((saa + alpha) * (scc + alpha) - sac^2) AS a2 FROM sets, gr),
  sc AS (SELECT z.seed, z.f, h, ai, 1 - sum((y - (my + b1 * (a - ma)))^2) / regr_syy(y, y) AS rb, 1 - sum((y - (my + a1 * (a - ma) + a2 * (c - mc)))^2) / regr_syy(y, y) AS ra
         FROM z JOIN fit ON z.seed = fit.seed AND z.f = fit.f AND z.g = fit.h WHERE NOT test AND h < {inner_k} GROUP BY z.seed, z.f, h, ai),
  av AS (SELECT seed, f, ai, avg(rb) AS rb, avg(ra) AS ra FROM sc GROUP BY seed, f, ai),
  pick AS ({pick}),
  oof AS (SELECT z.seed, z.f AS fold, id AS c_custkey, y, m.my + m.b1 * (a - m.ma) AS pred_base, k.my + k.a1 * (a - k.ma) + k.a2 * (c - k.mc) AS pred_aug
          FROM z JOIN pick USING (seed, f) JOIN fit m ON m.seed = z.seed AND m.f = z.f AND m.h = {inner_k} AND m.ai = ib JOIN fit k ON k.seed = z.seed AND k.f = z.f AND k.h = {inner_k} AND k.ai = ia WHERE test)"""


def _rows_sql(p: str = "avg_price", q: str = "acctbal") -> str:
    return f"""WITH {dv.CUSTOMERS}, x AS (SELECT c_custkey AS id, slope AS b, var AS v, {p} AS p, {q} AS q, seed, {hw("c_custkey", "seed")} % 5 AS o,
      {hw("c_custkey", "seed", "'inner'")} % 5 AS g FROM cust, (SELECT unnest([0, 1]) AS seed))"""


RIDGE = ridge_sql(_rows_sql())
R2 = "count(*) AS n, 1 - sum((y - pred_base)^2) / regr_syy(y, y) AS r2_base, 1 - sum((y - pred_aug)^2) / regr_syy(y, y) AS r2_aug, (sum((y - pred_base)^2) - sum((y - pred_aug)^2)) / regr_syy(y, y) AS dr2"


def _range_sql(ridge: str, key: str = "") -> str:
    lead = f"{key}, " if key else ""
    return f"""{ridge}, s AS (SELECT {lead}seed, {R2} FROM oof GROUP BY {lead}seed)
           SELECT {lead}max(n) FILTER (WHERE seed = 0) AS n, max(r2_base) FILTER (WHERE seed = 0) AS r2_base, max(r2_aug) FILTER (WHERE seed = 0) AS r2_aug,
                  max(dr2) FILTER (WHERE seed = 0) AS dr2, min(dr2) AS dr2_lo, max(dr2) AS dr2_hi FROM s {f"GROUP BY {key}" if key else ""}"""


@query("nested_cv_ridge", "seed:i fold:i c_custkey:i y:d pred_base:d pred_aug:d", f"{RIDGE} SELECT * FROM oof")
def _(t):
    return evaluate.paired_increment_cv(dv.customer_features(t), "c_custkey", EB, BASE, AUG, seeds=[0, 1])


@query("paired_increment_cv", "n:i r2_base:d r2_aug:d dr2:d dr2_lo:d dr2_hi:d", _range_sql(RIDGE))
def _(t):
    oof = evaluate.paired_increment_cv(dv.customer_features(t), "c_custkey", EB, BASE, AUG, seeds=[0, 1])
    return metrics.increment_range(metrics.paired_increment(oof, "pred_base", "pred_aug", ["seed"]), 0)


@query("paired_increment_unshrunken", "n:i r2_base:d r2_aug:d dr2:d dr2_lo:d dr2_hi:d", _range_sql(ridge_sql(_rows_sql(), y="b")))
def _(t):
    oof = evaluate.paired_increment_cv(dv.customer_features(t), "c_custkey", Outcome("slope"), BASE, AUG, seeds=[0, 1])
    return metrics.increment_range(metrics.paired_increment(oof, "pred_base", "pred_aug", ["seed"]), 0)


def _list_rows(columns: list[str], seeds: str = "[0, 1]") -> str:
    return f"""WITH {dv.CUSTOMERS}, x AS (SELECT c_custkey AS id, slope AS b, var AS v, [{", ".join(columns)}] AS x, seed, {hw("c_custkey", "seed")} % 5 AS o,
      {hw("c_custkey", "seed", "'inner'")} % 5 AS g FROM cust, (SELECT unnest({seeds}) AS seed))"""


def _summary_sql(cv: str, arms: list[str]) -> str:
    """`repeat_summary` of each arm of an oof table."""
    long = " UNION ALL ".join(f"SELECT '{a}' AS arm, seed, fold, y, pred_{a} AS pred FROM oof" for a in arms)
    r2 = "1 - sum((y - pred)^2) / regr_syy(y, y)"
    return f"""{cv}, l AS ({long}), s AS (SELECT arm, seed, count(*) AS n, {r2} AS r2 FROM l GROUP BY arm, seed), f AS (SELECT arm, fold, {r2} AS r2 FROM l WHERE seed = 0 GROUP BY arm, fold),
      a AS (SELECT arm, max(r2) FILTER (WHERE seed = 0) AS r2, min(r2) AS repeat_lo, max(r2) AS repeat_hi, count(r2) AS n_repeats, max(n) FILTER (WHERE seed = 0) AS n FROM s GROUP BY arm)
      SELECT * FROM a JOIN (SELECT arm, avg(r2) AS r2_fold_mean FROM f GROUP BY arm) USING (arm)"""


FEATURES = ["avg_price", "max_price", "share_f", "n_orders", "acctbal", "gappy"]
ARMS = [Arm("established_ridge", ("avg_price", "n_orders")), Arm("rich_elastic_net", tuple(FEATURES), kind="elastic_net", grid=linear.ELASTIC_GRID),
        Arm("rich_ridge", tuple(FEATURES)), Arm("rich_ridge_loo", tuple(FEATURES), grid=linear.LOO_GRID, tune="loo")]


_PLACES = [{"columns": [FEATURES.index(c) for c in a.columns], "grid": a.grid, "loo": a.tune == "loo"} for a in ARMS]


@query("benchmark_arms", "arm:s r2:d repeat_lo:d repeat_hi:d n_repeats:i n:i r2_fold_mean:d",
       _summary_sql(linear_cv_sql(_list_rows(FEATURES), len(FEATURES), {a.name: x for a, x in zip(ARMS, _PLACES, strict=True)}), [a.name for a in ARMS]))
def _(t):
    oof = linear.nested_cv(dv.customer_features(t), "c_custkey", EB, ARMS, seeds=[0, 1])
    return metrics.repeat_summary(linear.long_predictions(oof, [a.name for a in ARMS], ["seed", "fold"]), ["arm"], 0)


_EMB = f"""WITH x AS (SELECT vec_id AS id, label::DOUBLE AS b, 0::DOUBLE AS v, embedding::DOUBLE[] AS x, seed, {hw("vec_id", "seed")} % 5 AS o, {hw("vec_id", "seed", "'inner'")} % 5 AS g
  FROM embeddings, (SELECT unnest([0, 1]) AS seed))"""


@query("embedding_ridge", "arm:s r2:d repeat_lo:d repeat_hi:d n_repeats:i n:i r2_fold_mean:d",
       _summary_sql(linear_cv_sql(_EMB, 64, {"narrow": {"columns": range(10), "grid": linear.RIDGE_GRID}, "wide": {"columns": range(64), "grid": linear.RIDGE_GRID}}, y="b"), ["narrow", "wide"]))
def _(t):
    """A wide arm (every dimension) against a narrow one, on the vectors' label."""
    width = 64
    e = t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)])
    arms = [Arm("narrow", tuple(f"e{i}" for i in range(10))), Arm("wide", tuple(f"e{i}" for i in range(width)))]
    oof = linear.nested_cv(e, "vec_id", Outcome("label"), arms, seeds=[0, 1])
    return metrics.repeat_summary(linear.long_predictions(oof, ["narrow", "wide"], ["seed", "fold"]), ["arm"], 0)


_LOO = ", ".join(f"{a!r}::DOUBLE" for a in linear.LOO_GRID)
LOO = f"""WITH {dv.CUSTOMERS}, x AS (SELECT c_custkey AS id, slope AS b, var AS v, avg_price AS p, acctbal AS q, {hw("c_custkey", "0")} % 5 AS o FROM cust),
  pr AS (SELECT f, avg(b) AS mu, greatest(0, var_samp(b) - avg(v)) AS tau2, avg(p) AS mp, stddev_pop(p) AS sp, avg(q) AS mq, stddev_pop(q) AS sq FROM x, (SELECT unnest(range(5)) AS f) WHERE o <> f GROUP BY f),
  z AS (SELECT id, f, o = f AS test, mu + tau2 / (tau2 + v) * (b - mu) AS y, (p - mp) / sp AS a, (q - mq) / sq AS c FROM x, pr),
  s AS (SELECT f, count(*) AS n, avg(y) AS my, sum(a * a) AS saa, sum(c * c) AS scc, sum(a * c) AS sac, sum(a * y) AS say, sum(c * y) AS scy FROM z WHERE NOT test GROUP BY f),
  fit AS (SELECT *, (saa + alpha) * (scc + alpha) - sac^2 AS det, ((scc + alpha) * say - sac * scy) / ((saa + alpha) * (scc + alpha) - sac^2) AS b1, ((saa + alpha) * scy - sac * say) / ((saa + alpha) * (scc + alpha) - sac^2) AS b2
          FROM s, (SELECT unnest([{_LOO}]) AS alpha, unnest(range(25)) AS ai)),
  e AS (SELECT z.f, ai, sum(((y - my - b1 * a - b2 * c) / (1 - 1.0::DOUBLE / n - ((scc + alpha) * a^2 - 2 * sac * a * c + (saa + alpha) * c^2) / det))^2) AS sse FROM z JOIN fit ON z.f = fit.f WHERE NOT test GROUP BY z.f, ai),
  best AS (SELECT f, arg_min(ai, sse) AS ai FROM e GROUP BY f)"""


@query("ridge_leave_one_out", "seed:i fold:i c_custkey:i pred_loo:d",
       f"{LOO} SELECT 0 AS seed, z.f AS fold, id AS c_custkey, my + b1 * a + b2 * c AS pred_loo FROM z JOIN best ON best.f = z.f JOIN fit ON fit.f = z.f AND fit.ai = best.ai WHERE test")
def _(t):
    return linear.nested_cv(dv.customer_features(t), "c_custkey", EB, [Arm("loo", ("avg_price", "acctbal"), grid=linear.LOO_GRID, tune="loo")])


@query("elastic_net_cv", "seed:i fold:i c_custkey:i pred_net:d",
       linear_cv_sql(_list_rows(FEATURES, "[0]"), len(FEATURES), {"net": {"columns": range(len(FEATURES)), "grid": linear.ELASTIC_GRID}}) + " SELECT seed, fold, id AS c_custkey, pred_net FROM oof")
def _(t):
    return linear.nested_cv(dv.customer_features(t), "c_custkey", EB, [Arm("net", tuple(FEATURES), kind="elastic_net", grid=linear.ELASTIC_GRID)])


CONTROLS = {"anchor": ("avg_price", "acctbal"), "negative": ("avg_price", "noise"), "technical": ("avg_price", "n_orders"), "positive": ("acctbal", "avg_price")}


def _controls_sql() -> str:
    noise = hu("c_custkey", "'control'")
    parts = " UNION ALL ".join(
        f"""SELECT c_custkey AS id, slope AS b, var AS v, {p} AS p, {q if q != "noise" else noise} AS q, '{name}:' || seed AS seed, {hw("c_custkey", "seed")} % 5 AS o,
            {hw("c_custkey", "seed", "'inner'")} % 5 AS g FROM cust, (SELECT unnest([0, 1]) AS seed)""" for name, (p, q) in CONTROLS.items())
    ridge = ridge_sql(f"WITH {dv.CUSTOMERS}, x AS ({parts})")
    split = ridge + ", oof2 AS (SELECT * REPLACE (CAST(split_part(seed, ':', 2) AS INT) AS seed), split_part(seed, ':', 1) AS control FROM oof)"
    return _range_sql(split, "control").replace("FROM oof GROUP BY control", "FROM oof2 GROUP BY control")


@query("control_arms", "control:s n:i r2_base:d r2_aug:d dr2:d dr2_lo:d dr2_hi:d", _controls_sql())
def _(t):
    f = dv.customer_features(t).withColumn("noise", hash_uniform("c_custkey", F.lit("control")))
    return evaluate.control_arms(f, "c_custkey", EB, {k: ([p], [q]) for k, (p, q) in CONTROLS.items()}, seeds=[0, 1])


@query("anchored_control", "control:s n:i dr2:d", f"SELECT control, n, dr2 FROM ({_controls_sql()}) WHERE control = 'anchor'")
def _(t):
    f = dv.customer_features(t)
    got = evaluate.control_arms(f, "c_custkey", EB, {"anchor": (["avg_price"], ["acctbal"])})
    return evaluate.check_anchor(got, 0.0, 1.0)


def _ablation_sql() -> str:
    block = [1, 2, 3]
    names = {1: "avg_price", 2: "acctbal", 3: "share_f"}
    subsets = {"full": block} | {f"only_{names[c]}": [c] for c in block} | {f"drop_{names[c]}": [x for x in block if x != c] for c in block}
    arms = {"base": {"columns": [0], "grid": linear.RIDGE_GRID}} | {k: {"columns": [0, *v], "grid": linear.RIDGE_GRID} for k, v in subsets.items()}
    cv = linear_cv_sql(_list_rows(["n_orders", *names.values()]), 4, arms)
    return _range_sql(cv + ", oof2 AS (" + " UNION ALL ".join(f"SELECT '{k}' AS subset, seed, y, pred_base, pred_{k} AS pred_aug FROM oof" for k in subsets) + ")", "subset").replace(
        "FROM oof GROUP BY subset", "FROM oof2 GROUP BY subset")


@query("block_ablation", "subset:s n:i r2_base:d r2_aug:d dr2:d dr2_lo:d dr2_hi:d", _ablation_sql())
def _(t):
    return evaluate.ablation(dv.customer_features(t), "c_custkey", EB, ["n_orders"], ["avg_price", "acctbal", "share_f"], seeds=[0, 1])


N_PERM = 200
PERM = ridge_sql(f"""WITH {dv.CUSTOMERS}, d AS (SELECT c_custkey, avg_price, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM cust),
  k AS (SELECT rep, c_custkey, {permuted_sql("pos", "n", "rep")} AS pos FROM d, (SELECT unnest(range(1, {N_PERM + 1})) AS rep)),
  sh AS (SELECT rep, k.c_custkey, avg_price FROM k JOIN d USING (pos) UNION ALL SELECT 0, c_custkey, avg_price FROM cust),
  x AS (SELECT c.c_custkey AS id, slope AS b, var AS v, n_orders AS p, sh.avg_price AS q, rep AS seed, {hw("c.c_custkey", "0")} % 5 AS o, 0 AS g FROM cust c JOIN sh ON sh.c_custkey = c.c_custkey)""",
                 "1.0::DOUBLE", 1)


def _null(t):
    return evaluate.permutation_null(dv.customer_features(t), "c_custkey", EB, ["n_orders"], ["avg_price"], n_perm=N_PERM)


@query("permutation_null", "rep:i n:i r2_base:d r2_aug:d dr2:d", f"{PERM} SELECT seed AS rep, {R2} FROM oof GROUP BY seed")
def _(t):
    return _null(t)


@query("permutation_p", "observed:d n_perm:i null_mean:d null_sd:d p_raw:d p_corrected:d",
       f"""{PERM}, r AS (SELECT seed AS rep, {R2} FROM oof GROUP BY seed), o AS (SELECT dr2 AS observed FROM r WHERE rep = 0)
           SELECT max(observed) AS observed, count(*) AS n_perm, avg(dr2) AS null_mean, stddev_pop(dr2) AS null_sd, avg(CASE WHEN dr2 >= observed THEN 1.0::DOUBLE ELSE 0 END) AS p_raw,
                  (count(*) FILTER (WHERE dr2 >= observed) + 1) / (count(*) + 1) AS p_corrected FROM r, o WHERE rep > 0""")
def _(t):
    return evaluate.permutation_p(_null(t))


NOISE = ridge_sql(f"""WITH {dv.CUSTOMERS}, x AS (SELECT c_custkey AS id, slope AS b, var AS v, avg_price AS p,
    sqrt(-2 * ln({hu("c_custkey", "rep", "'noise0'")})) * cos(6.283185307179586::DOUBLE * {hu("c_custkey", "rep", "'noise0'", word=1)}) AS q, rep AS seed, {hw("c_custkey", "0")} % 5 AS o, 0 AS g
  FROM cust, (SELECT unnest(range(20)) AS rep))""", "1.0::DOUBLE", 1)


@query("noise_draws", "rep:i n:i r2_base:d r2_aug:d dr2:d", f"{NOISE} SELECT seed AS rep, {R2} FROM oof GROUP BY seed")
def _(t):
    return evaluate.noise_floor(dv.customer_features(t), "c_custkey", EB, ["avg_price"], width=1, draws=list(range(20)))


@query("noise_summary", "n_draws:i mean:d sd:d min:d max:d p95:d z:d3",
       f"""{NOISE}, r AS (SELECT seed, {R2} FROM oof GROUP BY seed) SELECT count(*) AS n_draws, avg(dr2) AS mean, stddev_samp(dr2) AS sd, min(dr2) AS min, max(dr2) AS max,
           quantile_cont(dr2, 0.95) AS p95, (0.05 - avg(dr2)) / stddev_samp(dr2) AS z FROM r""")
def _(t):
    draws = evaluate.noise_floor(dv.customer_features(t), "c_custkey", EB, ["avg_price"], width=1, draws=list(range(20)))
    return evaluate.noise_summary(draws, "dr2", F.lit(0.05))


def _five_sql() -> str:
    noise = [f"sqrt(-2 * ln({hu('c_custkey', 'rep', f'{chr(39)}noise{i}{chr(39)}')})) * cos(6.283185307179586::DOUBLE * {hu('c_custkey', 'rep', f'{chr(39)}noise{i}{chr(39)}', word=1)})" for i in range(5)]
    rows = f"""WITH {dv.CUSTOMERS}, x AS (SELECT c_custkey AS id, slope AS b, var AS v, [avg_price, {", ".join(noise)}] AS x, rep AS seed, {hw("c_custkey", "0")} % 5 AS o, 0 AS g
      FROM cust, (SELECT unnest(range(20)) AS rep))"""
    return linear_cv_sql(rows, 6, {"base": {"columns": [0], "grid": (1.0,)}, "aug": {"columns": range(6), "grid": (1.0,)}}, inner_k=1)


@query("noise_floor_five_columns", "n_draws:i mean:d sd:d min:d max:d p95:d z:d3",
       f"""{_five_sql()}, r AS (SELECT seed, {R2} FROM oof GROUP BY seed) SELECT count(*) AS n_draws, avg(dr2) AS mean, stddev_samp(dr2) AS sd, min(dr2) AS min, max(dr2) AS max,
           quantile_cont(dr2, 0.95) AS p95, (0.05 - avg(dr2)) / stddev_samp(dr2) AS z FROM r""")
def _(t):
    draws = evaluate.noise_floor(dv.customer_features(t), "c_custkey", EB, ["avg_price"], width=5, draws=list(range(20)))
    return evaluate.noise_summary(draws, "dr2", F.lit(0.05))


def _sites(t):
    """Customers with their site (nation) and the site label shuffled over them with equal sizes."""
    f = folds.cluster_folds(dv.customer_features(t), "c_custkey", "c_nationkey", 20).withColumnRenamed("fold", "site")
    shuffled = folds.shuffled_labels(f.select("c_custkey", "site"), "c_custkey", ["site"], [1]).select("c_custkey", F.col("site").alias("random_site"))
    return f.join(shuffled, "c_custkey")


def _site_oof(t):
    return evaluate.cluster_cv(_sites(t), "c_custkey", EB, ["avg_price"], ["acctbal"], {0: "site", 1: "random_site"}, inner_k=3)


SITE = ridge_sql(f"""WITH {dv.CUSTOMERS}, st AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) >= 20 THEN c_nationkey ELSE -1 END AS site, row_number() OVER (ORDER BY c_custkey) AS pos FROM cust),
  k AS (SELECT c_custkey, row_number() OVER (ORDER BY {hu("c_custkey", "1", "'perm'")}, c_custkey) AS pos FROM cust),
  r AS (SELECT k.c_custkey, site AS random_site FROM k JOIN st USING (pos)),
  x AS (SELECT st.c_custkey AS id, slope AS b, var AS v, avg_price AS p, acctbal AS q, seed, CASE WHEN seed = 0 THEN site ELSE random_site END AS o, {hw("st.c_custkey", "seed", "'inner'")} % 3 AS g
        FROM st JOIN r ON r.c_custkey = st.c_custkey, (SELECT unnest([0, 1]) AS seed))""", inner_k=3)
CELLS = f"""{SITE}, cells AS (SELECT fold AS cluster, {R2}, regr_slope(y, pred_aug) AS cal_slope,
  sqrt(greatest(0, regr_syy(y, pred_aug) - regr_slope(y, pred_aug) * regr_sxy(y, pred_aug)) / (count(*) - 2) / regr_sxx(y, pred_aug)) AS cal_slope_se FROM oof WHERE seed = 0 GROUP BY fold HAVING count(*) >= 20)"""


@query("site_validation", "cluster:i n:i r2_base:d r2_aug:d dr2:d cal_slope:d cal_slope_se:d", f"{CELLS} SELECT * FROM cells")
def _(t):
    return evaluate.cluster_metrics(_site_oof(t).filter(F.col("seed") == 0), "cluster", 20)


@query("site_against_random", "scheme:s n:i r2_base:d r2_aug:d dr2:d",
       f"{SITE} SELECT CASE WHEN seed = 0 THEN 'site' ELSE 'random' END AS scheme, {R2} FROM oof GROUP BY seed")
def _(t):
    oof = _site_oof(t).withColumn("scheme", F.when(F.col("seed") == 0, "site").otherwise("random"))
    return metrics.paired_increment(oof, "pred_base", "pred_aug", ["scheme"])


@query("site_calibration_pooling", "k:i estimate:d se:d ci_lo:d ci_hi:d tau2:d i2_percent:d",
       f"""{CELLS}, c AS (SELECT cal_slope AS e, 1 / cal_slope_se^2 AS w FROM cells WHERE cluster <> -1), q AS (SELECT count(*) AS k, sum(w) AS sw, sum(w * w) AS sww, sum(w * e) / sum(w) AS fx FROM c),
           q2 AS (SELECT max(k) AS k, max(sw) AS sw, max(sww) AS sww, sum(w * (e - fx)^2) AS q FROM c, q),
           h AS (SELECT k, greatest(0, (q - (k - 1)) / (sw - sww / sw)) AS tau2, CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) * 100 ELSE 0 END AS i2_percent FROM q2),
           p AS (SELECT max(k) AS k, max(tau2) AS tau2, max(i2_percent) AS i2_percent, sum(e / (1 / w + tau2)) / sum(1 / (1 / w + tau2)) AS estimate, sqrt(1 / sum(1 / (1 / w + tau2))) AS se FROM c, h)
           SELECT *, estimate - 1.96 * se AS ci_lo, estimate + 1.96 * se AS ci_hi FROM p""")
def _(t):
    sites = evaluate.cluster_metrics(_site_oof(t).filter(F.col("seed") == 0), "cluster", 20).filter(F.col("cluster") != -1)
    return meta.random_effects(sites, [], "cal_slope", "cal_slope_se")


# ---- binary outcomes -----------------------------------------------------------------------


LABEL_COLUMNS = ["avg_price", "acctbal", "n_orders"]


def _stratified(t, seeds):
    """Customers with a stratified outer fold for each seed, and the columns that hold them."""
    f = dv.customer_features(t)
    for s in seeds:
        f = folds.stratified_folds(f, "c_custkey", "label", 5, s).withColumnRenamed("fold", f"outer{s}")
    return f, {s: f"outer{s}" for s in seeds}


def _stratified_rows(columns: list[str], seeds: str = "[0]") -> str:
    return f"""WITH RECURSIVE {dv.CUSTOMERS}, x AS (SELECT c_custkey AS id, label AS y, [{", ".join(columns)}]::DOUBLE[] AS x, seed,
      (row_number() OVER (PARTITION BY seed, label ORDER BY {hu("c_custkey", "seed")}, c_custkey) - 1) % 5 AS o, {hw("c_custkey", "seed", "'inner'")} % 5 AS g FROM cust, (SELECT unnest({seeds}) AS seed))"""


def _label_rows(columns: list[str], seeds: str = "[0]") -> str:
    return f"""WITH RECURSIVE {dv.CUSTOMERS}, x AS (SELECT c_custkey AS id, label AS y, [{", ".join(columns)}]::DOUBLE[] AS x, seed, {hw("c_custkey", "seed")} % 5 AS o,
      {hw("c_custkey", "seed", "'inner'")} % 5 AS g FROM cust, (SELECT unnest({seeds}) AS seed))"""


@query("logistic_cv", "seed:i fold:i c_custkey:i y:i pred:d", logistic_cv_sql(_stratified_rows(LABEL_COLUMNS), 3) + " SELECT seed, fold, id AS c_custkey, y, pred FROM oof")
def _(t):
    f, outer = _stratified(t, [0])
    return logistic.logistic_cv(f, "c_custkey", "label", LABEL_COLUMNS, fold_cols=outer)


@query("logistic_nested_auc", "auc:d auc_lo:d auc_hi:d", logistic_cv_sql(_stratified_rows(LABEL_COLUMNS, "[0, 1]"), 3, logistic.C_GRID) + " " + repeated_auc_sql("oof", ""))
def _(t):
    f, outer = _stratified(t, [0, 1])
    oof = logistic.logistic_cv(f, "c_custkey", "label", LABEL_COLUMNS, seeds=[0, 1], grid=logistic.C_GRID, fold_cols=outer)
    return logistic.repeated_auc(oof, [])


def _recalibrated_sql() -> str:
    """Newton fits of the model and of Platt's line; the isotonic fit as the largest of least means of runs of scores."""
    model = newton_sql("SELECT f AS k1, 0 AS k2, 0 AS k3, 0 AS k4, e, y FROM z WHERE NOT test AND held = 0", "SELECT f AS k1, 0 AS k2, 0 AS k3, 0 AS k4, 1.0::DOUBLE AS c FROM ff", 4, 12)
    line = newton_sql("SELECT f AS k1, 0 AS k2, 0 AS k3, 0 AS k4, [1, p]::DOUBLE[] AS e, y FROM cal", "SELECT f AS k1, 0 AS k2, 0 AS k3, 0 AS k4, 1e6::DOUBLE AS c FROM ff", 2, 20)
    for old in ("ft", "tr", "nt", "be"):
        line = line.replace(f"{old} AS", f"p{old} AS").replace(f"{old}(k1", f"p{old}(k1").replace(f"FROM {old}", f"FROM p{old}").replace(f"JOIN {old} ", f"JOIN p{old} ").replace(f"SELECT {old}.", f"SELECT p{old}.")
    return f"""{_label_rows(LABEL_COLUMNS)}, h AS (SELECT *, ({hw("id", "0", "'calib'")} % 1000 < 250)::INT AS held FROM x),
  ff AS (SELECT DISTINCT o AS f FROM h),
  lg AS (SELECT o, held, unnest(x) AS val, unnest(range(3)) AS i FROM h),
  ms AS (SELECT f, i, avg(val) AS m, stddev_pop(val) AS s FROM lg JOIN ff ON o <> f AND held = 0 GROUP BY f, i),
  sc AS (SELECT f, list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM ms GROUP BY f),
  z AS MATERIALIZED (SELECT id, f, o = f AS test, held, y, list_concat([1::DOUBLE], list_transform(range(3), lambda i: (h.x[i + 1] - m[i + 1]) / s[i + 1])) AS e FROM h, sc),
  {model},
  raw AS (SELECT id, f, test, held, y, 1 / (1 + exp(-{dot("beta", "e")})) AS p FROM z JOIN be ON k1 = f WHERE test OR held = 1),
  cal AS MATERIALIZED (SELECT f, y, p FROM raw WHERE NOT test),
  {line},
  s AS (SELECT f, p, sum(y)::DOUBLE AS t, count(*)::DOUBLE AS w, row_number() OVER (PARTITION BY f ORDER BY p) AS i FROM cal GROUP BY f, p),
  c AS (SELECT *, sum(t) OVER q AS ct, sum(w) OVER q AS cw FROM s WINDOW q AS (PARTITION BY f ORDER BY i)),
  runs AS (SELECT a.f, a.i AS a, b.i AS b, (b.ct - a.ct + a.t) / (b.cw - a.cw + a.w) AS mean FROM c a JOIN c b ON a.f = b.f AND a.i <= b.i),
  least AS (SELECT f, a, b, min(mean) OVER (PARTITION BY f, a ORDER BY b DESC) AS low FROM runs),
  iso AS (SELECT l.f, b AS i, max(low) AS v, any_value(s.p) AS p FROM least l JOIN s ON s.f = l.f AND s.i = l.b GROUP BY l.f, b),
  te AS (SELECT raw.f, raw.id, raw.y, raw.p, 1 / (1 + exp(-(pbe.beta[1] + pbe.beta[2] * raw.p))) AS platt FROM raw JOIN pbe ON k1 = f WHERE test),
  lo AS (SELECT te.*, iso.p AS p0, iso.v AS v0 FROM te ASOF LEFT JOIN iso ON te.f = iso.f AND te.p >= iso.p),
  both_ AS (SELECT lo.*, iso.p AS p1, iso.v AS v1 FROM lo ASOF LEFT JOIN iso ON lo.f = iso.f AND lo.p <= iso.p),
  fin AS (SELECT f, y, p, platt, CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL OR p1 = p0 THEN v0 ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END AS iso FROM both_),
  l AS (SELECT 'raw' AS kind, y, p AS pred FROM fin UNION ALL SELECT 'platt', y, platt FROM fin UNION ALL SELECT 'isotonic', y, iso FROM fin),
  bn AS (SELECT kind, least(floor(pred * 10), 9) AS bin, count(*) AS n, avg(pred) AS mp, avg(y::DOUBLE) AS mt FROM l GROUP BY 1, 2),
  ec AS (SELECT kind, sum(n * abs(mp - mt)) / sum(n) AS ece FROM bn GROUP BY kind),
  au AS (SELECT kind, {AUC} AS auc, avg((pred - y)^2) AS brier FROM (SELECT *, rank() OVER (PARTITION BY kind ORDER BY pred) + (count(*) OVER (PARTITION BY kind, pred) - 1) / 2.0::DOUBLE AS r FROM l) GROUP BY kind)
  SELECT kind, auc, brier, ece FROM au JOIN ec USING (kind)"""


@query("recalibrated_scores", "kind:s auc:d5 brier:d5 ece:d5", _recalibrated_sql())
def _(t):
    oof = logistic.recalibrated_cv(dv.customer_features(t), "c_custkey", "label", LABEL_COLUMNS)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"p_{k}").alias("p")) for k in ("raw", "platt", "isotonic")]))
    long = oof.select("y", each.alias("e")).select("y", "e.kind", "e.p")
    return (metrics.auc(long, ["kind"], "y", "p").join(metrics.brier(long, ["kind"], "y", "p"), "kind")
            .join(metrics.ece(long, ["kind"], "y", "p").drop("n"), "kind"))


@query("boosted_trees", "n:i r2:d mae:d rmse:d")
def _(t):
    oof = logistic.boosted_cv(dv.customer_features(t), "c_custkey", "slope", ["avg_price", "acctbal", "n_orders"], k=3, max_iter=10)
    return metrics.regression_metrics(oof, [])


@query("boosted_classifier", "n_pos:i n_neg:i auc:d")
def _(t):
    oof = logistic.boosted_cv(dv.customer_features(t), "c_custkey", "label", ["avg_price", "acctbal", "n_orders"], kind="binary", k=3, max_iter=5)
    return metrics.auc(oof, [], "y", "pred")


ITEMS = ("share_f", "n_orders", "max_price")


def _items_sql() -> str:
    """The item's place among the alternatives is part of the seed's number, so that one text fits all."""
    items = "[" + ", ".join(f"'{i}'" for i in ITEMS) + "]"
    rows = f"""WITH RECURSIVE {dv.CUSTOMERS}, x AS (SELECT c_custkey AS id, label AS y, [acctbal, [{", ".join(ITEMS)}][k + 1]]::DOUBLE[] AS x, 10 * k + s AS seed, {hw("c_custkey", "s")} % 5 AS o,
      {hw("c_custkey", "s", "'inner'")} % 5 AS g FROM cust, (SELECT unnest([0, 1]) AS s), (SELECT unnest(range({len(ITEMS)})) AS k))"""
    return f"""{logistic_cv_sql(rows, 2)}, named AS (SELECT {items}[seed // 10 + 1] AS item, seed % 10 AS seed, y, pred FROM oof) {repeated_auc_sql("named", "item, ")}"""


@query("item_sensitivity", "item:s auc:d auc_lo:d auc_hi:d", _items_sql())
def _(t):
    """The same questionnaire model under alternative items for one question."""
    f = dv.customer_features(t)
    parts = None
    for item in ITEMS:
        oof = logistic.logistic_cv(f, "c_custkey", "label", ["acctbal", item], seeds=[0, 1]).withColumn("item", F.lit(item))
        parts = oof if parts is None else parts.unionByName(oof)
    return logistic.repeated_auc(parts, ["item"])
