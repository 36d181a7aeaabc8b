"""Scores of predictions, grouped by any keys. Everything is partial sums, score
histograms or order statistics; nothing sorts a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import cumulate, exact_quantiles, join_on_keys, number_rows


def _r2(y: str, pred: str) -> tuple[Column, Column]:
    sse = F.sum((F.col(y) - F.col(pred)) * (F.col(y) - F.col(pred)))
    return sse, F.regr_syy(y, y)


def regression_metrics(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred",
                       min_n: int = 1) -> DataFrame:
    """n, R2 (NULL when the truth is constant), MAE and RMSE; NULL below `min_n` rows."""
    rows = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    sse, sst = _r2(y, pred)
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sse.alias("sse"), sst.alias("sst"),
                                F.avg(F.abs(F.col(y) - F.col(pred))).alias("mae"))
    enough = F.col("n") >= min_n
    return g.select(*keys, "n", F.when(enough & (F.col("sst") > 0), 1 - F.col("sse") / F.col("sst")).alias("r2"),
                    F.when(enough, F.col("mae")).alias("mae"),
                    F.when(enough, F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"))


def repeat_summary(long_oof: DataFrame, keys: list[str], canonical: int) -> DataFrame:
    """Pooled R2 of the canonical seed, mean of its fold R2s, and the range of pooled R2 over seeds.

    The range is the spread over repeats, not a confidence interval.
    """
    pooled = regression_metrics(long_oof, [*keys, "seed"])
    folds = regression_metrics(long_oof.filter(F.col("seed") == canonical), [*keys, "fold"])
    a = pooled.groupBy(*keys).agg(
        F.max(F.when(F.col("seed") == canonical, F.col("r2"))).alias("r2"), F.min("r2").alias("repeat_lo"),
        F.max("r2").alias("repeat_hi"), F.count("r2").alias("n_repeats"),
        F.max(F.when(F.col("seed") == canonical, F.col("n"))).alias("n"))
    return a.join(folds.groupBy(*keys).agg(F.avg("r2").alias("r2_fold_mean")), keys)


def paired_increment(oof: DataFrame, base: str, aug: str, keys: list[str]) -> DataFrame:
    """R2 of both predictions on the rows that have both, and their difference; `unscored` counts the other rows."""
    scored = F.col(base).isNotNull() & F.col(aug).isNotNull()
    y = F.when(scored, F.col("y"))
    g = oof.groupBy(*keys).agg(
        F.count(y).alias("n"), F.count_if(~scored).alias("unscored"), F.regr_syy(y, y).alias("sst"),
        F.sum((y - F.col(base)) * (y - F.col(base))).alias("sse_base"),
        F.sum((y - F.col(aug)) * (y - F.col(aug))).alias("sse_aug"))
    ok = F.col("sst") > 0
    return g.select(*keys, "n", F.when(ok, 1 - F.col("sse_base") / F.col("sst")).alias("r2_base"),
                    F.when(ok, 1 - F.col("sse_aug") / F.col("sst")).alias("r2_aug"),
                    F.when(ok, (F.col("sse_base") - F.col("sse_aug")) / F.col("sst")).alias("dr2"), "unscored")


def increment_range(per_seed: DataFrame, canonical: int, keys: list[str] | None = None) -> DataFrame:
    """The canonical seed's increment, with the observed range over seeds."""
    first = {c: F.max(F.when(F.col("seed") == canonical, F.col(c))).alias(c) for c in ("n", "r2_base", "r2_aug", "dr2")}
    return per_seed.groupBy(*(keys or [])).agg(
        *first.values(), F.min("dr2").alias("dr2_lo"), F.max("dr2").alias("dr2_hi"))


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counted half, from the histogram of scores."""
    c = cumulate(df, keys, score, {"pos": (F.col(label) == 1).cast("long"), "neg": (F.col(label) != 1).cast("long")})
    below = F.col("cum_neg") - F.col("neg")
    g = c.groupBy(*keys).agg(F.max("tot_pos").alias("n_pos"), F.max("tot_neg").alias("n_neg"),
                             F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("wins"))
    return g.select(*keys, "n_pos", "n_neg", area().alias("auc"))


def area() -> Column:
    """The area from `wins` (pairs in order, ties half), `n_pos` and `n_neg`; NULL where there is one class only."""
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return F.when(ok, F.col("wins") / F.col("n_pos").cast("double") / F.col("n_neg"))


def auc_ordinal(df: DataFrame, keys: list[str], label: str, score: str, tie: str) -> DataFrame:
    """The same area from ordinal ranks: equal scores take consecutive ranks in `tie` order."""
    r = number_rows(df.select(*keys, label, score, tie), keys, score, [tie], "__r")
    g = r.groupBy(*keys).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) != 1).alias("n_neg"),
        F.sum(F.when(F.col(label) == 1, F.col("__r"))).alias("s"))
    p = F.col("n_pos").cast("double")
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return g.select(*keys, "n_pos", "n_neg",
                    F.when(ok, (F.col("s") - p * (p + 1) / 2) / (p * F.col("n_neg"))).alias("auc"))


def brier(df: DataFrame, keys: list[str], label: str, prob: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(prob) - F.col(label)) * (F.col(prob) - F.col(label))).alias("brier"))


def reliability_bins(df: DataFrame, keys: list[str], label: str, prob: str, bins: int = 10) -> DataFrame:
    """Uniform bins on [0, 1], the last one closed."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))
    return (df.groupBy(*keys, b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_pred"),
                 F.avg(F.col(label).cast("double")).alias("mean_true"))
            .withColumn("bin_lo", F.col("bin") / bins).withColumn("bin_hi", (F.col("bin") + 1) / bins))


def ece(df: DataFrame, keys: list[str], label: str, prob: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over `reliability_bins`."""
    b = reliability_bins(df, keys, label, prob, bins)
    g = b.groupBy(*keys).agg(F.sum(F.col("n") * F.abs(F.col("mean_pred") - F.col("mean_true"))).alias("s"),
                             F.sum("n").alias("n"))
    return g.select(*keys, "n", (F.col("s") / F.col("n")).alias("ece"))


def calibration_line(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred", min_n: int = 3,
                     min_sd: float = 1e-12) -> DataFrame:
    """Least squares of truth on prediction: slope (with standard error), intercept, mean error.

    NULL where there are too few rows or the prediction is constant.
    """
    rows = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(pred).alias("mp"),
        F.regr_sxx(y, pred).alias("sxx"), F.regr_sxy(y, pred).alias("sxy"), F.regr_syy(y, pred).alias("syy"))
    ok = (F.col("n") >= min_n) & (F.sqrt(F.col("sxx") / F.col("n")) >= min_sd)
    slope = F.col("sxy") / F.col("sxx")
    ssr = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    return g.select(*keys, "n", F.when(ok, slope).alias("cal_slope"),
                    F.when(ok & (F.col("n") > 2), F.sqrt(ssr / (F.col("n") - 2) / F.col("sxx"))).alias("cal_slope_se"),
                    F.when(ok, F.col("my") - slope * F.col("mp")).alias("cal_intercept"),
                    F.when(ok, F.col("mp") - F.col("my")).alias("citl"))


def quantile_bins(df: DataFrame, y: str, pred: str, bins: int = 10) -> DataFrame:
    """Calibration curve over equal-count bins of the prediction; edges are exact percentiles."""
    edges = exact_quantiles(df, [], pred, {f"e{i}": i / bins for i in range(bins + 1)})
    j = join_on_keys(df.select(y, pred), edges.drop("n"), [])
    at = F.lit(None).cast("int")
    for i in range(bins):
        hi = F.col(pred) <= F.col(f"e{i + 1}") if i == bins - 1 else F.col(pred) < F.col(f"e{i + 1}")
        at = F.coalesce(at, F.when((F.col(pred) >= F.col(f"e{i}")) & hi, F.lit(i)))
    return (j.withColumn("bin", at).filter(F.col("bin").isNotNull()).groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(pred).alias("mean_pred"), F.avg(y).alias("mean_obs")))


def conformal_loo(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred", alpha: float = 0.10) -> DataFrame:
    """Coverage and mean width of intervals whose half-width is a quantile of all *other* residuals.

    Leaving a residual out shifts the sorted list by one above its place, so each
    point's quantile is read from three order statistics of the full list. Points are
    counted per distinct residual.
    """
    rows = (df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
            .select(*keys, F.abs(F.col(y) - F.col(pred)).alias("res")))
    c = cumulate(rows, keys, "res", {"cnt": F.lit(1).cast("long")})
    n = F.col("tot_cnt")
    level = F.least(F.lit(1.0), F.ceil(F.round(n * F.lit(1 - alpha), 9)) / (n - 1))
    h = (n - 2) * level
    j = F.floor(h)
    first = F.col("cum_cnt") - F.col("cnt") + 1        # 1-based place of the value's first copy
    c = c.withColumns({"j": j, "g": h - j, "first": first})

    def stat(place: Column) -> Column:                 # 1-based order statistic of the full list
        return F.max(F.when((F.col("first") <= place) & (place <= F.col("cum_cnt")), F.col("res")))

    stats = c.groupBy(*keys).agg(*[stat(F.least(F.col("j") + i, n)).alias(f"r{i}") for i in (1, 2, 3)])
    c = join_on_keys(c, stats, keys)
    lo = F.when(F.col("first") > F.col("j") + 1, F.col("r1")).otherwise(F.col("r2"))
    nxt = F.least(F.col("j") + 1, n - 2)               # 0-based upper order statistic of the shorter list
    hi = F.when(nxt == F.col("j"), lo).when(F.col("first") > nxt + 1, F.col("r2")).otherwise(F.col("r3"))
    q = lo + F.col("g") * (hi - lo)
    g = c.groupBy(*keys).agg(
        F.max("tot_cnt").alias("n"),
        (F.sum(F.when(F.col("res") <= q, F.col("cnt")).otherwise(0)) / F.max("tot_cnt")).alias("coverage"),
        (F.sum(2 * q * F.col("cnt")) / F.max("tot_cnt")).alias("mean_width"))
    few = F.col("n") < 3
    return g.select(*keys, "n", F.when(~few, F.col("coverage")).alias("coverage"),
                    F.when(~few, F.col("mean_width")).alias("mean_width"))


def conformal_strata(df: DataFrame, stratum: str, y: str = "y", pred: str = "pred", alpha: float = 0.10) -> DataFrame:
    """One half-width for everyone against one per stratum, with the coverage the former gives each stratum."""
    rows = df.select(stratum, F.abs(F.col(y) - F.col(pred)).alias("res"))
    both = exact_quantiles(rows, [stratum], "res", {"stratum_q": 1 - alpha})
    all_q = exact_quantiles(rows, [], "res", {"marginal_q": 1 - alpha}).select("marginal_q")
    j = join_on_keys(rows, all_q, [])
    cover = j.groupBy(stratum).agg(F.avg((F.col("res") <= F.col("marginal_q")).cast("double")).alias("coverage_at_marginal"),
                                   F.max("marginal_q").alias("marginal_q"))
    return cover.join(both, stratum).withColumn("stratum_width", 2 * F.col("stratum_q"))


def tertile_axis(df: DataFrame, column: str, axis: str) -> Column:
    """Level of an exact-tertile axis, with its cuts as scalar subqueries. NULL belongs to no level."""
    third = 1.0 / 3.0
    cut = exact_quantiles(df, [], column, {"a": third, "b": 2.0 * third}).select(F.struct("a", "b").alias("c")).scalar()
    x = F.col(column)
    return (F.when(x <= cut["a"], F.lit(f"{axis}_low")).when(x <= cut["b"], F.lit(f"{axis}_mid"))
            .when(x.isNotNull(), F.lit(f"{axis}_high")))


def subgroup_audit(df: DataFrame, axes: dict[str, Column], y: str = "y", pred: str = "pred", min_n: int = 10
                   ) -> DataFrame:
    """R2, RMSE and calibration per level of several axes at once.

    A row is offered to each axis by a generator over a literal array; only the
    partial sums per (axis, level) are shuffled. Levels under `min_n` keep their count only.
    """
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c.alias("level")) for a, c in axes.items()]))
    rows = (df.select(F.col(y).alias("y"), F.col(pred).alias("pred"), each.alias("e"))
            .select("y", "pred", "e.axis", "e.level").filter(F.col("level").isNotNull()))
    m = regression_metrics(rows, ["axis", "level"], min_n=min_n)
    c = calibration_line(rows, ["axis", "level"], min_n=min_n, min_sd=1e-9).select(
        "axis", "level", "cal_slope", "cal_intercept")
    return m.select("axis", "level", "n", "r2", "rmse").join(c, ["axis", "level"])


def disparity(audit: DataFrame) -> DataFrame:
    """Per axis: spread of R2 over reported levels and the worst distance of a calibration slope from 1."""
    g = audit.groupBy("axis").agg(F.count("r2").alias("levels"), (F.max("r2") - F.min("r2")).alias("s"),
                                  F.max(F.abs(F.col("cal_slope") - 1)).alias("worst_cal_slope_dev"))
    return g.select("axis", "levels", F.when(F.col("levels") >= 2, F.col("s")).alias("r2_spread"), "worst_cal_slope_dev")


def outcome_gradient(df: DataFrame, level: str, y: str, cutoff: float = -0.3) -> DataFrame:
    """Mean, spread, share below a cut-off and variance ratio of the outcome per level."""
    whole = df.agg(F.var_pop(y).alias("__all"))
    g = df.filter(F.col(level).isNotNull() & F.col(y).isNotNull()).groupBy(level).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("sd"),
        (100 * F.avg((F.col(y) < cutoff).cast("double"))).alias("pct_below"), F.var_pop(y).alias("__v"))
    return join_on_keys(g, whole, []).select(level, "n", "mean", "sd", "pct_below",
                                             (F.col("__v") / F.col("__all")).alias("variance_ratio"))


def strata_increment(oof: DataFrame, stratum: str, base: str, aug: str, min_n: int = 20) -> DataFrame:
    """Score shared out-of-fold rows inside each stratum. Models are never refitted per stratum.

    Strata are a column of the rows, so they partition them. Cells under `min_n` keep their count only.
    """
    y = F.col("y")
    g = oof.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n"), F.regr_syy("y", "y").alias("sst"), F.stddev_samp("y").alias("sd"),
        F.avg((y - F.col(base)) * (y - F.col(base))).alias("mse_b"),
        F.avg((y - F.col(aug)) * (y - F.col(aug))).alias("mse_a"))
    ok = F.col("n") >= min_n
    gain = F.sqrt("mse_b") - F.sqrt("mse_a")
    return g.select(
        stratum, "n", F.when(ok, (F.col("mse_b") - F.col("mse_a")) * F.col("n") / F.col("sst")).alias("dr2"),
        F.when(ok, F.sqrt("mse_b")).alias("rmse_base"), F.when(ok, F.sqrt("mse_a")).alias("rmse_aug"),
        F.when(ok, gain).alias("rmse_gain"), F.when(ok, 100 * gain / F.col("sd")).alias("rmse_gain_pct_sd"),
        F.when(ok, F.col("sd")).alias("outcome_sd"))


def surviving_gap(cells: DataFrame, stratum: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Differences of dr2 between two strata, and the share of the first that the second keeps."""
    (a, (a1, a2)), (b, (b1, b2)) = pairs.items()

    def at(s: str) -> Column:
        return F.max(F.when(F.col(stratum) == s, F.col("dr2")))

    g = cells.agg((at(a1) - at(a2)).alias(f"gap_{a}"), (at(b1) - at(b2)).alias(f"gap_{b}"))
    return g.withColumn("surviving", F.when(F.col(f"gap_{a}") != 0, F.col(f"gap_{b}") / F.col(f"gap_{a}")))
