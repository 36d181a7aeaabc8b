"""Per-subject decline rates from long visit tables, and their empirical-Bayes shrinkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import average_ranks, join_on_keys, number_rows


def _moments(subject: str, time: str, score: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_visits"), F.avg(time).alias("mean_t"), F.avg(score).alias("mean_y"),
            F.regr_sxx(score, time).alias("sxx"), F.regr_syy(score, time).alias("syy"),
            F.regr_sxy(score, time).alias("sxy")]


def _slope(n: Column, sxx: Column, sxy: Column) -> Column:
    return F.when((n >= 3) & (sxx > 0), sxy / sxx)


def _slope_var(n: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    ssr = F.greatest(syy - sxy * sxy / sxx, F.lit(0.0))
    return F.when((n >= 3) & (sxx > 0), ssr / (n - 2) / sxx)


def subject_slopes(visits: DataFrame, subject: str, time: str, score: str, event: str) -> DataFrame:
    """One row per subject: least-squares slope, its sampling variance, and the
    slope without the earliest visit.

    Sums are combined map-side, so a subject's rows are not shuffled; only distinct (subject, event) pairs are, to be
    counted. The earliest visit is taken back out of the second moments (an exact
    down-date), so no window over a subject's visits is needed and a subject
    with very many visits is still combined map-side.
    """
    rows = visits.filter(F.col(time).isNotNull() & F.col(score).isNotNull())
    g = rows.groupBy(subject).agg(
        *_moments(subject, time, score),
        (F.max(time) - F.min(time)).alias("span"),
        F.min(F.struct(F.col(time).alias("t"), F.col(event).alias("e"), F.col(score).alias("y"))).alias("first"))
    events = rows.select(F.col(subject).alias("__s"), F.col(event).alias("__e")).distinct().groupBy("__s").agg(F.count("__e").alias("n_events"))
    g = g.join(events, F.col(subject).eqNullSafe(F.col("__s"))).drop("__s")
    n, t0, y0 = F.col("n_visits"), F.col("first.t"), F.col("first.y")
    mt = (n * F.col("mean_t") - t0) / F.nullif(n - 1, F.lit(0))
    my = (n * F.col("mean_y") - y0) / F.nullif(n - 1, F.lit(0))
    g = g.withColumns({
        "sxx_x": F.col("sxx") - (t0 - F.col("mean_t")) * (t0 - mt),
        "sxy_x": F.col("sxy") - (t0 - F.col("mean_t")) * (y0 - my)})
    return g.select(
        subject, "n_visits", "n_events", "span", "mean_y", "sxx",
        _slope(n, F.col("sxx"), F.col("sxy")).alias("ols_slope"),
        _slope_var(n, F.col("sxx"), F.col("sxy"), F.col("syy")).alias("slope_var"),
        _slope(n - 1, F.col("sxx_x"), F.col("sxy_x")).alias("slope_excl_first"))


def eligible(slopes: DataFrame, min_events: int, min_span: float) -> DataFrame:
    """Subjects with enough distinct visits over a long enough span, and a defined slope."""
    return slopes.filter((F.col("n_events") >= min_events) & (F.col("span") >= min_span)
                         & F.col("slope_var").isNotNull())


def _tau2(n: Column, m2: Column, mean_v: Column) -> Column:
    return F.when(n >= 2, F.greatest(F.lit(0.0), m2 / (n - 1) - mean_v)).otherwise(F.lit(0.0))


def shrinkage_params(slopes: DataFrame, keys: list[str] | None = None, drop_zero_var: bool = False) -> DataFrame:
    """Method-of-moments prior per key: mu, tau2, residual_var, n_used.

    `drop_zero_var` leaves out subjects whose slope fits their visits exactly.
    """
    rows = slopes.filter(F.col("slope_var") > 0) if drop_zero_var else slopes
    g = rows.groupBy(*(keys or [])).agg(
        F.count("ols_slope").alias("n_used"), F.avg("ols_slope").alias("mu"),
        F.regr_sxx("ols_slope", "ols_slope").alias("m2"), F.avg("slope_var").alias("residual_var"))
    return g.select(*(keys or []), F.coalesce("mu", F.lit(0.0)).alias("mu"),
                    _tau2(F.col("n_used"), F.col("m2"), F.col("residual_var")).alias("tau2"),
                    "residual_var", "n_used")


def shrunken(mu: Column, tau2: Column, slope: Column, var: Column) -> Column:
    """mu + w (slope - mu) with w = tau2 / (tau2 + var), and w = 0 where that is 0 / 0."""
    weight = F.when(tau2 + var > 0, tau2 / (tau2 + var)).otherwise(F.lit(0.0))
    return mu + weight * (slope - mu)


def shrink(slopes: DataFrame, params: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Shrunken slope per subject under *passed* parameters (fitted elsewhere, e.g. on training rows)."""
    j = join_on_keys(slopes, params.select(*(keys or []), "mu", "tau2"), keys or [])
    return j.withColumn("eb_slope", shrunken(F.col("mu"), F.col("tau2"), F.col("ols_slope"),
                                             F.col("slope_var"))).drop("mu", "tau2")


def training_params(folded: DataFrame) -> DataFrame:
    """Shrinkage parameters of every training set: all rows of a seed but those of one fold.

    `folded` has (seed, fold, ols_slope, slope_var), each subject once per seed.
    Only fold-level moments are aggregated; a training set is their total minus
    the held-out fold, merged exactly, so no row is copied per fold. The
    window runs over seeds x folds rows.
    """
    cell = folded.groupBy("seed", "fold").agg(
        F.count("ols_slope").alias("n"), F.avg("ols_slope").alias("m"),
        F.regr_sxx("ols_slope", "ols_slope").alias("m2"), F.sum("slope_var").alias("v"))
    all_folds = Window.partitionBy("seed")
    t = cell.withColumns({"all_n": F.sum("n").over(all_folds), "all_v": F.sum("v").over(all_folds),
                          "all_m": F.sum(F.col("n") * F.col("m")).over(all_folds) / F.sum("n").over(all_folds)})
    off = F.col("m") - F.col("all_m")
    t = t.withColumn("all_m2", F.sum(F.col("m2") + F.col("n") * off * off).over(all_folds))
    n = F.col("all_n") - F.col("n")
    mu = (F.col("all_n") * F.col("all_m") - F.col("n") * F.col("m")) / F.nullif(n, F.lit(0))
    gap = F.col("m") - mu
    m2 = F.col("all_m2") - F.col("m2") - gap * gap * F.col("n") * n / F.col("all_n")
    mean_v = (F.col("all_v") - F.col("v")) / F.nullif(n, F.lit(0))
    return t.select("seed", "fold", F.coalesce(mu, F.lit(0.0)).alias("mu"),
                    _tau2(n, m2, mean_v).alias("tau2"), mean_v.alias("residual_var"), n.alias("n_used"))


def intercept_slope_corr(slopes: DataFrame) -> DataFrame:
    """Correlation of a subject's mean score with its slope; NULL below three subjects."""
    g = slopes.agg(F.corr("mean_y", "ols_slope").alias("r"), F.count("ols_slope").alias("n"))
    return g.select(F.when(F.col("n") >= 3, F.col("r")).alias("r"), "n")


def reliability(slopes: DataFrame, strata: Column | None = None) -> DataFrame:
    """tau2 / (tau2 + mean sampling variance), overall or per stratum.

    tau2 and the residual variance always come from all subjects; a stratum
    brings its own time spread: v_i = residual_var / sxx_i.
    """
    params = shrinkage_params(slopes)
    if strata is None:
        return params.select(F.lit("all").alias("stratum"), F.col("n_used").alias("n"),
                             F.col("residual_var").alias("mean_v"),
                             (F.col("tau2") / (F.col("tau2") + F.col("residual_var"))).alias("reliability"))
    j = join_on_keys(slopes, params.select("tau2", "residual_var"), [])
    g = j.groupBy(strata.alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.max("tau2").alias("tau2"),
        F.avg(F.col("residual_var") / F.col("sxx")).alias("mean_v"))
    return g.select("stratum", "n", "mean_v", (F.col("tau2") / (F.col("tau2") + F.col("mean_v"))).alias("reliability"))


def split_half_slopes(visits: DataFrame, subject: str, time: str, score: str, event: str) -> DataFrame:
    """Slopes from each subject's odd and even visits (1st, 3rd, ... and 2nd, 4th, ...)."""
    rows = visits.filter(F.col(time).isNotNull() & F.col(score).isNotNull()).select(subject, time, score, event)
    v = number_rows(rows, [subject], time, [event], "visit")
    aggs = []
    for half, rest in (("odd", 1), ("even", 0)):
        y = F.when(F.col("visit") % 2 == rest, F.col(score))
        t = F.when(F.col("visit") % 2 == rest, F.col(time))
        aggs += [F.count(y).alias(f"n_{half}"), F.regr_sxx(y, t).alias(f"sxx_{half}"),
                 F.regr_sxy(y, t).alias(f"sxy_{half}")]
    g = v.groupBy(subject).agg(*aggs)
    both = g.select(subject, *[_slope(F.col(f"n_{h}"), F.col(f"sxx_{h}"), F.col(f"sxy_{h}")).alias(f"slope_{h}")
                               for h in ("odd", "even")])
    return both.dropna()


def split_half_reliability(halves: DataFrame, subject: str) -> DataFrame:
    """Pearson and Spearman correlation of the half slopes, and Spearman-Brown 2r / (1 + r)."""
    halves = cut_lineage(halves)
    ranked = halves
    for h in ("odd", "even"):
        r = average_ranks(halves, [], f"slope_{h}", f"rank_{h}").select(f"slope_{h}", f"rank_{h}")
        ranked = ranked.join(r, f"slope_{h}")
    g = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("slope_odd", "slope_even").alias("pearson"),
                   F.corr("rank_odd", "rank_even").alias("spearman"))
    return g.select("n", "pearson", "spearman",
                    (2 * F.col("pearson") / (1 + F.col("pearson"))).alias("spearman_brown"))


def conversion_label(visits: DataFrame, subject: str, event: str, state: str,
                     baseline: str = "BL", normal: int = 1, impaired: int = 2) -> DataFrame:
    """Subjects normal at baseline, with 1.0 if a later visit reached `impaired`."""
    g = visits.groupBy(subject).agg(
        F.max(F.when(F.col(event) == baseline, (F.col(state) == normal).cast("int"))).alias("normal"),
        F.max(F.when((F.col(event) != baseline) & (F.col(state) >= impaired), 1)).alias("later"))
    return g.filter(F.col("normal") == 1).select(subject, F.coalesce("later", F.lit(0)).cast("double").alias("converted"))


def ever_positive(rows: DataFrame, subject: str, item: str, name: str) -> DataFrame:
    """Highest answer a subject ever gave, over the visits that have one."""
    return rows.groupBy(subject).agg(F.max(item).alias(name)).filter(F.col(name).isNotNull())
