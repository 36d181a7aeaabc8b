"""Pooling over sites, and group comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probability import fisher_exact_p, normal_two_sided_p, t_quantile
from .ranks import average_ranks, join_on_keys


def random_effects(sites: DataFrame, keys: list[str], estimate: str, se: str) -> DataFrame:
    """DerSimonian-Laird pooling: estimate, interval, tau2, I2 and the interval for a new site.

    Two passes of sums over the sites: fixed-effect mean first, then random weights.
    Leave pooled leftover clusters out of `sites`: they are not sites.
    """
    w = 1 / (F.col(se) * F.col(se))
    rows = sites.filter(F.col(estimate).isNotNull() & (F.col(se) > 0))
    s = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"),
        (F.sum(w * F.col(estimate)) / F.sum(w)).alias("fixed"))
    j = join_on_keys(rows, s, keys)
    dev = F.col(estimate) - F.col("fixed")
    q = j.groupBy(*keys).agg(F.max("k").alias("k"), F.max("sw").alias("sw"), F.max("sww").alias("sww"),
                             F.sum(w * dev * dev).alias("q"))
    df, c = F.col("k") - 1, F.col("sw") - F.col("sww") / F.col("sw")
    q = q.select(*keys, "k", "q",
                 F.when(c > 0, F.greatest(F.lit(0.0), (F.col("q") - df) / c)).otherwise(0.0).alias("tau2"),
                 F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - df) / F.col("q")) * 100).otherwise(0.0)
                 .alias("i2_percent"))
    j = join_on_keys(rows, q, keys)
    ws = 1 / (F.col(se) * F.col(se) + F.col("tau2"))
    p = j.groupBy(*keys).agg(F.max("k").alias("k"), F.max("tau2").alias("tau2"), F.max("i2_percent").alias("i2_percent"),
                             (F.sum(ws * F.col(estimate)) / F.sum(ws)).alias("estimate"),
                             F.sqrt(1 / F.sum(ws)).alias("se")).filter(F.col("k") >= 2)
    half = t_quantile(F.lit(0.975), (F.col("k") - 2).cast("double")) * F.sqrt(F.col("tau2") + F.col("se") * F.col("se"))
    p = p.withColumn("half", half)
    return p.select(*keys, "k", "estimate", "se", (F.col("estimate") - 1.96 * F.col("se")).alias("ci_lo"),
                    (F.col("estimate") + 1.96 * F.col("se")).alias("ci_hi"), "tau2", "i2_percent",
                    (F.col("estimate") - F.col("half")).alias("pi_lo"), (F.col("estimate") + F.col("half")).alias("pi_hi"))


def mann_whitney(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """U of group 1 and the two-sided p of its tie- and continuity-corrected normal approximation."""
    from .ranks import cumulate

    one, zero = (F.col(group) == 1).cast("long"), (F.col(group) == 0).cast("long")
    c = cumulate(df.filter(F.col(group).isin(0, 1)), keys, value, {"one": one, "zero": zero})
    t = (F.col("one") + F.col("zero")).cast("double")
    below = F.col("cum_zero") - F.col("zero")
    g = c.groupBy(*keys).agg(
        F.max("tot_one").alias("n1"), F.max("tot_zero").alias("n0"),
        F.sum(F.col("one") * (below + F.col("zero") / 2)).alias("u"), F.sum(t * t * t - t).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(F.col("u") - n1 * n0 / 2) - 0.5, F.lit(0.0)) / sd
    return g.select(*keys, "n1", "n0", "u", F.when((F.col("n1") > 0) & (F.col("n0") > 0) & (sd > 0),
                                                   F.least(F.lit(1.0), normal_two_sided_p(z))).alias("p"))


def two_by_two(df: DataFrame, keys: list[str], exposure: str, event: str, min_n: int = 0) -> DataFrame:
    """Cell counts, event rates and Fisher's exact p of a 2x2 table per key."""
    rows = df.filter(F.col(exposure).isin(0, 1) & F.col(event).isin(0, 1))

    def cell(x: int, y: int) -> Column:
        return F.count_if((F.col(exposure) == x) & (F.col(event) == y))

    g = rows.groupBy(*keys).agg(cell(1, 1).alias("n11"), cell(1, 0).alias("n10"),
                                cell(0, 1).alias("n01"), cell(0, 0).alias("n00"))
    a, b, c, d = (F.col(x) for x in ("n11", "n10", "n01", "n00"))
    full = (a + b > 0) & (c + d > 0) & (a + c > 0) & (b + d > 0) & (a + b + c + d >= min_n)
    return g.withColumns({"rate1": F.try_divide(a, a + b), "rate0": F.try_divide(c, c + d),
                          "p": F.when(full, fisher_exact_p(a, b, c, d))})


def carrier_effect(df: DataFrame, keys: list[str], carrier: str, y: str) -> DataFrame:
    """Means by carrier, standardised difference, and the R2 a binary predictor of that prevalence can reach."""
    rows = df.filter(F.col(carrier).isNotNull() & F.col(y).isNotNull())
    on = F.col(carrier) > 0
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(on.cast("double")).alias("prevalence"),
        F.avg(F.when(on, F.col(y))).alias("mean_carrier"), F.avg(F.when(~on, F.col(y))).alias("mean_other"),
        F.var_samp(y).alias("v"))
    diff = F.col("mean_carrier") - F.col("mean_other")
    p = F.col("prevalence")
    return g.select(*keys, "n", "prevalence", "mean_carrier", "mean_other", diff.alias("difference"),
                    F.when(F.col("v") > 0, diff / F.sqrt("v")).alias("cohens_d"),
                    F.when(F.col("v") > 0, p * (1 - p) * diff * diff / F.col("v")).alias("r2_ceiling"))


def group_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median and count per group."""
    from .ranks import exact_quantiles

    return exact_quantiles(df, [group], value, {"median": 0.5})


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation: Pearson on tie-averaged ranks."""
    rows = df.select(x, y).dropna()
    rx = average_ranks(rows, [], x, "rx").select(x, "rx")
    ry = average_ranks(rows, [], y, "ry").select(y, "ry")
    return rows.join(rx, x).join(ry, y).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("spearman"))
