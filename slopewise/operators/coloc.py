"""Colocalization of two traits at a locus by approximate Bayes factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import running_total

# Prior probabilities and prior effect sizes.
P1, P2, P12 = 1e-4, 1e-4, 1e-5
SD_QUANT, SD_BINARY = 0.15, 0.2
MIN_VARIANTS = 2
MIN_HARMONISED = 5
MIN_PANEL = 10


def log_abf(beta: Column, se: Column, sd_prior: float) -> Column:
    """Wakefield's log approximate Bayes factor."""
    v = se * se
    r = F.lit(sd_prior * sd_prior) / (F.lit(sd_prior * sd_prior) + v)
    z = beta / se
    return 0.5 * (F.log(1 - r) + r * z * z)


BAND = 500.0


def log_sum_exp(rows: DataFrame, keys: list[str], logs: dict[str, Column]) -> DataFrame:
    """Per key: log of the summed exponentials of each column, and how many rows had it, in one aggregation.

    Rows are summed inside bands of 500 log units, where exponentials are safe, and the few bands of a
    key are put together at the end. No maximum has to be known first, so the rows are read once and a
    crowded key is combined map-side. NULL logs count for nothing; a key of NULLs only still appears.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), c.alias("l")) for name, c in logs.items()]))
    r = rows.select(*keys, each.alias("e")).select(*keys, "e.kind", "e.l").withColumn("band", F.floor(F.col("l") / BAND))
    per = r.groupBy(*keys, "kind", "band").agg(F.count("l").alias("n"), F.sum(F.exp(F.col("l") - F.col("band") * BAND)).alias("s"))
    of_key = Window.partitionBy(*keys, "kind")           # bands of a key: the spread of its logs / 500
    per = per.withColumn("top", F.max("band").over(of_key))
    g = per.groupBy(*keys, "kind").agg(
        F.sum("n").alias("n"), F.max("top").alias("top"), F.sum(F.col("s") * F.exp((F.col("band") - F.col("top")) * BAND)).alias("s"))
    value = F.col("top") * BAND + F.log(F.col("s"))
    return g.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("kind") == k, value)).alias(f"lse_{k}") for k in logs])


def posteriors(pairs: DataFrame, keys: list[str], sd_y: float = 1.0) -> DataFrame:
    """PP0..PP4 per locus. Exposure quantitative, outcome case-control.

    One aggregation over the rows (`log_sum_exp`), so z^2 in the thousands neither overflows nor vanishes. Loci
    with too few usable rows come out as not estimable, with a placeholder 0 for pp4.
    """
    ok = (F.col("se_exp") > 0) & (F.col("se_out") > 0) & F.col("beta_exp").isNotNull() & F.col("beta_out").isNotNull()
    rows = pairs.select(*keys, F.when(ok, log_abf(F.col("beta_exp"), F.col("se_exp"), SD_QUANT * sd_y)).alias("l1"),
                        F.when(ok, log_abf(F.col("beta_out"), F.col("se_out"), SD_BINARY)).alias("l2"))
    s = log_sum_exp(rows, keys, {"1": F.col("l1"), "2": F.col("l2"), "12": F.col("l1") + F.col("l2")})
    a1, a2, a3 = F.col("lse_1"), F.col("lse_2"), F.col("lse_12")
    peak = F.greatest(F.lit(0.0), a1, a2, a1 + a2, a3)
    w = {0: F.exp(-peak), 1: P1 * F.exp(a1 - peak), 2: P2 * F.exp(a2 - peak),
         3: P1 * P2 * F.greatest(F.lit(0.0), F.exp(a1 + a2 - peak) - F.exp(a3 - peak)), 4: P12 * F.exp(a3 - peak)}
    total = w[0] + w[1] + w[2] + w[3] + w[4]
    enough = F.col("n") >= MIN_VARIANTS
    return s.select(*keys, F.col("n").alias("n_variants"), enough.alias("pp4_estimable"),
                    *[F.when(enough, w[i] / total).alias(f"pp{i}") for i in range(4)],
                    F.when(enough, w[4] / total).otherwise(0.0).alias("pp4"))


def route_method(loci: DataFrame, n_signals: str, n_harmonised: str, n_panel: str, n_usable: str | None = None,
                 n_shared: str | None = None) -> DataFrame:
    """Method asked for, and the label the result must carry.

    More than one signal asks for the multi-signal method. Under five harmonised variants there is no
    data; under ten in the reference panel it falls back. With `n_usable` (variants with usable effects and errors), a locus that has
    none is an error; with `n_shared` (variants that both traits' credible sets hold), the multi-signal method without
    any has no credible set to compare. The suffix travels with the value.
    """
    many = lambda c: F.coalesce(F.col(c), F.lit(0))
    asked = F.when(F.col(n_signals) > 1, "multi_signal").otherwise("abf")
    used = F.when((asked == "multi_signal") & (many(n_panel) < MIN_PANEL), F.lit("abf_fallback")).otherwise(asked)
    label = F.when(many(n_harmonised) < MIN_HARMONISED, F.concat(asked, F.lit("_nodata")))
    if n_usable:
        label = label.when(many(n_usable) == 0, F.concat(used, F.lit("_error")))
    if n_shared:
        label = label.when((used == "multi_signal") & (many(n_shared) == 0), F.lit("multi_signal_noCS"))
    return loci.withColumns({"method_asked": asked, "method_label": label.otherwise(used)})


def estimable(label: Column, pp4: Column) -> Column:
    """A label that marks a state without a posterior is never estimable, whatever the number says."""
    return F.coalesce(~label.rlike("_(nodata|error|noCS)$") & pp4.isNotNull(), F.lit(False))


def signal_counts(instruments: DataFrame, keys: list[str]) -> DataFrame:
    return instruments.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_signals"))


def credible_sets(variants: DataFrame, keys: list[str], ident: str, beta: str, se: str, sd_prior: float = SD_QUANT,
                  level: float = 0.95) -> DataFrame:
    """Smallest set of variants per locus whose posterior weights reach `level` (one signal per locus)."""
    rows = cut_lineage(variants.dropna(subset=[beta, se]).filter(F.col(se) > 0).select(
        *keys, ident, log_abf(F.col(beta), F.col(se), sd_prior).alias("l")))
    total = log_sum_exp(rows, keys, {"l": F.col("l")}).select(*keys, "lse_l")
    pp = rows.join(total, keys).select(*keys, ident, F.exp(F.col("l") - F.col("lse_l")).alias("pp"), (-F.col("l")).alias("__down"))
    run = running_total(pp, keys, "__down", [ident], F.col("pp"), "cum_pp")
    return run.filter(F.col("cum_pp") - F.col("pp") < level).drop("__down")


def set_overlap(a: DataFrame, b: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Variants shared by two traits' credible sets per locus."""
    return a.select(*keys, ident).join(b.select(*keys, ident), [*keys, ident]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_shared"))
