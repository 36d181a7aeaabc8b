"""Filling and scaling fitted on training rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_of
from .ranks import cumulate


def training_scalers(df: DataFrame, subject: str, columns: list[str], seeds: list[int], k: int) -> DataFrame:
    """Median, and mean and scale after median filling, of each column over each training set.

    One distributed count of the distinct values, carrying how many copies each training set
    has, gives all medians; the moments are sums over the same counts. Constant columns get scale 1.
    """
    sets = [(s, f) for s in seeds for f in range(k)]
    folds = {f"__f{s}": fold_of(subject, s, k) for s in seeds}
    long = df.withColumns(folds).select(*folds, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")
    ).select(*folds, "e.feature", "e.value")
    inside = {f"t{s}_{f}": (F.col(f"__f{s}") != f).cast("long") for s, f in sets}
    gaps = long.filter(F.col("value").isNull()).groupBy("feature").agg(*[F.sum(c).alias(f"miss_{n}") for n, c in inside.items()])
    c = cumulate(long, ["feature"], "value", inside)
    aggs = []
    for n in inside:
        cum, here, tot = F.col(f"cum_{n}"), F.col(n), F.col(f"tot_{n}")
        for tag, pos in (("a", F.floor((tot - 1) / 2)), ("b", F.ceil((tot - 1) / 2))):
            aggs.append(F.max(F.when((cum - here <= pos) & (pos < cum), F.col("value"))).alias(f"{tag}_{n}"))
        aggs += [F.max(tot).alias(f"n_{n}"), F.sum(here * F.col("value")).alias(f"s_{n}"),
                 F.sum(here * F.col("value") * F.col("value")).alias(f"q_{n}")]
    g = c.groupBy("feature").agg(*aggs).join(gaps, "feature", "left")
    rows = F.array(*[F.struct(
        F.lit(s).alias("seed"), F.lit(f).alias("fold"), ((F.col(f"a_t{s}_{f}") + F.col(f"b_t{s}_{f}")) / 2).alias("median"),
        F.col(f"n_t{s}_{f}").alias("n"), F.col(f"s_t{s}_{f}").alias("s"), F.col(f"q_t{s}_{f}").alias("q"),
        F.coalesce(f"miss_t{s}_{f}", F.lit(0)).alias("miss")) for s, f in sets])
    r = g.select("feature", F.inline(rows))
    n, med = F.col("n") + F.col("miss"), F.col("median")
    mean = (F.col("s") + F.col("miss") * med) / n
    var = F.greatest((F.col("q") + F.col("miss") * med * med) / n - mean * mean, F.lit(0.0))
    return r.select("seed", "fold", "feature", "median", mean.alias("mean"), F.when(var > 0, F.sqrt(var)).otherwise(1.0).alias("sd"))
