"""Cohort description: co-tracking, coverage, selection, agreement, dropout, enrichment."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import cumulate, join_on_keys


def unpivoted(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep..., variable, value) rows, inside the task."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")
    ).select(*keep, "e.variable", "e.value")


def co_tracking(df: DataFrame, reference: str, others: list[str], min_n: int = 5) -> DataFrame:
    """Pearson correlation of each column with the reference over pairwise complete rows; NULL up to `min_n`."""
    rows = unpivoted(df, others, [reference]).filter(F.col(reference).isNotNull() & F.col("value").isNotNull())
    g = rows.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.corr(reference, "value").alias("c"))
    return g.select("variable", "n", F.when(F.col("n") > min_n, F.col("c")).alias("r"))


def coverage(df: DataFrame, columns: list[str], sparse_below: float = 50.0) -> DataFrame:
    """Non-missing count and percentage per column, and whether it is sparse."""
    g = unpivoted(df, columns, []).groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_present"))
    pct = 100 * F.col("n_present") / F.col("n")
    return g.select("variable", "n_present", pct.alias("pct"), (pct < sparse_below).alias("sparse"))


MOST_BLOCKS = 16


def joint_availability(df: DataFrame, blocks: dict[str, list[str]], count: str = "n") -> DataFrame:
    """How many rows have every column of every block of a set, for all sets of blocks: `blocks` (names joined by +, the empty set is
    `` and counts all rows), `n_blocks`, `n`.

    One aggregation leaves a histogram of presence masks, at most 2 to the number of blocks; each mask then counts for the sets it contains.
    """
    names = list(blocks)
    if len(names) > MOST_BLOCKS:
        raise ValueError(f"at most {MOST_BLOCKS} blocks: there are 2 to their number of sets")
    whole = [F.when(F.greatest(F.lit(False), *[F.col(c).isNull() for c in cols]), 0).otherwise(1 << i) for i, cols in enumerate(blocks.values())]
    masks = df.select(sum(whole, F.lit(0)).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    sets = F.filter(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1)), lambda s: s.bitwiseAND(F.col("m")) == s)
    each = masks.withColumn("s", F.explode(sets)).groupBy("s").agg(F.sum("n").alias(count))
    # A set that no row has is reported with 0.
    every = df.sparkSession.range(1 << len(names)).select(F.col("id").cast("int").alias("s"))
    picked = [F.when(F.col("s").bitwiseAND(F.lit(1 << i)) != 0, n) for i, n in enumerate(names)]
    return every.join(each, "s", "left").select(F.concat_ws("+", *picked).alias("blocks"), F.bit_count("s").alias("n_blocks"), F.coalesce(count, F.lit(0)).alias(count))


def selection_table(df: DataFrame, retained: Column, columns: list[str]) -> DataFrame:
    """Mean of each column among retained and excluded rows."""
    rows = unpivoted(df.withColumn("__kept", retained), columns, ["__kept"])
    g = rows.groupBy("variable").agg(F.avg(F.when(F.col("__kept"), F.col("value"))).alias("retained_mean"),
                                     F.avg(F.when(~F.col("__kept"), F.col("value"))).alias("excluded_mean"))
    return g.withColumn("diff", F.col("retained_mean") - F.col("excluded_mean"))


def flag_agreement(a: DataFrame, b: DataFrame, subject: str, flag_a: str, flag_b: str) -> DataFrame:
    """Two binary sources over the subjects both know: overlap, sensitivity of b against a, and its precision."""
    both = a.select(subject, flag_a).join(b.select(subject, flag_b), subject)
    x, y = F.coalesce(F.col(flag_a), F.lit(False)), F.coalesce(F.col(flag_b), F.lit(False))
    g = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(x & y).alias("n_both"), F.count_if(x & ~y).alias("only_a"),
                 F.count_if(~x & y).alias("only_b"))
    return g.withColumns({"sensitivity": F.try_divide(F.col("n_both"), F.col("n_both") + F.col("only_a")),
                          "ppv": F.try_divide(F.col("n_both"), F.col("n_both") + F.col("only_b"))})


def text_flag(text: Column | str, include: str, exclude: str) -> Column:
    """Case-insensitive: matches `include` and not `exclude`. NULL text is False."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(t.rlike("(?i)" + include) & ~t.rlike("(?i)" + exclude), F.lit(False))


def dropout_summary(subjects: DataFrame, stratum: Column, first: str, last: str, slope: str) -> DataFrame:
    """Per stratum: when subjects enrol, how long before the cohort's end they stop, span and mean slope."""
    ends = subjects.agg(F.min(first).alias("__start"), F.max(last).alias("__end"))
    j = join_on_keys(subjects.withColumn("stratum", stratum), ends, [])
    return j.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(first) - F.col("__start")).alias("enrol_offset"),
        F.avg(F.col("__end") - F.col(last)).alias("before_cohort_end"),
        F.avg(F.col(last) - F.col(first)).alias("span"), F.avg(slope).alias("mean_slope"))


def enrichment(df: DataFrame, pred: str, y: str, percents: list[int], effect: float = 0.3, power: float = 0.8,
               alphas: tuple[float, ...] = (0.05, 0.1)) -> DataFrame:
    """Trial size when only the subjects with the lowest predictions are enrolled.

    The cut is by prediction rank, ceil(percent * n) subjects, from a distributed count of
    distinct predictions; a tie at the cut is enrolled in full. One conditional
    aggregation serves all percents.
    """
    rows = df.filter(F.col(pred).isNotNull() & F.col(y).isNotNull())
    c = cumulate(rows, [], pred, {"n": F.lit(1).cast("long"), "s": F.col(y), "ss": F.col(y) * F.col(y)})
    start = F.col("cum_n") - F.col("n")
    aggs = [F.max("tot_n").alias("total")]
    for p in percents:
        inside = start < F.ceil(F.col("tot_n") * p / 100.0)
        aggs += [F.sum(F.when(inside, F.col(m))).alias(f"{m}_{p}") for m in ("n", "s", "ss")]
    one = c.agg(*aggs)
    structs = F.array(*[F.struct(F.lit(p).alias("enrol_pct"), F.col(f"n_{p}").alias("n"), F.col(f"s_{p}").alias("s"),
                                 F.col(f"ss_{p}").alias("ss"), F.col("total")) for p in percents])
    r = one.select(F.inline(structs))
    mean, n = F.col("s") / F.col("n"), F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1)))
    out = r.select("enrol_pct", F.col("n").alias("n_enrolled"), mean.alias("mean_slope"), sd.alias("sd_slope"),
                   F.abs(sd / mean).alias("cv_ratio"), (F.lit(100.0) / F.col("enrol_pct")).alias("screen_per_enrollee"))
    norm = NormalDist()
    for a in alphas:
        z = norm.inv_cdf(1 - a / 2) + norm.inv_cdf(power)
        tag = f"{a:g}".replace("0.", "a")
        delta = F.col("mean_slope") * effect
        out = out.withColumn(f"n_per_arm_{tag}", 2 * z * z * F.col("sd_slope") * F.col("sd_slope") / (delta * delta))
    ref = out.filter(F.col("enrol_pct") == max(percents)).select(
        *[F.max(c).alias(f"__ref_{c}") for c in out.columns if c.startswith("n_per_arm")])
    names = [c for c in out.columns if c.startswith("n_per_arm")]
    j = join_on_keys(out, ref, [])
    return j.select(*out.columns, *[(100 * (1 - F.col(c) / F.col(f"__ref_{c}"))).alias(c.replace("n_per_arm", "pct_reduction"))
                                    for c in names])
