"""Long assay tables to one wide row per subject, and cohort membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import join_on_keys


def visit_order(event: Column | str) -> Column:
    """Explicit visit order: screening -1, baseline 0, Vnn by number, anything else last."""
    e = F.col(event) if isinstance(event, str) else event
    num = F.regexp_extract(e, r"V(\d+)", 1)
    return (F.when(e == "SC", F.lit(-1)).when(e == "BL", F.lit(0))
            .when(num != "", num.try_cast("int")).otherwise(F.lit(99)))


def paired_index(assays: DataFrame, subject: str, event: str, test: str, value: str,
                 numerator: str, denominator: str, scale: float = 1000.0) -> DataFrame:
    """Ratio of two compartments measured at the same visit, one visit per subject.

    Repeats of a test at a visit are averaged, visits lacking a side are left
    out, and the first remaining visit in `visit_order` is kept.
    """
    wide = (assays.filter(F.col(test).isin(numerator, denominator) & F.col(value).isNotNull())
            .groupBy(subject, event)
            .agg(F.avg(F.when(F.col(test) == numerator, F.col(value))).alias("num"),
                 F.avg(F.when(F.col(test) == denominator, F.col(value))).alias("den"))
            .dropna(subset=["num", "den"]))
    best = wide.groupBy(subject).agg(F.min(F.struct(
        visit_order(event).alias("ord"), F.col(event).alias("event"), "num", "den")).alias("b"))
    return best.select(subject, F.col("b.event").alias("event"), F.col("b.num").alias("numerator"),
                       F.col("b.den").alias("denominator"),
                       (F.try_divide(F.col("b.num"), F.col("b.den")) * F.lit(scale)).alias("index"))


def earliest_wide(assays: DataFrame, subject: str, target: str, value: str, targets: list[str],
                  order: list[Column | str]) -> DataFrame:
    """First non-null value per (subject, target) by `order`, as one column per target.

    One aggregation keyed by subject: each target is a conditional minimum over
    (order, value), so there is no per-subject sort and no second pivot pass.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    picks = []
    for t in targets:
        entry = F.struct(*[k.alias(f"o{i}") for i, k in enumerate(keys)], F.col(value).alias("x"))
        picks.append(F.min(F.when((F.col(target) == t) & F.col(value).isNotNull(), entry)).getField("x").alias(t))
    return assays.filter(F.col(target).isin(targets)).groupBy(subject).agg(*picks)


def assemble(base: DataFrame, required: list[DataFrame], optional: list[DataFrame], subject: str) -> DataFrame:
    """Feature table: `required` blocks restrict the subjects, `optional` blocks may leave gaps."""
    out = base
    for block in required:
        out = out.join(block, subject, "inner")
    for block in optional:
        out = out.join(block, subject, "left")
    return out


def funnel(members: DataFrame, steps: list[tuple[str, list[Column]]]) -> DataFrame:
    """Count left after each step, all in one pass. A step names the flags it requires together."""
    def all_of(flags: list[Column]) -> Column:
        out = F.lit(True)
        for f in flags:
            out = out & F.coalesce(f, F.lit(False))
        return out
    one = members.agg(*[F.count_if(all_of(flags)).alias(f"s{i}") for i, (_, flags) in enumerate(steps)])
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("requirement"),
                              F.col(f"s{i}").alias("n")) for i, (name, _) in enumerate(steps)])
    return one.select(F.inline(rows))


def residualise(df: DataFrame, y: str, x: str, name: str) -> DataFrame:
    """Residual of y on x by least squares over complete rows; incomplete rows get NULL."""
    fit = df.agg(F.regr_slope(y, x).alias("__b"), F.regr_intercept(y, x).alias("__a"))
    return (join_on_keys(df, fit, [])
            .withColumn(name, F.col(y) - (F.col("__a") + F.col("__b") * F.col(x))).drop("__a", "__b"))


def category_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """0-based code of each category in sorted order; NULL categories get -1."""
    from .ranks import number_rows

    cats = df.filter(F.col(column).isNotNull()).select(column).distinct()
    codes = number_rows(cats, [], column, [], "__r").select(column, (F.col("__r") - 1).alias(name))
    return df.join(codes, column, "left").withColumn(name, F.coalesce(F.col(name), F.lit(-1)))


def median_split(df: DataFrame, column: str, name: str) -> DataFrame:
    """1 above the exact median, 0 at or below it."""
    from .ranks import exact_quantiles

    cut = exact_quantiles(df, [], column, {"__med": 0.5}).select("__med")
    return join_on_keys(df, cut, []).withColumn(name, (F.col(column) > F.col("__med")).cast("int")).drop("__med")


def at_least_present(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Rows with at least k of the columns present."""
    return df.dropna(thresh=k, subset=columns)


def shared_subjects(blocks: list[DataFrame], subject: str) -> DataFrame:
    """Subjects every block knows, by one union and one aggregation instead of a join chain."""
    tagged = None
    for i, b in enumerate(blocks):
        part = b.select(subject, F.lit(1 << i).alias("__bit"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return (tagged.groupBy(subject).agg(F.bit_or("__bit").alias("__bits"))
            .filter(F.col("__bits") == (1 << len(blocks)) - 1).select(subject))
