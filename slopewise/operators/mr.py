"""Mendelian-randomisation estimates per (protein, platform) and the calls made from them."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.digests import hash_words
from ..functions.probability import normal_two_sided_p, t_two_sided_p
from ..session import cut_lineage
from .ranks import running_total

GROUP = ["protein", "platform"]
# Normal multipliers and verdict bounds.
Z95, Z80 = 1.96, 0.842
NULL_LO, NULL_HI = 0.91, 1.10
PP4_SUPPORT = 0.8


def verdict(lo: Column, hi: Column) -> Column:
    return (F.when((lo > 1.0) | (hi < 1.0), "positive")
            .when((lo > NULL_LO) & (hi < NULL_HI), "null").otherwise("inconclusive"))


def _weights(bx: str = "beta_exp", by: str = "beta_out", se: str = "se_out") -> tuple[Column, Column]:
    v = F.col(se) * F.col(se)
    return F.col(bx) * F.col(bx) / v, F.col(bx) * F.col(by) / v


def ivw(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Log-odds estimate and standard error: Wald ratio for one instrument, else inverse-variance weighted.

    The two-sum form of one instrument *is* its Wald ratio, so one aggregation covers both.
    """
    w, wy = _weights()
    zero = F.col("beta_exp") == 0
    g = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_instruments"), F.count_if(zero).alias("__zero"), F.sum(w).alias("__w"),
        F.sum(wy).alias("__wy"),
        F.avg((F.col("beta_exp") / F.col("se_exp")) * (F.col("beta_exp") / F.col("se_exp"))).alias("F"),
        F.bool_or(~F.col("strand_resolved")).alias("has_strand_ambiguous"))
    checked = F.when(F.col("__zero") > 0, F.raise_error(F.lit("zero exposure effect in an instrument group"))
                     .cast("double")).otherwise(F.col("__w"))
    g = g.withColumn("__w", checked)
    return g.select(*keys, "n_instruments", "F", F.when(F.col("n_instruments") == 1, "wald").otherwise("ivw").alias("method"),
                    (F.col("__wy") / F.col("__w")).alias("theta"), F.sqrt(1 / F.col("__w")).alias("se_theta"),
                    "has_strand_ambiguous")


def estimates(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Odds ratio with 95% interval, smallest effect detectable with 80% power, and verdict."""
    e = ivw(pairs, keys or GROUP)
    t, s = F.col("theta"), F.col("se_theta")
    lo, hi = F.exp(t - Z95 * s), F.exp(t + Z95 * s)
    return e.withColumns({"or": F.exp(t), "ci_low": lo, "ci_high": hi, "min_detectable_or_80": F.exp((Z95 + Z80) * s),
                          "verdict": verdict(lo, hi)})


def with_not_testable(est: DataFrame, expected: DataFrame, key: str = "protein") -> DataFrame:
    """Add a 'not_testable' row for every expected key without any estimate.

    Its ci_high is 0.0 so that numeric bound checks stay well defined; all other figures are NULL.
    """
    gone = expected.select(key).distinct().join(est, key, "left_anti")
    fixed = {"platform": F.lit("both"), "n_instruments": F.lit(0).cast("long"), "ci_high": F.lit(0.0),
             "verdict": F.lit("not_testable"), "has_strand_ambiguous": F.lit(False)}
    cols = [F.col(key) if f.name == key else fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in est.schema.fields]
    return est.unionByName(gone.select(*cols))


def leave_one_out(pairs: DataFrame, keys: list[str] | None = None, ident: str = "rsid") -> DataFrame:
    """Every instrument's weight share and the estimate without it: the group's sums minus its own.

    Group sums are aggregated and joined back, so a very large group is not gathered anywhere.
    Groups of one have no leave-one-out.
    """
    keys = keys or GROUP
    w, wy = _weights()
    rows = pairs.select(*keys, ident, w.alias("w"), wy.alias("wy"), (F.col("beta_out") / F.col("beta_exp")).alias("ratio"))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("tw"), F.sum("wy").alias("twy"))
    j = rows.join(total.filter(F.col("n") >= 2), keys)

    def excludes(t: Column, s: Column) -> Column:
        return ~((F.exp(t - Z95 * s) < 1.0) & (F.exp(t + Z95 * s) > 1.0))

    lw = F.col("tw") - F.col("w")
    t, s = (F.col("twy") - F.col("wy")) / lw, F.sqrt(1 / lw)
    full = excludes(F.col("twy") / F.col("tw"), F.sqrt(1 / F.col("tw")))
    return j.select(*keys, ident, (F.col("w") / F.col("tw")).alias("weight_frac"), F.col("ratio").alias("wald_ratio"),
                    F.exp("ratio").alias("wald_or"), F.exp(t).alias("loo_or"), F.exp(t - Z95 * s).alias("loo_ci_low"),
                    F.exp(t + Z95 * s).alias("loo_ci_high"), excludes(t, s).alias("loo_excludes_null"),
                    full.alias("full_excludes_null"))


def influence(loo: DataFrame, keys: list[str] | None = None, ident: str = "rsid") -> DataFrame:
    """Dominant instrument per group and whether every leave-one-out fit keeps the full fit's call."""
    g = loo.groupBy(*(keys or GROUP)).agg(
        F.max(F.struct(F.col("weight_frac"), F.col(ident))).alias("m"),
        F.bool_and(F.col("loo_excludes_null") == F.col("full_excludes_null")).alias("loo_verdict_stable"))
    return g.select(*(keys or GROUP), F.col("m.weight_frac").alias("loo_max_weight_frac"),
                    F.col(f"m.{ident}").alias("loo_max_weight_id"), "loo_verdict_stable")


def egger(pairs: DataFrame, keys: list[str] | None = None, min_n: int = 3) -> DataFrame:
    """Weighted regression of outcome on exposure effects with an intercept, instruments oriented to
    positive exposure effects. Closed form of six weighted sums; the t tail runs once per group."""
    keys = keys or GROUP
    sign = F.when(F.col("beta_exp") < 0, -1.0).otherwise(1.0)
    x, y, w = F.col("beta_exp") * sign, F.col("beta_out") * sign, 1 / (F.col("se_out") * F.col("se_out"))
    s = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("s0"), F.sum(w * x).alias("sx"),
                                 F.sum(w * x * x).alias("sxx"), F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"),
                                 F.sum(w * y * y).alias("syy")).filter(F.col("n") >= min_n)
    det = F.col("s0") * F.col("sxx") - F.col("sx") * F.col("sx")
    s = s.withColumns({"slope": (F.col("s0") * F.col("sxy") - F.col("sx") * F.col("sy")) / det,
                       "icept": (F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / det})
    ssr = F.greatest(F.col("syy") - F.col("icept") * F.col("sy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    sigma2 = ssr / (F.col("n") - 2)
    s = s.withColumns({"slope_se": F.sqrt(sigma2 * F.col("s0") / det), "icept_se": F.sqrt(sigma2 * F.col("sxx") / det)})
    t = F.when(F.col("icept_se") > 0, F.col("icept") / F.col("icept_se"))
    return s.select(*keys, "n", F.col("slope").alias("egger_slope"), F.col("slope_se").alias("egger_slope_se"),
                    F.col("icept").alias("egger_intercept"),
                    t_two_sided_p(t, (F.col("n") - 2).cast("double")).alias("egger_intercept_p"))


def weighted_median(pairs: DataFrame, keys: list[str] | None = None, ident: str = "rsid", min_n: int = 3) -> DataFrame:
    """First ratio (in sorted order) at which the running weight reaches half the group's weight.

    Distributed running sum per group: no group is sorted in one task.
    """
    keys = keys or GROUP
    rows = pairs.select(*keys, ident, (F.col("beta_out") / F.col("beta_exp")).alias("ratio"),
                        ((F.col("beta_exp") / F.col("se_out")) * (F.col("beta_exp") / F.col("se_out"))).alias("w"))
    rows = cut_lineage(rows)
    total = rows.groupBy(*keys).agg(F.sum("w").alias("tw"), F.count(F.lit(1)).alias("n"))
    run = running_total(rows, keys, "ratio", [ident], F.col("w"), "cum").join(total, keys)
    g = run.filter((F.col("cum") / F.col("tw") >= 0.5) & (F.col("n") >= min_n)).groupBy(*keys).agg(
        F.min("ratio").alias("wmedian_theta"), F.max("n").alias("n"))
    return g.select(*keys, "n", "wmedian_theta", F.exp("wmedian_theta").alias("wmedian_or"))


RANGE = 1 << 20  # numbers of instruments that a task holds at once
REPS_PER_TASK = 100
DRAWS = 1 << 14  # digests computed side by side


def weighted_median_se(pairs: DataFrame, keys: list[str] | None = None, ident: str = "rsid", reps: int = 1000,
                       min_n: int = 3, size: int = RANGE) -> DataFrame:
    """Bootstrap standard error of the weighted median: n draws with replacement per group and replicate.

    Draw d of a replicate takes the instrument numbered hash(group, replicate, d) mod n, where numbers follow the sorted
    ratios. So a range of numbers is a range of ratios for all replicates at once. A task holds one range of a group for some
    replicates, counts how often each of its instruments is drawn and adds weights up in order: no draw is a row, none is
    shuffled and no replicate is sorted. Groups of at most `size` instruments are done with that. Of a larger one each range
    gives the weight drawn in it, running totals name the range in which half the weight is reached, and that one is looked at again.
    """
    from .ranks import number_rows

    keys = keys or GROUP
    rows = pairs.select(*keys, ident, (F.col("beta_out") / F.col("beta_exp")).alias("ratio"),
                        ((F.col("beta_exp") / F.col("se_out")) * (F.col("beta_exp") / F.col("se_out"))).alias("w"))
    rows = cut_lineage(rows)
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in keys]).alias("__name")
    sizes = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("ratio").alias("m")).filter(F.col("n") >= min_n))
    numbered = cut_lineage(number_rows(rows.join(sizes, keys), keys, "ratio", [ident], "d"))
    some = F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // REPS_PER_TASK))).alias("__some")
    by = [*keys, "__range", "__some"]
    # Draws are the work, not rows: tasks are many even where the rows are few.
    dealt = numbered.select(*keys, name, F.floor((F.col("d") - 1) / size).alias("__range"), some, "d", "n", "m", F.col("ratio").cast("double").alias("ratio"), F.col("w").cast("double").alias("w")
                            ).repartition(16 * pairs.sparkSession.sparkContext.defaultParallelism, *by)
    of = {f.name: f.dataType for f in dealt.schema}
    schema = T.StructType([*[T.StructField(c, of[c]) for c in keys], T.StructField("rep", T.IntegerType()), T.StructField("__range", T.LongType()),
                           T.StructField("weight", T.DoubleType()), T.StructField("theta", T.DoubleType())])

    def medians(held: pa.Table, todo: list[tuple[int, float, float | None]]) -> pa.Table:
        """Weight drawn in the range, and the ratio at half of the weight, for each (replicate, weight before the range, weight of all)."""
        first, n, m = (held[c][0].as_py() for c in ("__range", "n", "m"))
        held = held.sort_by("d")
        ratio, w = held["ratio"].to_numpy(), held["w"].fill_null(0.0).to_numpy()
        weighed = held["w"].is_valid().to_numpy()
        drawn, lead = first * size, held["__name"][0].as_py()
        weights, thetas = [], []
        for rep, before, total in todo:
            times = np.zeros(len(ratio), np.int64)
            for words in hash_words(f"{lead}:{rep}:", m, ":wm", DRAWS):
                at = words.astype(np.int64) % n - drawn
                if drawn or len(ratio) < n:
                    at = at[(at >= 0) & (at < len(ratio))]
                times += np.bincount(at, minlength=len(ratio))
            run = np.cumsum(times * w)
            taken = np.flatnonzero(times)
            weights.append(float(run[-1]) if weighed[taken].any() else None)
            tw = total if total is not None else run[-1]
            theta = None
            if tw > 0 and len(taken):
                # Rounding cannot leave a replicate without a median.
                half = np.searchsorted((before + run) / tw, 0.5)
                theta = float(ratio[half if half < len(ratio) else taken[-1]])
            thetas.append(theta)
        of_all = {c: pa.array([held[c][0].as_py()] * len(todo), held[c].type) for c in keys}
        return pa.table(of_all | {"rep": pa.array([t[0] for t in todo], pa.int32()), "__range": pa.array([first] * len(todo), pa.int64()),
                                  "weight": pa.array(weights, pa.float64()), "theta": pa.array(thetas, pa.float64())})

    def alone(held: pa.Table) -> pa.Table:
        first = held["__some"][0].as_py() * REPS_PER_TASK + 1
        return medians(held, [(rep, 0.0, None) for rep in range(first, min(first + REPS_PER_TASK, reps + 1))])

    def again(held: pa.Table, crossed: pa.Table) -> pa.Table:
        if not held.num_rows or not crossed.num_rows:
            return to_arrow_schema(schema).empty_table()
        return medians(held, list(zip(*(crossed[c].to_pylist() for c in ("rep", "before", "tw")), strict=True)))

    def medians_of(groups: DataFrame) -> DataFrame:
        found = cut_lineage(groups.groupBy(*by).applyInArrow(alone, schema))
        part = Window.partitionBy(*keys, "rep")
        before = F.coalesce(F.sum("weight").over(part.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        ranges = found.select(*keys, "rep", "__range", before.alias("before"), F.sum("weight").over(part).alias("tw"))
        # The last range that begins below the half.
        half = ranges.filter((F.col("tw") > 0) & (F.col("before") < 0.5 * F.col("tw"))).groupBy(*keys, "rep").agg(F.max(F.struct("__range", "before", "tw")).alias("c"))
        half = half.select(*keys, "rep", "c.__range", "c.before", "c.tw", F.floor((F.col("rep") - 1) / REPS_PER_TASK).cast("int").alias("__some"))
        return groups.groupBy(*by).cogroup(half.groupBy(*by)).applyInArrow(again, schema)

    med = dealt.filter(F.col("m") <= size).groupBy(*by).applyInArrow(alone, schema)
    if (sizes.agg(F.max("m").alias("m")).first()["m"] or 0) > size:
        med = med.unionByName(medians_of(dealt.filter(F.col("m") > size)))
    med = med.filter(F.col("theta").isNotNull())
    return med.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_boot"), F.stddev_samp("theta").alias("wmedian_se"))


def wald_scan(lead: DataFrame, outcomes: DataFrame, keys: list[str], n_tests: Column | None = None) -> DataFrame:
    """Effect, standard error and p of each (exposure, outcome study) pair on log-odds or linear scale.

    `lead` and `outcomes` are joined on rsid, aligned, and pooled per keys (one instrument gives a Wald ratio).
    """
    from .harmonise import align_alleles

    j = lead.join(outcomes, lead["rsid"] == outcomes["rsid_out"])
    a = align_alleles(j.withColumnRenamed("beta", "beta_exp").withColumnRenamed("se", "se_exp"))
    w, wy = _weights()
    g = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_snp"), (F.sum(wy) / F.sum(w)).alias("beta"),
                             F.sqrt(1 / F.sum(w)).alias("se"))
    g = g.withColumns({"or": F.exp("beta"), "p": normal_two_sided_p(F.col("beta") / F.col("se"))})
    return g.withColumn("hit", F.col("p") < 0.05 / n_tests) if n_tests is not None else g


def power_bounds(est: DataFrame, control_or: float, power: float = 0.80) -> DataFrame:
    """Smallest detectable odds ratio per estimate, and whether it rules out an effect of the control's size."""
    n = NormalDist()
    z = n.inv_cdf(0.975) + n.inv_cdf(power)
    mde = F.exp(F.lit(z) * F.col("se_theta"))
    return est.withColumns({"mde_or": mde, "excludes_control_scale": F.when(mde < control_or, "YES").otherwise("NO")})


def control_gate(control: DataFrame, applied: str, platforms: list[str]) -> DataFrame:
    """Does the positive control recover (OR > 1, interval above 1)? On the platform the gate uses and on all.

    `control` has one row per platform. Both answers are kept: the narrower gate is a deviation to disclose.
    """
    ok = F.coalesce((F.col("or") > 1.0) & (F.col("ci_low") > 1.0), F.lit(False))
    g = control.agg(*[F.coalesce(F.bool_or(F.when(F.col("platform") == p, ok)), F.lit(False)).alias(f"recovers_{p}")
                      for p in platforms])
    every = F.lit(True)
    for p in platforms:
        every = every & F.col(f"recovers_{p}")
    return g.select(*g.columns, F.col(f"recovers_{applied}").alias("gate_applied"), every.alias("gate_prespecified"))


def pleiotropy(scan: DataFrame, proteins: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Flag per protein: True with notes on its hits, False without hits, NULL if it was not scanned.

    Notes list one entry per disease scanned, a short fixed list.
    """
    note = F.format_string("%s (OR=%.3f, p=%.4f)", F.col("disease"), F.col("or"), F.col("p"))
    hit = F.col("p") < threshold
    g = scan.groupBy("protein").agg(F.bool_or(hit).alias("pleiotropy_flag"),
                                    F.array_join(F.array_sort(F.collect_list(F.when(hit, note))), "; ").alias("notes"))
    return proteins.select("protein").distinct().join(g, "protein", "left").select(
        "protein", "pleiotropy_flag",
        F.when(F.col("pleiotropy_flag").isNull(), "not in scan").when(F.col("pleiotropy_flag"), F.col("notes"))
        .otherwise("no significant hits").alias("pleiotropy_notes"))


def causal_call(est: DataFrame, coloc: DataFrame, proteins: DataFrame, a: str, b: str, mr_control: Column,
                coloc_control: Column) -> DataFrame:
    """One row per protein with both platforms' columns and the call.

    A colocalization posterior that is missing or not estimable counts as below the support
    threshold, an assumption that travels as `*_pp4_estimable`. No 'null' call survives a failed control.
    """
    def of(df: DataFrame, cols: list[str], prefix: str = "") -> DataFrame:
        aggs = [F.max(F.when(F.col("platform") == p, F.col(c))).alias(f"{p}_{prefix}{c}") for p in (a, b) for c in cols]
        return df.groupBy("protein").agg(*aggs)

    untestable = est.groupBy("protein").agg(F.bool_or(F.col("verdict") == "not_testable").alias("nt"))
    j = (proteins.select("protein").distinct().join(of(est, ["verdict", "or", "ci_low", "ci_high"]), "protein", "left")
         .join(of(coloc, ["pp4", "pp4_estimable"]), "protein", "left").join(untestable, "protein", "left"))
    va, vb = F.col(f"{a}_verdict"), F.col(f"{b}_verdict")
    pa, pb = F.coalesce(f"{a}_pp4", F.lit(0.0)), F.coalesce(f"{b}_pp4", F.lit(0.0))
    gates = mr_control & coloc_control
    n = va.isNotNull().cast("int") + vb.isNotNull().cast("int")
    both = (F.when((va == "null") & (vb == "null"),
                   F.when((pa < PP4_SUPPORT) & (pb < PP4_SUPPORT) & gates, "null").otherwise("inconclusive"))
            .when(va == vb, F.when((va == "positive") & (F.greatest(pa, pb) >= PP4_SUPPORT), "positive").otherwise("inconclusive"))
            .otherwise("discordant"))
    one, pp = F.coalesce(va, vb), F.coalesce(f"{a}_pp4", f"{b}_pp4", F.lit(0.0))
    single = F.when((one == "positive") & (pp >= PP4_SUPPORT), "positive").otherwise("inconclusive")
    call = F.when(F.coalesce("nt", F.lit(False)), "not_testable").when(n == 2, both).otherwise(single)
    tested = F.when(F.coalesce("nt", F.lit(False)), 0).otherwise(n)
    return j.withColumns({"platforms_tested": tested.cast("long"), "causal_call": call}).drop("nt")
