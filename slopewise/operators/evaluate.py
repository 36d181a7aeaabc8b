"""Comparing models: equivalence, decomposition, controls, ablation, site validation, nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform
from ..session import cut_lineage
from . import metrics
from .folds import fold_of, permuted_blocks
from .linear import SUMS, Arm, Design, Outcome, design_columns, narrow, nested_cv, pooled_scores, prepare, small_or_shuffled, sums_of_tables
from .ranks import join_on_keys

MARGIN = 0.02


def equivalence(arm_seed_r2: DataFrame, reference: str, excluded: list[str], canonical: int = 0,
                margin: float = MARGIN) -> DataFrame:
    """Best arm against a reference arm: equivalent, superior or inconclusive.

    `arm_seed_r2` has (arm, seed, r2). The best arm is the one with the highest
    canonical R2 outside `excluded` and the reference. The verdict looks at the ends of
    the per-seed differences: all below the margin, all at or above it, or neither.
    `seed_range_width` is that range's width, a measure of run-to-run jitter and not
    of statistical resolution.
    """
    out_of_race = [reference, *excluded]
    best = (arm_seed_r2.filter((F.col("seed") == canonical) & ~F.col("arm").isin(out_of_race))
            .agg(F.max_by("arm", F.struct("r2", "arm")).alias("best_arm")))
    rows = join_on_keys(arm_seed_r2, best, [])
    by_seed = rows.groupBy("seed", "best_arm").agg(
        (F.max(F.when(F.col("arm") == F.col("best_arm"), F.col("r2")))
         - F.max(F.when(F.col("arm") == reference, F.col("r2")))).alias("diff"))
    g = by_seed.groupBy("best_arm").agg(
        F.max(F.when(F.col("seed") == canonical, F.col("diff"))).alias("best_minus_reference"),
        F.min("diff").alias("range_lo"), F.max("diff").alias("range_hi"))
    status = (F.when(F.col("range_hi") < margin, "equivalent")
              .when(F.col("range_lo") >= margin, "superior").otherwise("inconclusive"))
    return g.select("best_arm", "best_minus_reference", "range_lo", "range_hi",
                    (F.col("range_hi") - F.col("range_lo")).alias("seed_range_width"),
                    F.lit(margin).alias("margin"), status.alias("status"))


def decompose(arm_r2: DataFrame, reference: str, same_features: str, richer: dict[str, str]) -> DataFrame:
    """Split a gain into the effect of the model class and the effect of each richer feature set."""
    def r2(arm: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col("r2")))

    return arm_r2.agg((r2(same_features) - r2(reference)).alias("model_class_effect"),
                      *[(r2(arm) - r2(same_features)).alias(f"feature_set_effect_{label}")
                        for label, arm in richer.items()])


def replication(gains: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Do the gains of all runs clear the margin? `gains` has (run, gain)."""
    return gains.agg(F.count(F.lit(1)).alias("runs"), F.min("gain").alias("smallest_gain"),
                     F.max("gain").alias("largest_gain"), F.bool_and(F.col("gain") >= margin).alias("all_clear_margin"))


def paired_increment_cv(df: DataFrame, subject: str, outcome: Outcome, base: list[str], aug: list[str], *,
                        k: int = 5, inner_k: int = 5, seeds: list[int] | None = None, grid: tuple | None = None,
                        carry: list[str] | None = None) -> DataFrame:
    """Out-of-fold rows of a base model and the base plus added columns, on identical folds."""
    extra = {"grid": grid} if grid else {}
    arms = [Arm("base", tuple(base), **extra), Arm("aug", tuple([*base, *aug]), **extra)]
    return nested_cv(df, subject, outcome, arms, k=k, inner_k=inner_k, seeds=seeds, carry=carry)


def permutation_null(df: DataFrame, subject: str, outcome: Outcome, base: list[str], block: list[str], *,
                     n_perm: int, k: int = 5, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """Null distribution of the increment when the added block is shuffled as a whole, by a keyed permutation a repetition.

    Fixed penalty for every run, so observed (rep 0) and permuted increments compare
    like with like. One row per rep.
    """
    # A row's fold is hashed once and travels with it through all repetitions.
    df = narrow(df, subject, [*base, *block], outcome).withColumn("__fold", fold_of(subject, seed, k))
    observed = df.select(F.lit(0).alias("rep"), subject, *outcome.columns, *base, *block, "__fold")
    # Shuffling moves whole values, so centres, medians and shrinkage of the observed table hold for every rep.
    d = prepare(observed, subject, [*base, *block], outcome, [seed], k, 1, rep="rep", fold_cols={seed: "__fold"})
    shuffled = permuted_blocks(df.select(subject, *design_columns(d)), subject, block, list(range(1, n_perm + 1)), then=sums_of_tables(d, True), kinds=SUMS)
    return _score_pairs(observed, d, base, block, alpha, shuffled)


def _score_pairs(data: DataFrame, d: Design, base: list[str], added: list[str], alpha: float, more: DataFrame | None = None) -> DataFrame:
    """R2 with and without the added columns per rep, at one fixed penalty, in one pass; `more` are sums of other reps' rows."""
    arms = [Arm("base", tuple(base), grid=(alpha,)), Arm("aug", tuple([*base, *added]), grid=(alpha,))]
    return _pair_up(pooled_scores(data, d, arms, more), ["rep"])


def _pair_up(scores: DataFrame, keys: list[str]) -> DataFrame:
    g = scores.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("arm") == a, F.col("r2"))).alias(f"r2_{a}") for a in ("base", "aug")])
    return g.withColumn("dr2", F.col("r2_aug") - F.col("r2_base"))


def permutation_p(null: DataFrame, value: str = "dr2", rep: str = "rep") -> DataFrame:
    """Share of permuted values at or above the observed one, as is and with the +1 correction.

    A raw 0 only bounds p by 1 / n_perm; `p_corrected` is never 0.
    """
    obs = null.filter(F.col(rep) == 0).agg(F.max(value).alias("observed"))
    j = join_on_keys(null.filter((F.col(rep) > 0) & F.col(value).isNotNull()), obs, [])
    g = j.agg(F.max("observed").alias("observed"), F.count(F.lit(1)).alias("n_perm"), F.avg(value).alias("null_mean"),
              F.stddev_pop(value).alias("null_sd"), F.count_if(F.col(value) >= F.col("observed")).alias("b"))
    return g.select("observed", "n_perm", "null_mean", "null_sd", (F.col("b") / F.col("n_perm")).alias("p_raw"),
                    ((F.col("b") + 1) / (F.col("n_perm") + 1)).alias("p_corrected"))


def gaussian_block(df: DataFrame, subject: str, width: int, draws: list[int]) -> DataFrame:
    """Hash-seeded standard normals per (subject, draw): the features of a pure-noise arm."""
    r = df.withColumn("rep", F.explode(F.array(*[F.lit(int(x)) for x in draws])))
    cols = {}
    for i in range(width):
        u = hash_uniform(subject, F.col("rep"), F.lit(f"noise{i}"), word=0)
        v = hash_uniform(subject, F.col("rep"), F.lit(f"noise{i}"), word=1)
        cols[f"noise{i}"] = F.sqrt(-2 * F.ln(u)) * F.cos(F.lit(6.283185307179586) * v)
    return r.withColumns(cols)


def noise_floor(df: DataFrame, subject: str, outcome: Outcome, base: list[str], *, width: int, draws: list[int],
                k: int = 5, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """Increment of columns of pure noise, one row per draw."""
    noise = [f"noise{i}" for i in range(width)]
    data = gaussian_block(narrow(df, subject, base, outcome), subject, width, draws)
    d = prepare(data, subject, [*base, *noise], outcome, [seed], k, 1, rep="rep")
    return _score_pairs(data, d, base, noise, alpha)


def noise_summary(draws: DataFrame, value: str, observed: Column) -> DataFrame:
    """Distribution of null increments and how far an observed one lies above it. Rows = draws, a fixed small number."""
    g = draws.agg(F.count(value).alias("n_draws"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                  F.min(value).alias("min"), F.max(value).alias("max"), F.percentile(value, F.lit(0.95)).alias("p95"))
    return g.withColumn("z", (observed - F.col("mean")) / F.col("sd"))


def control_arms(df: DataFrame, subject: str, outcome: Outcome, specs: dict[str, tuple[list[str], list[str]]], *,
                 k: int = 5, inner_k: int = 5, seeds: list[int] | None = None) -> DataFrame:
    """Increment of every (base, added) pair on the same rows and folds: one pass for all arms.

    Sums are kept for the union of the columns; an arm is a sub-matrix of them.
    """
    seeds = seeds or [0]
    arms = []
    for name, (base, added) in specs.items():
        arms += [Arm(f"{name}__base", tuple(base)), Arm(f"{name}__aug", tuple([*base, *added]))]
    features = sorted({c for a in arms for c in a.columns})
    df = narrow(df, subject, features, outcome)
    d = prepare(df, subject, features, outcome, seeds, k, inner_k)
    r2 = pooled_scores(df, d, arms).select(
        F.substring_index("arm", "__", 1).alias("control"), F.substring_index("arm", "__", -1).alias("arm"), "seed", "n", "r2")
    return metrics.increment_range(_pair_up(r2, ["control", "seed"]), seeds[0], ["control"])


def check_anchor(found: DataFrame, expected: float, tol: float, column: str = "dr2") -> DataFrame:
    """Pass the rows through, but fail the job if the anchor value is off by more than `tol`."""
    off = F.abs(F.col(column) - F.lit(expected)) > tol
    return found.withColumn(column, F.when(off, F.raise_error(F.concat(F.lit("anchor not reproduced: "), F.col(column)))
                                           .cast("double")).otherwise(F.col(column)))


def ablation(df: DataFrame, subject: str, outcome: Outcome, base: list[str], block: list[str], *,
             k: int = 5, inner_k: int = 5, seeds: list[int] | None = None) -> DataFrame:
    """Increment of the full block, each member alone, and the block without each member."""
    specs = {"full": (base, list(block))}
    for c in block:
        specs[f"only_{c}"] = (base, [c])
        specs[f"drop_{c}"] = (base, [x for x in block if x != c])
    return control_arms(df, subject, outcome, specs, k=k, inner_k=inner_k, seeds=seeds).withColumnRenamed("control", "subset")


def cluster_cv(df: DataFrame, subject: str, outcome: Outcome, base: list[str], aug: list[str],
               fold_cols: dict[int, str], *, inner_k: int = 5, carry: list[str] | None = None) -> DataFrame:
    """Leave-one-cluster-out predictions of a base and an augmented model.

    `fold_cols` maps a seed to the column that holds its clusters, so real sites and
    random clusters of the same sizes go through one pass. Labels are numbered in a table of
    their own, as small as the model list since each cluster has a model, and joined.
    """
    labels = None
    for c in fold_cols.values():
        some = df.select(F.col(c).alias("cluster")).distinct()
        labels = some if labels is None else labels.unionByName(some)
    numbered = Window.partitionBy(F.lit(0)).orderBy("cluster")
    labels = cut_lineage(labels.filter("cluster is not null").distinct().withColumn("fold", F.row_number().over(numbered) - 1))
    k, out = labels.count(), df
    dense = {s: f"__dense{s}" for s in fold_cols}
    for s, c in fold_cols.items():
        own = labels.select(F.col("cluster").alias(c), F.col("fold").alias(dense[s]))
        out = out.join(small_or_shuffled(own, k), c)
    arms = [Arm("base", tuple(base)), Arm("aug", tuple([*base, *aug]))]
    oof = nested_cv(out, subject, outcome, arms, k=k, inner_k=inner_k, seeds=list(fold_cols), fold_cols=dense, carry=carry)
    return oof.join(small_or_shuffled(labels, k), "fold").drop("fold")


def cluster_metrics(oof: DataFrame, cluster: str, min_n: int = 20) -> DataFrame:
    """Scores and calibration slope of each cluster with at least `min_n` rows."""
    inc = metrics.paired_increment(oof, "pred_base", "pred_aug", [cluster])
    cal = metrics.calibration_line(oof.withColumnRenamed("pred_aug", "pred"), [cluster]).select(
        cluster, "cal_slope", "cal_slope_se")
    return inc.filter(F.col("n") >= min_n).join(cal, cluster)
