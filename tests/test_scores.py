import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slopewise.functions import exprs as ex, probability as pb
from slopewise.operators import meta, metrics, profile, reconcile as rc, resample


@pytest.mark.parametrize("n,alpha", [(3, 0.1), (7, 0.1), (40, 0.1), (101, 0.25), (101, 0.05)])
def test_conformal_equals_leaving_each_residual_out(spark, n, alpha):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"y": np.round(rng.normal(size=n), 1), "pred": 0.0})
    res = np.abs(pdf.y.to_numpy())
    qs = [np.quantile(np.delete(res, i), min(1.0, math.ceil(round(n * (1 - alpha), 9)) / (n - 1))) for i in range(n)]
    got = metrics.conformal_loo(spark.createDataFrame(pdf), [], alpha=alpha).first()
    assert np.isclose(got.coverage, np.mean(res <= np.array(qs) + 1e-12)) and np.isclose(got.mean_width, 2 * np.mean(qs))


def test_auc_counts_ties_half_and_ordinal_does_not(spark):
    rows = [(1, 0.5, 1), (0, 0.5, 2), (1, 0.9, 3), (0, 0.1, 4), (0, 0.5, 5)]
    df = spark.createDataFrame(rows, ["y", "s", "id"])
    pairs = [(a, b) for a, b in itertools.product([r for r in rows if r[0]], [r for r in rows if not r[0]])]
    want = np.mean([(p[1] > q[1]) + 0.5 * (p[1] == q[1]) for p, q in pairs])
    assert np.isclose(metrics.auc(df, [], "y", "s").first().auc, want)
    want = np.mean([(p[1], p[2]) > (q[1], q[2]) for p, q in pairs])
    assert np.isclose(metrics.auc_ordinal(df, [], "y", "s", "id").first().auc, want)
    assert metrics.auc(df.filter("y = 1"), [], "y", "s").first().auc is None


def test_last_calibration_bin_is_closed(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.95), (1, 0.0)], ["y", "p"])
    got = {r.bin: r.n for r in metrics.reliability_bins(df, [], "y", "p").collect()}
    assert got == {9: 2, 0: 1}


def test_small_cells_and_constant_predictions_are_suppressed(spark):
    df = spark.range(30).select(F.when(F.col("id") < 5, "small").otherwise("big").alias("g"), F.col("id").cast("double").alias("y"), F.lit(1.0).alias("pred"))
    got = {r.level: r for r in metrics.subgroup_audit(df, {"axis": F.col("g")}).collect()}
    assert got["small"].n == 5 and got["small"].r2 is None
    assert got["big"].r2 < 0 and got["big"].cal_slope is None


def test_strata_partition_the_rows(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("s"), F.rand(1).alias("y"), F.rand(2).alias("a"), F.rand(3).alias("b"))
    cells = metrics.strata_increment(df, "s", "a", "b").collect()
    assert sum(c.n for c in cells) == 100 and all(c.dr2 is not None for c in cells)


def test_tails_against_known_values():
    assert np.isclose(pb.t_tail(2.228138852, 10), 0.05, atol=1e-8) and np.isclose(pb.t_tail(12.7062047, 1), 0.05, atol=1e-8)
    assert np.isclose(pb.t_point(0.975, 8), 2.306004135, atol=1e-8)
    assert np.isclose(pb.fisher_tail(8, 2, 1, 5), 0.034965034965) and np.isclose(pb.fisher_tail(5, 5, 5, 5), 1.0)
    assert pb.fisher_tail(400_000, 600_000, 300_000, 700_000) < 1e-300


def test_normal_tail(spark):
    z = [0.0, 0.3, 0.66, 0.67, 1.96, 5.6, 5.7, 9.0, 37.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], ["z"]).select(pb.normal_two_sided_p("z").alias("p")).collect()]
    assert np.allclose(got, [math.erfc(x / math.sqrt(2)) for x in z], rtol=1e-12)


def test_random_effects_against_hand_sums(spark):
    y, se = np.array([0.3, 0.8, 1.1, 0.5]), np.array([0.1, 0.2, 0.15, 0.3])
    w = 1 / se ** 2
    fixed = (w * y).sum() / w.sum()
    q = (w * (y - fixed) ** 2).sum()
    tau2 = max(0, (q - 3) / (w.sum() - (w ** 2).sum() / w.sum()))
    ws = 1 / (se ** 2 + tau2)
    got = meta.random_effects(spark.createDataFrame(list(zip(y.tolist(), se.tolist())), ["e", "s"]), [], "e", "s").first()
    assert np.isclose(got.estimate, (ws * y).sum() / ws.sum()) and np.isclose(got.tau2, tau2)
    half = 4.30265273 * np.sqrt(tau2 + 1 / ws.sum())
    assert np.isclose(got.pi_hi - got.estimate, half, atol=1e-7)


def test_bootstrap_weights_average_one(spark):
    n = resample.with_replicates(spark.range(4000), "id", 8).groupBy("rep").agg(F.sum("w").alias("w")).collect()
    assert len(n) == 8 and all(abs(r.w - 4000) < 350 for r in n)


def test_enrichment_reproduces_a_published_sample_size(spark):
    # A mean of -0.11974 and sd of 0.34731 need 1467.39 per arm at alpha 0.05; checked by the formula alone.
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"p": rng.normal(size=500), "y": rng.normal(size=500)})
    pdf.y = -0.11974137900493187 + 0.3473118737313474 * (pdf.y - pdf.y.mean()) / pdf.y.std(ddof=1)
    got = profile.enrichment(spark.createDataFrame(pdf), "p", "y", [100, 50]).filter("enrol_pct = 100").first()
    assert np.isclose(got.n_per_arm_a05, 1467.3912059959268, rtol=1e-9) and np.isclose(got.n_per_arm_a1, 1155.8630556, rtol=1e-6)


def test_reconcile_verdicts(spark):
    actual = spark.createDataFrame([("a", 1.0), ("b", 0.0581), ("c", 0.06), ("d", 5.0)], ["f", "value"])
    anchors = spark.createDataFrame([("a", 1.0 + 1e-8, None), ("b", 0.058132859, 4), ("c", 0.058132859, 4)], "f string, anchor_value double, stored_dp int")
    got = {r.f: r.verdict for r in rc.reconcile(actual, anchors, ["f"]).collect()}
    assert got == {"a": "PASS", "b": "ROUNDED", "c": "FAIL", "d": "UNANCHORABLE"}
    worst = rc.worst_verdict(rc.reconcile(actual, anchors, ["f"]).withColumn("art", F.lit("x")), "art", []).first()
    assert worst.verdict == "FAIL" and worst.n_checked == 3


def test_nested_json_is_flattened(spark):
    text = '{"n": 3, "arms": [{"r2": 0.5, "tags": ["x", null]}, {"r2": 0.25}], "note": "hi"}'
    got = {r.path: r.value for r in rc.flatten_json(spark.createDataFrame([(1, text)], ["id", "j"]), ["id"], "j").collect()}
    assert got["arms.0.r2"] == "0.5" and got["arms.1.r2"] == "0.25" and got["n"] == "3" and got["arms.0.tags.0"] == '"x"'
    assert got["note"] == '"hi"' and len(got) == 6


def test_coincident_values_across_cell_borders(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0 + 4e-10), ("c", 2.0), ("d", 1.0)], ["f", "v"])
    got = {r.field: r.n_other for r in rc.coincidences(df, "f", "v", 1e-9).collect()}
    assert got == {"a": 2, "b": 2, "d": 2}


def test_null_and_nan_rules(spark):
    df = spark.createDataFrame([(None, "3"), (-1.0, "x"), (float("nan"), "nan"), (1.0, " 2.5 ")], "a double, s string")
    r = df.select(ex.log1p_clipped(ex.nan_to_null("a")).alias("l"), ex.parse_number("s").alias("n"), ex.guarded_ratio("a", F.lit(2.0)).alias("q")).collect()
    assert [x.l for x in r] == [None, 0.0, None, math.log(2)] and [x.n for x in r] == [3.0, None, None, 2.5]
    assert r[1].q is None and r[3].q == 0.5


@pytest.mark.parametrize("size", [7, 64, 1 << 16])
def test_replicates_have_exactly_as_many_draws_as_rows(spark, size):
    n, reps = 500, 30
    x = np.random.default_rng(3).normal(size=n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double").repartition(5)
    got = resample.bootstrap_sums(df.withColumn("one", F.lit(1.0)), "id", ["x", "one"], reps, size).toPandas().set_index("rep").sort_index()
    assert (got.n == n).all() and (got.one == n).all() and len(got) == reps
    for rep in (0, 11, 29):
        drawn = np.concatenate([b * size + resample.drawn_rows(rep, b, n, size) for b in range(-(-n // size))])
        assert len(drawn) == n and np.isclose(got.x[rep], x[drawn].sum())
    counts = np.array([[resample.draws_of_bucket(r, b, n, size) for b in range(-(-n // size))] for r in range(reps)])
    assert (counts.sum(1) == n).all()
    # Means of draws vary as they should: the standard error of a mean is the population's deviation over sqrt(n).
    se = np.std([x[np.concatenate([b * size + resample.drawn_rows(r, b, n, size) for b in range(-(-n // size))])].mean() for r in range(400)])
    assert 0.85 < se / (x.std() / np.sqrt(n)) < 1.15


def test_joint_availability_counts_every_set(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({c: np.where(rng.random(200) < 0.3, np.nan, 1.0) for c in "abcd"})
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abcd"])
    blocks = {"one": ["a"], "two": ["b", "c"], "three": ["a", "d"]}
    got = {r.blocks: (r.n_blocks, r.n) for r in profile.joint_availability(df, blocks).collect()}
    assert len(got) == 8
    for k in range(8):
        names = [n for i, n in enumerate(blocks) if k >> i & 1]
        cols = [c for n in names for c in blocks[n]]
        assert got["+".join(names)] == (len(names), int(pdf[cols].notna().all(axis=1).sum()))
    assert {r.n for r in profile.joint_availability(df.limit(0), blocks).collect()} == {0}
