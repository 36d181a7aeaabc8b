import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slopewise.operators import assay, folds, longitudinal as lg, preprocess


@pytest.fixture(scope="module")
def visits(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        n = rng.integers(3, 8)
        t = np.sort(60 + rng.random(n) * 5)
        y = 28 - 0.3 * (t - 60) * rng.normal(1, 0.5) + rng.normal(size=n)
        rows += [(i, f"V{j:02d}", float(a), float(b)) for j, (a, b) in enumerate(zip(t, y))]
    pdf = pd.DataFrame(rows, columns=["id", "ev", "t", "y"])
    return pdf, spark.createDataFrame(pdf)


def ols(t, y):
    tc = t - t.mean()
    b = (tc * (y - y.mean())).sum() / (tc ** 2).sum()
    r = y - y.mean() - b * tc
    return b, (r ** 2).sum() / (len(t) - 2) / (tc ** 2).sum()


def test_slopes_variances_and_first_visit_removed(visits):
    pdf, df = visits
    got = lg.subject_slopes(df, "id", "t", "y", "ev").toPandas().set_index("id")
    for i, g in pdf.groupby("id"):
        b, v = ols(g.t.to_numpy(), g.y.to_numpy())
        assert np.isclose(got.loc[i, "ols_slope"], b) and np.isclose(got.loc[i, "slope_var"], v)
        rest = g.sort_values("t").iloc[1:]
        if len(rest) >= 3:
            assert np.isclose(got.loc[i, "slope_excl_first"], ols(rest.t.to_numpy(), rest.y.to_numpy())[0])
        else:
            assert pd.isna(got.loc[i, "slope_excl_first"])


def test_too_few_visits_or_no_time_spread(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 2.0), (1, "b", 2.0, 3.0), (2, "a", 1.0, 1.0), (2, "b", 1.0, 2.0), (2, "c", 1.0, 3.0)],
                               ["id", "ev", "t", "y"])
    assert [r.ols_slope for r in lg.subject_slopes(df, "id", "t", "y", "ev").collect()] == [None, None]


def test_eligibility_boundary_is_inclusive(spark):
    df = spark.createDataFrame([(i, f"e{j}", t, float(j * j)) for i, ts in ((1, (0.0, 1.0, 2.0, 3.0)), (2, (0.0, 1.0, 2.0, 2.99)))
                                for j, t in enumerate(ts)], ["id", "ev", "t", "y"])
    assert [r.id for r in lg.eligible(lg.subject_slopes(df, "id", "t", "y", "ev"), 4, 3.0).collect()] == [1]


def test_training_params_ignore_held_out_subjects(visits, spark):
    pdf, _ = visits
    rng = np.random.default_rng(0)
    s = pd.DataFrame({"id": np.arange(60), "ols_slope": rng.normal(size=60), "slope_var": rng.random(60)})
    folded = folds.assign_folds(spark.createDataFrame(s), "id", 5, [0, 1])
    got = lg.training_params(folded).toPandas().set_index(["seed", "fold"]).sort_index()
    fold = folded.toPandas()
    for (seed, f), row in got.iterrows():
        ids = fold[(fold.seed == seed) & (fold.fold != f)]
        assert np.isclose(row.mu, ids.ols_slope.mean()) and row.n_used == len(ids)
        assert np.isclose(row.tau2, max(0.0, ids.ols_slope.var(ddof=1) - ids.slope_var.mean()))
    changed = folded.withColumn("ols_slope", F.when((F.col("seed") == 0) & (F.col("fold") == 2), 1e6).otherwise(F.col("ols_slope")))
    again = lg.training_params(changed).toPandas().set_index(["seed", "fold"]).sort_index()
    assert np.isclose(again.loc[(0, 2), "mu"], got.loc[(0, 2), "mu"]) and again.loc[(0, 1), "mu"] > 1e3


def test_no_between_variance_collapses_to_the_mean(spark):
    s = spark.createDataFrame([(i, b, 10.0) for i, b in enumerate((0.1, 0.2, 0.3))], ["id", "ols_slope", "slope_var"])
    out = lg.shrink(s, lg.shrinkage_params(s)).collect()
    assert all(np.isclose(r.eb_slope, 0.2) for r in out)
    exact = spark.createDataFrame([(i, b, 0.0) for i, b in enumerate((0.1, 0.2, 0.3))], ["id", "ols_slope", "slope_var"])
    assert all(np.isclose(r.eb_slope, r.ols_slope) for r in lg.shrink(exact, lg.shrinkage_params(exact)).collect())
    none = exact.filter("id > 9")
    assert lg.shrinkage_params(none).first()[:2] == (0.0, 0.0)


def test_folds_partition_and_do_not_depend_on_layout(spark):
    ids = spark.range(500).withColumnRenamed("id", "s")
    a = {(r.s, r.seed): r.fold for r in folds.assign_folds(ids, "s", 5, [0, 1]).collect()}
    b = {(r.s, r.seed): r.fold for r in folds.assign_folds(ids.repartition(7).orderBy(F.desc("s")), "s", 5, [0, 1]).collect()}
    assert a == b and len(a) == 1000 and set(a.values()) == set(range(5))
    assert all(r.violations == 0 for r in folds.leak_check(folds.assign_folds(ids, "s", 5, [0, 1]), "s").collect())


def test_stratified_cluster_and_size_matched_folds(spark):
    df = spark.range(300).select(F.col("id").alias("s"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("c"),
                                 F.when(F.col("id") < 250, F.col("id") % 5).otherwise(5 + F.col("id") % 25).cast("int").alias("site"))
    st = folds.stratified_folds(df, "s", "c", 5, 1).groupBy("c", "fold").count().collect()
    assert {r["count"] for r in st if r.c == "rare"} == {6} and {r["count"] for r in st if r.c == "common"} == {54}
    cl = folds.cluster_folds(df, "s", "site", 20).select("s", "fold")
    sizes = {r.fold: r["count"] for r in cl.groupBy("fold").count().collect()}
    assert sizes == {**{i: 50 for i in range(5)}, -1: 50}
    rnd = folds.size_matched_clusters(cl, "s", [1, 2])
    for seed in (1, 2):
        assert {r.fold: r["count"] for r in rnd.filter(F.col("seed") == seed).groupBy("fold").count().collect()} == sizes
    assert rnd.groupBy("seed").agg(F.count_distinct("s").alias("n")).collect()[0].n == 300


def test_training_scalers(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"s": np.arange(200), "a": rng.normal(size=200), "b": 3.0})
    pdf.loc[rng.random(200) < 0.2, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    got = preprocess.training_scalers(df, "s", ["a", "b"], [0], 4).toPandas().set_index(["fold", "feature"])
    fold = folds.assign_folds(df, "s", 4, [0]).toPandas().set_index("s").fold.sort_index().to_numpy()
    for f in range(4):
        tr = pdf.a[fold != f]
        full = tr.fillna(tr.median())
        assert np.allclose(got.loc[(f, "a"), ["median", "mean", "sd"]].astype(float), [tr.median(), full.mean(), full.std(ddof=0)])
        assert got.loc[(f, "b"), "sd"] == 1.0


def test_visit_order_and_first_value(spark):
    df = spark.createDataFrame([(1, "V04", "x", 4.0), (1, "BL", "x", None), (1, "SC", "y", 9.0), (1, "V02", "x", 2.0), (1, "U01", "y", 1.0)],
                               "id int, ev string, target string, v double")
    got = assay.earliest_wide(df, "id", "target", "v", ["x", "y"], [assay.visit_order("ev")]).first()
    assert (got.x, got.y) == (2.0, 9.0)


def test_hot_subject_is_combined_before_the_shuffle(visits):
    _, df = visits
    plan = lg.subject_slopes(df, "id", "t", "y", "ev")._jdf.queryExecution().executedPlan().toString()
    assert "partial_regr" in plan and "Window" not in plan
    exchanges = [x for x in plan.split("\n") if "hashpartitioning" in x]
    assert exchanges and all("ev#" not in x.split("hashpartitioning")[1] or "__e#" in x for x in exchanges)
    for k, line in enumerate(plan.split("\n")):  # what is dealt by the event is (subject, event) pairs alone
        if "hashpartitioning" in line and "__e#" in line:
            below = next(x for x in plan.split("\n")[k + 1 :] if "HashAggregate" in x)
            assert "functions=[]" in below
