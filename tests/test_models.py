import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slopewise.operators import evaluate, folds, linear, logistic, metrics
from slopewise.operators.linear import Arm, Outcome


def word(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


N = 400


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(N, 4))
    b = x[:, 0] * 0.5 + x[:, 1] * 0.3 + rng.normal(size=N) * 0.7
    v = rng.uniform(0.05, 0.3, N)
    x[rng.random(N) < 0.1, 1] = np.nan
    pdf = pd.DataFrame(x, columns=list("pqrs")).assign(id=np.arange(N), b=b, v=v, lab=(b + rng.normal(size=N) > 0).astype(int))
    df = spark.createDataFrame(pdf).select("id", "b", "v", "lab", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "pqrs"])
    return pdf, df


def ridge(x, y, a):
    m = x.mean(0)
    beta = np.linalg.solve((x - m).T @ (x - m) + a * np.eye(x.shape[1]), (x - m).T @ (y - y.mean()))
    return y.mean() - m @ beta, beta


def brute(pdf, cols, seed, fold, kind="inner"):
    f = np.array([word(f"{i}:{seed}") % 5 for i in range(N)])
    g = np.array([word(f"{i}:{seed}:inner") % 5 for i in range(N)])
    tr = f != fold
    b, v = pdf.b.to_numpy(), pdf.v.to_numpy()
    mu = b[tr].mean()
    tau2 = max(0.0, b[tr].var(ddof=1) - v[tr].mean())
    y = mu + tau2 / (tau2 + v) * (b - mu)
    x = pdf[cols].to_numpy()
    x = np.where(np.isnan(x), np.nanmedian(x[tr], axis=0), x)
    z = (x - x[tr].mean(0)) / x[tr].std(0)
    scores = []
    for a in linear.RIDGE_GRID:
        r = []
        for k in range(5):
            fit, held = tr & (g != k), tr & (g == k)
            b0, be = ridge(z[fit], y[fit], a)
            r.append(1 - ((y[held] - b0 - z[held] @ be) ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum())
        scores.append(np.mean(r))
    b0, be = ridge(z[tr], y[tr], linear.RIDGE_GRID[int(np.argmax(scores))])
    return np.flatnonzero(~tr), y[~tr], b0 + z[~tr] @ be


def test_nested_cv_equals_row_level_fitting(data):
    pdf, df = data
    arms = [Arm("base", ("p", "r")), Arm("aug", ("p", "r", "q", "s"))]
    oof = linear.nested_cv(df, "id", Outcome("b", "v"), arms, seeds=[0, 1]).toPandas()
    assert len(oof) == 2 * N and oof.groupby("seed").id.nunique().eq(N).all()
    for seed in (0, 1):
        for fold in (0, 3):
            got = oof[(oof.seed == seed) & (oof.fold == fold)].set_index("id")
            for name, cols in (("base", ["p", "r"]), ("aug", ["p", "r", "q", "s"])):
                ids, y, pred = brute(pdf, cols, seed, fold)
                assert np.allclose(got.loc[ids, "y"], y) and np.allclose(got.loc[ids, f"pred_{name}"], pred, atol=1e-9)


def test_scores_from_sums_equal_scores_of_rows(data):
    _, df = data
    arms = [Arm("base", ("p", "r")), Arm("aug", ("p", "r", "q", "s"))]
    d = linear.prepare(df, "id", ["p", "q", "r", "s"], Outcome("b", "v"), [0, 1], 5, 5)
    a = linear.pooled_scores(df, d, arms).toPandas().set_index(["arm", "seed"]).r2.sort_index()
    oof = linear.nested_cv(df, "id", Outcome("b", "v"), arms, seeds=[0, 1])
    b = metrics.regression_metrics(linear.long_predictions(oof, ["base", "aug"], ["seed"]), ["arm", "seed"]).toPandas()
    assert np.allclose(a, b.set_index(["arm", "seed"]).r2.sort_index())


def test_result_does_not_depend_on_layout(data, spark):
    _, df = data
    arm = [Arm("m", ("p", "q"))]
    a = linear.nested_cv(df, "id", Outcome("b", "v"), arm).toPandas().set_index("id").pred_m.sort_index()
    b = linear.nested_cv(df.repartition(9).orderBy(F.desc("id")), "id", Outcome("b", "v"), arm).toPandas().set_index("id").pred_m.sort_index()
    assert np.allclose(a, b, atol=1e-10)


def test_predictions_of_a_fold_ignore_its_own_outcomes(data):
    _, df = data
    arm = [Arm("m", ("p", "r"))]
    hit = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("0"))), 1, 8), 16, 10).cast("long"), F.lit(5)) == 2
    moved = df.withColumn("b", F.when(hit, F.col("b") + 100).otherwise(F.col("b")))
    a = linear.nested_cv(df, "id", Outcome("b", "v"), arm).filter("fold = 2").toPandas().set_index("id").pred_m.sort_index()
    b = linear.nested_cv(moved, "id", Outcome("b", "v"), arm).filter("fold = 2").toPandas().set_index("id").pred_m.sort_index()
    assert len(a) and np.allclose(a, b, atol=1e-9)


def test_elastic_net_meets_its_optimality_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    y = x @ np.array([1.0, 0.0, -0.5, 0.0, 0.2]) + rng.normal(size=300)
    x, y = x - x.mean(0), y - y.mean()
    a, l1 = 0.3, 0.9
    beta = linear._elastic(x.T @ x / 300, x.T @ y / 300, a, l1, y @ y / 300)
    grad = -x.T @ (y - x @ beta) / 300 + a * (1 - l1) * beta
    on = beta != 0
    assert on.any() and (~on).any()
    assert np.allclose(grad[on], -a * l1 * np.sign(beta[on]), atol=1e-7) and (np.abs(grad[~on]) <= a * l1 + 1e-7).all()


def test_permutation_null_is_centred_and_signal_stands_out(data):
    _, df = data
    null = evaluate.permutation_null(df.drop("q"), "id", Outcome("b", "v"), ["r"], ["p", "s"], n_perm=12)
    p = evaluate.permutation_p(null).first()
    assert p.observed > 0.1 and abs(p.null_mean) < 0.02 and p.p_raw == 0.0 and np.isclose(p.p_corrected, 1 / 13)


def test_equivalence_verdicts(spark):
    def run(best):
        rows = [("ref", s, 0.10) for s in range(3)] + [("rich", s, 0.10 + d) for s, d in enumerate(best)] + [("other", 0, 0.9)]
        return evaluate.equivalence(spark.createDataFrame(rows, ["arm", "seed", "r2"]), "ref", ["other"]).first()

    assert run((0.01, 0.0, 0.015)).status == "equivalent"
    assert run((0.03, 0.02, 0.05)).status == "superior"
    got = run((0.03, 0.01, 0.05))
    assert got.status == "inconclusive" and got.best_arm == "rich" and np.isclose(got.seed_range_width, 0.04)


def test_anchor_stops_the_job(spark):
    df = spark.createDataFrame([("a", 0.05)], ["control", "dr2"])
    assert evaluate.check_anchor(df, 0.0505, 0.002).first().dr2 == 0.05
    with pytest.raises(Exception, match="anchor not reproduced"):
        evaluate.check_anchor(df, 0.08, 0.002).collect()


def test_logistic_newton_solves_the_penalised_equations(data):
    pdf, df = data
    oof = logistic.logistic_cv(df, "id", "lab", ["p", "r"], k=3).toPandas().set_index("id")
    f = np.array([word(f"{i}:0") % 3 for i in range(N)])
    for fold in range(3):
        tr = f != fold
        x = pdf[["p", "r"]].to_numpy()
        z = np.column_stack([np.ones(N), (x - x[tr].mean(0)) / x[tr].std(0)])
        y, beta = pdf.lab.to_numpy(), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z[tr] @ beta))
            pen = np.diag([0.0, 1.0, 1.0])
            beta = beta + np.linalg.solve((z[tr] * (p * (1 - p))[:, None]).T @ z[tr] + pen, z[tr].T @ (y[tr] - p) - pen @ beta)
        want = 1 / (1 + np.exp(-z[~tr] @ beta))
        assert np.allclose(oof.loc[np.flatnonzero(~tr), "pred"], want, atol=1e-7)


def test_recalibration_covers_every_row_once_and_keeps_order(data):
    _, df = data
    oof = logistic.recalibrated_cv(df, "id", "lab", ["p", "r"], k=3).toPandas()
    assert len(oof) == N and oof.id.is_unique
    assert oof[["p_raw", "p_platt", "p_isotonic"]].apply(lambda c: c.between(0, 1).all()).all()
    for _, g in oof.groupby("fold"):
        g = g.sort_values("p_raw")
        assert (np.diff(g.p_platt) >= -1e-12).all() and (np.diff(g.p_isotonic) >= -1e-12).all()


def test_cluster_cv_leaves_each_cluster_out(data):
    pdf, df = data
    sites = df.withColumn("site", F.when(F.col("id") % 4 == 3, -1).otherwise(F.col("id") % 4 + 10).cast("int"))
    oof = evaluate.cluster_cv(sites, "id", Outcome("b", "v"), ["p"], ["s"], {0: "site"}, inner_k=3).toPandas()
    assert len(oof) == N and set(oof.cluster) == {-1, 10, 11, 12}
    b, v = pdf.b.to_numpy(), pdf.v.to_numpy()
    tr = pdf.id.to_numpy() % 4 != 3
    tau2 = max(0.0, b[tr].var(ddof=1) - v[tr].mean())
    got = oof[oof.cluster == -1].set_index("id").sort_index()
    assert np.allclose(got.y, b[tr].mean() + tau2 / (tau2 + v[~tr]) * (b[~tr] - b[tr].mean()))


@pytest.mark.parametrize("per_bin", [7, 10_000])
def test_isotonic_blocks_are_the_largest_of_least_means(spark, per_bin):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"f": rng.integers(0, 3, 260), "p": np.round(rng.random(260), 2)})
    pdf["y"] = (rng.random(260) < pdf.p).astype(int)
    pdf.loc[pdf.f == 2, "y"] = (pdf.p[pdf.f == 2] < 0.5).astype(int)  # falling: one block
    df = spark.createDataFrame(pdf)
    blocks = logistic.isotonic_blocks(df, "f", "y", "p", rows_per_bin=per_bin)
    tests = spark.createDataFrame([(f, float(x)) for f in range(4) for x in np.linspace(-0.1, 1.1, 41)] + [(0, None)], "f int, p double")
    got = tests.withColumn("v", logistic.isotonic_value(blocks, "f", "p")).toPandas()
    assert got.v[(got.f == 3) | got.p.isna()].isna().all()
    for f in range(3):
        s = pdf[pdf.f == f].groupby("p")["y"].agg(["sum", "count"])
        t, w = s["sum"].to_numpy(float), s["count"].to_numpy(float)
        n = len(s)
        mean = [[t[a:b + 1].sum() / w[a:b + 1].sum() if a <= b else np.inf for b in range(n)] for a in range(n)]
        fit = [max(min(mean[a][i:]) for a in range(i + 1)) for i in range(n)]
        own = got[(got.f == f) & got.p.notna()]
        assert np.allclose(own.v, np.interp(own.p, s.index, fit))
    assert blocks.filter("f = 2").count() == 1


def test_newton_settles_on_separable_and_extreme_rows(spark):
    rows = [(i, float(x), int(x > 0), 0 if i % 2 else 1) for i, x in enumerate([*np.linspace(-50, -0.01, 40), *np.linspace(0.01, 5000, 40)])]
    df = spark.createDataFrame(rows, "id long, x double, lab int, f int")
    for c in (1e-3, 1.0, 1e6):
        got = logistic.logistic_cv(df, "id", "lab", ["x"], k=2, grid=(c,), fold_cols={0: "f"}).toPandas()
        assert (got.status == "ok").all() and got.pred.between(0, 1).all()
        assert all(g.sort_values("id").pred.is_monotonic_increasing for _, g in got.groupby("fold"))


def test_arrays_permute_as_columns_do_and_every_block_is_filled(spark):
    n = 1000
    at = spark.range(n).select("id", folds.permuted(F.col("id"), n, F.lit(7)).alias("to")).toPandas().sort_values("id")["to"].to_numpy()
    way = folds.Permutation(n, 7)
    assert np.array_equal(way.to(np.arange(n)), at) and np.array_equal(way.back(at), np.arange(n))
    for size in (1, 2, 3, 5):
        assert sorted(folds.Permutation(size, 1).back(np.arange(size))) == list(range(size))

    rows = [(i, f"s{i}" if i % 5 else None, None if i % 3 == 0 else float(i), None if i % 4 == 0 else f"t{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, own string, v double, w string")
    for size in (64, 1 << 16):
        got = folds.permuted_blocks(df, "id", ["v", "w"], list(range(1, 20)), size).toPandas()
        assert len(got) == 19 * n
        for rep in (1, 16, 17, 19):
            of = got[got.rep == rep].sort_values("id")
            to = folds.Permutation(n, rep).to(np.arange(n))
            assert of["own"].where(of["own"].notna(), None).tolist() == [r[1] for r in rows]
            assert [None if np.isnan(x) else x for x in of["v"]] == [rows[t][2] for t in to]
            assert of["w"].where(of["w"].notna(), None).tolist() == [rows[t][3] for t in to]


def test_permuted_sums_are_those_of_the_permuted_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 17 == 0 else float(b), None if i % 29 == 0 else 0.1 + float(v), float(r), None if i % 7 == 0 else float(p))
            for i, (b, v, r, p) in enumerate(zip(rng.normal(size=400), rng.random(400), rng.normal(size=400), rng.normal(size=400)))]
    df = spark.createDataFrame([*rows, (None, 1.0, 0.2, 0.5, 0.1)], "id long, b double, v double, r double, p double")
    got = evaluate.permutation_null(df, "id", Outcome("b", "v"), ["r"], ["p"], n_perm=18).toPandas().set_index("rep")
    all_rows = folds.permuted_blocks(df, "id", ["p"], list(range(1, 19))).unionByName(df.withColumn("rep", F.lit(0))).select("rep", "id", "b", "v", "r", "p")
    d = linear.prepare(all_rows.filter("rep = 0"), "id", ["r", "p"], Outcome("b", "v"), [0], 5, 1, rep="rep")
    want = evaluate._score_pairs(all_rows, d, ["r"], ["p"], 1.0).toPandas().set_index("rep")
    assert len(got) == 19 and np.allclose(got.sort_index(), want.sort_index()[got.columns], atol=1e-9)


@pytest.mark.parametrize("per_range", [40, 500_000])
def test_inner_auc_is_exact_across_ranges(spark, per_range):
    """Held-out scores of every inner fit against all pairs: ties half, NULL filled, NaN highest, rows without a fold in none."""
    rng = np.random.default_rng(5)
    x = rng.choice([-1.0, 0.0, 0.5, 2.0], 400) + np.where(rng.random(400) < 0.5, rng.normal(size=400), 0.0)
    pdf = pd.DataFrame({"x": x, "y": (rng.random(400) < 1 / (1 + np.exp(-x))).astype(int), "o0": rng.integers(0, 2, 400), "g0": rng.integers(0, 3, 400)})
    values = [(None if i % 29 == 0 else float("nan") if i % 31 == 0 else float(r.x), int(r.y), None if i % 37 == 0 else int(r.o0), None if i % 41 == 0 else int(r.g0))
              for i, r in enumerate(pdf.itertuples())]
    df = spark.createDataFrame(values, "x double, y int, o0 int, g0 int").repartition(3)
    one = np.ones(1)
    fits = [logistic.Fit((0, o, g, i), ("x",), 1.0, (("o0", o, False), ("g0", g, False)), 0 * one, one, 0.25 * one, np.array([0.1, b]), True, classes=2)
            for o in range(2) for g in range(3) for i, b in enumerate((0.7, -1.3, 0.0))]
    got = logistic.inner_auc(df, 400, fits, "y", per_range)
    assert len(got) == len(fits)
    for f in fits:
        _, o, g, _ = f.name
        held = [(0.25 if v is None else v, y) for v, y, a, b in values if a is not None and a != o and b == g]
        p = np.array([1 / (1 + np.exp(-(f.beta[0] + f.beta[1] * v))) for v, _ in held])
        p = np.where(np.isnan(p), 2.0, p)
        y = np.array([y for _, y in held])
        pairs = p[y == 1][:, None] - p[y == 0][None, :]
        assert got[f.name] == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean(), abs=1e-12)


def test_nested_penalty_is_the_best_and_needs_few_passes(spark, monkeypatch):
    """Same choice and coefficients as fits from nought; an inner fit is passed over about three times, and no held-out score is a row."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 2))
    y = (rng.random(1500) < 1 / (1 + np.exp(-x[:, 0] + 0.4))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(t), i % 3) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, u double, v double, y int, part int")
    plain, passes = logistic._sum_over_rows, []

    def counted(rows, fits, part):
        passes.append(sum(len(f.name) == 4 for f in fits))
        return plain(rows, fits, part)

    monkeypatch.setattr(logistic, "_sum_over_rows", counted)
    grid, fits = (0.001, 1.0, 100.0), 3 * 3 * 3
    oof = logistic.logistic_cv(df, "id", "y", ["u", "v"], k=3, inner_k=3, grid=grid, fold_cols={0: "part"}).toPandas()
    assert fits < sum(passes) <= 4.2 * fits
    inner = {r.id: r.g for r in df.select("id", folds.fold_of("id", 0, 3, "inner").alias("g")).collect()}
    g = np.array([inner[i] for i in range(1500)])
    fold = np.arange(1500) % 3

    def fit(at, c, mean, scale):
        z = np.column_stack([np.ones(at.sum()), (x[at] - mean) / scale])
        beta, pen = np.zeros(3), np.array([0, 1 / c, 1 / c])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ beta))
            beta = beta + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (y[at] - p) - pen * beta)
        return beta

    for o in range(3):
        train = fold != o
        mean, scale = x[train].mean(0), x[train].std(0)
        score = []
        for c in grid:
            each = []
            for k in range(3):
                held = train & (g == k)
                eta = (x[held] - mean) / scale @ fit(train & (g != k), c, mean, scale)[1:]
                pairs = eta[y[held] == 1][:, None] - eta[y[held] == 0][None, :]
                each.append(((pairs > 0) + 0.5 * (pairs == 0)).mean())
            score.append(np.mean(each))
        beta = fit(train, grid[int(np.argmax(score))], mean, scale)
        test = oof[oof.fold == o].sort_values("id")
        want = 1 / (1 + np.exp(-(beta[0] + (x[fold == o] - mean) / scale @ beta[1:])))
        assert np.allclose(test.pred.to_numpy(), want, atol=1e-9)
