"""Nothing is dropped without saying so: deep JSON, one-class and empty folds, long chains of clumping, shared folders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopewise import session
from slopewise.operators import ld, linear, logistic, metrics
from slopewise.operators import reconcile as rc


def test_json_of_any_depth(spark):
    deep, path = 7, []
    for k in range(14):
        deep = {"k": deep} if k % 2 else [deep]
        path.insert(0, "k" if k % 2 else "0")
    rows = [(1, json.dumps({"a": deep, "b": [1, {"c": "x"}]})), (2, "5"), (3, json.dumps({"only": True}))]
    got = {(r.id, r.path): r.value for r in rc.flatten_json(spark.createDataFrame(rows, "id long, j string"), ["id"], "j").collect()}
    assert got == {(1, "a." + ".".join(path)): "7", (1, "b.0"): "1", (1, "b.1.c"): '"x"', (2, ""): "5", (3, "only"): "true"}


@pytest.mark.parametrize("n, bound", [(12, 4), (10_000, ld.IN_ONE_GROUP)])
def test_clumping_goes_on_to_the_end(spark, n, bound):
    assoc = spark.createDataFrame([("l", f"v{k:05d}", 1e-9, float(k)) for k in range(n)] + [("l", "alone", 1e-9, 3.0), ("m", "v00003", 1e-9, 0.0)], "locus string, v string, p double, o double")
    edges = spark.createDataFrame([(f"v{k:05d}", f"v{k + 1:05d}", 0.5) for k in range(n - 1)], "a string, b string, r2 double")
    want = sorted([("l", "alone"), ("m", "v00003"), *(("l", f"v{k:05d}") for k in range(0, n, 2))])
    assert sorted((r.locus, r.v) for r in ld.clump(assoc, edges, "locus", "v", F.col("o"), p="p", in_one_group=bound).collect()) == want
    # Ties, and no order at all, go by name.
    got = ld.clump(assoc.withColumn("o", F.when(F.col("o") < 5, 1.0)), edges, "locus", "v", F.col("o"), p="p", in_one_group=bound)
    assert ("l", "v00005") in {(r.locus, r.v) for r in got.collect()}


def test_one_class_fold_keeps_its_rows(spark):
    rows = [(k, float(k % 7), int(k < 20 and k % 2 == 0), 0 if k < 20 else 1) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, lab int, f int")
    got = logistic.logistic_cv(df, "id", "lab", ["x"], k=2, fold_cols={0: "f"}).toPandas()
    assert len(got) == 60
    assert set(got[got.fold == 0].status) == {"one_class"} and got[got.fold == 0].pred.isna().all()
    assert set(got[got.fold == 1].status) == {"ok"} and got[got.fold == 1].pred.notna().all()
    assert logistic.repeated_auc(logistic.logistic_cv(df, "id", "lab", ["x"], k=2, fold_cols={0: "f"}), []).count() == 1


def test_gaps_are_filled_with_the_training_median(spark):
    rng = np.random.default_rng(2)
    x = 100 + rng.normal(size=240)
    lab = (rng.random(240) < 1 / (1 + np.exp(-(x - 100)))).astype(int)
    gap = rng.random(240) < 1 / 3
    df = spark.createDataFrame([(i, None if g else float(v), int(y), i % 3) for i, (v, g, y) in enumerate(zip(x, gap, lab))], "id long, x double, lab int, f int")
    got = logistic.logistic_cv(df, "id", "lab", ["x"], k=3, fold_cols={0: "f"}).toPandas().set_index("id")
    for fold in range(3):
        train = np.array([i % 3 != fold for i in range(240)])
        filled = df.withColumn("x", F.coalesce("x", F.lit(float(np.median(x[train & ~gap])))))
        want = logistic.logistic_cv(filled, "id", "lab", ["x"], k=3, fold_cols={0: "f"}).toPandas().set_index("id")
        own = got[got.fold == fold].index
        assert np.allclose(got.loc[own].pred, want.loc[own].pred, atol=1e-7)


def test_more_folds_than_subjects(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal()), 0.1) for i in range(4)], "id long, x double, y double, v double")
    arms = [linear.Arm("a", ("x",), "ridge", (1.0,))]
    got = linear.nested_cv(df, "id", linear.Outcome("y", "v"), arms, k=5, inner_k=2, seeds=[0, 1]).toPandas()
    assert sorted(zip(got.seed, got.id)) == [(s, i) for s in (0, 1) for i in range(4)]
    assert set(got.status) == {"ok", "no_fit"}  # three of the four share a fold in one of the seeds
    assert (got.pred_a.isna() == (got.status == "no_fit")).all()


@pytest.mark.parametrize("rows", [1, 2, 3])
def test_folds_without_a_fit_keep_their_rows(spark, rows):
    df = spark.createDataFrame([(i, float(i), float(i * i), 0.1, i) for i in range(rows)], "id long, x double, y double, v double, f int")
    arms = [linear.Arm("base", ("x",), "ridge", (1.0,)), linear.Arm("aug", ("x",), "elastic_net", ((0.1, 0.5), (1.0, 0.5)))]
    got = linear.nested_cv(df, "id", linear.Outcome("y", "v"), arms, k=rows, inner_k=2, fold_cols={0: "f"})
    out = got.toPandas()
    fits = rows == 3
    assert sorted(out.id) == list(range(rows)) and (out.status == ("ok" if fits else "no_fit")).all() and out.pred_aug.notna().all() == fits
    score = metrics.paired_increment(got, "pred_base", "pred_aug", ["seed"]).first()
    assert (score.n, score.unscored) == ((3, 0) if fits else (0, rows))


def test_elastic_net_path_settles():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6))
    x[:, 5] = x[:, 4] + 1e-7 * rng.normal(size=80)  # nearly the same column twice
    y = x @ np.array([1, -1, 0.5, 0, 0.3, 0.3]) + rng.normal(size=80)
    x, y = (x - x.mean(0)) / x.std(0), y - y.mean()
    sxx, sxy, syy = x.T @ x / 80, x.T @ y / 80, y @ y / 80
    for (a, l1), b in zip(linear.ELASTIC_GRID, linear._elastic_path(sxx, sxy, syy, linear.ELASTIC_GRID), strict=True):
        alone = linear._elastic(sxx, sxy, a, l1, syy)
        worth = [0.5 * (syy - 2 * c @ sxy + c @ sxx @ c) + a * l1 * abs(c).sum() + 0.5 * a * (1 - l1) * c @ c for c in (b, alone)]
        assert abs(worth[0] - worth[1]) < 1e-12 and linear._gap(sxx, sxy, syy, b, a * l1, a * (1 - l1)) <= 1e-12


def test_checkpoint_folder_is_local_only_on_one_machine(monkeypatch):
    class Context:
        master = "spark://host:7077"
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, x):
            self.folder = x

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(Session())
    Session.sparkContext.master = "local[4]"
    assert session.checkpoint_folder(Session()).startswith("/")
    Session.sparkContext = Context()
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared"}
    assert session.checkpoint_folder(Session()) == "hdfs://shared"
