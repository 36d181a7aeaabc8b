import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slopewise.operators import ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 900
    # One key holds most rows, one value holds a third of them, one outlier stretches the range.
    pdf = pd.DataFrame({"id": np.arange(n), "k": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 5, n)),
                        "x": np.round(rng.normal(size=n), 2)})
    pdf.loc[rng.random(n) < 0.33, "x"] = 0.5
    pdf.loc[7, "x"] = 1e6
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("per_bin", [5, 10_000])
def test_row_numbers_match_a_plain_sort(rows, per_bin):
    pdf, df = rows
    got = ranks.number_rows(df, ["k"], "x", ["id"], "r", rows_per_bin=per_bin).toPandas().set_index("id")["r"].sort_index()
    want = pdf.sort_values(["k", "x", "id"]).assign(r=lambda d: d.groupby("k").cumcount() + 1).set_index("id")["r"].sort_index()
    assert (got == want).all()


@pytest.mark.parametrize("per_bin", [5, 10_000])
def test_running_counts_and_average_ranks(rows, per_bin):
    pdf, df = rows
    got = ranks.average_ranks(df, ["k"], "x", rows_per_bin=per_bin).toPandas()
    want = pdf.assign(a=pdf.groupby("k")["x"].rank()).groupby(["k", "x"])["a"].first()
    assert np.allclose(got.set_index(["k", "x"])["avg_rank"].sort_index(), want.sort_index())


@pytest.mark.parametrize("per_bin", [5, 10_000])
def test_exact_quantiles(rows, per_bin):
    pdf, df = rows
    got = ranks.exact_quantiles(df, ["k"], "x", {"a": 0.1, "m": 0.5, "z": 1.0}, rows_per_bin=per_bin).toPandas().set_index("k").sort_index()
    for name, p in (("a", 0.1), ("m", 0.5), ("z", 1.0)):
        assert np.allclose(got[name], pdf.groupby("k")["x"].quantile(p))


def test_global_rank_without_keys(rows):
    pdf, df = rows
    got = ranks.number_rows(df, [], "x", ["id"], "r", rows_per_bin=20).toPandas().set_index("id")["r"]
    want = pdf.sort_values(["x", "id"]).reset_index(drop=True).reset_index().set_index("id")["index"] + 1
    assert (got.sort_index() == want.sort_index()).all()


SHAPES = {
    "outlier": lambda rng, n: np.where(np.arange(n) == 5, 1e300, rng.normal(size=n)),
    "heavy_tail": lambda rng, n: np.exp(40 * rng.normal(size=n)) * rng.choice([-1, 1], n),
    "ties": lambda rng, n: np.where(rng.random(n) < 0.9, 0.0, rng.normal(size=n)),
    "one_value": lambda rng, n: np.zeros(n),
}


@pytest.mark.parametrize("shape, limit", [*((s, 1_000_000) for s in SHAPES), ("heavy_tail", 10)])
def test_bins_hold_at_most_twice_what_was_asked(spark, monkeypatch, shape, limit):
    monkeypatch.setattr(ranks, "BROADCAST_EDGES", limit)
    monkeypatch.setattr(ranks, "FAN_OUT", 16)  # several levels of cuts
    rng = np.random.default_rng(4)
    n = 8_000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b"], n)), "x": SHAPES[shape](rng, n), "t": rng.integers(0, 50, n)})
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != "b", F.col("k")))
    table, count = ranks.written(df.withColumn("i", F.monotonically_increasing_id()))
    binned, cells = ranks.bins(table, count, ["k"], ["x", "t", "i"], {}, 40)
    sizes = [r["__n"] for r in cells.collect()]
    assert sum(sizes) == n and max(sizes) <= 80 and len(sizes) <= 2.5 * n / 40
    ends = binned.groupBy("k", "__bin").agg(F.min(F.struct("x", "t", "i")).alias("lo"), F.max(F.struct("x", "t", "i")).alias("hi")).toPandas()
    for _, part in ends.groupby("k", dropna=False):
        part = part.sort_values("__bin")
        assert all(tuple(a.values()) < tuple(b.values()) for a, b in zip(part["hi"][:-1], part["lo"][1:], strict=False))
    got = ranks.number_rows(df, ["k"], "x", ["t"], "r", rows_per_bin=40).toPandas().sort_values(["k", "r"])
    want = got.sort_values(["k", "x", "t"], kind="stable")
    assert (got["r"].to_numpy() == got.groupby("k", dropna=False).cumcount().to_numpy() + 1).all()
    assert (got[["x", "t"]].to_numpy() == want[["x", "t"]].to_numpy()).all()


def test_input_is_read_once_and_words_have_an_order(spark):
    reads = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(w, k) for k, w in enumerate(["b", "é", "a", "aa", "Z", "", "日"] * 40)], "w string, i int").mapInArrow(once, "w string, i int")
    got = ranks.number_rows(df, [], "w", ["i"], "r", rows_per_bin=30).toPandas().sort_values("r")
    assert reads.value == 280
    assert list(zip(got["w"], got["i"])) == sorted(zip(got["w"], got["i"]), key=lambda x: (x[0].encode(), x[1]))


def test_nothing_in_nothing_out(spark):
    df = spark.createDataFrame([], "k string, x double, id long")
    assert ranks.number_rows(df, ["k"], "x", ["id"]).count() == 0
    assert ranks.exact_quantiles(df, ["k"], "x", {"m": 0.5}).count() == 0
