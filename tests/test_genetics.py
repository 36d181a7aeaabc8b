import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slopewise.functions.digests import hash_words
from slopewise.operators import coloc, harmonise as hz, ld, mr, variants as vr
from slopewise.sources import tables as src

EXP = "protein string, platform string, rsid string, chrom string, pos long, effectAllele string, otherAllele string, eaf double, beta double, se double, palindromic boolean"
OUT = "rsid_out string, chrom_out string, pos_out long, ea_out string, oa_out string, beta_out double, se_out double, eaf_out double"


def exp(spark, *rows):
    return spark.createDataFrame([("P", "a", rs, c, p, a, b, f, 1.0, 0.1, {a, b} in ({"A", "T"}, {"C", "G"})) for rs, c, p, a, b, f in rows], EXP)


def test_direct_swapped_and_incompatible(spark):
    e = exp(spark, ("rs1", "1", 10, "A", "G", 0.3), ("rs2", "1", 20, "A", "G", 0.3), ("rs3", "1", 30, "A", "G", 0.3))
    o = spark.createDataFrame([("rs1", "1", 10, "a", "g", 0.5, 0.1, 0.3), ("rs2", "1", 20, "G", "A", 0.5, 0.1, 0.7), ("rs3", "1", 30, "A", "C", 0.5, 0.1, 0.3)], OUT)
    got = {r.rsid: r for r in hz.harmonise(e, o).collect()}
    assert set(got) == {"rs1", "rs2"} and got["rs1"].beta_out == 0.5 and got["rs2"].beta_out == -0.5 and np.isclose(got["rs2"].eaf_out, 0.3)


def test_palindromes_three_ways(spark):
    e = exp(spark, ("rs1", "1", 1, "A", "T", 0.5), ("rs2", "1", 2, "A", "T", 0.2), ("rs3", "1", 3, "A", "T", 0.2), ("rs4", "1", 4, "A", "T", 0.2), ("rs5", "1", 5, "A", "G", 0.5))
    o = spark.createDataFrame([(f"rs{i}", "1", i, "A", a, 1.0, 0.1, f) for i, a, f in ((1, "T", 0.5), (2, "T", 0.2), (3, "T", 0.8), (4, "T", None), (5, "G", 0.5))], OUT)
    got = {r.rsid: (r.beta_out, r.strand_resolved) for r in hz.harmonise(e, o).collect()}
    assert got == {"rs1": (1.0, False), "rs2": (1.0, True), "rs3": (-1.0, True), "rs4": (1.0, False), "rs5": (1.0, True)}


def test_null_rsid_goes_by_position_and_x_is_23(spark):
    e = exp(spark, (None, "X", 5, "A", "G", 0.3), ("rs9", "2", 7, "A", "G", 0.3), ("rs1", "1", 1, "A", "G", 0.3))
    o = spark.createDataFrame([(None, "23", 5, "A", "G", 1.0, 0.1, 0.3), (None, "2", 7, "A", "G", 2.0, 0.1, 0.3), ("rs1", "9", 9, "A", "G", 3.0, 0.1, 0.3)], OUT)
    got = {(r.chrom, r.matched_by, r.beta_out) for r in hz.join_with_fallback(e, o).collect()}
    assert got == {("X", "position", 1.0), ("2", "position", 2.0), ("1", "rsid", 3.0)}
    assert hz.absent_instruments(e, o.filter("rsid_out = 'rs1'"), ["protein"]).first().n_absent == 2


def test_windows_are_inclusive_and_floored(spark):
    genes = spark.createDataFrame([("G", "1", 100, 200, 1, 0), ("G", "1", 900, 950, 1, 1)], ["protein", "chrom", "gene_start", "gene_end", "strand", "o"])
    w = vr.make_windows(genes, "protein", ["o"], 150)
    assert w.first().cis_start == 0 and w.first().cis_end == 350
    v = spark.createDataFrame([("1", p) for p in (0, 1, 350, 351)] + [("2", 100)], ["chrom", "pos"])
    got = vr.within_windows(v, w.drop("strand"), bin_width=100).select("pos").collect()
    assert sorted(r.pos for r in got) == [0, 1, 350]


def test_verdicts_and_forced_control_failure(spark):
    b = spark.createDataFrame([(1.1, 1.2), (0.95, 1.05), (0.8, 1.3), (0.5, 0.9)], ["lo", "hi"])
    assert [r.v for r in b.select(mr.verdict(F.col("lo"), F.col("hi")).alias("v")).collect()] == ["positive", "null", "inconclusive", "positive"]
    est = spark.createDataFrame([("N", "a", "null", 1.0, 0.95, 1.05), ("N", "b", "null", 1.0, 0.95, 1.05), ("D", "a", "null", 1.0, 0.95, 1.05),
                                 ("D", "b", "inconclusive", 1.0, 0.8, 1.2), ("S", "a", "positive", 1.5, 1.2, 1.8), ("T", "both", "not_testable", None, None, 0.0)],
                                "protein string, platform string, verdict string, or double, ci_low double, ci_high double")
    cl = spark.createDataFrame([("N", "a", 0.1, True), ("N", "b", 0.0, False), ("S", "a", 0.9, True)], "protein string, platform string, pp4 double, pp4_estimable boolean")
    good = {r.protein: r.causal_call for r in mr.causal_call(est, cl, est, "a", "b", F.lit(True), F.lit(True)).collect()}
    assert good == {"N": "null", "D": "discordant", "S": "positive", "T": "not_testable"}
    for gates in ((False, True), (True, False)):
        bad = {r.protein: r.causal_call for r in mr.causal_call(est, cl, est, "a", "b", F.lit(gates[0]), F.lit(gates[1])).collect()}
        assert "null" not in bad.values() and bad["N"] == "inconclusive"


def pairs(spark, n=8, seed=0):
    rng = np.random.default_rng(seed)
    bx = rng.normal(size=n) + np.sign(rng.normal(size=n)) * 0.5
    pdf = pd.DataFrame({"protein": "P", "platform": "a", "rsid": [f"rs{i}" for i in range(n)], "beta_exp": bx, "se_exp": 0.1,
                        "beta_out": 0.2 * bx + rng.normal(size=n) * 0.05, "se_out": rng.uniform(0.05, 0.1, n), "strand_resolved": True})
    return pdf, spark.createDataFrame(pdf)


def test_leave_one_out_equals_refitting(spark):
    pdf, df = pairs(spark)
    got = mr.leave_one_out(df).toPandas().set_index("rsid")
    for i in range(len(pdf)):
        r = pdf.drop(i)
        w = r.beta_exp ** 2 / r.se_out ** 2
        t = (r.beta_exp * r.beta_out / r.se_out ** 2).sum() / w.sum()
        assert np.isclose(got.loc[f"rs{i}", "loo_or"], np.exp(t)) and np.isclose(got.loc[f"rs{i}", "loo_ci_low"], np.exp(t - 1.96 / np.sqrt(w.sum())))
    assert mr.leave_one_out(df.limit(1)).count() == 0


def test_egger_equals_weighted_least_squares(spark):
    pdf, df = pairs(spark, 12, 3)
    s = np.sign(pdf.beta_exp)
    x, y, w = np.column_stack([np.ones(12), pdf.beta_exp * s]), (pdf.beta_out * s).to_numpy(), (1 / pdf.se_out ** 2).to_numpy()
    xtwx = (x * w[:, None]).T @ x
    b = np.linalg.solve(xtwx, (x * w[:, None]).T @ y)
    s2 = (w * (y - x @ b) ** 2).sum() / 10
    got = mr.egger(df).first()
    assert np.isclose(got.egger_slope, b[1]) and np.isclose(got.egger_intercept, b[0])
    assert np.isclose(got.egger_slope_se, np.sqrt(s2 * np.linalg.inv(xtwx)[1, 1]))
    with pytest.raises(Exception, match="zero exposure effect"):
        mr.estimates(df.withColumn("beta_exp", F.lit(0.0))).collect()


def test_colocalization_states(spark):
    rng = np.random.default_rng(1)
    n = 60
    z = np.zeros(n)
    z[7] = 9.0
    rows = [("shared", float(z[i] * 0.05 + rng.normal() * 0.01), 0.05, float(z[i] * 0.05 + rng.normal() * 0.01), 0.05) for i in range(n)]
    rows += [("apart", float((9.0 if i == 3 else 0) * 0.05), 0.05, float((9.0 if i == 40 else 0) * 0.05), 0.05) for i in range(n)]
    rows += [("tiny", 0.1, 0.05, 0.1, 0.05), ("tiny", 0.1, 0.0, 0.1, 0.05)]
    rows += [("huge", float((120.0 if i == 1 else 0) * 0.05), 0.05, float((110.0 if i == 1 else 0) * 0.05), 0.05) for i in range(n)]
    got = {r.locus: r for r in coloc.posteriors(spark.createDataFrame(rows, ["locus", "beta_exp", "se_exp", "beta_out", "se_out"]), ["locus"]).collect()}
    assert got["shared"].pp4 > 0.9 and got["apart"].pp3 > 0.9 and got["huge"].pp4 > 0.99
    assert not got["tiny"].pp4_estimable and got["tiny"].pp4 == 0.0 and got["tiny"].pp0 is None
    for k in ("shared", "apart", "huge"):
        assert np.isclose(got[k].pp0 + got[k].pp1 + got[k].pp2 + got[k].pp3 + got[k].pp4, 1.0)
    labels = spark.createDataFrame([("abf_nodata", 0.0), ("multi_signal_noCS", 0.0), ("abf", 0.3)], ["m", "p"])
    assert [r.e for r in labels.select(coloc.estimable(F.col("m"), F.col("p")).alias("e")).collect()] == [False, False, True]


def greedy(order, near):
    kept, out = [], set()
    for v in order:
        if v not in out:
            kept.append(v)
            out |= near[v]
    return set(kept)


@pytest.mark.parametrize("seed", [0, 1])
def test_clumping_rounds_equal_the_sequential_answer(spark, seed):
    rng = np.random.default_rng(seed)
    n = 60
    p = np.round(rng.random(n), 1)
    edges = [(i, j, 0.5) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.06]
    near = {i: {b for a, b, _ in edges if a == i} | {a for a, b, _ in edges if b == i} for i in range(n)}
    assoc = spark.createDataFrame([(0, i, float(p[i]), float(i % 7), i) for i in range(n)], ["locus", "v", "p", "F", "pos"])
    e = spark.createDataFrame(edges, ["a", "b", "r2"])
    got = {r.v for r in ld.clump(assoc, e, "locus", "v", vr.clump_order("p", "F", "pos", "v"), p="p", p1=1.0, r2=0.1).collect()}
    assert got == greedy(sorted(range(n), key=lambda i: (p[i], -(i % 7), -i, i)), near)


@pytest.mark.parametrize("tile", [2, 512])
def test_ld_over_block_borders_with_missing_dosages(spark, monkeypatch, tile):
    monkeypatch.setattr(ld, "TILE", tile)
    rng = np.random.default_rng(4)
    m, s = 9, 50
    x = rng.integers(0, 3, size=(s, m)).astype(float)
    x[:, 4] = x[:, 3]
    x[rng.random((s, m)) < 0.1] = np.nan
    pos = [100, 900, 1800, 1950, 2100, 2900, 3100, 9000, 9500]
    rows = [(f"v{j}", i, None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(s) for j in range(m)]
    d = spark.createDataFrame(rows, "variant string, sample int, dosage double")
    v = spark.createDataFrame([(f"v{j}", "1", pos[j]) for j in range(m)], ["variant", "chrom", "pos"])
    got = {tuple(sorted((r.a, r.b))): (r.n, r.r) for r in ld.ld_pairs(d, v, 1).collect()}
    want = {}
    for i in range(m):
        for j in range(i + 1, m):
            if pos[j] - pos[i] <= 1000:
                ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                want[f"v{i}", f"v{j}"] = (ok.sum(), np.corrcoef(x[ok, i], x[ok, j])[0, 1])
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1])


def test_pseudo_p_orders_underflowed_rows(spark):
    df = spark.createDataFrame([("P", 0.0, 900.0, 1, "a"), ("P", 0.0, 950.0, 2, "b"), ("P", 0.0, 950.0, 3, "c"), ("P", 1e-9, 30.0, 4, "d")], ["protein", "p", "F", "pos", "id"])
    got = {r.id: r.q for r in vr.pseudo_p(df, ["protein"], "p", "F", "pos", "id", "q").collect()}
    assert got["c"] < got["b"] < got["a"] < 1e-290 and got["d"] == 1e-9


def test_header_contract_and_columns(spark, tmp_path):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    body = "23 100 v1 A G 0.2 1 100 ADD NA 0.1 1 9.0 NA\n"
    good.write_text(" ".join(src.REGENIE_COLUMNS) + "\n" + body)
    bad.write_text(" ".join(src.REGENIE_COLUMNS[:-1]) + "\n" + body)
    r = src.regenie_to_instruments(src.read_regenie(spark, str(good))).first()
    assert (r.chrom, r.effectAllele, r.beta, r.se) == ("X", "G", None, 0.1)
    src.check_regenie_header(spark, str(good))
    with pytest.raises(ValueError):
        src.check_regenie_header(spark, str(bad))
    with pytest.raises(Exception, match="unexpected header"):
        src.read_regenie(spark, str(bad)).collect()
    with pytest.raises(ValueError):
        src.conform(spark.range(1), src.INSTRUMENT_SCHEMA)
    with pytest.raises(ValueError):
        src.require_columns(spark.range(1), ["hm_code", "hm_other"], any_of=True)


def test_arms_are_resumed_and_csv_is_quoted(spark, tmp_path):
    arms = spark.createDataFrame([("a", 1.0), ("b", 2.0)], ["arm", "r2"])
    path = str(tmp_path / "arms")
    assert src.pending_arms(spark, arms.select("arm"), path).count() == 2
    src.write_arms(arms.filter("arm = 'a'"), path)
    assert [r.arm for r in src.pending_arms(spark, arms.select("arm"), path).collect()] == ["b"]
    src.write_arms(arms.filter("arm = 'b'"), path)
    assert spark.read.parquet(path).count() == 2
    out = str(tmp_path / "csv")
    src.write_quoted_csv(spark.createDataFrame([('say "hi", x', 1.5), (None, 2.0)], ["s", "v"]).coalesce(1), out)
    lines = next((tmp_path / "csv").glob("part*")).read_text().splitlines()
    assert lines == ['"s","v"', '"say ""hi"", x",1.5', '"",2.0']


def test_every_label_of_a_locus(spark):
    rows = [("few", 1, 4, 20, 4, 1), ("few2", 3, 0, 20, 0, 0), ("bad", 1, 9, 20, 0, 1), ("bad2", 2, 9, 20, 0, 0), ("panel", 2, 9, 3, 9, 0), ("none", 2, 9, 20, 9, 0), ("none2", 2, 9, 20, 9, None), ("one", 1, 9, 0, 9, 0), ("two", 2, 9, 20, 9, 5)]
    loci = spark.createDataFrame(rows, "locus string, s int, h int, p int, u int, c int")
    got = {r.locus: r.method_label for r in coloc.route_method(loci, "s", "h", "p", "u", "c").collect()}
    assert got == {"few": "abf_nodata", "few2": "multi_signal_nodata", "bad": "abf_error", "bad2": "multi_signal_error", "panel": "abf_fallback", "none": "multi_signal_noCS",
                   "none2": "multi_signal_noCS", "one": "abf", "two": "multi_signal"}


def test_an_odds_ratio_needs_an_error(spark):
    beta, se = vr.log_odds("o", "s")
    df = spark.createDataFrame([(2.0, 0.1), (0.0, None)], "o double, s double")
    assert [tuple(r) for r in df.select(beta, se).collect()] == [(np.log(2.0), 0.05), (None, None)]
    for s in (0.0, -0.1, None):
        with pytest.raises(Exception, match="not positive"):
            spark.createDataFrame([(2.0, s)], "o double, s double").select(*vr.log_odds("o", "s")).collect()


def test_readers_assert_the_build_and_freeze_schemas(spark, tmp_path):
    file = tmp_path / "x.h.tsv"
    file.write_text("rsid\thm_code\tbeta\nrs1\t10\t0.5\n")
    schema = "rsid string, hm_code int, beta double"
    assert src.read_sumstats_tsv(spark, str(file), schema, suffix=".h.tsv", vouching=["hm_code", "hm_coordinate_conversion"]).first().beta == 0.5
    with pytest.raises(ValueError, match="does not end"):
        src.read_sumstats_tsv(spark, str(file), schema, suffix=".h.tsv.gz")
    with pytest.raises(ValueError, match="expected columns"):
        src.read_sumstats_tsv(spark, str(file), schema, vouching=["hm_rsid"])
    asked = tmp_path / "q.csv"
    asked.write_text("id,item\n1,2.5\n2,\n")
    frozen = src.frozen_schema(spark, str(asked))
    assert frozen.simpleString() == "struct<id:int,item:double>"
    asked.write_text("id,item\n3,4\n")  # a later file that would be read as whole numbers by itself
    assert spark.read.csv(str(asked), header=True, schema=frozen).first().item == 4.0


def test_union_of_platforms_is_labelled(spark):
    df = spark.createDataFrame([("r1",), ("r2",)], "rsid string")
    got = hz.union_platforms(a=df, b=df.limit(1)).groupBy("platform").count().collect()
    assert {r.platform: r["count"] for r in got} == {"a": 2, "b": 1}


def _bootstrapped(rows, reps):
    """theta of each replicate by sorting its draws."""
    rows = sorted(rows, key=lambda r: (r[3] / r[2], r[1]))
    n, out = len(rows), []
    for rep in range(1, reps + 1):
        at = sorted(int(hashlib.md5(f"{rows[0][0]}:{rep}:{d}:wm".encode()).hexdigest()[:8], 16) % n for d in range(1, n + 1))
        w = np.cumsum([(rows[i][2] / rows[i][4]) ** 2 for i in at])
        out.append(rows[at[int(np.argmax(w / w[-1] >= 0.5))]])
    return np.std([r[3] / r[2] for r in out], ddof=1)


def test_weighted_median_bootstrap_counts_draws_in_one_range_and_in_many(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, float(bx), float(by), float(se)) for g, n in (("a", 130), ("b", 41), ("c", 3), ("d", 2))
            for i, (bx, by, se) in enumerate(zip(rng.random(n) + 0.5, rng.normal(size=n), rng.random(n) + 0.1))]
    pairs = spark.createDataFrame([*rows, ("b2", 1, 1.0, None, 1.0), (None, 1, 1.0, 1.0, 1.0)], "g string, i long, beta_exp double, beta_out double, se_out double")
    want = {g: _bootstrapped([r for r in rows if r[0] == g], 120) for g in "abc"}
    for size in (1 << 20, 32):
        got = {r.g: (r.n_boot, r.wmedian_se) for r in mr.weighted_median_se(pairs, ["g"], "i", 120, size=size).collect()}
        assert set(got) == set(want)
        for g, se in want.items():
            assert got[g][0] == 120 and np.isclose(got[g][1], se, atol=1e-12), (g, size)


def test_hash_words_are_md5():
    for lead in ("p:a:7:", "x" * 60, "é" * 70, ""):
        got = np.concatenate(list(hash_words(lead, 1234, ":wm", 100)))
        assert got.tolist() == [int(hashlib.md5(f"{lead}{d}:wm".encode()).hexdigest()[:8], 16) for d in range(1, 1235)]


def test_coloc_routing_reads_the_associations_once(spark, tmp_path, monkeypatch):
    """Six reads of the largest table before; instruments and outcomes are written once now."""
    from slopewise.plans import QUERIES, derived, genetics

    calls = {"instruments": 0, "outcomes": 0}
    for name in calls:
        def counted(t, name=name, real=getattr(derived, name)):
            calls[name] += 1
            return real(t)
        monkeypatch.setattr(genetics.dv, name, counted)
    spark.range(0, 60).selectExpr("id AS p_partkey", "concat('Brand#', id % 2) AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(0, 1200).selectExpr("id % 60 AS l_partkey", "if(id % 2 = 0, 'F', 'O') AS l_linestatus", "cast(id % 13 AS double) AS l_quantity",
                                    "cast(id % 7 AS double) AS l_extendedprice", "cast(id % 3 AS double) / 100 AS l_discount").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = QUERIES["coloc_routing"](spark, str(tmp_path)).collect()
    assert rows and calls == {"instruments": 1, "outcomes": 1}
