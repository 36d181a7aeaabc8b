"""Sources, sinks and the reconciliation of stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, reconcile as rc
from ..session import scratch_path
from ..sources import tables as src
from . import derived as dv
from .registry import query


@query("flatten_json", "event_id:i path:s value:s", """SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events""")
def _(t):
    return rc.flatten_json(t.events, ["event_id"], "props")


RESULTS = f"""WITH {dv.SCORED}, m AS (SELECT priority, count(*) AS n, 1 - sum((y - pred_base)^2) / regr_syy(y, y) AS r2, avg(abs(y - pred_base)) AS mae, sqrt(avg((y - pred_base)^2)) AS rmse FROM scored GROUP BY priority),
  actual AS (SELECT priority AS artifact, 'r2' AS field, r2 AS value FROM m UNION ALL SELECT priority, 'mae', round(mae, 3) FROM m UNION ALL SELECT priority, 'rmse', rmse FROM m),
  anchors AS (SELECT priority AS artifact, 'r2' AS field, r2 AS anchor_value, CAST(NULL AS INT) AS stored_dp FROM m WHERE priority <> '5-LOW' UNION ALL
    SELECT priority, 'mae', mae, CASE WHEN priority < '3' THEN 3 END FROM m WHERE priority <> '5-LOW'),
  v AS (SELECT artifact, field, value, anchor_value, value - anchor_value AS delta, CASE WHEN anchor_value IS NULL THEN 'UNANCHORABLE' WHEN abs(value - anchor_value) <= 1e-6 THEN 'PASS'
          WHEN stored_dp IS NOT NULL AND round_even(anchor_value * pow(10, stored_dp), 0) = round_even(value * pow(10, stored_dp), 0) THEN 'ROUNDED' ELSE 'FAIL' END AS verdict
        FROM actual LEFT JOIN anchors USING (artifact, field))"""


def _reconciled(t):
    m = metrics.regression_metrics(dv.scored(t), ["priority"], pred="pred_base").withColumnRenamed("priority", "artifact")
    actual = rc.numeric_leaves(m.withColumn("mae", F.round("mae", 3)), ["artifact"], ["r2", "mae", "rmse"])
    anchors = rc.numeric_leaves(m.filter(F.col("artifact") != "5-LOW"), ["artifact"], ["r2", "mae"]).select(
        "artifact", "field", F.col("value").alias("anchor_value"),
        F.when((F.col("field") == "mae") & (F.col("artifact") < "3"), 3).alias("stored_dp"))
    return rc.reconcile(actual, anchors, ["artifact", "field"])


@query("reconcile_values", "artifact:s field:s value:d delta:d8 verdict:s", f"{RESULTS} SELECT * FROM v")
def _(t):
    return _reconciled(t)


@query("reconcile_artifacts", "artifact:s n_values:i n_checked:i verdict:s",
       f"""{RESULTS} SELECT artifact, count(*) AS n_values, count(*) FILTER (WHERE verdict <> 'UNANCHORABLE') AS n_checked,
           CASE WHEN artifact = '1-URGENT' THEN 'ANCHOR' WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'ROUNDED') THEN 'ROUNDED' WHEN bool_or(verdict = 'PASS') THEN 'PASS' ELSE 'UNANCHORABLE' END AS verdict
           FROM v GROUP BY artifact""")
def _(t):
    return rc.worst_verdict(_reconciled(t), "artifact", ["1-URGENT"])


@query("result_invariants", "check:s lhs:d4 rhs:d4 ok:b",
       f"""WITH {dv.SCORED}, a AS (SELECT count(*) AS n, sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN status = 'O' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS p,
             1 - sum((y - pred_base)^2) / regr_syy(y, y) AS rb, 1 - sum((y - pred_aug)^2) / regr_syy(y, y) AS ra FROM scored)
           SELECT 'strata partition the rows' AS "check", f + o + p AS lhs, n AS rhs, true AS ok FROM a UNION ALL SELECT 'delta = aug - base', ra - rb, ra - rb, true FROM a UNION ALL SELECT 'base = aug', rb, ra, false FROM a""")
def _(t):
    s = dv.scored(t)
    counts = s.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status") == x).alias(x) for x in "FOP"])
    inc = metrics.paired_increment(s, "pred_base", "pred_aug", []).select("r2_base", "r2_aug", "dr2")
    packed = inc.select(F.struct("r2_base", "r2_aug", "dr2").alias("i")).scalar()
    row = counts.withColumn("i", packed)
    return rc.invariants(row, [
        ("strata partition the rows", F.col("F") + F.col("O") + F.col("P"), F.col("n"), 0.0),
        ("delta = aug - base", F.col("i.dr2"), F.col("i.r2_aug") - F.col("i.r2_base"), 1e-9),
        ("base = aug", F.col("i.r2_base"), F.col("i.r2_aug"), 1e-9)])


@query("estimator_coincidence", "field:s value:d n_other:i",
       """WITH x AS (SELECT 'o' || o_orderkey AS field, o_totalprice AS value FROM orders UNION ALL SELECT 'c' || c_custkey, c_acctbal FROM customer),
          g AS (SELECT value, count(DISTINCT field) AS n FROM x GROUP BY value) SELECT field, value, n - 1 AS n_other FROM x JOIN g USING (value) WHERE n > 1""")
def _(t):
    o = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("field"), F.col("o_totalprice").alias("value"))
    c = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("field"), F.col("c_acctbal").alias("value"))
    return rc.coincidences(o.unionByName(c), "field", "value", 1e-6)


# ---- readers and writers, on tables written to the shared scratch folder ---------------------------


@query("sumstats_round_trip", "Name:s Pos:i Beta:d SE:d",
       f"""WITH {dv.EXPOSURES} SELECT "Name", pos AS "Pos", beta AS "Beta", se AS "SE" FROM exposures""")
def _(t):
    """Write summary statistics as text, read them under the fixed schema, ingest by chromosome and position, read back."""
    e = dv.exposures(t)
    text = e.select(F.concat(F.lit("chr"), "chrom").alias("Chrom"), F.col("pos").alias("Pos"), "Name", "rsids", "effectAllele", "otherAllele", F.col("beta").alias("Beta"),
                    F.col("pval").alias("Pval"), (-F.log10("pval")).alias("minus_log10_pval"), F.col("se").alias("SE"), F.col("n").alias("N"), F.col("eaf").alias("ImpMAF"))
    raw, table = scratch_path(t.spark, "sumstats-text"), scratch_path(t.spark, "sumstats")
    text.write.csv(raw, sep="\t", header=True, nullValue="NA")
    src.ingest_sumstats(src.read_sumstats_tsv(t.spark, raw), table, partitions=16)
    return t.spark.read.parquet(table)


@query("regenie_round_trip", "Name:s chrom:s pos:i effectAllele:s otherAllele:s beta:d8 se:d8 n_raw:s",
       f"""WITH {dv.EXPOSURES} SELECT "Name", chrom, pos, "effectAllele", "otherAllele", CASE WHEN l_partkey % 5 <> 0 THEN beta END AS beta, se, CAST(n AS VARCHAR) AS n_raw FROM exposures""")
def _(t):
    """Write space-separated association output, read it back with its header checked and numbers coerced."""
    e = dv.exposures(t)
    chrom = F.when(F.col("chrom") == "X", "23").otherwise(F.col("chrom"))
    beta = F.when(F.col("l_partkey") % 5 == 0, "NA").otherwise(F.col("beta").cast("string"))
    line = F.concat_ws(" ", chrom, "pos", "Name", "otherAllele", "effectAllele", "eaf", F.lit("1"), "n", F.lit("ADD"), beta, "se", F.lit("1"), F.lit("8.5"), F.lit("NA"))
    path = scratch_path(t.spark, "regenie")
    e.select(line.alias(" ".join(src.REGENIE_COLUMNS))).write.option("header", True).option("quote", "\u0000").option("sep", "\u0001").csv(path)
    return src.regenie_to_instruments(src.read_regenie(t.spark, path))


@query("contract_round_trip", "protein:s platform:s pos:i beta_exp:d strand_resolved:b", f"WITH {dv.HARMONISED} SELECT * FROM harmonised")
def _(t):
    path = scratch_path(t.spark, "harmonised")
    src.write_contract(dv.harmonised(t), path, src.HARMONISED_SCHEMA)
    return src.conform(t.spark.read.parquet(path), src.HARMONISED_SCHEMA)


@query("quoted_csv_round_trip", "n_name:s n_nationkey:i", "SELECT n_name, n_nationkey FROM nation")
def _(t):
    path = scratch_path(t.spark, "nation")
    src.write_quoted_csv(t.nation.select("n_name", "n_nationkey"), path)
    return src.read_assays(t.spark, path, {"n_name": "string", "n_nationkey": "int"})


@query("json_record_round_trip", "protein:s platform:s n_instruments:i method:s",
       f"WITH {dv.HARMONISED} SELECT protein, platform, count(*) AS n_instruments, CASE WHEN count(*) = 1 THEN 'wald' ELSE 'ivw' END AS method FROM harmonised GROUP BY protein, platform")
def _(t):
    from ..operators import mr

    path = scratch_path(t.spark, "estimates")
    est = mr.estimates(dv.harmonised(t))
    src.write_records(est, path)
    return t.spark.read.schema(est.schema).json(path)


@query("pending_arms", "arm:s", "SELECT DISTINCT o_orderpriority AS arm FROM orders WHERE o_orderpriority >= '3'")
def _(t):
    path = scratch_path(t.spark, "arms")
    m = metrics.regression_metrics(dv.scored(t), ["priority"], pred="pred_base").withColumnRenamed("priority", "arm")
    src.write_arms(m.filter(F.col("arm") < "3"), path)
    return src.pending_arms(t.spark, m.select("arm"), path)


@query("anchor_check", "anchor:s chrom:s pos:i found:b build_ok:b",
       f"""WITH {dv.OUTCOMES} SELECT 'rs100' AS anchor, min(chrom_out) AS chrom, min(pos_out) AS pos, count(*) > 0 AS found, count(*) > 0 AS build_ok FROM outcomes WHERE rsid_out = 'rs100'""")
def _(t):
    return src.anchor_check(dv.outcomes(t), "rsid_out", "rs100", "chrom_out", "pos_out", (str(100 % 22 + 1), 101_000))
