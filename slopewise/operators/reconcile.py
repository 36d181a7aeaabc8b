"""Holding stored results against anchors, siblings and invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# Verdicts from best to worst.
VERDICTS = ("PASS", "ROUNDED", "FAIL")


def flatten_json(df: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """(keys..., path, value text) for every leaf of a JSON text column, whatever its shape and depth.

    Objects and arrays are opened level by level with the variant explode until no nested value is left. Each level is a
    narrow generator over the one before, which is written once, so nothing is shuffled and no text is parsed again.
    """
    level = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(json_col).alias("v"))
    kind = F.schema_of_variant("v")
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    sep = F.when(F.col("path") == "", F.lit("")).otherwise(F.lit("."))
    leaves = []
    while True:
        leaves.append(level.filter(~nested).select(*keys, "path", F.to_json("v").alias("value")))
        if leaves[1:] and level.filter(nested).isEmpty():
            return reduce(DataFrame.unionByName, leaves)
        opened = level.filter(nested).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).select(
            F.col("pos").alias("p"), F.col("key").alias("k"), F.col("value").alias("child")))
        level = cut_lineage(opened.select(*keys, F.concat("path", sep, F.coalesce(F.col("k"), F.col("p").cast("string"))).alias("path"),
                                          F.col("child").alias("v")))


def numeric_leaves(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A result table as (keys..., field, value) rows."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns]))
    return df.select(*keys, each.alias("e")).select(*keys, "e.field", "e.value")


def reconcile(actual: DataFrame, anchors: DataFrame, keys: list[str], tol: float = 1e-6) -> DataFrame:
    """Verdict per value: PASS within `tol`, ROUNDED when equal at the decimals stored, else FAIL.

    `anchors` has (keys..., anchor_value, stored_dp), stored_dp NULL where the value is not
    declared to be a rounded copy. Values without an anchor are UNANCHORABLE.
    """
    j = actual.join(anchors, keys, "left")
    delta = F.col("value") - F.col("anchor_value")
    scale = F.pow(F.lit(10.0), F.col("stored_dp"))
    same = F.rint(F.col("anchor_value") * scale) == F.rint(F.col("value") * scale)
    verdict = (F.when(F.col("anchor_value").isNull(), "UNANCHORABLE").when(F.abs(delta) <= tol, "PASS")
               .when(F.col("stored_dp").isNotNull() & same, "ROUNDED").otherwise("FAIL"))
    return j.select(*keys, "value", "anchor_value", delta.alias("delta"), verdict.alias("verdict"))


def worst_verdict(verdicts: DataFrame, artifact: str, anchors: list[str]) -> DataFrame:
    """One verdict per artifact: ANCHOR if it defines one, else the worst of its checked values."""
    order = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict"))
    g = verdicts.groupBy(artifact).agg(F.max(order).alias("w"), F.count(F.lit(1)).alias("n_values"),
                                       F.count_if(F.col("verdict") != "UNANCHORABLE").alias("n_checked"))
    worst = F.when(F.col("w") > 0, F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.greatest("w", F.lit(1)).cast("int")))
    return g.select(artifact, "n_values", "n_checked",
                    F.when(F.col(artifact).isin(anchors) if anchors else F.lit(False), "ANCHOR")
                    .otherwise(F.coalesce(worst, F.lit("UNANCHORABLE"))).alias("verdict"))


def invariants(row: DataFrame, checks: list[tuple[str, Column, Column, float]]) -> DataFrame:
    """Named equalities over a one-row table of results: (check, lhs, rhs, tolerance)."""
    each = F.array(*[F.struct(F.lit(n).alias("check"), a.cast("double").alias("lhs"), b.cast("double").alias("rhs"),
                              F.coalesce(F.abs(a.cast("double") - b.cast("double")) <= t, F.lit(False)).alias("ok"))
                     for n, a, b, t in checks])
    return row.select(F.inline(each))


def coincidences(values: DataFrame, name: str, value: str, tol: float = 1e-9) -> DataFrame:
    """For each named value: how many *other* names hold it within `tol`, and one of them.

    Equal values are grouped first (count, smallest and largest name), so a value
    shared by very many names costs one row and no pair of names is ever formed.
    Groups sit in cells of width `tol`; a value looks into its own cell and both neighbours.
    """
    named = values.select(F.col(name).alias("field"), F.col(value).alias("value")).filter(F.col("value").isNotNull())
    groups = named.groupBy("value").agg(F.count_distinct("field").alias("n"), F.min("field").alias("lo"),
                                        F.max("field").alias("hi"))
    near = (groups.select(F.col("value").alias("at"), F.explode(F.array(
        *[F.floor(F.col("value") / tol) + i for i in (-1, 0, 1)])).alias("cell")))
    other = groups.select("value", "n", "lo", "hi", F.floor(F.col("value") / tol).alias("cell"))
    around = (near.join(other, "cell").filter(F.abs(F.col("at") - F.col("value")) <= tol)
              .groupBy("at").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    j = named.distinct().join(around.withColumnRenamed("at", "value"), "value")
    return j.filter(F.col("n") > 1).select(
        "field", "value", (F.col("n") - 1).alias("n_other"),
        F.when(F.col("lo") != F.col("field"), F.col("lo")).otherwise(F.col("hi")).alias("example"))
