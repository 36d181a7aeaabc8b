"""Joining exposure and outcome associations and putting them on the same allele."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_palindrome, numeric_chrom
from ..session import cut_lineage

# Allele-frequency band and margin for palindromic variants.
BAND_LO, BAND_HI, MARGIN = 0.42, 0.58, 0.05

HARMONISED = ["protein", "platform", "rsid", "chrom", "pos", "effectAllele", "otherAllele", "eaf_exp", "eaf_out",
              "beta_exp", "se_exp", "beta_out", "se_out", "aligned", "palindromic", "strand_resolved", "outcome_source"]


def union_platforms(**tables: DataFrame) -> DataFrame:
    """Instrument tables of several platforms, labelled."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("platform", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def prune_outcome(outcome: DataFrame, exposure: DataFrame) -> DataFrame:
    """Outcome rows whose rsid or (chromosome, position) some exposure asks for.

    One scan of the large side against two small distinct key sets; a row that matches both
    ways stays one row.
    """
    ids = exposure.select(F.col("rsid").alias("rsid_out")).dropna().distinct().withColumn("__i", F.lit(True))
    places = (exposure.select(numeric_chrom("chrom").alias("__c"), F.col("pos").alias("pos_out")).dropna().distinct()
              .withColumn("__p", F.lit(True)))
    j = (outcome.withColumn("__c", numeric_chrom("chrom_out")).join(ids, "rsid_out", "left")
         .join(places, ["__c", "pos_out"], "left"))
    return j.filter(F.coalesce("__i", F.lit(False)) | F.coalesce("__p", F.lit(False))).select(*outcome.columns)


def join_with_fallback(exposure: DataFrame, outcome: DataFrame, route: list[str] | None = None) -> DataFrame:
    """Match by rsid; exposures whose rsid matched nothing, or that have none, match by position.

    Several outcome rows per exposure are all kept. A NULL rsid never equals a NULL rsid. `route`
    names columns present on both sides (such as the outcome source) that must agree too.
    """
    on = list(route or [])
    side = outcome.withColumnsRenamed({c: f"__{c}" for c in on})

    def agree(left: DataFrame) -> list[Column]:
        return [left[c] == side[f"__{c}"] for c in on]

    extra = [f"__{c}" for c in on]
    by_id = exposure.join(side, [exposure["rsid"] == side["rsid_out"], *agree(exposure)]).drop(*extra)
    known = outcome.select(F.col("rsid_out").alias("rsid"), *on).dropna()
    rest = exposure.join(known, ["rsid", *on], "left_anti").withColumn("__c", numeric_chrom("chrom"))
    placed = side.withColumn("__d", numeric_chrom("chrom_out"))
    at = [F.col("__c") == F.col("__d"), F.col("pos") == F.col("pos_out")] + [F.col(c) == F.col(f"__{c}") for c in on]
    by_pos = rest.join(placed, at).drop("__c", "__d", *extra)
    return (by_id.withColumn("matched_by", F.lit("rsid"))
            .unionByName(by_pos.withColumn("matched_by", F.lit("position"))))


def route_outcomes(exposure: DataFrame, routes: dict[str, str], default: str, key: str = "protein") -> DataFrame:
    """Which outcome study each exposure goes to."""
    source = F.lit(default)
    for k, v in routes.items():
        source = F.when(F.col(key) == k, F.lit(v)).otherwise(source)
    return exposure.withColumn("outcome_source", source)


def absent_instruments(exposure: DataFrame, outcome: DataFrame, keys: list[str], route: list[str] | None = None
                       ) -> DataFrame:
    """How many exposures per key match by neither rsid nor position."""
    on = list(route or [])
    known = outcome.select(F.col("rsid_out").alias("rsid"), *on).dropna()
    places = outcome.select(numeric_chrom("chrom_out").alias("__c"), F.col("pos_out").alias("pos"), *on).dropna()
    rest = (exposure.join(known, ["rsid", *on], "left_anti").withColumn("__c", numeric_chrom("chrom"))
            .join(places, ["__c", "pos", *on], "left_anti"))
    return rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_absent"))


def allele_match() -> Column:
    """'direct', 'swapped' or 'incompatible' from the four allele columns, any case."""
    a, b = F.upper("effectAllele"), F.upper("otherAllele")
    c, d = F.upper("ea_out"), F.upper("oa_out")
    return F.when((a == c) & (b == d), "direct").when((a == d) & (b == c), "swapped").otherwise("incompatible")


def alignment_counts(joined: DataFrame, keys: list[str]) -> DataFrame:
    m = joined.withColumn("__m", allele_match())
    return m.groupBy(*keys).agg(*[F.count_if(F.col("__m") == k).alias(f"n_{k}") for k in ("direct", "swapped", "incompatible")])


def align_alleles(joined: DataFrame, drop_palindromic: bool = False) -> DataFrame:
    """Put the outcome on the exposure's effect allele; rows that cannot be are dropped. Row-wise, no shuffle."""
    rows = joined.filter(~is_palindrome("effectAllele", "otherAllele")) if drop_palindromic else joined
    swap = F.col("__m") == "swapped"
    out = rows.withColumn("__m", allele_match()).filter(F.col("__m") != "incompatible").withColumns({
        "beta_out": F.when(swap, -F.col("beta_out")).otherwise(F.col("beta_out")), "aligned": F.lit(True)})
    if "eaf_out" in joined.columns:
        out = out.withColumn("eaf_out", F.when(swap, 1.0 - F.col("eaf_out")).otherwise(F.col("eaf_out")))
    return out.drop("__m")


def resolve_palindromes(aligned: DataFrame, eaf: str = "eaf", lo: float = BAND_LO, hi: float = BAND_HI,
                        margin: float = MARGIN) -> DataFrame:
    """Strand of palindromic variants by allele frequency.

    In the middle band, or where the frequencies do not decide, `strand_resolved` is
    False and the row stays. A clear mismatch flips the outcome.
    """
    same = F.abs(F.col(eaf) - F.col("eaf_out"))
    flip = F.abs(F.col(eaf) - (1.0 - F.col("eaf_out")))
    pal = F.col("palindromic")
    band = F.coalesce((F.col(eaf) >= lo) & (F.col(eaf) <= hi), F.lit(False))
    concordant = F.coalesce(same + margin < flip, F.lit(False))
    discordant = F.coalesce(flip + margin < same, F.lit(False))
    turn = pal & ~band & discordant
    rows = aligned.withColumns({"__turn": turn, "strand_resolved": ~pal | (~band & (concordant | discordant))})
    return rows.withColumns({
        "beta_out": F.when(F.col("__turn"), -F.col("beta_out")).otherwise(F.col("beta_out")),
        "eaf_out": F.when(F.col("__turn"), 1.0 - F.col("eaf_out")).otherwise(F.col("eaf_out"))}).drop("__turn")


def prepared_sides(exposure: DataFrame, outcome: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides written once: the exposures, and the outcome rows any of them asks for.

    The outcome table is by far the largest input. It is scanned once here, by `prune_outcome`; the joins
    by rsid, by position and for the unmatched then read the pruned rows only.
    """
    small = cut_lineage(exposure)
    return small, cut_lineage(prune_outcome(outcome, small))


def harmonise(exposure: DataFrame, outcome: DataFrame, route: list[str] | None = None) -> DataFrame:
    """Join with fallback, align, resolve strands; the fixed column list of harmonised pairs."""
    exposure, outcome = prepared_sides(exposure, outcome)
    done = resolve_palindromes(align_alleles(join_with_fallback(exposure, outcome, route)))
    done = done.withColumnsRenamed({"eaf": "eaf_exp", "beta": "beta_exp", "se": "se_exp"})
    if "outcome_source" not in done.columns:
        done = done.withColumn("outcome_source", F.lit("outcome"))
    return done.select(*HARMONISED)
