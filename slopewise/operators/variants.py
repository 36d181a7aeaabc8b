"""Summary-statistic tables: windows, quality filters, look-ups, clump order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import first_of_list, is_palindrome, nan_to_null
from .ranks import exact_quantiles, join_on_keys, number_rows

# Significance and strength thresholds.
P_GENOME_WIDE = 5e-8
P_RELAXED = 5e-6
LOG10P_GENOME_WIDE = 7.30103
MIN_F = 10.0
RARE_EAF = 0.01
N_EXPOSURE_DEFAULT = 54_000
N_LOCUS_DEFAULT = 35_000


def make_windows(genes: DataFrame, symbol: str, order: list[str], pad: int = 500_000,
                 extra: DataFrame | None = None) -> DataFrame:
    """Gene span +- pad, start not below 0; the first row per symbol by `order` counts.

    `genes` has (symbol, chrom, gene_start, gene_end, strand); `extra` appends genes it lacks.
    """
    cols = ["chrom", "gene_start", "gene_end", "strand"]
    first = genes.groupBy(symbol).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("g")).select(
        symbol, *[F.col(f"g.{c}").alias(c) for c in cols])
    if extra is not None:
        first = first.unionByName(extra.select(symbol, *cols))
    return first.withColumns({"cis_start": F.greatest(F.lit(0), F.col("gene_start") - pad),
                              "cis_end": F.col("gene_end") + pad})


def missing_symbols(windows: DataFrame, wanted: DataFrame, symbol: str) -> DataFrame:
    """Wanted symbols without a window; empty when all is well."""
    return wanted.join(windows, symbol, "left_anti")


def within_windows(variants: DataFrame, windows: DataFrame, chrom: str = "chrom", pos: str = "pos",
                   bin_width: int = 1_000_000) -> DataFrame:
    """Variants inside each window (both ends included).

    Windows are spread over position bins and joined on (chromosome, bin), an
    equality join that Spark broadcasts when the windows' own size allows and
    otherwise shuffles, with adaptive splitting of heavy bins. A variant has one bin,
    so each (variant, window) match appears once.
    """
    w = windows.withColumnRenamed(chrom, "__c").withColumn(
        "__bin", F.explode(F.sequence(F.floor(F.col("cis_start") / bin_width), F.floor(F.col("cis_end") / bin_width))))
    v = variants.withColumn("__bin", F.floor(F.col(pos) / bin_width))
    j = v.join(w, (F.col(chrom) == F.col("__c")) & (v["__bin"] == w["__bin"])
               & (F.col(pos) >= F.col("cis_start")) & (F.col(pos) <= F.col("cis_end")))
    return j.drop("__c", "__bin")


def significant(df: DataFrame, p: str, keys: list[str], strict: float = P_GENOME_WIDE, relaxed: float = P_RELAXED
                ) -> DataFrame:
    """Rows under the strict threshold, or under the relaxed one where a key has no strict row."""
    any_strict = df.groupBy(*keys).agg(F.bool_or(F.col(p) < strict).alias("__any"))
    j = df.filter(F.col(p) < relaxed).join(any_strict, keys)
    cut = F.when(F.col("__any"), F.lit(strict)).otherwise(F.lit(relaxed))
    return j.filter(F.col(p) < cut).withColumn("p_threshold", cut).drop("__any")


def f_stat(beta: str = "beta", se: str = "se") -> Column:
    return (F.col(beta) / F.col(se)) * (F.col(beta) / F.col(se))


def strong_instruments(df: DataFrame, beta: str = "beta", se: str = "se", other_allele: str | None = "otherAllele",
                       min_f: float = MIN_F) -> DataFrame:
    """Drop multiallelic markers ('!') and se <= 0, add F, keep F above the floor. Filters only: no shuffle."""
    rows = df.filter(F.col(other_allele) != "!") if other_allele else df
    return rows.filter(F.col(se) > 0).withColumn("F", f_stat(beta, se)).filter(F.col("F") > min_f)


def p_from_log10(log10p: str) -> Column:
    """10^-x. Very strong signals underflow to 0 and stay 0."""
    return F.pow(F.lit(10.0), -F.col(log10p))


def clump_order(p: str, strength: str, pos: str, ident: str) -> Column:
    """Strict total order of variants: smaller p, then stronger, then higher position, then id."""
    return F.struct(F.col(p).alias("p"), (-F.col(strength)).alias("s"), (-F.col(pos)).alias("q"), F.col(ident).alias("i"))


def pseudo_p(df: DataFrame, keys: list[str], p: str, strength: str, pos: str, ident: str, name: str = "pval_for_clump"
             ) -> DataFrame:
    """p as is, and rank * 1e-300 for the underflowed zeros, strongest first."""
    zero = df.filter(F.col(p) == 0).withColumns({"__neg": -F.col(strength), "__pos": -F.col(pos)})
    ranked = number_rows(zero, keys, "__neg", ["__pos", ident], "__r")
    done = ranked.withColumn(name, F.col("__r") * F.lit(1e-300)).drop("__r", "__neg", "__pos")
    return df.filter((F.col(p) != 0) | F.col(p).isNull()).withColumn(name, F.col(p)).unionByName(done)


def add_flags(df: DataFrame, effect: str = "effectAllele", other: str = "otherAllele", eaf: str = "eaf",
              rsids: str | None = "rsids") -> DataFrame:
    """Palindrome flag, rare-variant flag and the first rsid of a comma list."""
    out = df.withColumns({"palindromic": is_palindrome(effect, other), "rare": F.coalesce(F.col(eaf) < RARE_EAF, F.lit(False))})
    return out.withColumn("rsid", first_of_list(rsids)) if rsids else out


def log_odds(odds_ratio: Column | str, or_se: Column | str) -> tuple[Column, Column]:
    """ln(OR) with OR = 0 as NULL, and its standard error by the delta method; an odds ratio whose error is not positive stops the job."""
    o = F.col(odds_ratio) if isinstance(odds_ratio, str) else odds_ratio
    s = F.col(or_se) if isinstance(or_se, str) else or_se
    safe = F.when(o > 0, o)
    bad = F.raise_error(F.lit("standard error of an odds ratio is missing or not positive")).cast("double")
    return F.ln(safe), F.when(safe.isNotNull(), F.when(s / safe > 0, s / safe).otherwise(bad))


def repair_n(df: DataFrame, raw: str, name: str = "n", default: int = N_EXPOSURE_DEFAULT) -> DataFrame:
    """Sample sizes as numbers: unparsable ones become the default; so do all of them if every one is 0."""
    n = F.coalesce(nan_to_null(F.col(raw).cast("string").try_cast("double")), F.lit(float(default))).cast("long")
    rows = df.withColumn(name, n)
    top = rows.agg(F.max(F.abs(F.col(name))).alias("__top"))
    return join_on_keys(rows, top, []).withColumn(
        name, F.when(F.col("__top") == 0, F.lit(default)).otherwise(F.col(name))).drop("__top")


def locus_n(df: DataFrame, keys: list[str], n: str, default: int = N_LOCUS_DEFAULT) -> DataFrame:
    """Median positive sample size per locus (truncated), the default where there is none."""
    med = exact_quantiles(df.filter(F.col(n) > 0), keys, n, {"__m": 0.5}).drop("n")
    loci = df.select(*keys).distinct()
    return loci.join(med, keys, "left").select(*keys, F.coalesce(F.floor("__m"), F.lit(default)).cast("long").alias("n_locus"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per key, the first by `order`. A minimum over structs: combined map-side, no sort per key."""
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return g.select(*keys, *[F.col(f"r.{c}").alias(c) for c in columns])


def lookup_eaf(df: DataFrame, annotation: DataFrame, key: str, order: list[str], freq: str = "eaf") -> DataFrame:
    """Allele frequency from an annotation table (first row per key); rows it lacks are dropped."""
    dim = first_per_key(annotation, [key], order, [freq]).filter(F.col(freq).isNotNull())
    return df.join(dim, key)


def lookup_rsid(df: DataFrame, id_map: DataFrame, key: str, order: list[str], rsid: str = "rsid") -> DataFrame:
    """rsid from an id map (first non-null per key); rows it lacks stay, with NULL."""
    return df.join(first_per_key(id_map.filter(F.col(rsid).isNotNull()), [key], order, [rsid]), key, "left")


def drop_blocklisted(df: DataFrame, blocklist: DataFrame, key: str) -> DataFrame:
    return df.join(blocklist.select(key), key, "left_anti")


def strongest(df: DataFrame, keys: list[str], by: Column, columns: list[str]) -> DataFrame:
    """Top-1 row per key by a (total) order; used as the clump fallback and for lead variants."""
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), by).alias("r"))
    return g.select(*keys, *[F.col(f"r.{c}").alias(c) for c in columns])


def instrument_gate(df: DataFrame, wanted: DataFrame, key: str, strength: str = "F", min_f: float = MIN_F) -> DataFrame:
    """Per wanted key: instruments found, whether any is strong, and whether the key drops out."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col(strength) > min_f).alias("strong"))
    return wanted.join(g, key, "left").select(
        key, F.coalesce("n", F.lit(0)).alias("n_instruments"), F.coalesce("strong", F.lit(False)).alias("strong"),
        F.col("n").isNull().alias("dropped"))


def choose_studies(catalogue: DataFrame, patterns: dict[str, str], exclude: str, min_cases: int = 500,
                   population: str = "euro", min_total: int = 2000) -> DataFrame:
    """Largest study per disease pattern.

    First choice: matching trait, not excluded, enough cases, the wanted population. Where a
    disease has none, any matching study above `min_total` samples. The patterns are a literal
    list, tested row-wise in one scan of the catalogue.
    """
    hits = F.filter(F.array(*[F.struct(F.lit(d).alias("disease"), F.col("trait").rlike("(?i)" + p).alias("hit"))
                              for d, p in patterns.items()]), lambda x: x["hit"])
    rows = (catalogue.filter(~F.col("trait").rlike("(?i)" + exclude)).withColumn("__h", F.explode(hits))
            .withColumn("disease", F.col("__h.disease")).drop("__h"))
    first = (F.coalesce("ncase", F.lit(0)) >= min_cases) & F.lower("population").startswith(population)
    second = F.coalesce("sample_size", F.lit(0)) > min_total
    size = F.coalesce(F.nullif("ncase", F.lit(0)), "sample_size", F.lit(0))
    rank = F.struct(F.when(first, 1).otherwise(0).alias("tier"), size.alias("size"), F.col("id"))
    g = rows.filter(first | second).groupBy("disease").agg(F.max_by(F.struct("id", size.alias("size"), first.alias("first_choice")), rank).alias("r"))
    return g.select("disease", F.col("r.id").alias("id"), F.col("r.size").alias("size"), F.col("r.first_choice").alias("first_choice"))
