"""Readers, checks and writers. Schemas are stated; nothing is inferred on a hot path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import nan_to_null, numeric_chrom

# Column contracts of the file formats.
SUMSTATS_SCHEMA = ("Chrom string, Pos long, Name string, rsids string, effectAllele string, otherAllele string, "
                   "Beta double, Pval double, minus_log10_pval double, SE double, N double, ImpMAF double")
REGENIE_COLUMNS = ("CHROM", "GENPOS", "ID", "ALLELE0", "ALLELE1", "A1FREQ", "INFO", "N", "TEST", "BETA", "SE", "CHISQ",
                   "LOG10P", "EXTRA")
REGENIE_NUMBERS = ("GENPOS", "BETA", "SE", "A1FREQ", "LOG10P")
INSTRUMENT_SCHEMA = ("protein string, Name string, rsid string, chrom string, pos long, effectAllele string, "
                     "otherAllele string, eaf double, beta double, se double, pval double, F double, palindromic boolean")
HARMONISED_SCHEMA = ("protein string, platform string, rsid string, chrom string, pos long, effectAllele string, "
                     "otherAllele string, eaf_exp double, eaf_out double, beta_exp double, se_exp double, beta_out double, "
                     "se_out double, aligned boolean, palindromic boolean, strand_resolved boolean, outcome_source string")


def read_sumstats_tsv(spark: SparkSession, path: str, schema: str = SUMSTATS_SCHEMA, suffix: str | None = None,
                      vouching: list[str] | None = None) -> DataFrame:
    """Tab-separated summary statistics with a header. 'NA' and '.' are missing.

    The build can be asserted: `suffix` is what the file's name must end with, and one of the `vouching` columns must be in its header.
    A gzip file is one task: ingest it once with `ingest_sumstats` and read the result.
    """
    if suffix:
        require_suffix(path, suffix)
    if vouching:
        require_columns(spark.read.csv(path, sep="\t", header=True), vouching, any_of=True)
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="NA", enforceSchema=False)
    return df.select(*[nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def ingest_sumstats(df: DataFrame, path: str, chrom: str = "Chrom", pos: str = "Pos", partitions: int | None = None) -> None:
    """One-off conversion to Parquet: ranged by (chromosome, position), so window filters skip row groups,
    and split by chromosome, so they skip directories. A heavy chromosome still spans many ranges."""
    ranged = df.withColumn("chrom", numeric_chrom(chrom))
    by = [F.col("chrom"), F.col(pos)]
    ranged = ranged.repartitionByRange(partitions, *by) if partitions else ranged.repartitionByRange(*by)
    ranged.sortWithinPartitions("chrom", pos).write.mode("overwrite").partitionBy("chrom").parquet(path)


def read_regenie(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated association output. A file whose header is not the expected one fails."""
    lines = spark.read.text(path)
    parts = F.split(F.trim("value"), r"\s+")
    header = F.array(*[F.lit(c) for c in REGENIE_COLUMNS])
    rows = lines.select(parts.alias("p"), F.col("value").startswith("CHROM").alias("head"))
    bad = F.concat(F.lit("unexpected header: "), F.concat_ws(" ", "p"))
    rows = rows.filter(F.when(F.col("head") & (F.col("p") != header), F.raise_error(bad).cast("boolean")).otherwise(~F.col("head")))
    cols = [F.get("p", F.lit(i)).alias(c) for i, c in enumerate(REGENIE_COLUMNS)]
    df = rows.filter(F.size("p") > 1).select(*cols)
    return df.withColumns({c: nan_to_null(F.col(c).try_cast("double")) for c in REGENIE_NUMBERS})


def check_regenie_header(spark: SparkSession, path: str) -> None:
    """Raise unless the first line carries exactly the expected columns."""
    first = spark.read.text(path).limit(1).first()
    found = tuple(first.value.split()) if first else ()
    if found != REGENIE_COLUMNS:
        raise ValueError(f"unexpected header: {found}")


def regenie_to_instruments(df: DataFrame) -> DataFrame:
    """Association columns under the shared names; the tested allele is the effect allele."""
    from ..operators.variants import p_from_log10

    x = F.when(F.col("CHROM") == "23", F.lit("X")).otherwise(F.col("CHROM"))
    return df.select(F.col("ID").alias("Name"), x.alias("chrom"), F.col("GENPOS").cast("long").alias("pos"),
                     F.col("ALLELE1").alias("effectAllele"), F.col("ALLELE0").alias("otherAllele"), F.col("A1FREQ").alias("eaf"),
                     F.col("BETA").alias("beta"), F.col("SE").alias("se"), F.col("LOG10P").alias("log10p"),
                     p_from_log10("LOG10P").alias("pval"), F.col("N").alias("n_raw"))


def read_assays(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV with a header, of which only the named columns are read, under pinned types.

    Every column is read as text and converted with NULL for what does not parse.
    """
    df = spark.read.csv(path, header=True, inferSchema=False)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    return df.select(*[F.trim(c).try_cast(t).alias(c) for c, t in columns.items()])


def frozen_schema(spark: SparkSession, path: str, sampling: float = 1.0) -> T.StructType:
    """Infer a questionnaire file's schema once, to be stored and passed to later reads."""
    return spark.read.csv(path, header=True, inferSchema=True, samplingRatio=sampling).schema


def require_columns(df: DataFrame, columns: list[str], any_of: bool = False) -> DataFrame:
    """Raise if columns that vouch for a file's coordinate build are absent."""
    have = [c for c in columns if c in df.columns]
    if (any_of and not have) or (not any_of and len(have) < len(columns)):
        raise ValueError(f"expected columns {columns}, found {df.columns}")
    return df


def require_suffix(path: str, suffix: str) -> str:
    if not path.endswith(suffix):
        raise ValueError(f"{path} does not end with {suffix}")
    return path


def anchor_check(df: DataFrame, ident: str, value: str, chrom: str, pos: str, at: tuple[str, int], tolerance: int = 500_000
                 ) -> DataFrame:
    """Is a known variant where the expected coordinate build puts it? One filtered row."""
    g = df.filter(F.col(ident) == value).agg(F.min(F.struct(F.col(chrom).cast("string").alias("c"), F.col(pos).alias("p"))).alias("r"))
    ok = (F.col("r.c") == at[0]) & (F.abs(F.col("r.p") - at[1]) < tolerance)
    return g.select(F.lit(value).alias("anchor"), F.col("r.c").alias("chrom"), F.col("r.p").alias("pos"),
                    F.col("r").isNotNull().alias("found"), F.coalesce(ok, F.lit(False)).alias("build_ok"))


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Exactly the contract's columns, in order and type; a missing column fails before any work."""
    want = T.StructType.fromDDL(schema)
    missing = [f.name for f in want.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields])


def write_contract(df: DataFrame, path: str, schema: str) -> None:
    conform(df, schema).write.mode("overwrite").parquet(path)


def write_quoted_csv(df: DataFrame, path: str) -> None:
    """CSV with text quoted and numbers bare: quotes are put around text columns, and escaping is done here."""
    def cell(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.StringType):
            quoted = F.concat(F.lit('"'), F.replace(F.col(f.name), F.lit('"'), F.lit('""')), F.lit('"'))
            return F.coalesce(quoted, F.lit('""'))
        return F.coalesce(F.col(f.name).cast("string"), F.lit('""'))

    head = ",".join(f'"{c}"' for c in df.columns)
    lines = df.select(F.concat_ws(",", *[cell(f) for f in df.schema.fields]).alias(head))
    lines.write.mode("overwrite").option("quote", "\u0000").option("escape", "\u0000").option("header", True).option(
        "sep", "\u0001").csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON records, NULL fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def pending_arms(spark: SparkSession, planned: DataFrame, path: str, key: str = "arm") -> DataFrame:
    """Planned arms that have no result yet at `path`."""
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:  # no result table yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return planned
        raise
    return planned.join(done, key, "left_anti")


def write_arms(df: DataFrame, path: str, key: str = "arm") -> None:
    """Write results partitioned by arm; only the arms present in `df` are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path))
