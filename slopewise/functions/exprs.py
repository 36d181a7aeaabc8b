"""Scalar column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000.0


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN and NULL are one kind of missing: NULL."""
    c = as_col(c)
    return F.when(F.isnan(c), None).otherwise(c)


def parse_number(c: Column | str) -> Column:
    """Numeric parse that yields NULL for anything that is not a number."""
    return nan_to_null(F.trim(as_col(c)).try_cast("double"))


def guarded_ratio(num: Column | str, den: Column | str, scale: float = 1.0) -> Column:
    """num / den * scale where both are positive, else NULL."""
    num, den = as_col(num), as_col(den)
    return F.when((num > 0) & (den > 0), num / den * F.lit(scale))


def log1p_clipped(c: Column | str) -> Column:
    """log(1 + max(x, 0)). NULL stays NULL (`greatest` alone would turn it into 0)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def blank_codes(c: Column | str, codes: Iterable) -> Column:
    """Sentinel codes to NULL."""
    c = as_col(c)
    return F.when(~c.isin(list(codes)), c)


def keep_codes(c: Column | str, codes: Iterable) -> Column:
    """Only documented codes survive; everything else is NULL."""
    c = as_col(c)
    return F.when(c.isin(list(codes)), c)


def above(c: Column | str, threshold: float) -> Column:
    """1.0 / 0.0 for c > threshold, NULL kept."""
    c = as_col(c)
    return F.when(c.isNotNull(), (c > threshold).cast("double"))


def first_of_list(c: Column | str, sep: str = ",") -> Column:
    """First element of a separated list; the usual missing markers become NULL."""
    c = F.trim(as_col(c))
    return F.when(~c.isin("NA", ".", "nan", ""), F.trim(F.split(c, sep).getItem(0)))


def strip_chrom(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c).cast("string"), "(?i)^chr", "")


def numeric_chrom(c: Column | str) -> Column:
    """Chromosome label with the X chromosome written 23."""
    s = F.upper(strip_chrom(c))
    return F.when(s == "X", F.lit("23")).otherwise(s)


def is_palindrome(a: Column | str, b: Column | str) -> Column:
    """A/T or C/G allele pair, either order, any case."""
    pair = F.concat(F.upper(as_col(a)), F.upper(as_col(b)))
    return pair.isin("AT", "TA", "CG", "GC")


def hash_word(*parts: Column | str | int, word: int = 0) -> Column:
    """One of the four 32-bit words of md5 over the ':'-joined parts, as a long.

    The value depends on the row's own keys alone: the same for any partitioning,
    any engine and any recomputed task.
    """
    cols = [F.lit(str(p)) if isinstance(p, int) else as_col(p).cast("string") for p in parts]
    digest = F.md5(F.concat_ws(":", *cols))
    return F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("long")


def hash_uniform(*parts: Column | str | int, word: int = 0) -> Column:
    """Uniform in (0, 1) from `hash_word`."""
    return (hash_word(*parts, word=word) + F.lit(0.5)) / F.lit(4294967296.0)


def elapsed_days(df: DataFrame, column: str) -> Column:
    """Days since 1970-01-01 of a timestamp column of either kind, free of the session time zone."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), c)
    else:
        micros = F.unix_micros(c)
    return micros / F.lit(MICROS_PER_DAY)


def tidy(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(as_col(c).cast("double"), digits) + F.lit(0.0)
