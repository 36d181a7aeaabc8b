"""Query registry.

A query names its output columns with their kind once; the Spark result and the SQL text
are both cast and rounded by that list, so they can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables as lazily read DataFrames: `t.events`, `t.orders`, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _parse(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in cols.split()]


def _spark_col(name: str, kind: str):
    if kind[0] == "d":
        return tidy(F.col(name), int(kind[1:] or 6)).alias(name)
    return F.col(name).cast({"i": "bigint", "s": "string", "b": "int"}[kind]).cast(
        {"i": "bigint", "s": "string", "b": "bigint"}[kind]).alias(name)


def _sql_col(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind[0] == "d":
        return f"round(CAST({q} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0::DOUBLE AS {q}"
    if kind == "b":
        return f"CAST(CAST({q} AS BOOLEAN) AS BIGINT) AS {q}"
    return f"CAST({q} AS {'BIGINT' if kind == 'i' else 'VARCHAR'}) AS {q}"


def query(name: str, cols: str, sql: str | None = None):
    """Register `fn(tables)`; `cols` is 'name:kind ...' with kinds i, s, b, d (6 decimals) or dN."""
    spec = _parse(cols)

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder)).select(*[_spark_col(n, k) for n, k in spec])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = f"SELECT {', '.join(_sql_col(n, k) for n, k in spec)} FROM ({sql}) AS q"
        return fn

    return add


def hw(*parts: object, word: int = 0) -> str:
    """SQL for `hash_word`."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(str(p) for p in parts)})), {1 + 8 * word}, 8))::BIGINT"


def hu(*parts: object, word: int = 0) -> str:
    """SQL for `hash_uniform`."""
    return f"(({hw(*parts, word=word)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def permuted_sql(at: str, n: str, *key: str) -> str:
    """SQL for `permuted`: four Feistel rounds over the halves of the bits, walked along the cycle until below n."""
    bits = f"greatest(2, length(bin({n} - 1)))"
    low = f"({bits} // 2)"
    low_mask, high_mask = f"((1::BIGINT << {low}::INT) - 1)", f"((1::BIGINT << ({bits} - {low})::INT) - 1)"

    def rounds(x: str) -> str:
        return f"""list_reduce([{x}, 1, 2, 3, 4], lambda x, r: CASE WHEN r % 2 = 1 THEN xor(x, ({hw(f"x & {low_mask}", *key, "r", "'feistel'")} & {high_mask}) << {low}::INT)
                   ELSE xor(x, {hw(f"x >> {low}::INT", *key, "r", "'feistel'")} & {low_mask}) END)"""

    return f"list_reduce(list_prepend({rounds(f'({at})::BIGINT')}, range(64)), lambda w, i: CASE WHEN w < {n} THEN w ELSE {rounds('w')} END)"
