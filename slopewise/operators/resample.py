"""Bootstrap intervals: replicates of exactly as many draws as rows, and hashed Poisson weights for streams of unknown length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform
from ..session import cut_lineage
from .ranks import number_rows

# Cumulative Poisson(1) probabilities P(X <= k), k = 0..9.
POISSON_CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
               0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253,
               0.999998874797402, 0.9999998885745217)


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw by inversion of a uniform."""
    out = F.when(u <= POISSON_CDF[0], 0)
    for k, p in enumerate(POISSON_CDF[1:], 1):
        out = out.when(u <= p, k)
    return out.otherwise(len(POISSON_CDF))


def with_replicates(df: DataFrame, subject: str, reps: int) -> DataFrame:
    """Rows with their bootstrap weight for each replicate they take part in.

    Each digest yields the uniforms of four replicates. The rows fan out inside
    the task only; the aggregates that follow combine them before any shuffle.
    """
    blocks = F.array(*[F.lit(i) for i in range((reps + 3) // 4)])
    # The uniforms are columns of their own, so each is computed once and not per comparison.
    b = df.withColumn("__blk", F.explode(blocks)).withColumns(
        {f"__u{w}": hash_uniform(subject, F.col("__blk"), F.lit("boot"), word=w) for w in range(4)})
    four = F.array(*[F.struct((F.col("__blk") * 4 + w).alias("rep"), poisson_weight(F.col(f"__u{w}")).alias("w"))
                     for w in range(4)])
    return b.select(*df.columns, F.inline(four)).filter((F.col("w") > 0) & (F.col("rep") < reps))


BUCKET = 1 << 16  # rows that share a place in the tree of draws
_MASK = 0xFFFFFFFF


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 32-bit numbers held in 64 bits."""
    x = x ^ (x >> 16)
    x = (x * 0x85EBCA6B) & _MASK
    x ^= x >> 13
    x = (x * 0xC2B2AE35) & _MASK
    return x ^ (x >> 16)


def draws_of_bucket(rep: int, bucket: int, rows: int, size: int = BUCKET) -> int:
    """How many of a replicate's `rows` draws fall into a bucket of `size` neighbouring rows (the last may be shorter).

    Counts are split down a binary tree of buckets by binomials, each seeded by its replicate and node. Every task follows
    the path to its own bucket and finds the numbers that all others find, so the buckets' draws add up to `rows` exactly.
    """
    lo, hi, count = 0, -(-rows // size), rows
    while hi - lo > 1 and count:
        middle = (lo + hi) // 2
        left, both = (middle - lo) * size, min(hi * size, rows) - lo * size
        node = np.random.Generator(np.random.Philox(key=[(rep << 32) | 0xB007, (lo << 32) | hi]))
        first = int(node.binomial(count, left / both))
        lo, hi, count = (lo, middle, first) if bucket < middle else (middle, hi, count - first)
    return count


def drawn_rows(rep: int, bucket: int, rows: int, size: int = BUCKET) -> np.ndarray:
    """Places inside the bucket of a replicate's draws, with repeats."""
    here = min(size, rows - bucket * size)
    key = int(scrambled(np.array([(bucket + int(scrambled(np.array([rep], np.uint64))[0])) & _MASK], np.uint64))[0])
    h = scrambled((np.arange(draws_of_bucket(rep, bucket, rows, size), dtype=np.uint64) + np.uint64(key)) & np.uint64(_MASK))
    return ((h * np.uint64(here)) >> np.uint64(32)).astype(np.int64)


def bootstrap_sums(df: DataFrame, subject: str, columns: list[str], reps: int, size: int = BUCKET) -> DataFrame:
    """`rep`, `n` (draws: as many as rows, exactly) and the sum of each column over the rows drawn with replacement.

    Rows are numbered by key. A bucket of neighbouring rows draws its share for all replicates at once and returns sums, so
    what is shuffled is the rows once and then one row for each (bucket, replicate).
    """
    numbered = cut_lineage(number_rows(df.select(subject, *[F.col(c).cast("double").alias(c) for c in columns]), [], subject, [], "__pos"))
    rows = numbered.count()
    placed = numbered.select(F.floor((F.col("__pos") - 1) / size).alias("__b"), ((F.col("__pos") - 1) % size).alias("__at"), *columns)
    schema = "rep int, n long, " + ", ".join(f"`{c}` double" for c in columns)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, values in _buckets(it, columns):
            out = np.empty((reps, len(columns)))
            counts = np.zeros(reps, np.int64)
            for rep in range(reps):
                times = np.bincount(drawn_rows(rep, bucket, rows, size), minlength=len(values))
                counts[rep], out[rep] = times.sum(), times @ values
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps, dtype=np.int32)), pa.array(counts), *(pa.array(c) for c in out.T)], ["rep", "n", *columns])

    each = placed.repartition("__b").sortWithinPartitions("__b", "__at").mapInArrow(sums, schema)
    return each.groupBy("rep").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns])


def _buckets(it: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket's rows in order, as a matrix."""
    now, held = None, []
    for batch in it:
        of = batch.column("__b").to_numpy()
        values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if now is not None and of[lo] != now:
                yield now, np.concatenate(held)
                held = []
            now = int(of[lo])
            held.append(values[lo:hi])
    if held:
        yield now, np.concatenate(held)


def bootstrap_increment(oof: DataFrame, subject: str, base: str, aug: str, reps: int) -> DataFrame:
    """R2 of both predictions and their difference in each bootstrap replicate of the scored rows, each of exactly as many draws."""
    y = F.col("y")
    terms = {"sy": y, "syy": y * y, "sse_b": (y - F.col(base)) * (y - F.col(base)), "sse_a": (y - F.col(aug)) * (y - F.col(aug))}
    rows = oof.filter(y.isNotNull() & F.col(base).isNotNull() & F.col(aug).isNotNull()).select(subject, *[c.alias(n) for n, c in terms.items()])
    g = bootstrap_sums(rows, subject, list(terms), reps)
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return g.select("rep", F.col("n"), (1 - F.col("sse_b") / sst).alias("r2_base"),
                    (1 - F.col("sse_a") / sst).alias("r2_aug"),
                    ((F.col("sse_b") - F.col("sse_a")) / sst).alias("dr2"))


def percentile_ci(reps: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """Median and percentile interval over replicates. Rows = replicates, a fixed small number."""
    a = (1 - level) / 2
    return reps.agg(F.count(value).alias("n_reps"), F.avg(value).alias("mean"),
                    F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(a)).alias("ci_lo"),
                    F.percentile(value, F.lit(1 - a)).alias("ci_hi"))
