"""Fold assignment. A fold is a function of a subject's own key, never of row order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import hash_uniform, hash_word
from ..session import cut_lineage
from .ranks import number_rows


def fold_of(subject: Column | str, seed: Column | int, k: int, salt: str = "") -> Column:
    parts = [subject, seed] + ([F.lit(salt)] if salt else [])
    return F.pmod(hash_word(*parts), F.lit(k)).cast("int")


def per_seed(df: DataFrame, seeds: list[int]) -> DataFrame:
    """Each row once per seed (a generator over a literal array, no join)."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def assign_folds(df: DataFrame, subject: str, k: int, seeds: list[int]) -> DataFrame:
    """Shuffled K folds on subjects: one row per (row, seed) with its fold."""
    return per_seed(df, seeds).withColumn("fold", fold_of(subject, F.col("seed"), k))


def expand_folds(folded: DataFrame, k: int) -> DataFrame:
    """Every row in every fold's data set of its seed, with `is_test` for its own fold.

    For inspection and leak checks. The fitting operators do not expand: they
    subtract the held-out fold from totals.
    """
    return (folded.withColumnRenamed("fold", "own_fold")
            .withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(k)])))
            .withColumn("is_test", F.col("fold") == F.col("own_fold")))


def stratified_folds(df: DataFrame, subject: str, stratum: str, k: int, seed: int) -> DataFrame:
    """Folds dealt out in hashed order inside each stratum, so classes stay balanced."""
    shuffled = df.withColumn("__u", hash_uniform(subject, seed))
    numbered = number_rows(shuffled, [stratum], "__u", [subject], "__r")
    return numbered.withColumn("fold", F.pmod(F.col("__r") - 1, F.lit(k)).cast("int")).drop("__u", "__r")


def cluster_folds(df: DataFrame, subject: str, cluster: str, min_n: int, pooled: int = -1) -> DataFrame:
    """Leave-one-cluster-out folds; clusters below `min_n` subjects form one pooled fold."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n"))
    return (df.join(sizes, cluster)
            .withColumn("fold", F.when(F.col("__n") >= min_n, F.col(cluster)).otherwise(F.lit(pooled)))
            .drop("__n"))


def shuffled_labels(df: DataFrame, subject: str, columns: list[str], reps: list[int]) -> DataFrame:
    """Move `columns` as one block to hash-shuffled subjects, once per repetition.

    Subjects are numbered once by key, and once per repetition in hashed order;
    equal numbers exchange values. Both numberings are distributed.
    """
    donors = number_rows(df.select(subject, *columns), [], subject, [], "pos").select("pos", *columns)
    order = (df.select(subject).withColumn("rep", F.explode(F.array(*[F.lit(int(r)) for r in reps])))
             .withColumn("__u", hash_uniform(subject, F.col("rep"), F.lit("perm"))))
    ranked = number_rows(order, ["rep"], "__u", [subject], "pos").select("rep", subject, "pos")
    return ranked.join(donors, "pos").drop("pos")


WALK = 64  # steps along a cycle; each leaves the range with a chance under one half


def permuted(at: Column, n: int, *key: Column | int | str) -> Column:
    """Where a permutation of 0..n-1, one for each key, sends position `at`: computed for each row alone, nothing is sorted.

    Four Feistel rounds over the two halves of the bits of the next power of two are a bijection of that range; the
    cycle is followed until it is back below n, which keeps it a bijection of 0..n-1.
    """
    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    low_mask, high_mask = F.lit((1 << low) - 1), F.lit((1 << (bits - low)) - 1)

    def turn(x: Column, r: Column) -> Column:
        odd = x.bitwiseXOR(F.shiftleft(hash_word(x.bitwiseAND(low_mask), *key, r, F.lit("feistel")).bitwiseAND(high_mask), low))
        even = x.bitwiseXOR(hash_word(F.shiftright(x, low), *key, r, F.lit("feistel")).bitwiseAND(low_mask))
        return F.when(r % 2 == 1, odd).otherwise(even)

    def rounds(x: Column) -> Column:
        return F.aggregate(F.array(*[F.lit(r).cast("long") for r in (1, 2, 3, 4)]), x, turn)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), rounds(at.cast("long")), lambda x, _: F.when(x < n, x).otherwise(rounds(x)))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("no end of a cycle found")).cast("long"))


class Permutation:
    """`permuted` for arrays. What a round changes hangs on half of the bits only, so a key's rounds are tables of some sqrt(n) entries."""

    def __init__(self, n: int, *key: int):
        bits = max(2, (n - 1).bit_length())
        self.n, self.low = n, bits // 2
        sizes = 1 << self.low, 1 << (bits - self.low)
        self.rounds = []
        for r in (1, 2, 3, 4):
            own, other = sizes if r % 2 else sizes[::-1]
            tail = ":".join(str(x) for x in (*key, r, "feistel"))
            words = np.array([int(hashlib.md5(f"{v}:{tail}".encode()).hexdigest()[:8], 16) for v in range(own)], np.int64) & (other - 1)
            self.rounds.append(words << self.low if r % 2 else words)

    def _round(self, x: np.ndarray, r: int) -> np.ndarray:
        return x ^ self.rounds[r][x >> self.low if r % 2 else x & ((1 << self.low) - 1)]

    def _walk(self, x: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
        def once(x):
            for r in order:
                x = self._round(x, r)
            return x

        x = once(x)
        while len(far := np.flatnonzero(x >= self.n)):
            x[far] = once(x[far])
        return x

    def to(self, at: np.ndarray) -> np.ndarray:
        """Where positions are sent."""
        return self._walk(at, (0, 1, 2, 3))

    def back(self, place: np.ndarray) -> np.ndarray:
        """Which positions are sent to these places: each round undoes itself, so they run backwards."""
        return self._walk(place, (3, 2, 1, 0))


BLOCK = 1 << 16  # neighbouring rows that one task fills
REPS_PER_TASK = 16  # repetitions that it fills at once


def permuted_blocks(df: DataFrame, subject: str, columns: list[str], reps: list[int], size: int = BLOCK,
                    then: Callable[[pa.Table], pa.Table] | None = None, kinds: str | None = None) -> DataFrame:
    """All rows once a repetition, with `columns` as one block from another row: a keyed permutation of the rows' numbers.

    Rows are numbered once by key. Every row works out which position of each repetition takes its values, and sends them there
    as one array for each (repetition, block of positions); so a value costs a few bytes of a shuffle, and nothing is sorted or
    looked up by row. A task holds one block of rows for a few repetitions; rows come out in runs of one repetition. `then` turns
    a task's rows into rows of `kinds` where only their sums are wanted.
    """
    numbered = cut_lineage(number_rows(df, [], subject, [], "__pos").withColumn("__pos", F.col("__pos") - 1))
    n = numbered.count()
    # Each row becomes many: a small table is dealt over all cores first.
    donors = numbered.select("__pos", *columns).repartition(df.sparkSession.sparkContext.defaultParallelism, "__pos")
    of = {f.name: f.dataType for f in numbered.schema}
    own = [c for c in numbered.columns if c not in (*columns, "__pos")]

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = {rep: Permutation(n, rep) for rep in reps}
        for table in chunks(it, size):
            place = table["__pos"].to_numpy()
            values = table.select(columns).combine_chunks()
            for i, rep in enumerate(reps):
                at = ways[rep].back(place)
                block = at // size
                order = np.argsort(block.astype(np.uint16) if n <= size << 16 else block, kind="stable")
                block = block[order]
                cuts = np.flatnonzero(np.diff(block, prepend=-1))
                ends = pa.array(np.append(cuts, len(at)).astype(np.int32))
                lists = [pa.array((at[order] % size).astype(np.int32)), *(values[c].take(pa.array(order)).combine_chunks() for c in columns)]
                lists = [pa.ListArray.from_arrays(ends, _one(x)) for x in lists]
                few = len(cuts)
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array(np.full(few, i // REPS_PER_TASK, np.int32)), pa.array(np.full(few, rep, np.int32)), *lists],
                                                 ["__block", "__some", "rep", "__at", *columns])

    pieces = T.StructType([T.StructField("__block", T.LongType()), T.StructField("__some", T.IntegerType()), T.StructField("rep", T.IntegerType()),
                           T.StructField("__at", T.ArrayType(T.IntegerType())), *[T.StructField(c, T.ArrayType(of[c])) for c in columns]])
    sent = donors.mapInArrow(send, pieces)
    some = F.explode(F.sequence(F.lit(0), F.lit((len(reps) - 1) // REPS_PER_TASK)))
    takers = numbered.select(F.floor(F.col("__pos") / size).alias("__block"), some.alias("__some"), (F.col("__pos") % size).cast("int").alias("__at"), *own)

    def fill(rows: pa.Table, got: pa.Table) -> pa.Table:
        each, which = np.unique(got["rep"].to_numpy(), return_inverse=True)
        at = pc.list_flatten(got["__at"]).to_numpy()
        found = np.zeros((len(each), size), np.int64)
        found[np.repeat(which, pc.list_value_length(got["__at"]).to_numpy()), at] = np.arange(len(at))
        mine = pa.array(np.tile(np.arange(rows.num_rows), len(each)))
        source = pa.array(found[:, rows["__at"].to_numpy()].ravel())
        out = {"rep": pa.array(np.repeat(each, rows.num_rows).astype(np.int32))}
        out |= {c: rows[c].take(mine) for c in own} | {c: pc.list_flatten(got[c]).take(source) for c in columns}
        return then(pa.table(out)) if then else pa.table(out)

    filled = T.StructType([T.StructField("rep", T.IntegerType()), *[T.StructField(c, of[c]) for c in (*own, *columns)]])
    by = ["__block", "__some"]
    return takers.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(fill, kinds if then else filled)


def _one(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def chunks(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task, at least `size` at a time but for the last ones."""
    held, rows = [], 0
    for batch in it:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def size_matched_clusters(folded: DataFrame, subject: str, seeds: list[int]) -> DataFrame:
    """Random clusters with exactly the sizes of the given ones: the labels, shuffled."""
    return shuffled_labels(folded, subject, ["fold"], seeds).withColumnRenamed("rep", "seed")


def leak_check(folded: DataFrame, subject: str) -> DataFrame:
    """Per seed: subjects, and how many are in the test fold more or less than once (0 is right)."""
    per = folded.groupBy("seed", subject).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("seed").agg(F.count(F.lit(1)).alias("subjects"), F.count_if(F.col("n") != 1).alias("violations"))
