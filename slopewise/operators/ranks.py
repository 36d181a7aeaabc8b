"""Running totals, ranks and exact quantiles that do not put a group into one task.

A plain `Window.partitionBy(key).orderBy(value)` moves a whole key into one task, and a global order moves the whole
table. Here the input is evaluated once and written. A key of few rows is one bin. The range of a larger key is cut
at quantiles of a hashed sample of its rows, and a bin whose exact count is still over twice the asked size is cut again in
the same way, so heavy tails, outliers and gaps only move the edges. Edges are (value, tie columns, row number) tuples: a
value that most rows share is cut inside, by its ties. A window over the bin totals (few rows) gives each bin its
offset; a second window, over (key, bin), finishes inside the bin.

Samples are drawn by a hash of the written row number, so a recomputed task agrees with the first run. Edges move only the
work, never the result. NULL values take no part; a NULL key is a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_BIN = 50_000
FAN_OUT = 256  # bins that one cut can make of one
SAMPLED = 64  # sampled rows for each bin asked for
BROADCAST_EDGES = 1_000_000  # edges counted; beyond, only bins with a 2000th of all rows have theirs broadcast
LARGE_SHARE = 2000

_BIN, _ROW, _CELL, _AT, _EDGES, _N = "__bin", "__row", "__cell", "__at", "__edges", "__n"


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys; with no keys `right` has exactly one row, taken as a scalar subquery."""
    if keys:
        return left.join(right, keys)
    packed = right.select(F.struct(*[F.col(c) for c in right.columns]).alias("__one"))
    return (left.withColumn("__one", packed.scalar())
            .select(*left.columns, *[F.col("__one")[c].alias(c) for c in right.columns]))


def _by_key(keys: list[str], *more: str):
    return Window.partitionBy(*keys, *more) if keys or more else Window.partitionBy(F.lit(0))


def written(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows as a written table, and how many there are."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def bins(rows: DataFrame, count: int, keys: list[str], order: list[str], totals: dict[str, Column],
         rows_per_bin: int = ROWS_PER_BIN) -> tuple[DataFrame, DataFrame] | None:
    """`rows` with a bin number that rises with `order` inside the keys, and (keys, bin) with its count `__n` and `totals`.

    `order` must tell any two rows of a key apart. No bin has more than twice `rows_per_bin` rows. None if no key
    needs more than one bin.
    """
    if count <= rows_per_bin:
        return None
    out = rows.withColumn(_BIN, F.lit(0).cast("long"))
    sums = [F.count(F.lit(1)).alias(_N), *[c.alias(m) for m, c in totals.items()]]
    most, level = rows_per_bin, 0
    while True:
        cells = cut_lineage(out.groupBy(*keys, _BIN).agg(*sums))
        large = cells.filter(F.col(_N) > most)
        wanted = large.agg(F.sum(_wanted(rows_per_bin)).alias("edges")).first()["edges"]
        if not wanted:
            return (out, cells) if level else None
        level += 1
        out = _cut(out, large, wanted, count, keys, order, rows_per_bin, level)
        most = 2 * rows_per_bin


def _wanted(rows_per_bin: int) -> Column:
    return F.least(F.lit(FAN_OUT), F.ceil(F.col(_N) / F.lit(float(rows_per_bin))).cast("int"))


def _cut(rows: DataFrame, large: DataFrame, wanted: int, count: int, keys: list[str], order: list[str],
         rows_per_bin: int, level: int) -> DataFrame:
    """Cut each bin of `large` at quantiles of a sample of its rows."""
    cell = F.struct(*keys, _BIN).alias(_CELL)
    sizes = large.select(cell, _N, _wanted(rows_per_bin).alias("__bins"))
    share = F.lit(float(SAMPLED)) * F.col("__bins") / F.col(_N)
    draw = F.pmod(F.xxhash64(*order, F.lit(level)), F.lit(1 << 30)) < share * float(1 << 30)
    inside = rows.select(cell, F.struct(*order).alias(_AT), *order)
    drawn = _meet(inside, sizes, wanted, count, "inner").filter(draw)
    drawn = drawn.groupBy(_CELL, "__bins", _N).agg(F.array_sort(F.collect_list(_AT)).alias("__s"))
    at = "transform(sequence(1, __bins - 1), i -> __s[cast(i * size(__s) / __bins as int)])"
    edges = cut_lineage(drawn.select(_CELL, _N, F.expr(at).alias(_EDGES)))
    steps = ", ".join(str(1 << k) for k in reversed(range(FAN_OUT.bit_length() - 1)))
    search = F.expr(f"aggregate(array({steps}), 0, (p, s) -> if(p + s <= size({_EDGES}) and element_at({_EDGES}, p + s) <= {_AT}, p + s, p))")
    met = _meet(rows.withColumn(_CELL, cell).withColumn(_AT, F.struct(*order)), edges, wanted, count, "left")
    new = F.col(_BIN) * FAN_OUT + F.when(F.col(_EDGES).isNull(), 0).otherwise(search)
    return met.withColumn(_BIN, new.cast("long")).select(*rows.columns)


def _meet(rows: DataFrame, cells: DataFrame, numbers: int, count: int, how: str) -> DataFrame:
    """Join rows to one row a cell. Cells that hold much of the table are few and broadcast; the others are shuffled."""
    if numbers <= BROADCAST_EDGES:
        return rows.join(F.broadcast(cells), _CELL, how)
    hot = F.col(_N) >= count / LARGE_SHARE
    some, few = cells.filter(hot), cells.filter(~hot)
    met = rows.join(F.broadcast(some), _CELL)
    return met.unionByName(rows.join(F.broadcast(some.select(_CELL)), _CELL, "left_anti").join(few, _CELL, how))


def _offsets(cells: DataFrame, keys: list[str], totals: list[str]) -> DataFrame:
    """Sum of each measure over the earlier bins of the key (`__off_m`) and over all of them (`__tot_m`). One row per (key, bin)."""
    part = _by_key(keys)
    before = part.orderBy(_BIN).rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(F.struct(*keys, _BIN).alias(_CELL), *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"__off_{m}") for m in totals],
                        *[F.sum(m).over(part).alias(f"__tot_{m}") for m in totals])


def cumulate(df: DataFrame, keys: list[str], value: str, measures: dict[str, Column], *,
             rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """One row per distinct (keys, value) with summed measures `m`, their running
    totals `cum_m` and the key's totals `tot_m`.

    Equal values are summed before anything is shuffled, so one value that holds
    a third of all rows arrives as one row per map task.
    """
    distinct = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
                .agg(*[F.sum(c).alias(m) for m, c in measures.items()]))
    rows, count = written(distinct)
    cut = bins(rows, count, keys, [value], {m: F.sum(m) for m in measures}, rows_per_bin)
    up_to = lambda *more: _by_key(keys, *more).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    if cut is None:
        return rows.select(*keys, value, *measures, *[F.sum(m).over(_by_key(keys)).alias(f"tot_{m}") for m in measures],
                           *[F.sum(m).over(up_to()).alias(f"cum_{m}") for m in measures])
    binned, cells = cut
    offsets = _offsets(cells, keys, list(measures))
    return (binned.withColumn(_CELL, F.struct(*keys, _BIN)).join(offsets, _CELL)
            .select(*keys, value, *measures, *[F.col(f"__tot_{m}").alias(f"tot_{m}") for m in measures],
                    *[(F.col(f"__off_{m}") + F.sum(m).over(Window.partitionBy(_CELL).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).alias(f"cum_{m}")
                      for m in measures]))


def running_total(df: DataFrame, keys: list[str], value: str, ties: list[str], measure: Column, name: str, *,
                  rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Row-level inclusive running sum of `measure` by (value, ties) inside the keys; rows equal in both take any order."""
    rows, count = written(df.filter(F.col(value).isNotNull()).withColumn("__m", measure).withColumn(_ROW, F.monotonically_increasing_id()))
    order = [value, *[t for t in ties if t != value], _ROW]
    cut = bins(rows, count, keys, order, {"t": F.sum("__m")}, rows_per_bin)
    if cut is None:
        inside = _by_key(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum("__m").over(inside)).drop("__m", _ROW)
    binned, cells = cut
    inside = Window.partitionBy(_CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (binned.withColumn(_CELL, F.struct(*keys, _BIN)).join(_offsets(cells, keys, ["t"]), _CELL)
            .withColumn(name, F.col("__off_t") + F.sum("__m").over(inside))
            .drop(_BIN, _CELL, "__off_t", "__tot_t", "__m", _ROW))


def number_rows(df: DataFrame, keys: list[str], value: str, ties: list[str], name: str = "rank", *,
                rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Row number 1..n by (value, ties) inside the keys."""
    return running_total(df, keys, value, ties, F.lit(1).cast("long"), name, rows_per_bin=rows_per_bin)


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "avg_rank", *,
                  rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Tie-averaged rank of each distinct value, with its row count `n`."""
    c = cumulate(df, keys, value, {"n": F.lit(1).cast("long")}, rows_per_bin=rows_per_bin)
    return c.select(*keys, value, "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias(name))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], *,
                    rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Linear-interpolation quantiles, one column per entry of `probs`, and the count `n`."""
    c = cumulate(df, keys, value, {"n": F.lit(1).cast("long")}, rows_per_bin=rows_per_bin)
    return quantiles_from_cumulated(c, keys, value, "n", probs)


def quantiles_from_cumulated(c: DataFrame, keys: list[str], value: str, count: str,
                             probs: dict[str, float]) -> DataFrame:
    """Quantiles of the multiset described by `count` and its running and key totals."""
    cum, total = F.col(f"cum_{count}"), F.col(f"tot_{count}")
    before = cum - F.col(count)

    def at(pos: Column) -> Column:
        return F.max(F.when((before <= pos) & (pos < cum), F.col(value)))

    aggs, out = [], []
    for name, p in probs.items():
        h = (total - 1) * F.lit(float(p))
        aggs += [at(F.floor(h)).alias(f"__a_{name}"), at(F.ceil(h)).alias(f"__b_{name}"),
                 F.max(h - F.floor(h)).alias(f"__g_{name}")]
        out.append((F.col(f"__a_{name}") + (F.col(f"__b_{name}") - F.col(f"__a_{name}")) * F.col(f"__g_{name}"))
                   .alias(name))
    return c.groupBy(*keys).agg(F.max(total).alias("n"), *aggs).select(*keys, "n", *out)
