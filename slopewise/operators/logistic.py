"""Penalised logistic regression for many fits at once, recalibration, boosted trees.

All fits (folds x penalties x inner folds x arms) advance together: one pass over the
rows per Newton step. Fits of the same rows and columns share them: their scores, gradients and curvatures are matrix products. A task
keeps one small gradient and curvature block per fit, and only those are summed. The driver holds coefficients: fits x columns numbers.
Penalties are compared by the exact AUC of every inner fit: held-out scores travel as sorted arrays, one for each range of a fit's scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .folds import chunks, fold_of
from .linear import Design, Outcome, small_or_shuffled, training_medians
from .metrics import area, auc
from .ranks import ROWS_PER_BIN, bins, join_on_keys, written

C_GRID = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
TOLERANCE = 1e-9
FEW_COLUMNS = 16  # up to which the products of columns are formed once for all fits of the same rows
ROWS_PER_RANGE, SAMPLED = 500_000, 500  # held-out scores in one task, about; how many of those are sampled for the edges
ROWS_AT_ONCE = 2048  # rows of which a task holds the columns of one model at a time: they stay in the cache
CHUNK = 1 << 17  # rows whose scores are sorted before they are sent


@dataclass
class Fit:
    """One model: the columns it uses, its penalty, and which rows train it.

    `rows` are (column, value, wanted) tests that must all hold: column == value is `wanted`.
    """

    name: tuple
    columns: tuple[str, ...]
    c: float
    rows: tuple[tuple[str, int, bool], ...]
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    fill: np.ndarray | None = None
    beta: np.ndarray | None = None
    converged: bool = False
    n: float = 0.0
    classes: int = 0


def _member(fit: Fit, cols: dict[str, np.ndarray], n: int) -> np.ndarray:
    m = np.ones(n, dtype=bool)
    for column, value, wanted in fit.rows:
        m &= (cols[column] == value) == wanted
    return m


def _read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}


def _standard(fit: Fit, cols: dict[str, np.ndarray], m: np.ndarray) -> np.ndarray:
    """One line for the intercept and each column, so that what is done to a column runs through memory in order."""
    x = np.array([cols[c][m] for c in fit.columns], dtype=float)
    if fit.mean is not None:
        x = np.where(np.isnan(x), fit.fill[:, None], x)
        x = (x - fit.mean[:, None]) / fit.scale[:, None]
    return np.concatenate([np.ones((1, x.shape[1])), x])


def _alike(fits: list[Fit]) -> list[list[int]]:
    """The numbers of the fits, those with the same rows and the same standardised columns together."""
    out: dict = {}
    for i, f in enumerate(fits):
        numbers = (None if x is None else x.tobytes() for x in (f.mean, f.scale, f.fill))
        out.setdefault((f.columns, f.rows, *numbers), []).append(i)
    return list(out.values())


def _sum_over_rows(rows: DataFrame, fits: list[Fit], part) -> list[np.ndarray | None]:
    """Sum part(fits of the same rows and columns, cols, member), a row of numbers for each of those fits, over all rows."""
    sets = _alike(fits)

    def partial(it):
        acc: dict[int, np.ndarray] = {}
        for batch in it:
            if not batch.num_rows:
                continue
            whole = _read(batch)
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                cols = {n: x[at:at + ROWS_AT_ONCE] for n, x in whole.items()}
                for k, alike in enumerate(sets):
                    m = _member(fits[alike[0]], cols, min(ROWS_AT_ONCE, batch.num_rows - at))
                    if m.any():
                        v = part([fits[i] for i in alike], cols, m)
                        acc[k] = acc[k] + v if k in acc else v
        for i, v in ((i, v) for k, values in acc.items() for i, v in zip(sets[k], values, strict=True)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, dtype=np.int32)),
                                              pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)],
                                             names=["fit", "pos", "val"])

    t = (rows.mapInArrow(partial, "fit int, pos int, val double").groupBy("fit", "pos").agg(F.sum("val").alias("val")).toArrow())
    fit, pos, val = (t.column(c).to_numpy() for c in ("fit", "pos", "val"))
    out: list[np.ndarray | None] = [None] * len(fits)
    order = np.lexsort((pos, fit))
    fit, val = fit[order], val[order]
    for i in np.unique(fit):
        out[int(i)] = val[fit == i]
    return out


def standardise_fits(rows: DataFrame, fits: list[Fit], fill: dict | None = None) -> None:
    """Mean and scale of each fit's columns over its own training rows (after filling gaps)."""
    for f in fits:
        f.fill = np.array([(fill or {}).get((*f.name[:2], c), 0.0) for c in f.columns])

    def part(alike, cols, m):
        x = np.column_stack([cols[c][m] for c in alike[0].columns]).astype(float)
        x = np.where(np.isnan(x), alike[0].fill, x)
        return np.tile(np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), (len(alike), 1))

    for f, s in zip(fits, _sum_over_rows(rows, fits, part)):
        if s is None:
            continue
        p = len(f.columns)
        f.mean = s[1:1 + p] / s[0]
        var = np.maximum(s[1 + p:] / s[0] - f.mean ** 2, 0.0)
        f.scale = np.where(var > 1e-14 * np.maximum(s[1 + p:] / s[0], 1e-300), np.sqrt(var), 1.0)


def newton(rows: DataFrame, fits: list[Fit], label: str) -> list[Fit]:
    """Fit all models in lock-step Newton passes with step halving on the penalised deviance, until each has settled.

    Each pass lowers a model's deviance, or halves its step. Penalised deviance has one minimum, so there is no limit of steps.
    Finished models leave; a model whose rows are all of one class stays flagged as not converged. A model that comes with coefficients
    sets out from them, which saves passes and leaves the minimum where it is.
    """

    def part(alike, cols, m):
        z = _standard(alike[0], cols, m)
        y = cols[label][m].astype(float)
        eta = np.array([f.beta for f in alike]) @ z
        e = np.exp(-np.abs(eta))
        p = np.where(eta >= 0, 1.0, e) / (1.0 + e)
        deviance = (np.maximum(eta, 0.0) + np.log1p(e)).sum(1) - eta @ y
        w, q = p * (1 - p), len(z)
        if len(alike) > 1 and q <= FEW_COLUMNS:
            i, j = np.triu_indices(q)
            h = np.empty((len(alike), q, q))
            h[:, i, j] = h[:, j, i] = w @ (z[i] * z[j]).T
        else:
            h = np.array([(z * one) @ z.T for one in w])
        sums = np.tile([len(y), y.sum()], (len(alike), 1))
        return np.column_stack([sums, deviance, (y - p) @ z.T, h.reshape(len(alike), -1)])

    for f in fits:
        f.beta = np.zeros(len(f.columns) + 1) if f.beta is None else f.beta
    base, lowest, steps = {}, {}, {}
    open_fits = list(fits)
    while open_fits:
        still = []
        for f, s in zip(open_fits, _sum_over_rows(rows, open_fits, part)):
            if s is None or s[1] == 0 or s[1] == s[0]:
                continue
            q, k = len(f.beta), id(f)
            f.n, f.classes = s[0], 2
            pen = np.full(q, 1.0 / f.c)
            pen[0] = 0.0
            value = s[2] + 0.5 * pen @ (f.beta * f.beta)
            if k in lowest and value > lowest[k] + 1e-13 * abs(lowest[k]):
                steps[k] = steps[k] / 2
            else:
                base[k], lowest[k] = f.beta, min(value, lowest.get(k, np.inf))
                steps[k] = np.linalg.solve(s[3 + q:].reshape(q, q) + np.diag(pen) + 1e-12 * np.eye(q), s[3:3 + q] - pen * f.beta)
            size = np.abs(steps[k]).max()
            f.beta = base[k] + steps[k]
            if size < TOLERANCE * (1.0 + np.abs(base[k]).max()):
                f.converged = True
            else:
                still.append(f)
        open_fits = still
    return fits


def raw_coefficients(f: Fit) -> tuple[float, list[float], list[float]]:
    """Intercept, slopes and fills in the units of the columns."""
    mean = f.mean if f.mean is not None else np.zeros(len(f.columns))
    scale = f.scale if f.scale is not None else np.ones(len(f.columns))
    b = f.beta[1:] / scale
    fill = f.fill if f.fill is not None else np.zeros(len(f.columns))
    return float(f.beta[0] - b @ mean), [float(x) for x in b], [float(x) for x in fill]


def _model_table(spark, fits: list[Fit], keys: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(k, T.IntegerType()) for k in keys] + [
        T.StructField("a0", T.DoubleType()), T.StructField("b", T.ArrayType(T.DoubleType())),
        T.StructField("f", T.ArrayType(T.DoubleType())), T.StructField("converged", T.BooleanType())])
    rows = [tuple(int(x) for x in f.name) + raw_coefficients(f) + (f.converged,) for f in fits if f.classes == 2]
    return spark.createDataFrame(rows, schema)


def probability(columns: tuple[str, ...]) -> Column:
    """P(label = 1) from the joined model columns a0, b, f. Stays in the JVM."""
    eta = F.col("a0")
    for i, c in enumerate(columns):
        eta = eta + F.col("b")[i] * F.coalesce(F.col(c).cast("double"), F.col("f")[i])
    return 1 / (1 + F.exp(-eta))


def _rows(df: DataFrame, subject: str, columns: list[str], label: str, seeds: list[int], k: int, inner_k: int,
          fold_cols: dict[int, str] | None = None) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in columns] + [F.col(label).cast("int").alias(label)]
    for s in seeds:
        outer = F.col(fold_cols[s]).cast("int") if fold_cols else fold_of(subject, s, k)
        cols += [outer.alias(f"o{s}"), fold_of(subject, s, inner_k, "inner").alias(f"g{s}")]
    return df.dropna(subset=[label]).select(subject, *cols)


def training_fill(rows: DataFrame, subject: str, columns: list[str], seeds: list[int], k: int) -> dict:
    """(seed, fold, column) -> median of a gappy column over the rows outside the fold (columns o<seed>)."""
    gaps = rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    gappy = [c for i, c in enumerate(columns) if gaps[f"g{i}"]]
    if not gappy:
        return {}
    return training_medians(rows, Design(subject, gappy, Outcome(subject), seeds, k, 1, fold_cols={s: f"o{s}" for s in seeds}), gappy)


def logistic_cv(df: DataFrame, subject: str, label: str, columns: list[str], *, seeds: list[int] | None = None, k: int = 5,
                inner_k: int = 5, grid: tuple[float, ...] = (1.0,), fill: dict | None = None,
                fold_cols: dict[int, str] | None = None) -> DataFrame:
    """Out-of-fold probabilities; with more than one grid value the penalty is chosen per fold by mean inner AUC.

    Gaps are filled with the training median of each fold; `fill`, which maps (seed, fold, column) to a value, overrides it.
    Every row comes back: where the training rows are all of one class `pred` is NULL, and `status` says so, as it does
    where the fit did not settle.
    """
    seeds, cols = seeds or [0], tuple(columns)
    spark = df.sparkSession
    # Each row is read by many models: a small table is dealt over all cores first.
    rows, count = written(_rows(df, subject, columns, label, seeds, k, inner_k, fold_cols).repartition(spark.sparkContext.defaultParallelism))
    outer = [Fit((s, f), cols, grid[0], ((f"o{s}", f, False),)) for s in seeds for f in range(k)]
    numbers = rows.drop(subject)
    standardise_fits(numbers, outer, training_fill(rows, subject, columns, seeds, k) if fill is None else fill)
    outer = _choose_c(numbers, count, outer, label, grid, inner_k) if len(grid) > 1 else newton(numbers, outer, label)
    return _predict(rows, spark, outer, subject, label, cols, seeds)


def _with_seed_folds(rows: DataFrame, seeds: list[int], extra: list[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"o{s}").alias("fold"), F.col(f"g{s}").alias("inner"))
                               for s in seeds]))
    return rows.select(*extra, each.alias("e")).select(*extra, "e.seed", "e.fold", "e.inner")


def _predict(rows: DataFrame, spark, fits: list[Fit], subject: str, label: str, cols: tuple[str, ...], seeds: list[int]) -> DataFrame:
    models = _model_table(spark, fits, ["seed", "fold"])
    long = _with_seed_folds(rows, seeds, [subject, label, *cols])
    j = long.join(small_or_shuffled(models, len(fits) * (2 + 2 * len(cols))), ["seed", "fold"], "left")
    status = F.when(F.col("a0").isNull(), "one_class").when(~F.col("converged"), "not_converged").otherwise("ok")
    return j.select("seed", "fold", subject, F.col(label).alias("y"), probability(cols).alias("pred"), status.alias("status"))


def _choose_c(rows: DataFrame, count: int, outer: list[Fit], label: str, grid: tuple[float, ...], inner_k: int) -> list[Fit]:
    """The outer fits, each with the penalty of the highest mean AUC over its inner folds.

    Every fold is fitted with every penalty, and sets out from the fit of all rows; the inner fits set out from their fold's.
    """
    first = next((f for f in outer if f.mean is not None), None)
    whole = [Fit((i,), first.columns, c, (), first.mean, first.scale, first.fill) for i, c in enumerate(grid)] if first else []
    start = [f.beta for f in newton(rows, whole, label)] or [None] * len(grid)
    full = {(*f.name, i): Fit((*f.name, i), f.columns, c, f.rows, f.mean, f.scale, f.fill, start[i]) for f in outer for i, c in enumerate(grid)}
    newton(rows, list(full.values()), label)
    inner = [Fit((s, o, g, i), f.columns, f.c, (*f.rows, (f"g{s}", g, False)), f.mean, f.scale, f.fill, f.beta)
             for (s, o, i), f in full.items() for g in range(inner_k)]
    newton(rows, inner, label)
    scored: dict = {}
    for (s, o, _, i), value in inner_auc(rows, count, inner, label).items():
        scored.setdefault((s, o), {}).setdefault(i, []).append(value)
    chosen = []
    for f in outer:
        best, at = None, 0
        for i, values in sorted(scored.get(f.name, {}).items()):
            mean = sum(values) / len(values)
            if best is None or mean > best + 1e-12:
                best, at = mean, i
        chosen.append(full[(*f.name, at)])
    for f in chosen:
        f.name = f.name[:2]
    return chosen


def _held_out(fit: Fit, cols: dict[str, np.ndarray]) -> np.ndarray:
    """The rows that an inner fit leaves to be scored: outside its outer fold and inside its inner one; no fold is no row."""
    (outer, o, _), (inner, g, _) = fit.rows
    return (cols[outer] == cols[outer]) & (cols[outer] != o) & (cols[inner] == g)


def _scores(table: pa.Table, label: str, sets: list[list[tuple[int, Fit]]]):
    """(number of the fit, scores in order, whether each is of label 1) of all fits; the fits of a set share their held-out rows."""
    cols = {n: table[n].to_numpy() for n in table.column_names}
    gaps = {c: table[c].is_null().to_numpy() for c in sets[0][0][1].columns}
    for fits in sets:
        m = np.flatnonzero(_held_out(fits[0][1], cols))
        if not len(m):
            continue
        own = [(cols[c][m], gaps[c][m]) for c in fits[0][1].columns]
        one = cols[label][m] == 1
        for i, fit in fits:
            eta, b, fill = raw_coefficients(fit)
            for (x, gap), slope, f in zip(own, b, fill, strict=True):
                eta = eta + slope * np.where(gap, f, x)
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-eta))
            order = np.argsort(p)
            yield i, p[order], one[order]


def inner_auc(rows: DataFrame, count: int, fits: list[Fit], label: str, rows_per_range: int = ROWS_PER_RANGE) -> dict[tuple, float]:
    """Name of each inner fit -> exact AUC of its held-out rows, ties counted half; fits and rows of one class are left out.

    The scores of a fit are cut into ranges of about `rows_per_range`, at edges from a sample of the rows; edges only move the
    work, never the result. A task of the first pass sorts the scores of a chunk of rows and sums equal ones; an array of them
    is sent for each fit and range, and one task counts a range. The ranges below it are added to that as one number.
    """
    sets: dict = {}
    for i, f in enumerate(fits):
        if f.classes == 2:
            sets.setdefault(f.rows, []).append((i, f))
    if not sets:
        return {}
    sets, edges = list(sets.values()), {}
    if count > rows_per_range:
        def drawn(it):
            for table in chunks(it, CHUNK):
                for i, p, _ in _scores(table, label, sets):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([p])], ["fit", "value"])

        def cut(pieces: pa.Table) -> pa.Table:
            p = np.sort(pc.list_flatten(pieces["value"]).to_numpy())
            return pa.table({"fit": pieces["fit"][:1], "edges": pa.array([p[step::step]], pa.list_(pa.float64()))})

        share = min(1.0, SAMPLED / rows_per_range)
        step = round(share * rows_per_range)
        found = rows.sample(share, 1).mapInArrow(drawn, "fit int, value array<double>").groupBy("fit").applyInArrow(cut, "fit int, edges array<double>")
        edges = {r.fit: np.unique(r.edges) for r in found.collect()}
    none = np.empty(0)

    def send(it):
        for table in chunks(it, CHUNK):
            for i, p, one in _scores(table, label, sets):
                value, pos, neg = _equal(p, one.astype(np.int32), (~one).astype(np.int32))
                at = np.append(0, np.searchsorted(value, edges.get(i, none), side="left"))
                ends = np.append(at, len(value)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (value, pos, neg)]
                sent = pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(np.arange(len(at), dtype=np.int32)), *lists],
                                                  ["fit", "range", "value", "pos", "neg"])
                yield sent.filter(pa.array(np.diff(ends) > 0))

    def count_range(pieces: pa.Table) -> pa.Table:
        value, pos, neg = (pc.list_flatten(pieces[c]).to_numpy() for c in ("value", "pos", "neg"))
        order = np.argsort(value, kind="stable")
        _, pos, neg = _equal(value[order], pos[order].astype(np.int64), neg[order].astype(np.int64))
        wins = (pos * (np.cumsum(neg) - neg + neg / 2)).sum()
        return pa.table({"fit": pieces["fit"][:1], "range": pieces["range"][:1], "pos": [pos.sum()], "neg": [neg.sum()], "wins": [wins]})

    sent = rows.mapInArrow(send, "fit int, range int, value array<double>, pos array<int>, neg array<int>")
    counted = sent.groupBy("fit", "range").applyInArrow(count_range, "fit int, range int, pos long, neg long, wins double")
    lower = F.coalesce(F.sum("neg").over(Window.partitionBy("fit").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counted.withColumn("wins", F.col("wins") + F.col("pos") * lower).groupBy("fit").agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("wins").alias("wins"))
    return {fits[r.fit].name: r.auc for r in sums.select("fit", area().alias("auc")).collect() if r.auc is not None}


def _equal(value: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted values, equal ones once, with summed counts. NaN, which comes last, is one value."""
    new = np.append(True, (value[1:] != value[:-1]) & ~np.isnan(value[:-1]))
    if new.all():
        return value, *counts
    at = np.flatnonzero(new)
    return value[at], *(np.add.reduceat(c, at, dtype=c.dtype) for c in counts)


def recalibrated_cv(df: DataFrame, subject: str, label: str, columns: list[str], *, seed: int = 0, k: int = 5,
                    calib_share: float = 0.25, c: float = 1.0) -> DataFrame:
    """Out-of-fold raw, Platt and isotonic probabilities.

    Inside each training set a hashed share is held back: the model never sees it, and both
    recalibrations see nothing else. Test rows are in neither. Where the share has one class only, the raw probability stands; where the
    model's own training rows have, all three are NULL.
    """
    cols, spark = tuple(columns), df.sparkSession
    held = (fold_of(subject, seed, 1000, "calib") < int(1000 * calib_share)).cast("int")
    rows = cut_lineage(_rows(df, subject, columns, label, [seed], k, 1).withColumn("held", held))
    base = [Fit((seed, f), cols, c, ((f"o{seed}", f, False), ("held", 1, False))) for f in range(k)]
    standardise_fits(rows, base, training_fill(rows.filter("held = 0"), subject, columns, [seed], k))
    newton(rows, base, label)
    models = _model_table(spark, base, ["seed", "fold"])
    # Every row under every fold's model: calibration rows of other folds, and its own fold's test row.
    each = rows.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(k)])))
    each = each.withColumn("test", F.col(f"o{seed}") == F.col("fold")).filter(F.col("test") | (F.col("held") == 1))
    scored = each.join(small_or_shuffled(models.drop("seed"), k * (2 + 2 * len(cols))), "fold", "left").select(
        "fold", "test", subject, label, probability(cols).alias("p_raw"))
    calib = cut_lineage(scored.filter(~F.col("test") & F.col("p_raw").isNotNull()).select("fold", label, "p_raw"))
    platt = newton(calib, [Fit((f,), ("p_raw",), 1e6, (("fold", f, True),)) for f in range(k)], label)
    out = scored.filter("test")
    p_models = _model_table(spark, platt, ["fold"])
    j = out.join(small_or_shuffled(p_models, 4 * k), "fold", "left")
    platted = F.when(F.col("p_raw").isNotNull(), F.coalesce(probability(("p_raw",)), F.col("p_raw")))
    out = j.withColumn("p_platt", platted).drop("a0", "b", "f", "converged")
    two = [x.name[0] for x in platt if x.classes == 2]
    knots = isotonic_blocks(calib.filter(F.col("fold").isin(two)), "fold", label, "p_raw")
    stepped = F.when(F.col("fold").isin(two), isotonic_value(knots, "fold", "p_raw")).otherwise(F.col("p_raw"))
    return out.select("fold", subject, F.col(label).alias("y"), "p_raw", "p_platt", stepped.alias("p_isotonic"))


BLOCK = "lo double, hi double, total double, weight double"


def _pooled(keys: list[str]):
    """Pool adjacent violators: a stack of blocks for each run of equal keys, as rows come in order."""

    def pool(it):
        now, stack = None, []
        for batch in it:
            names = batch.schema.names
            own = list(zip(*(batch.column(names.index(c)).to_pylist() for c in keys), strict=True))
            for key, row in zip(own, zip(*(batch.column(names.index(c)).to_pylist() for c in ("lo", "hi", "total", "weight")), strict=True), strict=True):
                if key != now:
                    if stack:
                        yield _stack(now, stack)
                    now, stack = key, []
                lo, hi, total, weight = row
                while stack and stack[-1][2] * weight >= total * stack[-1][3]:  # its mean is not below this one's
                    lo, _, t, w = stack.pop()
                    total, weight = total + t, weight + w
                stack.append((lo, hi, total, weight))
        if stack:
            yield _stack(now, stack)

    def _stack(key, stack):
        columns = [pa.array([k] * len(stack)) for k in key] + [pa.array(c, pa.float64()) for c in zip(*stack, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, *(x.split()[0] for x in BLOCK.split(", "))])

    return pool


def isotonic_blocks(train: DataFrame, key: str, label: str, score: str, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """The blocks of the isotonic fit of `label` on `score` for every value of the integer `key`: `lo`, `hi` (scores), `total`, `weight`.

    Pooling is done inside ranges of scores, which leaves a stack of blocks for each, and again over the stacks of a key in order:
    pooling pooled blocks gives the blocks of the whole. Equal scores are summed before.
    """
    one = train.filter(F.col(score).isNotNull()).groupBy(F.col(key).cast("long").alias(key), F.col(score).cast("double").alias("lo")).agg(
        F.sum(F.col(label).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    rows, count = written(one.withColumn("hi", F.col("lo")))
    cut = bins(rows, count, [key], ["lo"], {}, rows_per_bin)
    ranges = (rows.withColumn("__bin", F.lit(0).cast("long")) if cut is None else cut[0])
    inside = ranges.repartition(key, "__bin").sortWithinPartitions(key, "__bin", "lo").mapInArrow(_pooled([key, "__bin"]), f"{key} long, __bin long, {BLOCK}")
    return inside.drop("__bin").repartition(key).sortWithinPartitions(key, "lo").mapInArrow(_pooled([key]), f"{key} long, {BLOCK}")


def isotonic_value(blocks: DataFrame, key: str, score: str) -> Column:
    """The fit at a score: a block's mean inside it, linear between blocks, the end blocks' means outside.

    The blocks go to the tasks as two arrays a key. For 0/1 labels the means are distinct rising fractions, so n rows
    leave at most some 2 n^(2/3) blocks.
    """
    found: dict = {}
    for r in blocks.sort(key, "lo").toArrow().to_pylist():
        x, y = found.setdefault(r[key], ([], []))
        x += [r["lo"], r["hi"]]
        y += [r["total"] / r["weight"]] * 2
    arrays = {k: (np.array(x), np.array(y)) for k, (x, y) in found.items()}

    @F.pandas_udf("double")
    def value(k: pd.Series, s: pd.Series) -> pd.Series:
        out = np.full(len(s), np.nan)
        for one in k.dropna().unique():
            if one in arrays:
                at = (k == one).to_numpy()
                out[at] = np.interp(s[at].to_numpy(dtype=float), *arrays[one])
        return pd.Series(out).where(s.notna().to_numpy() & ~np.isnan(out), None)

    return value(F.col(key).cast("long"), F.col(score))


def boosted_cv(df: DataFrame, subject: str, label: str, columns: list[str], *, kind: str = "regression", seed: int = 0, k: int = 5,
               max_iter: int = 20, max_depth: int = 4, step: float = 0.1) -> DataFrame:
    """Out-of-fold predictions of boosted trees (Spark's own), the nonlinear comparator. One fit per fold."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    data = df.dropna(subset=[label]).select(subject, F.col(label).cast("double").alias("y"),
                                            *[F.col(c).cast("double").alias(c) for c in columns],
                                            fold_of(subject, seed, k).alias("fold"))
    data = VectorAssembler(inputCols=list(columns), outputCol="x", handleInvalid="keep").transform(data).select(
        subject, "y", "fold", "x").persist(StorageLevel.MEMORY_AND_DISK)
    args = {"featuresCol": "x", "labelCol": "y", "maxIter": max_iter, "maxDepth": max_depth, "stepSize": step, "seed": 42}
    parts = None
    for f in range(k):
        train, test = data.filter(F.col("fold") != f), data.filter(F.col("fold") == f)
        if kind == "regression":
            got = GBTRegressor(**args).fit(train).transform(test).withColumn("pred", F.col("prediction"))
        else:
            got = GBTClassifier(**args).fit(train).transform(test).withColumn("pred", vector_to_array("probability")[1])
        got = got.select("fold", subject, "y", "pred")
        parts = got if parts is None else parts.unionByName(got)
    return parts


def repeated_auc(oof: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and range over seeds of the pooled out-of-fold AUC of the rows that have a prediction; `unscored` counts the others."""
    per = auc(oof.filter(F.col("pred").isNotNull()), [*keys, "seed"], "y", "pred")
    g = per.groupBy(*keys).agg(F.avg("auc").alias("auc"), F.min("auc").alias("auc_lo"), F.max("auc").alias("auc_hi"))
    return join_on_keys(g, oof.groupBy(*keys).agg(F.count_if(F.col("pred").isNull()).alias("unscored")), keys)
