"""Leak-safe cross-validated linear models from fold-level sums.

No row is copied per fold and no model is fitted on rows. One pass over the
features leaves, per (seed, outer fold, inner fold), the cross products of the
columns. Any training set is a sum of such cells, so standardisation, median
filling, the inner alpha search (including its scores) and the final fit are
all small matrix work on those sums. Predictions are a second, JVM-side pass.

Gaps: a column with NULLs travels as (value or 0, is-missing). The filled column
is value + fill * missing, a linear map, so one set of sums serves every fold's
own median.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .folds import fold_of, per_seed
from .longitudinal import shrunken, training_params
from .ranks import cumulate

# Penalty grids.
RIDGE_GRID = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
ELASTIC_GRID = tuple((a, l1) for a in (0.001, 0.01, 0.1, 1.0, 10.0) for l1 in (0.1, 0.5, 0.9))
LOO_GRID = tuple(float(10.0 ** e) for e in np.linspace(-3.0, 3.0, 25))


@dataclass(frozen=True)
class Outcome:
    """Either a ready column, or a slope with its variance to be shrunken per training set."""

    column: str
    variance: str | None = None

    @property
    def columns(self) -> list[str]:
        return [self.column] + ([self.variance] if self.variance else [])


@dataclass(frozen=True)
class Arm:
    """A named model: its columns, its kind and its penalty grid (one entry means no tuning)."""

    name: str
    columns: tuple[str, ...]
    kind: str = "ridge"
    grid: tuple = RIDGE_GRID
    tune: str = "inner"  # "inner" cross-validation, or "loo" (ridge only)


@dataclass
class Design:
    """What the passes over the data share. Everything here is a few numbers per column or fold."""

    subject: str
    features: list[str]
    outcome: Outcome
    seeds: list[int]
    k: int
    inner_k: int
    rep: str | None = None
    fold_cols: dict[int, str] = field(default_factory=dict)
    center: dict[str, float] = field(default_factory=dict)
    gappy: list[str] = field(default_factory=list)
    fill: dict[tuple[int, int, str], float] = field(default_factory=dict)
    params: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return 1 + len(self.features) + len(self.gappy)

    def fold(self, seed: int) -> Column:
        """Outer fold of a row: a given column (0..k-1) or the hash of its key."""
        if self.fold_cols:
            return F.col(self.fold_cols[seed]).cast("int")
        return fold_of(self.subject, seed, self.k)

    def folded(self, df: DataFrame) -> DataFrame:
        """One row per (row, seed) with its fold."""
        out = per_seed(df, self.seeds)
        fold = F.lit(None).cast("int")
        for s in self.seeds if self.fold_cols else []:
            fold = F.when(F.col("seed") == s, self.fold(s)).otherwise(fold)
        return out.withColumn("fold", fold if self.fold_cols else fold_of(self.subject, F.col("seed"), self.k))


def prepare(df: DataFrame, subject: str, features: list[str], outcome: Outcome, seeds: list[int],
            k: int, inner_k: int, rep: str | None = None, fold_cols: dict[int, str] | None = None) -> Design:
    """Column centres and gaps, training medians of gappy columns, and per-training-set shrinkage."""
    d = Design(subject, list(features), outcome, list(seeds), k, inner_k, rep, dict(fold_cols or {}))
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                 *[F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(features)]).first()
    d.center = {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(features)}
    d.gappy = [c for i, c in enumerate(features) if row[f"g{i}"] > 0]
    once = df.filter(F.col(rep) == F.lit(df.agg(F.min(rep)).first()[0])) if rep else df
    if d.gappy:
        d.fill = training_medians(once, d, d.gappy)
    if outcome.variance:
        folded = d.folded(once.dropna(subset=outcome.columns)).select(
            "seed", "fold", F.col(outcome.column).alias("ols_slope"), F.col(outcome.variance).alias("slope_var"))
        d.params = {(r.seed, r.fold): (r.mu, r.tau2) for r in training_params(folded).collect()}
    return d


def training_medians(df: DataFrame, d: Design, columns: list[str]) -> dict[tuple[int, int, str], float]:
    """Exact median of each column over each training set, from one distributed sort of the values."""
    sets = [(s, f) for s in d.seeds for f in range(d.k)]
    folds = [f"__f{s}" for s in d.seeds]
    long = df.withColumns({f"__f{s}": d.fold(s) for s in d.seeds}).select(*folds, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")
    ).select(*folds, "e.feature", "e.value")
    c = cumulate(long, ["feature"], "value",
                 {f"t{s}_{f}": (F.col(f"__f{s}") != f).cast("long") for s, f in sets})
    aggs = []
    for s, f in sets:
        cum, here, n = F.col(f"cum_t{s}_{f}"), F.col(f"t{s}_{f}"), F.col(f"tot_t{s}_{f}")
        for tag, pos in (("a", F.floor((n - 1) / 2)), ("b", F.ceil((n - 1) / 2))):
            aggs.append(F.max(F.when((cum - here <= pos) & (pos < cum), F.col("value"))).alias(f"{tag}{s}_{f}"))
    rows = c.groupBy("feature").agg(*aggs).collect()
    return {(s, f, r["feature"]): (0.0 if r[f"a{s}_{f}"] is None else 0.5 * (r[f"a{s}_{f}"] + r[f"b{s}_{f}"]))
            for r in rows for s, f in sets}


def _outcome_array(d: Design, cols: dict[str, np.ndarray], seed: int, fold: int) -> np.ndarray:
    y = cols[d.outcome.column]
    if not d.outcome.variance:
        return y
    mu, tau2 = d.params.get((seed, fold), (0.0, 0.0))  # a fold whose training set has no rows
    v = cols[d.outcome.variance]
    w = np.divide(tau2, tau2 + v, out=np.zeros_like(v), where=(tau2 + v) > 0)
    return mu + w * (y - mu)


def _matrix(d: Design, cols: dict[str, np.ndarray]) -> np.ndarray:
    """[1, centred values with gaps as 0, missing flags] for a batch."""
    n = len(cols[d.outcome.column])
    parts = [np.ones(n)]
    parts += [np.nan_to_num(cols[c] - d.center[c]) for c in d.features]
    parts += [np.isnan(cols[c]).astype(float) for c in d.gappy]
    return np.column_stack(parts)


def design_columns(d: Design) -> list[Column]:
    """The numeric columns a pass needs, with fold ids computed in the JVM."""
    keep = [F.col(c).cast("double").alias(c) for c in [*d.features, *d.outcome.columns]]
    for s in d.seeds:
        inner = fold_of(d.subject, s, d.inner_k, "inner") if d.inner_k > 1 else F.lit(0)
        keep += [d.fold(s).alias(f"__o{s}"), inner.alias(f"__g{s}")]
    return keep


def _design_rows(df: DataFrame, d: Design) -> DataFrame:
    rep = F.col(d.rep).cast("int") if d.rep else F.lit(0)
    return df.dropna(subset=d.outcome.columns).select(rep.alias("__rep"), *design_columns(d))


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for b in it:
        if b.num_rows:
            # Arrow NULLs become NaN on the float columns.
            yield {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}


SUMS = "rep int, seed int, slot int, sums array<double>"
SLOTS = 32  # rows that carry a key's sums into its last merge, at most


def _layout(d: Design, held_out: bool) -> list[tuple[int, ...]]:
    """Shapes of a key's parts: X'X by (outer, inner) fold; [X'y, y'y] of each training set by inner fold; the same of each test fold."""
    q = d.width
    return [(d.k, d.inner_k, q, q), (d.k, d.inner_k, q + 1), (d.k if held_out else 0, q + 1)]


def _split(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])
    return [x.reshape(s) for x, s in zip(np.split(flat, cuts[:-1]), shapes, strict=True)]


def _sum_batch(sums: dict[tuple[int, int], np.ndarray], slot: int) -> pa.RecordBatch:
    size = len(next(iter(sums.values())))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * size), pa.array(np.concatenate(list(sums.values()))))
    keys = np.array(list(sums), dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.full(len(sums), slot, np.int32)), lists], ["rep", "seed", "slot", "sums"])


def _added(it: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], np.ndarray]:
    """Sum of the arrays of each (rep, seed)."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in it:
        lists = b.column("sums")
        for rep, seed, lo, hi in zip(b.column("rep").to_pylist(), b.column("seed").to_pylist(), lists.offsets.to_pylist(), lists.offsets.to_pylist()[1:]):
            values = lists.values.to_numpy()[lo:hi]
            if (rep, seed) in total:
                total[rep, seed] += values
            else:
                total[rep, seed] = values.copy()
    return total


def _merged(partials: DataFrame) -> DataFrame:
    """First level: the arrays of the tasks of a slot are added up. The second is `_added` by whoever takes the keys."""

    def merge(it):
        total = _added(it)
        if total:
            yield _sum_batch(total, 0)

    return partials.repartition("rep", "seed", "slot").mapInArrow(merge, SUMS).repartition("rep", "seed")


def fold_sums(df: DataFrame, d: Design, held_out: bool = False, more: DataFrame | None = None) -> DataFrame:
    """Cross products per fold cell, as one array for each (rep, seed), dealt by key for `_solved`.

    Each task adds its rows up to one array a key, tasks are merged in two levels, and no number goes to the driver:
    what is shuffled is seeds x folds x inner folds x columns^2 numbers a task, whatever the row count. `more` are arrays of
    other rows (`sums_of_tables`).
    """
    partials = _design_rows(df, d).mapInArrow(_partial_sums(d, held_out), SUMS)
    return _merged(partials.unionByName(more) if more is not None else partials)


def sums_of_tables(d: Design, held_out: bool = False) -> Callable[[pa.Table], pa.Table]:
    """The arrays of `fold_sums` for an Arrow table of `rep` and `design_columns`, in the task that has it."""
    partial = _partial_sums(d, held_out)

    def sums(table: pa.Table) -> pa.Table:
        table = table.rename_columns(["__rep" if c == "rep" else c for c in table.column_names])
        known = np.ones(table.num_rows, bool)
        for c in d.outcome.columns:
            known &= ~np.isnan(table[c].to_numpy())
        found = list(partial(table.filter(pa.array(known)).combine_chunks().to_batches()))
        return pa.Table.from_batches(found) if found else to_arrow_schema(T.StructType.fromDDL(SUMS)).empty_table()

    return sums


def _partial_sums(d: Design, held_out: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shapes = _layout(d, held_out)
    size = sum(int(np.prod(s)) for s in shapes)
    cells = np.arange((d.k + 1) * d.inner_k + 1)

    def partial(it):
        slot = TaskContext.get().partitionId() % SLOTS
        total: dict[tuple[int, int], np.ndarray] = {}
        for cols in _batches(it):
            by = np.argsort(cols["__rep"], kind="stable")
            reps, first = np.unique(cols["__rep"][by], return_index=True)
            for rep, rows in zip(reps.tolist(), np.split(by, first[1:]), strict=True):
                part = {n: v[rows] for n, v in cols.items()}
                z = _matrix(d, part)
                for s in d.seeds:
                    gram, cross, held = _split(total.setdefault((rep, s), np.zeros(size)), shapes)
                    o, g = part[f"__o{s}"], part[f"__g{s}"]
                    # Rows of no fold train every model. Each cell's rows are neighbours after one sort.
                    cell = (np.where((o >= 0) & (o < d.k), o, d.k) * d.inner_k + g).astype(np.int16 if len(cells) < 1 << 15 else np.int64)
                    order = np.argsort(cell, kind="stable")
                    y = np.column_stack([_outcome_array(d, part, s, a) for a in range(d.k)])[order]
                    zs, ends = z[order], np.searchsorted(cell[order], cells)
                    for c in np.flatnonzero(np.diff(ends)):
                        (own, b), here = divmod(int(c), d.inner_k), slice(ends[c], ends[c + 1])
                        zc, yc = zs[here], y[here]
                        found = np.column_stack([yc.T @ zc, (yc * yc).sum(0)])
                        if own < d.k:
                            gram[own, b] += zc.T @ zc
                            if held_out:
                                held[own] += found[own]
                        found[own:own + 1] = 0.0
                        cross[:, b] += found
        if total:
            yield _sum_batch(total, slot)

    return partial


def _solved(sums: DataFrame, solve: Callable[[int, int, np.ndarray], list[dict]], schema: str) -> DataFrame:
    """Rows of `solve(rep, seed, sums)` for every key, in the tasks that hold the keys."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(it):
        for (rep, seed), flat in _added(it).items():
            rows = solve(rep, seed, flat)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return sums.mapInArrow(run, schema)


@dataclass
class _Train:
    """Sums of one arm's training set in standardised columns, split by inner fold."""

    gram: np.ndarray      # (inner_k, p + 1, p + 1), intercept first
    cross: np.ndarray     # (inner_k, p + 1)
    yy: np.ndarray        # (inner_k,)
    mean: np.ndarray
    scale: np.ndarray
    fill: np.ndarray      # raw units
    basis: np.ndarray     # stored columns -> intercept and standardised columns


def _training_set(gram: np.ndarray, crossed: np.ndarray, d: Design, arm: Arm, seed: int, fold: int) -> _Train | None:
    """None if the training set has fewer than two rows."""
    q, p = d.width, len(arm.columns)
    raw = gram[np.arange(d.k) != fold].sum(0)
    cross, yy = crossed[fold, :, :q], crossed[fold, :, q]
    if raw[:, 0, 0].sum() < 2:
        return None
    fill = np.array([d.fill.get((seed, fold, c), d.center[c]) for c in arm.columns])
    # Linear map from the stored columns to filled, centred ones.
    to_filled = np.zeros((q, p + 1))
    to_filled[0, 0] = 1.0
    for j, c in enumerate(arm.columns):
        to_filled[1 + d.features.index(c), j + 1] = 1.0
        if c in d.gappy:
            to_filled[1 + len(d.features) + d.gappy.index(c), j + 1] = fill[j] - d.center[c]
    total = to_filled.T @ raw.sum(0) @ to_filled
    n = total[0, 0]
    mean = total[0, 1:] / n
    var = np.maximum(np.diag(total)[1:] / n - mean ** 2, 0.0)
    size = np.maximum(np.diag(total)[1:] / n, 1e-300)
    scale = np.where(var > 1e-14 * size, np.sqrt(var), 1.0)
    std = np.eye(p + 1)
    std[0, 1:] = -mean / scale
    std[1:, 1:] = np.diag(1.0 / scale)
    m = to_filled @ std
    return _Train(m.T @ raw @ m, cross @ m, yy, mean, scale, fill, m)


def _fit(gram: np.ndarray, cross: np.ndarray, yy: float, kind: str, grid: tuple) -> np.ndarray:
    """Coefficients (intercept first) for each grid point, intercept not penalised."""
    n = gram[0, 0]
    mx, my = gram[0, 1:] / n, cross[0] / n
    sxx = gram[1:, 1:] - np.outer(mx, mx) * n
    sxy = cross[1:] - mx * cross[0]
    if kind == "ridge":
        lam, vec = np.linalg.eigh(sxx)
        proj = vec.T @ sxy
        # A grid value that a caller means as "no penalty" still needs a solvable system.
        betas = [vec @ (proj / np.maximum(lam + a, 1e-12)) for a in grid]
    else:
        betas = _elastic_path(sxx / n, sxy / n, max(yy / n - my * my, 0.0), grid)
    return np.array([np.concatenate([[my - mx @ b], b]) for b in betas])


def _elastic_path(sxx: np.ndarray, sxy: np.ndarray, syy: float, grid: tuple) -> list[np.ndarray]:
    """Elastic-net coefficients for each (alpha, share of l1), each fit begun at the one with the next larger l1 penalty."""
    out: dict[int, np.ndarray] = {}
    beta = np.zeros(len(sxy))
    for i in sorted(range(len(grid)), key=lambda i: -grid[i][0] * grid[i][1]):
        beta = out[i] = _elastic(sxx, sxy, *grid[i], syy, beta)
    return [out[i] for i in range(len(grid))]


def _elastic(sxx: np.ndarray, sxy: np.ndarray, alpha: float, l1: float, syy: float, start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent for |y - Xb|^2 / 2n + alpha (l1 |b| + (1 - l1) |b|^2 / 2) on mean cross products.

    Ends when the duality gap is under 1e-13 of y's variance, or no coefficient moves any more in double precision.
    """
    beta = np.zeros(len(sxy)) if start is None else start.copy()
    lasso, ridge = alpha * l1, alpha * (1 - l1)
    while True:
        worst = 0.0
        for j in range(len(beta)):
            rest = sxy[j] - sxx[j] @ beta + sxx[j, j] * beta[j]
            new = np.sign(rest) * max(abs(rest) - lasso, 0.0) / (sxx[j, j] + ridge or 1.0)
            worst, beta[j] = max(worst, abs(new - beta[j])), new
        if worst <= 1e-15 * np.abs(beta).max(initial=0.0) or _gap(sxx, sxy, syy, beta, lasso, ridge) <= 1e-13 * syy:
            return beta


def _gap(sxx: np.ndarray, sxy: np.ndarray, syy: float, beta: np.ndarray, lasso: float, ridge: float) -> float:
    """How far the objective can be above its minimum: primal less dual at the residuals, scaled to be dual feasible."""
    fit = sxx @ beta
    rss = syy - 2 * beta @ sxy + beta @ fit
    steep = np.abs(sxy - fit - ridge * beta).max(initial=0.0)
    c = 1.0 if steep <= lasso else lasso / steep
    return 0.5 * rss * (1 + c * c) + lasso * np.abs(beta).sum() - c * (syy - beta @ sxy) + 0.5 * ridge * (1 + c * c) * (beta @ beta)


def _sse(gram: np.ndarray, cross: np.ndarray, yy: float, coef: np.ndarray) -> float:
    return yy - 2.0 * coef @ cross + coef @ gram @ coef


def _choose_inner(t: _Train, arm: Arm) -> int:
    """Grid index with the best mean inner-fold R2; the first one on ties."""
    scores = []
    for b in range(len(t.yy)):
        held = t.gram[b]
        n = held[0, 0]
        if n < 1 or t.gram[:, 0, 0].sum() - n < 2:
            continue
        sst = t.yy[b] - t.cross[b][0] ** 2 / n
        if sst <= 0:
            continue
        fits = _fit(t.gram.sum(0) - held, t.cross.sum(0) - t.cross[b], t.yy.sum() - t.yy[b], arm.kind, arm.grid)
        scores.append([1.0 - _sse(held, t.cross[b], t.yy[b], c) / sst for c in fits])
    if not scores:
        return 0
    mean = np.mean(scores, axis=0)
    return int(np.flatnonzero(mean >= mean.max() - 1e-12)[0])


def _chosen(t: _Train, arm: Arm, pick: int | None = None) -> tuple[np.ndarray, int]:
    """Coefficients at the chosen penalty, and its place in the grid."""
    if pick is None:
        pick = _choose_inner(t, arm) if len(arm.grid) > 1 else 0
    return _fit(t.gram.sum(0), t.cross.sum(0), t.yy.sum(), arm.kind, (arm.grid[pick],))[0], pick


def pooled_scores(df: DataFrame, d: Design, arms: list[Arm], more: DataFrame | None = None) -> DataFrame:
    """Pooled out-of-fold R2 per (rep, arm, seed) from the sums alone: one pass over the rows. Lazy.

    A test fold's squared error is y'y - 2 b'X'y + b'X'Xb, so no row is predicted. Meant for the many runs
    (permutations, noise draws, control arms, subsets) of which only the score is wanted. `n` counts scored rows,
    `unscored` those of folds whose training set has fewer than two rows. `more` are the sums of further rows.
    """
    shapes, q = _layout(d, True), d.width

    def solve(rep: int, seed: int, flat: np.ndarray) -> list[dict]:
        gram, cross, held = _split(flat, shapes)
        out = []
        for arm in arms:
            n = sy = syy = sse = unscored = 0.0
            for f in range(d.k):
                own = gram[f].sum(0)
                if not own[0, 0]:
                    continue
                t = _training_set(gram, cross, d, arm, seed, f)
                if t is None:
                    unscored += own[0, 0]
                    continue
                coef, _ = _chosen(t, arm)
                sse += _sse(t.basis.T @ own @ t.basis, held[f, :q] @ t.basis, held[f, q], coef)
                n, sy, syy = n + own[0, 0], sy + held[f, 0], syy + held[f, q]
            sst = syy - sy * sy / n if n else 0.0
            out.append({"rep": rep, "arm": arm.name, "seed": seed, "n": int(n), "unscored": int(unscored), "r2": float(1.0 - sse / sst) if sst > 0 else None})
        return out

    return _solved(fold_sums(df, d, True, more), solve, "rep int, arm string, seed int, n long, unscored long, r2 double")


def fit_folds(df: DataFrame, d: Design, arms: list[Arm]) -> DataFrame:
    """One row per (rep, seed, fold): training `mu`, `tau2`, and per arm a struct `m_<arm>` of intercept `a0`, coefficients `b` and
    fills `f` in raw units and the `penalty`'s place in the grid; NULL where the training set has fewer than two rows. Lazy but for leave-one-out tuning."""
    shapes = _layout(d, False)
    sums = fold_sums(df, d)
    tuned = [a for a in arms if a.tune == "loo" and len(a.grid) > 1]
    picks: dict = {}
    if tuned:
        sums = cut_lineage(sums).repartition("rep", "seed")
        picks = loo_choice(df, d, tuned, sums)

    def solve(rep: int, seed: int, flat: np.ndarray) -> list[dict]:
        gram, cross, _ = _split(flat, shapes)
        out = []
        for f in range(d.k):
            mu, tau2 = d.params.get((seed, f), (0.0, 0.0))
            row = {"rep": rep, "seed": seed, "fold": f, "mu": mu, "tau2": tau2}
            for a in arms:
                t = _training_set(gram, cross, d, a, seed, f)
                if t is not None:
                    coef, pick = _chosen(t, a, picks.get((rep, seed, a.name, f)))
                    slope = coef[1:] / t.scale
                    base = coef[0] - slope @ (t.mean + np.array([d.center[c] for c in a.columns]))
                    row[f"m_{a.name}"] = {"a0": float(base), "b": slope.tolist(), "f": t.fill.tolist(), "penalty": pick}
                else:
                    row[f"m_{a.name}"] = None
            out.append(row)
        return out

    models = ", ".join(f"`m_{a.name}` struct<a0:double,b:array<double>,f:array<double>,penalty:int>" for a in arms)
    return _solved(sums, solve, f"rep int, seed int, fold int, mu double, tau2 double, {models}")


def loo_choice(df: DataFrame, d: Design, arms: list[Arm], sums: DataFrame) -> dict[tuple[int, int, str, int], int]:
    """Penalty place by leave-one-out error (leverage form) for each (rep, seed, arm, fold), with one extra pass over the rows.

    The driver gets the spectra of the training sets and then one number a model.
    """
    shapes = _layout(d, False)

    def spectra(rep: int, seed: int, flat: np.ndarray) -> list[dict]:
        gram, cross, _ = _split(flat, shapes)
        out = []
        for i, a in enumerate(arms):
            for f in range(d.k):
                t = _training_set(gram, cross, d, a, seed, f)
                if t is not None:
                    g, c = t.gram.sum(0), t.cross.sum(0)
                    lam, vec = np.linalg.eigh(g[1:, 1:])
                    out.append({"rep": rep, "seed": seed, "arm": i, "fold": f, "n": float(g[0, 0]), "ybar": float(c[0] / g[0, 0]), "lam": lam.tolist(), "vec": vec.ravel().tolist(),
                                "proj": (vec.T @ c[1:]).tolist(), "mean": t.mean.tolist(), "scale": t.scale.tolist(), "fill": t.fill.tolist()})
        return out

    numbers = ", ".join(f"{c} array<double>" for c in ("lam", "vec", "proj", "mean", "scale", "fill"))
    rows = _solved(sums, spectra, f"rep int, seed int, arm int, fold int, n double, ybar double, {numbers}").collect()
    work = [(r.rep, r.seed, r.arm, r.fold, r.n, r.ybar, *(np.array(r[c]) for c in ("lam", "vec", "proj", "mean", "scale", "fill"))) for r in rows]
    most = max(len(a.grid) for a in arms)

    def partial(it):
        slot = TaskContext.get().partitionId() % SLOTS
        total: dict[tuple[int, int], np.ndarray] = {}
        for cols in _batches(it):
            for rep, s, i, f, n, ybar, lam, vec, proj, mean, scale, fill in work:
                m = (cols[f"__o{s}"] != f) & (cols["__rep"] == rep)
                if not m.any():
                    continue
                arm, p = arms[i], len(lam)
                y = _outcome_array(d, {k: v[m] for k, v in cols.items()}, s, f)
                x = np.column_stack([np.where(np.isnan(cols[c][m]), fill[j], cols[c][m]) - d.center[c]
                                     for j, c in enumerate(arm.columns)])
                u = ((x - mean) / scale) @ vec.reshape(p, p)
                errs = total.setdefault((rep, s), np.zeros(len(arms) * d.k * most)).reshape(len(arms), d.k, most)
                for g, a in enumerate(arm.grid):
                    h = 1.0 / n + (u ** 2) @ (1.0 / (lam + a))
                    e = (y - ybar - u @ (proj / (lam + a))) / (1.0 - h)
                    errs[i, f, g] += e @ e
        if total:
            yield _sum_batch(total, slot)

    def choose(rep: int, seed: int, flat: np.ndarray) -> list[dict]:
        errs = flat.reshape(len(arms), d.k, most)
        return [{"rep": rep, "seed": seed, "arm": i, "fold": f, "pick": int(np.argmin(errs[i, f, :len(a.grid)]))} for i, a in enumerate(arms) for f in range(d.k)]

    found = _solved(_merged(_design_rows(df, d).mapInArrow(partial, SUMS)), choose, "rep int, seed int, arm int, fold int, pick int").collect()
    return {(r.rep, r.seed, arms[r.arm].name, r.fold): r.pick for r in found}


def predict_folds(df: DataFrame, d: Design, arms: list[Arm], fits: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Out-of-fold rows: seed, fold, subject, y, one prediction column per arm, and `status`: `ok`, or `no_fit` with NULL
    predictions where a fold's training set has fewer than two rows. Every row comes out once a seed.

    The join side has seeds x folds (x reps) rows; without reps its size is known and it is broadcast up to a limit.
    """
    numbers = len(d.seeds) * d.k * sum(3 + 2 * len(a.columns) for a in arms)
    table = fits if d.rep else small_or_shuffled(fits.drop("rep"), numbers)
    rows = d.folded(df.dropna(subset=d.outcome.columns))
    on = ["seed", "fold"]
    if d.rep:
        rows, on = rows.withColumn("rep", F.col(d.rep).cast("int")), ["rep", *on]
    j = rows.join(table, on, "left")
    y = F.col(d.outcome.column).cast("double")
    if d.outcome.variance:
        y = shrunken(F.col("mu"), F.col("tau2"), y, F.col(d.outcome.variance))
    whole = F.lit(True)
    for a in arms:
        whole = whole & F.col(f"m_{a.name}").isNotNull()
    return j.select(*on, d.subject, y.alias("y"), *[_score(a).alias(f"pred_{a.name}") for a in arms],
                    F.when(whole, "ok").otherwise("no_fit").alias("status"), *(carry or []))


BROADCAST_NUMBERS = 5_000_000


def small_or_shuffled(table: DataFrame, numbers: int) -> DataFrame:
    """Broadcast a table of `numbers` values (counted, not estimated) if that is small; else leave the join to Spark."""
    return F.broadcast(table) if numbers <= BROADCAST_NUMBERS else table


def _score(arm: Arm) -> Column:
    m = F.col(f"m_{arm.name}")
    out = m["a0"]
    for i, c in enumerate(arm.columns):
        out = out + m["b"][i] * F.coalesce(F.col(c).cast("double"), m["f"][i])
    return out


def nested_cv(df: DataFrame, subject: str, outcome: Outcome, arms: list[Arm], *, k: int = 5, inner_k: int = 5,
              seeds: list[int] | None = None, carry: list[str] | None = None, rep: str | None = None,
              fold_cols: dict[int, str] | None = None) -> DataFrame:
    """Repeated nested cross-validation of all arms on identical folds and rows.

    Fold-dependent outcomes (shrunken slopes) are refitted on each training
    set; filling, scaling and penalty choice see training rows only.
    """
    features = sorted({c for a in arms for c in a.columns})
    rows = narrow(df, subject, features, outcome, [*(carry or []), *([rep] if rep else []), *(fold_cols or {}).values()])
    d = prepare(rows, subject, features, outcome, seeds or [0], k, inner_k, rep, fold_cols)
    return predict_folds(rows, d, arms, fit_folds(rows, d, arms), carry)


def narrow(df: DataFrame, subject: str, features: list[str], outcome: Outcome, more: list[str] | None = None) -> DataFrame:
    """The columns that the passes over the rows need, evaluated once and written."""
    return cut_lineage(df.select(*dict.fromkeys([subject, *outcome.columns, *features, *(more or [])])))


def long_predictions(oof: DataFrame, arms: list[str], keys: list[str]) -> DataFrame:
    """Wide out-of-fold rows to (keys..., arm, y, pred). Narrow: no shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"pred_{a}").alias("pred")) for a in arms]))
    return oof.select(*keys, "y", each.alias("e")).select(*keys, "y", "e.arm", "e.pred")
