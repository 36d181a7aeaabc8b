"""SQL counterparts of tuned linear and logistic models with any number of columns.

A row's columns are one list; cross products are lists of numbers in a fixed order, and systems are solved by Gauss-Jordan
elimination written as a fold over the pivots, all inside DuckDB.
"""

from __future__ import annotations


def eliminated(system: str, p: int, rights: int = 1) -> str:
    """Gauss-Jordan elimination of p rows of p + `rights` numbers, given as one list: the right sides become solutions."""
    w = p + rights
    at = lambda i, j: f"m[({i}) * {w} + ({j}) + 1]"
    k = "s[1]::BIGINT"
    step = (f"list_transform(range({p * w}), lambda z: CASE WHEN z // {w} = {k} THEN {at(k, f'z % {w}')} / {at(k, k)} "
            f"ELSE {at(f'z // {w}', f'z % {w}')} - {at(f'z // {w}', k)} * {at(k, f'z % {w}')} / {at(k, k)} END)")
    return f"list_reduce(list_prepend({system}, [{', '.join(f'[{i}::DOUBLE]' for i in range(p))}]), lambda m, s: {step})"


def solve(system: str, p: int) -> str:
    """Solution list of a p by p system given as one list of p rows of p + 1 numbers (right side last)."""
    return f"list_select({eliminated(system, p)}, [{', '.join(str((i + 1) * (p + 1)) for i in range(p))}])"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(len({a})), lambda i: {a}[i + 1] * {b}[i + 1]))"


def linear_cv_sql(rows: str, p: int, arms: dict[str, dict], inner_k: int = 5, y: str = "mu + tau2 / (tau2 + v) * (b - mu)", sweeps: int = 400) -> str:
    """Cross-validated linear arms on the columns in list `x` (NULL: gap, filled with the training median), by sums.

    `rows` is SQL text that ends in a table x(id, seed, b, v, x, o, g). An arm has `columns` (places in x from 0), `grid`
    (ridge penalties, or pairs of penalty and l1 share), chosen by inner folds or, with `loo`, by leave-one-out error. The text ends in oof(seed, fold, id, y, pred_<arm>...).
    """
    e = p + 2  # a row's vector: 1, standardised columns, y
    out = f"""{rows}, ff AS (SELECT DISTINCT seed, o AS f FROM x),
  pr AS (SELECT x.seed, f, avg(b) AS mu, greatest(0, var_samp(b) - avg(v)) AS tau2 FROM x JOIN ff ON x.seed = ff.seed AND o <> f GROUP BY x.seed, f),
  lg AS (SELECT seed, id, o, unnest(x) AS val, unnest(range({p})) AS i FROM x),
  fl AS (SELECT lg.seed, f, i, coalesce(quantile_cont(val, 0.5), 0) AS med FROM lg JOIN ff ON lg.seed = ff.seed AND o <> f GROUP BY lg.seed, f, i),
  ms AS (SELECT fl.seed, fl.f, i, any_value(med) AS med, avg(coalesce(val, med)) AS m, stddev_pop(coalesce(val, med)) AS s FROM lg JOIN fl USING (seed, i) WHERE o <> fl.f GROUP BY fl.seed, fl.f, i),
  sc AS (SELECT seed, f, list(med ORDER BY i) AS med, list(m ORDER BY i) AS m, list(CASE WHEN s > 1e-7 * abs(m) THEN s ELSE 1 END ORDER BY i) AS s FROM ms GROUP BY seed, f),
  z AS (SELECT id, x.seed, f, o = f AS test, g, {y} AS y, list_transform(range({p}), lambda i: (coalesce(x.x[i + 1], med[i + 1]) - m[i + 1]) / s[i + 1]) AS a FROM x JOIN pr USING (seed) JOIN sc USING (seed, f)),
  zz AS (SELECT *, list_concat([1::DOUBLE], list_append(a, y)) AS e FROM z),
  cl AS (SELECT seed, f, g, i * {e} + j AS pos, sum(e[i + 1] * e[j + 1]) AS val FROM zz, (SELECT unnest(range({e})) AS i), (SELECT unnest(range({e})) AS j) WHERE NOT test GROUP BY seed, f, g, i, j),
  cell AS (SELECT seed, f, g, list(val ORDER BY pos) AS c FROM cl GROUP BY seed, f, g),
  tr AS (SELECT seed, f, h, list(val ORDER BY pos) AS c FROM (SELECT seed, f, h, pos, sum(val) AS val FROM cl, (SELECT unnest(range({inner_k + 1})) AS h) WHERE g <> h GROUP BY seed, f, h, pos) GROUP BY seed, f, h)"""
    joins, preds = "", ""
    for n, (name, arm) in enumerate(arms.items()):
        cols, grid = [c + 1 for c in arm["columns"]], arm["grid"]
        q = len(cols)
        net = isinstance(grid[0], tuple)
        place = f"[{', '.join(map(str, cols))}]"
        at = lambda i, j: f"c[({i}) * {e} + ({j}) + 1]"
        cov = lambda i, j: f"({at(i, j)} - {at(0, i)} * {at(0, j)} / c[1])"
        pick = lambda k: f"{place}[({k}) + 1]"
        right = f"CASE WHEN z % {q + 1} = {q} THEN {cov(pick(f'z // {q + 1}'), p + 1)} ELSE {cov(pick(f'z // {q + 1}'), pick(f'z % {q + 1}'))}"
        if net:
            system = f"list_transform(range({q * (q + 1)}), lambda z: ({right} END) / c[1])"
            j = f"(s[1]::BIGINT % {q})"
            rest = f"w[{j} * {q + 1} + {q + 1}] - list_sum(list_transform(range({q}), lambda k: CASE WHEN k = {j} THEN 0 ELSE w[{j} * {q + 1} + k + 1] * bb[k + 1] END))"
            new = f"sign({rest}) * greatest(abs({rest}) - alpha * l1, 0) / (w[{j} * {q + 1} + {j} + 1] + alpha * (1 - l1))"
            begin, steps = f"list_transform(range({q}), lambda k: 0::DOUBLE)", f"list_transform(range({sweeps * q}), lambda k: [k::DOUBLE])"
            solved = f"list_reduce(list_prepend({begin}, {steps}), lambda bb, s: list_transform(range({q}), lambda t: CASE WHEN t = {j} THEN {new} ELSE bb[t + 1] END))"
            table = f"(SELECT unnest([{', '.join(f'{a!r}::DOUBLE' for a, _ in grid)}]) AS alpha, unnest([{', '.join(f'{l!r}::DOUBLE' for _, l in grid)}]) AS l1, unnest(range({len(grid)})) AS ai)"
        else:
            system = f"list_transform(range({q * (q + 1)}), lambda z: {right} + CASE WHEN z // {q + 1} = z % {q + 1} THEN alpha ELSE 0 END END)"
            solved, table = solve("w", q), f"(SELECT unnest([{', '.join(f'{a!r}::DOUBLE' for a in grid)}]) AS alpha, unnest(range({len(grid)})) AS ai)"
        # The coefficients as a vector like a row's: intercept, columns (0 where not used), -1 for y.
        wide = ", ".join(f"bb[{cols.index(i) + 1}]" if i in cols else "0::DOUBLE" for i in range(1, p + 1))
        base = f"{at(0, p + 1)} / c[1] - list_sum(list_transform(range({q}), lambda i: bb[i + 1] * {at(0, pick('i'))} / c[1]))"
        choice = f"SELECT seed, f, min(ai) FILTER (WHERE r >= top - 1e-12) AS ai FROM (SELECT *, max(r) OVER (PARTITION BY seed, f) AS top FROM av{n}) GROUP BY seed, f"
        if len(grid) == 1:
            choice = "SELECT DISTINCT seed, f, 0 AS ai FROM tr"
        elif arm.get("loo"):
            unit = f"CASE WHEN z % {2 * q} >= {q} THEN CASE WHEN z % {2 * q} - {q} = z // {2 * q} THEN 1::DOUBLE ELSE 0 END"
            both = f"list_transform(range({2 * q * q}), lambda z: {unit} ELSE w[z // {2 * q} * {q + 1} + z % {2 * q} + 1] END)"
            lever = f"list_sum(list_transform(range({q * q}), lambda i: e[{pick(f'i // {q}')} + 1] * e[{pick(f'i % {q}')} + 1] * iv[i // {q} * {2 * q} + {q} + i % {q} + 1]))"
            choice = f"""SELECT seed, f, arg_min(ai, sse) AS ai FROM (SELECT zz.seed, zz.f, ai, sum((-list_sum(list_transform(range({e}), lambda i: e[i + 1] * i{n}.v[i + 1])) / (1 - 1 / i{n}.n - {lever}))^2) AS sse
              FROM zz JOIN (SELECT w.seed, w.f, w.ai, w.c[1] AS n, t.v, {eliminated("bothsides", q, q)} AS iv FROM (SELECT *, {both} AS bothsides FROM ws{n} WHERE h = {inner_k}) w JOIN ft{n} t USING (seed, f, h, ai)) i{n}
              ON zz.seed = i{n}.seed AND zz.f = i{n}.f WHERE NOT test GROUP BY zz.seed, zz.f, ai) GROUP BY seed, f"""
        err = f"list_sum(list_transform(range({e * e}), lambda i: v[i // {e} + 1] * v[i % {e} + 1] * k.c[i + 1]))"
        out += f""",
  ws{n} AS (SELECT seed, f, h, ai, c, {"alpha, l1, " if net else ""}{system} AS w FROM tr, {table}),
  fb{n} AS (SELECT *, {solved} AS bb FROM ws{n}),
  ft{n} AS (SELECT seed, f, h, ai, [{base}, {wide}, -1::DOUBLE] AS v FROM fb{n}),
  av{n} AS (SELECT seed, f, ai, avg(r) AS r FROM (SELECT t.seed, t.f, h, ai, 1 - {err} / (k.c[{e * e}] - k.c[{e}]^2 / k.c[1]) AS r FROM ft{n} t JOIN cell k ON k.seed = t.seed AND k.f = t.f AND k.g = t.h) GROUP BY seed, f, ai),
  pk{n} AS ({choice}),
  md{n} AS (SELECT seed, f, v FROM ft{n} JOIN pk{n} USING (seed, f, ai) WHERE h = {inner_k})"""
        joins += f" JOIN md{n} ON md{n}.seed = zz.seed AND md{n}.f = zz.f"
        preds += f", list_sum(list_transform(range({p + 1}), lambda i: e[i + 1] * md{n}.v[i + 1])) AS pred_{name}"
    return out + f""",
  oof AS (SELECT zz.seed, zz.f AS fold, id, y{preds} FROM zz{joins} WHERE test)"""


def newton_sql(rows: str, fits: str, q: int, steps: int) -> str:
    """Penalised logistic fits of all keys of `fits` (a select of key..., c: k1, k2, k3, k4, c) as table nt(k1, k2, k3, k4, c, step, beta).

    `rows` is a select of (k1, k2, k3, k4, e, y) for the training rows of each key; e begins with 1, whose coefficient has no penalty.
    """
    w = q + 1
    i, j = f"(pos // {w})", f"(pos % {w})"
    term = f"""CASE WHEN {j} = {q} THEN sum(e[{i} + 1] * (y - p)) - CASE WHEN {i} > 0 THEN any_value(beta[{i} + 1]) / any_value(c) ELSE 0 END
               ELSE sum(e[{i} + 1] * e[{j} + 1] * p * (1 - p)) + CASE WHEN {i} = {j} AND {i} > 0 THEN 1 / any_value(c) ELSE 0 END END"""
    return f"""ft AS ({fits}), tr AS MATERIALIZED ({rows}),
  nt(k1, k2, k3, k4, c, step, beta) AS (
    SELECT k1, k2, k3, k4, c, 0, list_transform(range({q}), lambda i: 0::DOUBLE) FROM ft
    UNION ALL
    SELECT k1, k2, k3, k4, c, step + 1, list_transform(range({q}), lambda i: beta[i + 1] + d[i + 1]) FROM (
      SELECT k1, k2, k3, k4, c, step, beta, {solve("w", q)} AS d FROM (
        SELECT k1, k2, k3, k4, any_value(c) AS c, any_value(step) AS step, any_value(beta) AS beta, list(val ORDER BY pos) AS w FROM (
          SELECT k1, k2, k3, k4, pos, any_value(c) AS c, any_value(step) AS step, any_value(beta) AS beta, {term} AS val
          FROM (SELECT nt.*, e, y, 1 / (1 + exp(-{dot("beta", "e")})) AS p FROM nt JOIN tr USING (k1, k2, k3, k4)), (SELECT unnest(range({q * w})) AS pos)
          GROUP BY k1, k2, k3, k4, pos) GROUP BY k1, k2, k3, k4) WHERE step < {steps})),
  be AS (SELECT k1, k2, k3, k4, beta FROM nt WHERE step = {steps})"""


def logistic_cv_sql(rows: str, p: int, grid: tuple[float, ...] = (1.0,), inner_k: int = 5, steps: int = 12) -> str:
    """Cross-validated logistic fits on the columns in list `x` (no gaps), penalty by mean inner AUC.

    `rows` is SQL text that begins with WITH RECURSIVE and ends in a table x(id, seed, y, x, o, g); the text ends in oof(seed, fold, id, y, pred).
    """
    ai = ", ".join(f"{c!r}::DOUBLE" for c in grid)
    scored = f"1 / (1 + exp(-{dot('beta', 'e')}))"
    tuned = len(grid) > 1
    every = f"(SELECT unnest([{ai}]) AS c, unnest(range({len(grid)})) AS a)"
    out = f"""{rows}, ff AS (SELECT DISTINCT seed, o AS f FROM x),
  lg AS (SELECT seed, o, unnest(x) AS val, unnest(range({p})) AS i FROM x),
  ms AS (SELECT lg.seed, f, i, avg(val) AS m, stddev_pop(val) AS s FROM lg JOIN ff ON lg.seed = ff.seed AND o <> f GROUP BY lg.seed, f, i),
  sc AS (SELECT seed, f, list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM ms GROUP BY seed, f),
  z AS MATERIALIZED (SELECT id, x.seed, f, o = f AS test, g, y, list_concat([1::DOUBLE], list_transform(range({p}), lambda i: (x.x[i + 1] - m[i + 1]) / s[i + 1])) AS e FROM x JOIN sc USING (seed)),
  {newton_sql(f"SELECT seed AS k1, f AS k2, h AS k3, a AS k4, e, y FROM z, (SELECT unnest(range({0 if tuned else inner_k}, {inner_k + 1})) AS h), {every} WHERE NOT test AND g <> h",
              f"SELECT seed AS k1, f AS k2, h AS k3, a AS k4, c FROM ff, (SELECT unnest(range({0 if tuned else inner_k}, {inner_k + 1})) AS h), {every}", p + 1, steps)}"""
    pick = "SELECT DISTINCT seed, f, 0 AS a FROM z"
    if tuned:
        out += f""",
  hd AS (SELECT k1 AS seed, k2 AS f, k3 AS h, k4 AS a, y, {scored} AS p FROM be JOIN z ON z.seed = k1 AND z.f = k2 AND z.g = k3 WHERE NOT test),
  rk AS (SELECT *, rank() OVER (PARTITION BY seed, f, h, a ORDER BY p) + (count(*) OVER (PARTITION BY seed, f, h, a, p) - 1) / 2.0::DOUBLE AS r FROM hd),
  ha AS (SELECT seed, f, h, a, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)) AS auc FROM rk GROUP BY seed, f, h, a),
  mn AS (SELECT seed, f, a, avg(auc) AS m FROM ha GROUP BY seed, f, a)"""
        pick = "SELECT seed, f, min(a) FILTER (WHERE m >= top - 1e-12) AS a FROM (SELECT *, max(m) OVER (PARTITION BY seed, f) AS top FROM mn) GROUP BY seed, f"
    return out + f""",
  pk AS ({pick}),
  oof AS (SELECT z.seed, z.f AS fold, id, y, {scored} AS pred FROM z JOIN pk USING (seed, f) JOIN be ON k1 = z.seed AND k2 = z.f AND k3 = {inner_k} AND k4 = a WHERE test)"""


AUC = "(sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y))"


def repeated_auc_sql(oof: str, keys: str) -> str:
    """Mean and range over seeds of the pooled AUC; `oof` names a table, `keys` its grouping columns with a comma after each."""
    part = f"{keys}seed"
    by = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""SELECT {keys}avg(auc) AS auc, min(auc) AS auc_lo, max(auc) AS auc_hi FROM (SELECT {part}, {AUC} AS auc FROM (
      SELECT *, rank() OVER (PARTITION BY {part} ORDER BY pred) + (count(*) OVER (PARTITION BY {part}, pred) - 1) / 2.0::DOUBLE AS r FROM {oof}) GROUP BY {part}) {by}"""
