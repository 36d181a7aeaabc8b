"""Tail probabilities.

The normal tail is a JVM column expression, as it is needed on every row of a
summary-statistics table. The t tail, t quantile and Fisher test run once per
*aggregated* row (one per group), as Arrow functions over NumPy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exprs import as_col

# The rational approximations of erf/erfc of W. J. Cody (1969),
# relative error below 1e-15. Numerators and denominators, highest power first
# after the leading one, in the order of the published tables.
ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
           3.77485237685302021e2, 3.20937758913846947e3)
ERF_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2,
           1.28261652607737228e3, 2.84423683343917062e3)
ERFC_MID_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
                6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
                1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
ERFC_MID_DEN = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
                1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
                3.43936767414372164e3, 1.23033935480374942e3)
ERFC_FAR_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
                1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
ERFC_FAR_DEN = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1,
                6.05183413124413191e-2, 2.33520497626869185e-3)
ONE_OVER_SQRT_PI = 5.6418958354775628695e-1


def _horner(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def _horner_sql(coefs, x: str) -> str:
    out = f"{coefs[0]!r}::DOUBLE"
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def erfc_nonneg(x: Column) -> Column:
    """erfc for x >= 0."""
    sq = x * x
    near = F.lit(1.0) - x * _horner(ERF_NUM, sq) / _horner(ERF_DEN, sq)
    mid = F.exp(-sq) * _horner(ERFC_MID_NUM, x) / _horner(ERFC_MID_DEN, x)
    inv = F.lit(1.0) / F.greatest(sq, F.lit(1.0))
    far = F.exp(-sq) / x * (F.lit(ONE_OVER_SQRT_PI) - inv * _horner(ERFC_FAR_NUM, inv) / _horner(ERFC_FAR_DEN, inv))
    return F.when(x <= 0.46875, near).when(x <= 4.0, mid).otherwise(far)


def normal_two_sided_p(z: Column | str) -> Column:
    """2 * (1 - Phi(|z|)), accurate in the far tail."""
    return erfc_nonneg(F.abs(as_col(z)) / F.lit(math.sqrt(2.0)))


def normal_two_sided_p_sql(z: str) -> str:
    """The same expression as ANSI SQL text, for checking in another engine."""
    x = f"(abs({z}) / {math.sqrt(2.0)!r}::DOUBLE)"
    sq = f"({x} * {x})"
    inv = f"(1.0::DOUBLE / greatest({sq}, 1.0::DOUBLE))"
    near = f"1.0 - {x} * {_horner_sql(ERF_NUM, sq)} / {_horner_sql(ERF_DEN, sq)}"
    mid = f"exp(-{sq}) * {_horner_sql(ERFC_MID_NUM, x)} / {_horner_sql(ERFC_MID_DEN, x)}"
    far = (f"exp(-{sq}) / {x} * ({ONE_OVER_SQRT_PI!r}::DOUBLE - {inv} * {_horner_sql(ERFC_FAR_NUM, inv)}"
           f" / {_horner_sql(ERFC_FAR_DEN, inv)})")
    return f"(CASE WHEN {x} <= 0.46875 THEN {near} WHEN {x} <= 4.0 THEN {mid} ELSE {far} END)"


# --- per-aggregated-row functions -------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def t_point(prob: float, df: float) -> float:
    """Quantile of Student's t for prob > 0.5, by bisection on the tail."""
    lo, hi = 0.0, 1.0
    while 0.5 * t_tail(hi, df) > 1.0 - prob:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if 0.5 * t_tail(mid, df) > 1.0 - prob else (lo, mid)
    return 0.5 * (lo + hi)


def fisher_tail(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p of [[a, b], [c, d]]: all tables no likelier than the seen one.

    The hypergeometric law has one mode, so both tails are summed outwards from
    where they start and stop once their terms vanish: work grows with the
    spread of the law, not with its support.
    """
    row, col, total = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - total), min(row, col)
    if lo == hi:
        return 1.0

    def logp(k: int) -> float:
        return (math.lgamma(row + 1) - math.lgamma(k + 1) - math.lgamma(row - k + 1)
                + math.lgamma(total - row + 1) - math.lgamma(col - k + 1)
                - math.lgamma(total - row - col + k + 1)
                - math.lgamma(total + 1) + math.lgamma(col + 1) + math.lgamma(total - col + 1))

    limit = logp(a) + 1e-7
    mode = min(hi, max(lo, (row + 1) * (col + 1) // (total + 2)))

    def edge(left: bool) -> int | None:
        """Innermost k of a tail whose probability is within the limit."""
        inner, outer = mode, (lo if left else hi)
        if logp(outer) > limit:
            return None
        if logp(inner) <= limit:
            return inner
        while abs(outer - inner) > 1:
            mid = (inner + outer) // 2
            inner, outer = (inner, mid) if logp(mid) <= limit else (mid, outer)
        return outer

    def tail(start: int | None, step: int) -> float:
        total_p, k = 0.0, start
        while k is not None and lo <= k <= hi:
            term = math.exp(logp(k))
            total_p += term
            if term < total_p * 1e-17:
                break
            k += step
        return total_p

    left, right = edge(True), edge(False)
    if left is not None and left == right:
        return 1.0
    return min(1.0, tail(left, -1) + tail(right, 1))


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(x, k) if np.isfinite(x) and k > 0 else None
                      for x, k in zip(t.astype(float), df.astype(float))], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_quantile(prob: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_point(p, k) if k > 0 else None
                      for p, k in zip(prob.astype(float), df.astype(float))], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fisher_exact_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_tail(int(w), int(x), int(y), int(z))
                      for w, x, y, z in zip(a, b, c, d)], dtype="float64")
