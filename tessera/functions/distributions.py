"""Student's t, Fisher's F and the normal distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# A public rational approximation of the normal quantile, good to
# 1.2e-9 relative; numerators and denominators of the middle and of the tails.
MIDDLE = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
MIDDLE_BELOW = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BELOW = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL_AT = 0.02425


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function: the share of Beta(a, b) below x,
    by its continued fraction, evaluated from the far end of 400 terms."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    fraction = 0.0
    for m in range(400, 0, -1):
        half, odd = divmod(m, 2)
        if odd:
            term = -(a + half) * (a + b + half) * x / ((a + 2 * half) * (a + 2 * half + 1))
        else:
            term = half * (b - half) * x / ((a + 2 * half - 1) * (a + 2 * half))
        fraction = term / (1 + fraction)
    front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return math.exp(front) / (a * (1 + fraction))


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return beta_share(df / (df + t * t), df / 2, 0.5) if df > 0 and t == t else float("nan")


def f_above(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    return beta_share(df2 / (df2 + df1 * f), df2 / 2, df1 / 2) if f > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    """The t that a share p lies below, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 2 * (1 - p) and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def _polynomial(c: tuple[float, ...], x: Column) -> Column:
    out = F.lit(c[0])
    for v in c[1:]:
        out = out * x + F.lit(v)
    return out


def normal_quantile(p: Column) -> Column:
    """The normal quantile of a share, as a column expression."""
    q = p - 0.5
    middle = q * _polynomial(MIDDLE, q * q) / _polynomial(MIDDLE_BELOW, q * q)
    tail = lambda s: _polynomial(TAIL, F.sqrt(-2 * F.log(s))) / _polynomial(TAIL_BELOW, F.sqrt(-2 * F.log(s)))
    return F.when(p < TAIL_AT, tail(p)).when(p > 1 - TAIL_AT, -tail(1 - p)).otherwise(middle)
