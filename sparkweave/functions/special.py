"""Tails of the t, normal, chi-square and hypergeometric distributions, as column expressions and over arrays.

Small p values come from forms whose terms are all positive (continued fractions), so that they keep their relative
precision down to the smallest doubles; 1 - x is only taken where p is large.
"""

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BETA_LEVELS = 48  # of the continued fraction of the incomplete beta function, where it is used
NORMAL_TERMS, NORMAL_LEVELS = 40, 30  # of the series up to NEAR, and of the continued fraction beyond
NEAR = 3.0  # standard deviations up to which the normal tail is 1 - series


def t_angle(t: Column, df: int) -> Column:
    """What t_two_sided takes; a column of its own, so that it is worked out once."""
    return F.atan(F.abs(t) / math.sqrt(df))


def _beta_terms(a: float, b: float, levels: int):
    """Factors of x in the continued fraction of the incomplete beta function."""
    for k in range(1, levels + 1):
        m = k // 2
        yield m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))


def t_two_sided(theta: Column, df: int) -> Column:
    """Two-sided p of a t statistic with a whole number of degrees of freedom, from its t_angle.

    Close to 0 the closed form is taken, further out the continued fraction.
    """
    c2 = F.pow(F.cos(theta), 2)
    inner = F.lit(1.0)
    if df % 2 == 0:
        for j in range(df // 2 - 1, 0, -1):
            inner = F.lit(1.0) + inner * c2 * F.lit((2 * j - 1) / (2 * j))
        middle = F.greatest(F.lit(0.0), F.lit(1.0) - F.sin(theta) * inner)
    else:
        for j in range((df - 3) // 2, 0, -1):
            inner = F.lit(1.0) + inner * c2 * F.lit(2 * j / (2 * j + 1))
        body = theta + (F.sin(theta) * F.cos(theta) * inner if df > 1 else F.lit(0.0))
        middle = F.greatest(F.lit(0.0), F.lit(1.0) - body * F.lit(2 / math.pi))
    a, b = df / 2, 0.5
    fraction = F.lit(1.0)
    for d in reversed(list(_beta_terms(a, b, BETA_LEVELS))):
        fraction = F.lit(1.0) + F.lit(d) * c2 / fraction
    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - math.log(a)
    tail = F.exp(a * F.log(c2) + F.lit(scale)) * F.sin(theta) / fraction
    return F.when(c2 < (a + 1) / (a + b + 2) - 0.05, F.when(c2 > 0, tail).otherwise(0.0)).otherwise(middle)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: shifted above 8, then Stirling's series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift -= np.where(low, np.log(np.where(low, x, 1.0)), 0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * 691 / 360360))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series + shift


def digamma(x) -> np.ndarray:
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out -= np.where(low, 1 / np.where(low, x, 1.0), 0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132 - y * 691 / 32760)))))


def trigamma(x) -> np.ndarray:
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out += np.where(low, 1 / np.where(low, x, 1.0) ** 2, 0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * (5 / 66 - y * 691 / 2730)))))


def trigamma_inverse(y: float) -> float:
    """The positive x whose trigamma is y: Newton's steps on 1 / trigamma, which is nearly a line."""
    if y <= 0:
        return math.inf
    x = 0.5 + 1 / y
    for _ in range(50):
        t, h = float(trigamma(x)), x * 1e-6
        slope = float(trigamma(x + h) - trigamma(x - h)) / (2 * h)
        step = t * (1 - t / y) / slope
        x += step
        if abs(step) < 1e-10 * x:
            break
    return x


def t_tail_of(t, df) -> np.ndarray:
    """Two-sided p of t statistics with any positive degrees of freedom (arrays; infinite ones are normal)."""
    t, df = np.broadcast_arrays(np.abs(np.asarray(t, dtype=float)), np.asarray(df, dtype=float))
    out = np.where(np.isinf(t), 0.0, np.where(np.isinf(df), normal_tail(t), np.nan))
    some = np.isfinite(df) & np.isfinite(t) & (df > 0)
    if some.any():
        t, df = t[some], df[some]
        x, rest = df / (df + t * t), t * t / (df + t * t)
        far = x < (df / 2 + 1) / (df / 2 + 2.5)
        with np.errstate(divide="ignore"):
            p = np.where(far, _beta_part(df / 2, 0.5, x, rest), 1 - _beta_part(0.5, df / 2, rest, x))
        out[some] = np.clip(p, 0, 1)
    return out


def _beta_part(a, b, x, rest) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction; rest is 1 - x."""
    a, b, x, rest = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x, rest)))
    fraction = np.ones_like(x)
    levels = int(60 + 3 * math.sqrt(max(float(a.max()), float(b.max()))))
    for k in range(min(levels, 2000), 0, -1):
        m = k // 2
        d = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        fraction = 1 + d * x / fraction
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log(rest) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
    return np.where((x <= 0) | (rest < 0), 0.0, np.where(rest <= 0, 1.0, front / fraction))


def t_tail(theta, df: int):
    """t_two_sided of an array of angles."""
    return t_tail_of(np.tan(np.asarray(theta, dtype=float)) * math.sqrt(df), df)


def normal_tail(z):
    """normal_two_sided of an array."""
    z = np.abs(np.asarray(z, dtype=float))
    near = np.minimum(z, NEAR)
    x2, inner = near * near, np.ones_like(z)
    for k in range(NORMAL_TERMS, 0, -1):
        inner = 1 + inner * x2 / (2 * k + 1)
    middle = 1 - math.sqrt(2 / math.pi) * near * np.exp(-x2 / 2) * inner
    far = np.maximum(z, NEAR)
    fraction = np.ones_like(z)
    with np.errstate(invalid="ignore", over="ignore", under="ignore"):
        for k in range(NORMAL_LEVELS, 0, -1):
            fraction = 1 + k / (far * far) / fraction
        tail = np.exp(-far * far / 2) * math.sqrt(2 / math.pi) / far / fraction
    return np.where(np.isnan(z), np.nan, np.where(z < NEAR, np.maximum(0, middle), tail))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal statistic."""
    x2 = z * z
    inner = F.lit(1.0)
    for k in range(NORMAL_TERMS, 0, -1):
        inner = F.lit(1.0) + inner * x2 / F.lit(float(2 * k + 1))
    middle = F.greatest(F.lit(0.0), 1 - math.sqrt(2 / math.pi) * F.abs(z) * F.exp(-x2 / 2) * inner)
    fraction = F.lit(1.0)
    for k in range(NORMAL_LEVELS, 0, -1):
        fraction = F.lit(1.0) + F.lit(float(k)) / x2 / fraction
    return F.when(F.abs(z) < NEAR, middle).otherwise(F.exp(-x2 / 2) * math.sqrt(2 / math.pi) / F.abs(z) / fraction)


def chi_square_tail(x, df: int) -> np.ndarray:
    """Upper tail of chi-square for whole degrees of freedom: from 1 or 2 upwards by steps of two, all terms positive."""
    x = np.maximum(np.asarray(x, dtype=float), 0)
    out = normal_tail(np.sqrt(x)) if df % 2 else np.exp(-x / 2)
    term = np.sqrt(2 * x / math.pi) * np.exp(-x / 2) if df % 2 else np.exp(-x / 2) * x / 2
    for k in range(3 if df % 2 else 4, df + 1, 2):
        out = out + term
        term = term * x / k
    return np.where(np.isnan(x), np.nan, out)


def chi_square_4(x: Column) -> Column:
    """Upper tail of chi-square with 4 degrees of freedom."""
    return F.exp(-x / 2) * (1 + x / 2)


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric_greater(hits: int, drawn: int, marked: int, total: int) -> float:
    """P(X >= hits) when `drawn` of `total` are taken and `marked` are marked."""
    top = min(drawn, marked)
    base = log_choose(total, drawn)
    return min(1.0, math.fsum(math.exp(log_choose(marked, k) + log_choose(total - marked, drawn - k) - base) for k in range(max(hits, drawn + marked - total, 0), top + 1)))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p of a 2x2 table: all tables with these margins that are no likelier."""
    drawn, marked, total = a + b, a + c, a + b + c + d
    base = log_choose(total, drawn)
    p = {k: math.exp(log_choose(marked, k) + log_choose(total - marked, drawn - k) - base) for k in range(max(0, drawn + marked - total), min(drawn, marked) + 1)}
    return min(1.0, math.fsum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))


def odds_ratio(a: int, b: int, c: int, d: int) -> float:
    """Conditional maximum-likelihood odds ratio of a 2x2 table."""
    drawn, marked, total = a + b, a + c, a + b + c + d
    low, high = max(0, drawn + marked - total), min(drawn, marked)
    if a == low:
        return 0.0
    if a == high:
        return math.inf
    logs = {k: log_choose(marked, k) + log_choose(total - marked, drawn - k) for k in range(low, high + 1)}

    def mean(w):
        top = max(v + k * w for k, v in logs.items())
        weight = {k: math.exp(v + k * w - top) for k, v in logs.items()}
        return sum(k * x for k, x in weight.items()) / sum(weight.values())

    lo, hi = -50.0, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < a else (lo, mid)
    return math.exp((lo + hi) / 2)
