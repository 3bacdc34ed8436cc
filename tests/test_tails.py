"""Tails against decimals of 60 digits and the standard library."""

import math
from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.functions import special

getcontext().prec = 90


def arctan(x: Decimal) -> Decimal:
    """By halving the angle, then the series."""
    halved = 0
    while abs(x) > Decimal("0.01"):
        x = x / (1 + (1 + x * x).sqrt())
        halved += 1
    total, term, k = Decimal(0), x, 1
    while abs(term) > Decimal(10) ** -85:
        total += term / k
        term, k = -term * x * x, k + 2
    return total * 2**halved


PI = 4 * arctan(Decimal(1))


def exact_t(t, df):
    """The closed form, in decimals."""
    t = Decimal(t)
    c2, sine = df / (df + t * t), abs(t) / (df + t * t).sqrt()
    inner = Decimal(1)
    if df % 2 == 0:
        for j in range(df // 2 - 1, 0, -1):
            inner = 1 + inner * c2 * (2 * j - 1) / (2 * j)
        return float(1 - sine * inner)
    for j in range((df - 3) // 2, 0, -1):
        inner = 1 + inner * c2 * 2 * j / (2 * j + 1)
    body = arctan(abs(t) / Decimal(df).sqrt()) + (sine * c2.sqrt() * inner if df > 1 else 0)
    return float(1 - 2 * body / PI)


def test_t_tails(spark):
    cases = [(r * math.sqrt(n - 2) / math.sqrt(1 - r * r), n - 2) for n in (3, 4, 12, 13, 64, 101, 189, 190) for r in (0.001, 0.05, 0.2, 0.3, 0.5, 0.7, 0.9, 0.97)]
    want = [exact_t(t, df) for t, df in cases]
    assert min(want) < 1e-90
    got = special.t_tail_of([t for t, _ in cases], [df for _, df in cases])
    assert got.tolist() == pytest.approx(want, rel=1e-10)
    for df in sorted({df for _, df in cases}):
        mine = [(t, p) for (t, d), p in zip(cases, want, strict=True) if d == df]
        column = spark.createDataFrame(mine, "t double, p double").select(special.t_two_sided(special.t_angle(F.col("t"), df), df).alias("q"), "p").collect()
        assert [r.q for r in column] == pytest.approx([r.p for r in column], rel=1e-10)
        angles = np.arctan(np.array([t for t, _ in mine]) / math.sqrt(df))
        assert special.t_tail(angles, df).tolist() == pytest.approx([p for _, p in mine], rel=1e-9)
    assert special.t_tail_of([2.0, np.nan, np.inf], [np.inf, 5, 5])[[0, 2]].tolist() == pytest.approx([math.erfc(math.sqrt(2)), 0.0])


def test_normal_tails(spark):
    z = [0.0, 1e-9, 0.5, 1.96, 2.9, 3.0, 3.1, 6.9, 7.1, 12.0, 25.0, 37.0]
    want = [math.erfc(x / math.sqrt(2)) for x in z]
    assert special.normal_tail(np.array([-x for x in z])).tolist() == pytest.approx(want, rel=1e-11)
    got = spark.createDataFrame([(x,) for x in z], "z double").select(special.normal_two_sided(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx(want, rel=1e-11)


def test_other_functions():
    x = np.array([1e-6, 0.1, 0.5, 1.0, 2.5, 7.9, 8.1, 30.0, 1e6])
    assert special.log_gamma(x).tolist() == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-13)
    step = 1e-5
    assert special.digamma(x[1:-1]).tolist() == pytest.approx([(math.lgamma(v + step) - math.lgamma(v - step)) / (2 * step) for v in x[1:-1]], rel=1e-6)
    assert float(special.trigamma(1.0)) == pytest.approx(math.pi**2 / 6, rel=1e-12) and float(special.trigamma(0.5)) == pytest.approx(math.pi**2 / 2, rel=1e-12)
    for v in (1e-4, 0.03, 1.0, 40.0, 1e5):
        assert float(special.trigamma(special.trigamma_inverse(v))) == pytest.approx(v, rel=1e-8)
    assert special.chi_square_tail(9.487729, 4) == pytest.approx(0.05, abs=1e-7) and special.chi_square_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-7)
    assert special.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-7) and special.chi_square_tail(1400.0, 2) == pytest.approx(math.exp(-700))
