"""Normalisation, designs and count models against plain versions on planted counts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.functions import negbin as likelihood
from sparkweave.operators import counts, negbin

N = 40


def planted(seed=1, genes=150):
    rng = np.random.default_rng(seed)
    size = rng.uniform(0.5, 2, N)
    trt = (np.arange(N) >= N // 2).astype(float)
    batch = np.arange(N) % 3
    level = np.exp(rng.uniform(2.5, 6, genes))
    change = np.zeros(genes)
    change[:20] = np.where(np.arange(20) % 2, 1.2, -1.2)
    a0 = np.full(genes, 0.08)
    more = np.zeros(genes)
    more[20:35] = 2.6  # of the log dispersion
    mu = level[:, None] * size * np.exp(change[:, None] * trt + 0.2 * (batch == 1))
    a = a0[:, None] * np.exp(more[:, None] * trt)
    y = rng.poisson(rng.gamma(1 / a, a * mu))
    y[-1] = 0
    return y, size, trt, batch


@pytest.fixture(scope="module")
def data(spark):
    y, size, trt, batch = planted()
    long = spark.createDataFrame([(g, s, int(v)) for g, row in enumerate(y) for s, v in enumerate(row)], "gene long, sample int, n long").cache()
    meta = spark.createDataFrame([(s, "Q5" if trt[s] else "Q1", f"b{batch[s]}", float(size[s])) for s in range(N)], "sample int, grp string, batch string, size double")
    return y, long, meta


def plain_sizes(y):
    full = y[(y > 0).all(axis=1)]
    logs = np.log(full) - np.log(full).mean(axis=1, keepdims=True)
    return np.exp(np.median(logs, axis=0))


def plain_factors(y):
    y = y[y.sum(axis=1) > 0].astype(float)
    lib = y.sum(axis=0)
    q = np.array([np.quantile(y[:, s], 0.75) / lib[s] for s in range(y.shape[1])])
    ref = int(np.argmin(np.round(np.abs(q - q.mean()), 12)))
    out = []
    for s in range(y.shape[1]):
        on = (y[:, s] > 0) & (y[:, ref] > 0)
        a, b = y[on, s] / lib[s], y[on, ref] / lib[ref]
        m, lv = np.log2(a / b), np.log2(a * b) / 2
        v = (lib[s] - y[on, s]) / lib[s] / y[on, s] + (lib[ref] - y[on, ref]) / lib[ref] / y[on, ref]
        rank = lambda x: np.array([(x < i).sum() + ((x == i).sum() + 1) / 2 for i in x])
        k = len(m)
        lo, lo2 = math.floor(k * 0.3) + 1, math.floor(k * 0.05) + 1
        keep = (rank(m) >= lo) & (rank(m) <= k + 1 - lo) & (rank(lv) >= lo2) & (rank(lv) <= k + 1 - lo2)
        out.append(0.0 if np.abs(m).max() < 1e-6 else (m[keep] / v[keep]).sum() / (1 / v[keep]).sum())
    out = np.array(out)
    return 2 ** (out - out.mean())


def test_sizes_and_factors(data):
    y, long, _ = data
    got = {r.sample: r.size for r in counts.median_ratio_sizes(long).collect()}
    assert [got[s] for s in range(N)] == pytest.approx(plain_sizes(y[:-1]).tolist(), rel=1e-9) or [got[s] for s in range(N)] == pytest.approx(plain_sizes(y).tolist(), rel=1e-9)
    f = {r.sample: r.factor for r in counts.trimmed_mean_factors(long).collect()}
    assert [f[s] for s in range(N)] == pytest.approx(plain_factors(y).tolist(), rel=1e-9)
    cpm = counts.counts_per_million(long, counts.library_sizes(long)).groupBy("sample").agg(F.sum("cpm").alias("t")).collect()
    assert all(r.t == pytest.approx(1e6) for r in cpm)


def test_design(data, spark):
    _, _, meta = data
    d = counts.design(meta, "sample", "grp", "Q1", ("batch",), ("size",))
    assert d.names == ("(Intercept)", "grpQ5", "batch1", "batch2", "size")
    assert d.matrix[:3, 2].tolist() == [1.0, 0.0, -1.0] and d.matrix[:3, 3].tolist() == [0.0, 1.0, -1.0]
    twice = meta.withColumn("same", F.col("batch"))
    assert counts.design(twice, "sample", "grp", "Q1", ("batch", "same")).names == ("(Intercept)", "grpQ5", "batch1", "batch2")
    for bad in (meta.union(meta), meta.withColumn("grp", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            counts.design(bad, "sample", "grp", "Q1")
    with pytest.raises(ValueError):
        counts.design(meta, "sample", "grp", "Q3")
    with pytest.raises(ValueError):
        counts.design(meta, "sample", "grp", "Q1", most=5)


def best(f, x, step=0.5):
    """Coordinate search to 1e-7."""
    x, now = np.array(x, float), f(x)
    while step > 1e-7:
        moved = False
        for i in range(len(x)):
            for s in (step, -step):
                y = x.copy()
                y[i] += s
                if (v := f(y)) > now:
                    x, now, moved = y, v, True
        step = step if moved else step / 2
    return x, now


def plain_like(y, mu, a):
    return sum(math.lgamma(k + 1 / b) - math.lgamma(1 / b) - math.lgamma(k + 1) + k * math.log(b * m / (1 + b * m)) - math.log1p(b * m) / b for k, m, b in zip(y, mu, a, strict=True))


def test_fits_against_plain_search():
    y, size, trt, _ = planted(3, 40)
    y = y[[0, 1, 22, 25, 36, 38]]
    x = np.stack([np.ones(N), trt], axis=1)
    off = np.log(size)
    a = np.full((len(y), 1), 0.1)
    beta, _ = likelihood.fit_mean(y, off, x, a)
    for row, b in zip(y, beta, strict=True):
        want, _ = best(lambda c: plain_like(row, np.exp(x @ c + off), np.full(N, 0.1)), [3.0, 0.0])
        assert b.tolist() == pytest.approx(want.tolist(), abs=2e-5)
    mu = np.exp(beta @ x.T + off)
    own = likelihood.fit_dispersion(y, mu, x, 40.0)
    for row, m, o in zip(y, mu, own, strict=True):
        def f(c, row=row, m=m):
            b = math.exp(c[0])
            return plain_like(row, m, np.full(N, b)) - 0.5 * np.linalg.slogdet((x.T * (m / (1 + b * m))) @ x)[1]
        assert math.log(o) == pytest.approx(best(f, [-2.0])[0][0], abs=1e-4)
    beta, gamma, like, _ = likelihood.fit_both(y, off, x, x)
    for row, b, g, v in zip(y, beta, gamma, like, strict=True):
        f = lambda c, row=row: plain_like(row, np.exp(x @ c[:2] + off), np.exp(np.clip(x @ c[2:], -18, 4)))
        want, top = best(f, [3.0, 0.0, -2.0, 0.0])
        assert v == pytest.approx(top, abs=1e-5)
        assert [*b, *g] == pytest.approx(want.tolist(), abs=2e-3)


@pytest.mark.parametrize("test", ["wald", "lrt"])
def test_mean_changes(data, test):
    y, long, meta = data
    d = counts.design(meta, "sample", "grp", "Q1", ("batch",))
    rows = {r.gene: r for r in negbin.mean_changes(long, d, "grpQ5", test).collect()}
    assert len(rows) == 150 and rows[149].p is None and rows[149]["class"] == "NS"
    assert all(rows[g]["class"] == ("up_deg" if g % 2 else "down_deg") for g in range(20))
    assert sum(rows[g]["class"] != "NS" for g in range(35, 149)) <= 8
    assert all(abs(rows[g].log2_fc - (1.2 if g % 2 else -1.2) / math.log(2)) < 0.8 for g in range(20))
    assert all(abs(r.log2_fc_shrunken) <= abs(r.log2_fc) + 1e-6 for r in rows.values() if r.p is not None)
    own = [rows[g].dispersion for g in range(35, 149)]
    assert 0.05 < np.median(own) < 0.12


def test_mean_and_dispersion_changes(data):
    _, long, meta = data
    d = counts.design(meta, "sample", "grp", "Q1", ("batch",))
    rows = {r.gene: r for r in negbin.mean_and_dispersion_changes(long, d, "grpQ5").collect()}
    assert len(rows) == 150 and rows[149].p_mu is None and rows[149].class_modelcomp == "NS"
    assert sum(rows[g].class_modelcomp in ("up_deg", "down_deg", "Both") for g in range(20)) >= 19
    assert sum(rows[g].class_modelcomp in ("up_dvg", "Both") for g in range(20, 35)) >= 12
    assert sum(rows[g].class_modelcomp != "NS" for g in range(35, 149)) <= 12
    assert all(rows[g].log2_fc_bcv > 0.5 for g in range(20, 35))


def test_moderated_t(data):
    _, long, meta = data
    d = counts.design(meta, "sample", "grp", "Q1", ("batch",))
    rows = {r.gene: r for r in counts.moderated_t(long, d, "grpQ5").collect()}
    assert len(rows) == 149
    assert all(rows[g]["class"] == ("up_deg" if g % 2 else "down_deg") for g in range(20))
    assert sum(rows[g]["class"] != "NS" for g in range(35, 149)) <= 8


def test_variance_prior(spark):
    rng = np.random.default_rng(5)
    df, d0, s0 = 10, 6.0, 0.5
    var = s0 * d0 / rng.chisquare(d0, 20000) * rng.chisquare(df, 20000) / df
    fits = spark.createDataFrame([(float(v**0.5),) for v in var], "sigma double")
    prior, variance = counts.variance_prior(fits, df)
    assert prior == pytest.approx(d0, rel=0.1) and variance == pytest.approx(s0, rel=0.05)
    assert counts.variance_prior(fits.where("sigma < 0"), df)[0] == math.inf


def test_local_trend(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 10, 4000)
    y = np.sin(x / 3) + rng.normal(0, 0.05, 4000)
    y[:40] += 30  # outliers weigh nothing in the end
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    knots = counts.local_trend(df, "x", "y", span=0.1)
    assert max(abs(v - math.sin(a / 3)) for a, v in knots) < 0.06
    assert counts.local_trend(df.where("x < 0"), "x", "y") == []
