"""Permutation tests against plain versions, split by split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.operators import diffnet, keyed, resample

P = diffnet.Params(alpha=0.6, threshold=0.1)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 40))
    x[0] = np.arange(40) / 10
    x[10:20, 32:] *= 6  # more spread where feature 0 is high
    x[20:26, 32:] = x[0, 32:] + rng.normal(scale=0.05, size=(6, 8))  # follow feature 0 only there
    long = spark.createDataFrame([(g, s, float(v)) for g, row in enumerate(x) for s, v in enumerate(row)], "gene long, sample int, value double").cache()
    return x, long, spark.createDataFrame([(0,), (3,)], "focus long")


def test_splits(data):
    _, long, focuses = data
    rows = resample.splits(long, focuses, 5).collect()
    assert len(rows) == 12 and all(len(r.low) == len(r.high) == 8 and not set(r.low) & set(r.high) for r in rows)
    own = next(r for r in rows if (r.focus, r.perm) == (0, 0))
    assert own.low == list(range(8)) and own.high == list(range(32, 40))
    assert len({tuple(r.low) for r in rows}) == 12


def test_row_metrics(data, spark):
    x, long, focuses = data
    every = resample.splits(long, focuses, 4).cache()
    got = {(r.focus, r.perm): r for r in resample.row_metrics(resample.row_correlations(long, every, 7, 3), every, P).collect()}
    assert len(got) == 10
    for s in every.collect():
        r = []
        for side in (s.low, s.high):
            z = keyed.rank_rows(x[:, side])
            r.append(z @ z[s.focus] / 7)
        rest = [g for g in range(30) if g != s.focus]
        low, high, pl, ph, pd = diffnet.tests_of(r[0][rest], r[1][rest], 8)

        def q(p):
            order = np.argsort(p)
            v = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
            out = np.empty(len(p))
            out[order] = np.minimum(1, v)
            return out

        sl, sh, sd = q(pl) < P.alpha, q(ph) < P.alpha, q(pd) < P.alpha
        edge = (sl | sh) & sd
        row = got[s.focus, s.perm]
        d = np.abs(high - low)[edge]
        assert row.n_diff_edges == edge.sum() and row.focus_deg_high == (sh & (np.abs(high) >= 0.1)).sum()
        assert row.mean_abs_delta == pytest.approx(d.mean() if len(d) else 0) and row.max_abs_delta == pytest.approx(d.max() if len(d) else 0)


def test_network_permutations(data):
    _, long, focuses = data
    rows = {(r.focus, r.metric): r for r in resample.network_permutations(long, focuses, 40, diffnet.Params(alpha=0.05, threshold=0.1)).collect()}
    assert len(rows) == 16 and rows[0, "n_diff_edges"].observed >= 2
    assert rows[0, "n_diff_edges"].p <= 0.1 and rows[0, "n_diff_edges"].any_sig == (rows[0, "n_diff_edges"].n_metrics_sig > 0)
    assert all(r.p is None or r.p >= 1 / 40 for r in rows.values())
    for (f, _), r in rows.items():
        assert (r.p is None) == (rows[f, "n_diff_edges"].observed == 0), r
    with pytest.raises(ValueError):
        resample.network_permutations(long, focuses, 3, P, mode="reference")
    seen = focuses.select("focus", *[F.lit(1.0 if m != "n_diff_edges" else 50.0).alias(m) for m in resample.METRICS])
    own = {(r.focus, r.metric): r for r in resample.network_permutations(long, focuses, 10, P, mode="reference", observed=seen).collect()}
    assert own[3, "n_diff_edges"].observed == 50 and own[3, "n_diff_edges"].p == pytest.approx(0.1)


def test_variability(data):
    x, long, focuses = data
    rows = {r.focus: r for r in resample.variability_permutations(long, focuses, 60).collect()}
    mad = lambda v: 1.4826 * np.median(np.abs(v - np.median(v)))
    low, high = (np.mean([mad(x[g, at]) for g in range(1, 30)]) for at in (slice(0, 8), slice(32, 40)))
    assert rows[0].mean_mad_low == pytest.approx(low) and rows[0].shift == pytest.approx(high - low)
    assert rows[0].perm_p <= 0.1 and 0 <= rows[3].perm_p <= 1 and rows[3].wilcoxon_p > 0


def test_split_metrics_without_a_table_of_rows(spark, monkeypatch):
    """The same metrics as from all rows; the blocks hand on a row for each split and block."""
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(90, 40)) + np.repeat(rng.normal(size=(9, 40)), 10, axis=0), 1)
    x[5] = 1.0  # without spread
    long = spark.createDataFrame([(g, s, float(v)) for g, row in enumerate(x) for s, v in enumerate(row)], "gene long, sample int, value double")
    focuses = spark.createDataFrame([(0,), (5,), (44,)], "focus long")
    every = resample.splits(long, focuses, 6).cache()
    made, jobs = [], resample._row_jobs
    monkeypatch.setattr(resample, "_row_jobs", lambda *a, **k: made.append(jobs(*a, **k)) or made[-1])
    params = diffnet.Params(alpha=0.3)
    got = {(r.focus, r.perm): r for r in resample.split_metrics(long, every, params, block=30, per=8).collect()}
    want = resample.row_metrics(resample.row_correlations(long, every), every, params).collect()
    assert len(got) == len(want) == 21 and sum(r.n_diff_edges for r in want) > 0 and sum(r.l1_rewire for r in want) > 0
    for r in want:
        assert tuple(got[r.focus, r.perm]) == pytest.approx(tuple(r), abs=1e-9)
    assert made[-1].count() <= 21 * 3
