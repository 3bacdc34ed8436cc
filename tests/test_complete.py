"""Pairwise-complete rank correlation and power centrality against dense versions."""

import numpy as np
import pytest

from sparkweave.operators import graph, keyed


def test_pairwise_complete(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 6, (7, 15)).astype(float), rng.normal(size=(9, 15))
    a[rng.random(a.shape) < 0.25], b[rng.random(b.shape) < 0.2] = np.nan, np.nan
    a[0], b[1, 2:] = 3.0, np.nan  # without spread; two samples only
    long = lambda x: spark.createDataFrame([(g, s, None if np.isnan(v) else float(v)) for g, row in enumerate(x) for s, v in enumerate(row)], "gene long, sample int, value double")
    rank = lambda v: np.array([(v < i).sum() + ((v == i).sum() + 1) / 2 for i in v])
    got = {(r.a, r.b): r for r in keyed.pairwise_complete(long(a), long(b), block=4).collect()}
    assert len(got) == 63
    for (i, j), r in got.items():
        on = ~np.isnan(a[i]) & ~np.isnan(b[j])
        x, y = rank(a[i][on]), rank(b[j][on])
        assert r.n == on.sum()
        if on.sum() < 3 or x.std() == 0 or y.std() == 0:
            assert r.r is None
        else:
            assert r.r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)


@pytest.mark.parametrize("exponent", [0.1, 0.5])
def test_power_centrality(spark, exponent):
    pairs = [(0, 1, 0.9), (0, 2, -0.8), (1, 2, 0.5), (2, 3, 0.7), (3, 4, 0.4)]
    edges, nodes = spark.createDataFrame(pairs, "gene_i long, gene_j long, r double"), spark.range(6).withColumnRenamed("id", "gene")
    for weight in (None, "r"):
        m = np.zeros((6, 6))
        for i, j, r in pairs:
            m[i, j] = m[j, i] = abs(r) if weight else 1.0
        want = np.linalg.solve(np.eye(6) - exponent * m, m.sum(axis=1))
        want /= np.sqrt((want**2).mean())
        got = {r.gene: r.power for r in graph.power_centrality(edges, nodes, exponent, weight).collect()}
        assert [got[g] for g in range(6)] == pytest.approx(want.tolist(), abs=1e-6)


def test_both_sides_from_one_table(spark):
    long = spark.createDataFrame([(g, s, float((g * 7 + s * s * 3) % 11)) for g in range(4) for s in range(9)], "gene long, sample int, value double")
    got = {(r.a, r.b): r.r for r in keyed.pairwise_complete(long.where("gene < 2"), long.where("gene >= 1")).collect()}
    assert len(got) == 6 and got[1, 1] == pytest.approx(1.0)


def test_ranks_are_not_sorted_for_each_pair(spark):
    """Pairs of 60 samples (floats) and of 300 (doubles) agree with plain ranks; ranks are products, not sorts of each pair."""
    assert not hasattr(keyed, "_masked_z")
    rng = np.random.default_rng(6)
    for places in (60, 300):
        x = rng.integers(0, 40, (6, places)).astype(float)
        x[rng.random(x.shape) < 0.3] = np.nan
        long = spark.createDataFrame([(g, s, None if np.isnan(v) else float(v)) for g, row in enumerate(x) for s, v in enumerate(row)], "gene long, sample int, value double")
        for r in keyed.pairwise_complete(long.where("gene < 3"), long.where("gene >= 3")).collect():
            on = ~np.isnan(x[r.a]) & ~np.isnan(x[r.b])
            p, q = ((np.sign(v[:, None] - v[None, :]).sum(axis=1)) for v in (x[r.a][on], x[r.b][on]))
            assert r.n == on.sum() and r.r == pytest.approx(np.corrcoef(p, q)[0, 1], abs=1e-12)
