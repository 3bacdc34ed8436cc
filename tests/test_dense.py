"""Metrics summed inside the blocks of pairs against those of the table of edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.operators import dense, graph, pairs

LEAST = 0.45


@pytest.fixture(scope="module")
def net(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(41, 12)) + np.repeat(rng.normal(size=(1, 12)), 41, 0) * (np.arange(41)[:, None] % 3), 1)
    x[7] = 1.0  # no spread, no vector
    rows = [(3 * g + 1, s, float(v)) for g, row in enumerate(x) for s, v in enumerate(row)]
    long = spark.createDataFrame(rows, "gene long, sample int, value double")
    vectors = pairs.rank_vectors(long).cache()
    edges = pairs.all_pairs(vectors).where(F.abs("r") >= LEAST).cache()
    return vectors, long.select("gene").distinct().cache(), edges


def table(df):
    return sorted(tuple(r) for r in df.collect())


def close(one, two):
    assert len(one) == len(two) > 0
    for a, b in zip(one, two, strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_pairs_below_the_cut_do_not_leave_a_block(net):
    vectors, _, edges = net
    close(table(pairs.all_pairs(vectors, block=6, least=LEAST)), table(edges))


def test_rows_of_each_node(net):
    vectors, nodes, edges = net
    close(table(dense.degrees(vectors, nodes, LEAST, block=6)), table(graph.degrees(edges, nodes)))
    assert table(dense.components(vectors, nodes, 0.8, block=6)) == table(graph.components(edges.where("abs(r) >= 0.8"), nodes))
    close(table(dense.page_rank(vectors, nodes, LEAST, steps=4, block=6)), table(graph.page_rank(edges, nodes, steps=4)))
    close(table(dense.eigenvector_centrality(vectors, nodes, LEAST, most=5, block=6)), table(graph.eigenvector_centrality(edges, nodes, most=5)))
    labels = nodes.select("gene", F.when(F.col("gene") % 5 > 0, F.col("gene") % 4).alias("module"))
    key = lambda df: df.select("gene", F.coalesce("module", F.lit(-1)), "k_total", "k_within", "k_out", "k_diff")
    close(table(key(dense.module_connectivity(vectors, labels, LEAST, block=6))), table(key(graph.module_connectivity(edges, labels))))


def test_single_rows(net):
    vectors, nodes, edges = net
    one, two = dense.topology(vectors, nodes, LEAST, block=6).first().asDict(), graph.topology(edges, nodes).first().asDict()
    assert one == pytest.approx(two, abs=1e-9)
    assert dense.summary(vectors, nodes, LEAST, block=6).first().asDict() == pytest.approx(graph.summary(edges, nodes).first().asDict(), abs=1e-9)
    cuts = [0.5, 0.7, 0.99999]
    close(table(dense.threshold_sweep(vectors, 41, cuts, LEAST, block=6).fillna(-1.0)), table(graph.threshold_sweep(edges, 41, cuts).fillna(-1.0)))


def test_powers(net):
    vectors, _, _ = net
    close(table(graph.soft_fits(dense.power_sums(vectors, [1, 2, 4, 6], block=6), [1, 2, 4, 6])), table(graph.soft_threshold(pairs.all_pairs(vectors), [1, 2, 4, 6])))


def test_eigenvector_centrality_ends_by_its_tolerance(net, monkeypatch):
    """The query has no bound of its own on the steps; few nodes and blocks of nodes give the same."""
    from sparkweave.plans import selections

    vectors, nodes, edges = net
    want = table(graph.eigenvector_centrality(edges, nodes, most=1000, tolerance=1e-9))
    close(table(dense.eigenvector_centrality(vectors, nodes, LEAST, most=1000, tolerance=1e-9)), want)
    asked = {}
    monkeypatch.setattr(selections.dense, "eigenvector_centrality", lambda vectors, nodes, least, **more: asked.update(more) or graph.eigenvector_centrality(edges, nodes, most=1))
    monkeypatch.setattr(selections, "_dense", lambda spark, sf_dir: (vectors, nodes))
    selections.QUERIES["eigenvector_centrality"](None, "")
    assert not asked


def test_links_of_other_vectors_are_those_of_their_products(spark):
    """Vectors that are no z-scored ranks, alone and among others."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(30, 12))
    z[::2] = np.argsort(np.argsort(z[::2], axis=1), axis=1) - 5.5
    z = (z - z.mean(axis=1, keepdims=True)) / z.std(axis=1, ddof=1, keepdims=True)
    vectors = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(z)], "gene long, z array<double>")
    r = np.abs(z @ z.T / 11) * (1 - np.eye(30))
    for part in (range(30), range(0, 30, 2)):
        got = {x.gene: x.k for x in pairs.linked_sums(vectors.where(F.col("gene").isin(list(part))), LEAST, lambda r, mine, other: (np.abs(r),), ["k"], block=7).collect()}
        want = np.where(r >= LEAST, r, 0)[np.ix_(part, part)].sum(axis=1)
        assert [got[g] for g in part] == pytest.approx(want.tolist(), abs=1e-9)
