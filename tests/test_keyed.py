"""Keyed networks against the one-reference form and plain sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.operators import diffnet, keyed

P = diffnet.Params(alpha=0.9, threshold=0.1)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(24, 40)) + np.outer(rng.normal(size=24) > 0, rng.normal(size=40))
    x[5, :4] = 0.5  # ties
    long = spark.createDataFrame([(g, s, float(v)) for g, row in enumerate(x) for s, v in enumerate(row)], "gene long, sample int, value double").cache()
    refs = spark.createDataFrame([(0,), (7,), (23,)], "ref_gene long")
    return long, refs, keyed.edges(long, refs, P).cache()


def test_equals_one_reference(data):
    long, _, got = data
    for ref in (0, 7, 23):
        want = {(r.gene_i, r.gene_j): r for r in diffnet.edges(long, diffnet.Params(focus=ref, alpha=0.9, threshold=0.1)).collect()}
        mine = {(r.gene_i, r.gene_j): r for r in got.where(F.col("ref_gene") == ref).collect()}
        assert mine.keys() == want.keys()
        for k, r in want.items():
            assert mine[k]["class"] == r["class"] and mine[k].sig_edge == r.sig_edge
            for c in ("r_low", "r_high", "p_diff", "q_low", "q_diff"):
                assert mine[k][c] == pytest.approx(r[c], abs=1e-9)


def test_blocks_do_not_matter(data):
    long, _, _ = data
    splits = diffnet.extremes(long.where("gene in (0, 7)"), 0.2)
    rows = lambda b, r: sorted((x.ref_gene, x.gene_i, x.gene_j, round(x.r_low, 9)) for x in keyed.correlations(long, splits, b, r).collect())
    assert rows(5, 1) == rows(100, 16) and len(rows(7, 2)) == 2 * 24 * 23 // 2


def test_focus_metrics(data):
    _, refs, got = data
    net = got.where("sig_differential").cache()
    focuses = refs.select("ref_gene", F.col("ref_gene").alias("focus")).union(refs.select("ref_gene", F.lit(3).cast("long")))
    table = {(r.ref_gene, r.focus): r for r in keyed.focus_metrics(net, focuses, P.threshold).collect()}
    assert len(table) == 6
    edges = net.collect()
    deg = {(r.ref_gene, r.focus): r for r in keyed.focus_degrees(net, focuses, P.threshold).collect()}
    for (ref, focus), row in table.items():
        mine = [e for e in edges if e.ref_gene == ref]
        near = {e.gene_j if e.gene_i == focus else e.gene_i for e in mine if focus in (e.gene_i, e.gene_j)}
        direct = [e for e in mine if focus in (e.gene_i, e.gene_j)]
        inner = [e for e in mine if e.gene_i in near and e.gene_j in near]
        outer = [e for e in mine if focus not in (e.gene_i, e.gene_j) and (e.gene_i in near) != (e.gene_j in near)]
        far = {e.gene_j if e.gene_i in near else e.gene_i for e in outer}
        assert (row.l1_n_nodes, row.n_l1_to_l1_edges, row.n_l1_to_l2_edges, row.l2_n_nodes) == (len(near), len(inner), len(outer), len(far))
        low = [e for e in direct if e.sig_low and abs(e.r_low) >= P.threshold]
        assert row.focus_deg_low == len(low) == deg[ref, focus].degree_low and deg[ref, focus].degree_diff == len(direct)
        assert row.l1_conn_low == pytest.approx(sum(abs(e.r_low) for e in low))
        assert row.l2_n_new == sum(e["class"] == "new" for e in inner + outer)
        assert row.full_mean_abs_dr == pytest.approx(np.mean([abs(e.delta) for e in direct + inner + outer]) if direct else 0)
        assert row.l1_clique_density == pytest.approx(2 * len(inner) / (len(near) * (len(near) - 1)) if len(near) > 1 else 0)
    assert len(keyed.focus_metrics(net, focuses).columns) >= 62


def test_topologies_and_context(data):
    _, refs, got = data
    net = got.where("sig_differential").cache()
    rows = {(r.ref_gene, r.net): r for r in keyed.topologies(keyed.networks(net, 0.3), refs, 24).collect()}
    assert len(rows) == 9
    edges = net.collect()
    for (ref, name), row in rows.items():
        mine = [(e.gene_i, e.gene_j) for e in edges if e.ref_gene == ref and (name == "diff" or abs(e[f"r_{name}"]) >= 0.3)]
        near = {}
        for a, b in mine:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        assert row.n_edges == len(mine) and row.max_degree == max(map(len, near.values()), default=0)
        local = [sum(b in near[a] for a in n for b in n if a < b) / (len(n) * (len(n) - 1) / 2) for n in near.values() if len(n) > 1]
        assert row.clustering == pytest.approx(np.mean(local) if local else 0)
        seen, sizes = set(), []
        for v in near:
            if v not in seen:
                stack, part = [v], set()
                while stack:
                    u = stack.pop()
                    if u not in part:
                        part.add(u)
                        stack += near[u]
                seen |= part
                sizes.append(len(part))
        assert (row.n_components, row.largest_component) == (len(sizes), max(sizes, default=0))
    every = refs.crossJoin(F.broadcast(got.sparkSession.range(24).withColumnRenamed("id", "focus")))
    ctx = {r.focus: r for r in keyed.context_variance(keyed.focus_degrees(net, every)).collect()}
    d = [[sum(f in (e.gene_i, e.gene_j) for e in edges if e.ref_gene == ref) for ref in (0, 7, 23)] for f in range(24)]
    assert all(ctx[f].variance == pytest.approx(np.var(d[f])) and ctx[f].most == max(d[f]) for f in range(24))
    assert sorted(r.context_rank for r in ctx.values() if r.context_rank) == [1, 2, 3, 4, 5]


def test_focus_spec(data, spark):
    genes = spark.range(10).withColumnRenamed("id", "gene")
    ids = lambda df: sorted(r.focus for r in df.collect())
    assert ids(keyed.parse_focus("3, 5,3", genes)) == [3, 5] and ids(keyed.parse_focus("top:2", genes)) == [0, 1] and len(ids(keyed.parse_focus("all", genes))) == 10
    scores = genes.withColumn("score", F.col("gene") % 4)
    assert ids(keyed.parse_focus("top:2", genes, scores)) == [3, 7]
    for bad in ("top:x", "a,b", "11", ""):
        with pytest.raises(ValueError):
            keyed.parse_focus(bad, genes)
