"""Reference-shaped fixtures against independent computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.functions import special
from sparkweave.operators import diffnet, express, fdr, graph, pairs
from sparkweave.sources import matrix


def long_of(spark, rows):
    return spark.createDataFrame([(g, s, None if v is None else float(v)) for g, row in enumerate(rows) for s, v in enumerate(row)], "gene long, sample int, value double")


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_planted_classes(spark):
    rng = np.random.default_rng(1)
    n = 60
    x = rng.normal(size=(10, n))
    x[0] = np.arange(n)
    low, high = np.arange(12), np.arange(48, 60)
    tie = lambda a, b, at, sign=1: x.__setitem__((b, at), sign * x[a, at])
    tie(1, 2, low), tie(3, 4, high), tie(5, 6, low), tie(5, 6, high, -1), tie(7, 8, low), tie(7, 8, high)
    got = diffnet.edges(long_of(spark, x), diffnet.Params(alpha=0.05, threshold=0.5)).where("gene_i in (1, 3, 5, 7) and gene_j = gene_i + 1")
    assert {(r.gene_i, r.gene_j): r["class"] for r in got.collect()} == {(1, 2): "disappear", (3, 4): "new", (5, 6): "sign_change", (7, 8): "unchanged"}


def test_ties_constants_and_nulls(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 10))
    x[0, :3], x[1, 2:5], x[2] = 1.0, -2.0, 7.0
    rows = x.tolist()
    rows[3][4] = None
    got = {(r.gene_i, r.gene_j): r.r for r in pairs.all_pairs(pairs.rank_vectors(long_of(spark, rows)), block=2).collect()}
    assert set(got) == {(0, 1), (0, 4), (1, 4)}
    for (i, j), r in got.items():
        assert r == pytest.approx(np.corrcoef(ranks(x[i]), ranks(x[j]))[0, 1], abs=1e-12)


def test_benjamini_hochberg(spark):
    rng = random.Random(3)
    p = [rng.random() ** 3 for _ in range(500)] + [0.0, 1.0, 0.5, 0.5, None]
    got = {r.i: r.q for r in fdr.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i long, p double"), "p", "q").collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    best, want = 1.0, {}
    for k in range(len(known), 0, -1):
        best = min(best, known[k - 1][0] * len(known) / k)
        want[known[k - 1][1]] = best
    assert got.pop(504) is None
    assert got == pytest.approx(want)


def test_tails(spark):
    row = spark.range(1).select(
        special.t_two_sided(special.t_angle(F.lit(2.1), 10), 10).alias("a"), special.t_two_sided(special.t_angle(F.lit(-4.0), 62), 62).alias("b"),
        special.t_two_sided(special.t_angle(F.lit(1.0), 1), 1).alias("c"), special.normal_two_sided(F.lit(1.96)).alias("d"), special.chi_square_4(F.lit(9.487729)).alias("e"),
    ).first()
    assert row.a == pytest.approx(0.0620772442, abs=1e-9) and row.b == pytest.approx(1.713748e-4, rel=1e-5)
    assert row.c == pytest.approx(0.5) and row.d == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-12) and row.e == pytest.approx(0.05, abs=1e-6)


def test_exact_tests():
    assert special.fisher_two_sided(3, 1, 1, 3) == pytest.approx(34 / 70)
    assert special.hypergeometric_greater(2, 3, 4, 10) == pytest.approx((6 * 6 + 4) / 120)
    assert special.odds_ratio(3, 1, 1, 3) == pytest.approx(6.408309, rel=1e-5)


def test_small_graph(spark):
    edges = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (1, 2, 0.5), (2, 3, 0.5), (5, 6, -1.0)], "gene_i long, gene_j long, r double")
    nodes = spark.range(8).withColumnRenamed("id", "gene")
    c = {r.gene: (r.degree, r.triangles, r.clustering) for r in graph.clustering(edges, nodes).collect()}
    assert c[2] == (3, 1, pytest.approx(1 / 3)) and c[4] == (0, 0, None) and c[0] == (2, 1, 1.0)
    assert {r.gene: r.component for r in graph.components(edges, nodes).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    n = {r.focus: (r.l1_nodes, r.l2_nodes, r.l1_l1_edges, r.l1_l2_edges) for r in graph.neighbourhoods(edges, nodes).collect()}
    assert n[3] == (1, 2, 0, 2) and n[0] == (2, 1, 1, 1) and n[7] == (0, 0, 0, 0)
    t = {(r.gene_i, r.gene_j): r.tom for r in graph.tom(edges).collect()}
    assert t[(0, 1)] == pytest.approx((0.25 + 0.5) / (1 + 1 - 0.5)) and (0, 3) in t
    assert sum(r.degree for r in graph.degrees(edges, nodes).collect()) == 2 * 5


def test_empty_edges(spark):
    edges = spark.createDataFrame([], "gene_i long, gene_j long, r double")
    nodes = spark.range(3).withColumnRenamed("id", "gene")
    assert graph.topology(edges, nodes).first().n_edges == 0
    assert graph.clustering(edges, nodes).count() == 3 and graph.components(edges, nodes).count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "plain.tsv").write_text("\ts1\ts2\ng1\t1.5\tNaN\ng2\tx\t-2\n")
    (tmp_path / "offset.tsv").write_text("s1\ts2\ng1\t1.5\t2\n")
    key = lambda r: (r.gene_id, r.sample_id)
    got = {key(r): r.value for r in matrix.read_wide(spark, str(tmp_path / "plain.tsv")).collect()}
    assert got == {("g1", "s1"): 1.5, ("g1", "s2"): None, ("g2", "s1"): None, ("g2", "s2"): -2.0}
    off = matrix.read_wide(spark, str(tmp_path / "offset.tsv"), offset_header=True)
    assert {key(r): r.value for r in off.collect()} == {("g1", "s1"): 1.5, ("g1", "s2"): 2.0}
    assert matrix.sample_names(spark, str(tmp_path / "plain.tsv")) == ["s1", "s2"]
    matrix.write_table(off, str(tmp_path / "out"), ["value"])
    with pytest.raises(Exception, match="(?i)exists"):
        matrix.write_table(off, str(tmp_path / "out"))


def test_rank_sum_without_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", 5.0), ("b", 6.0)], "g string, v double").withColumn("k", F.lit(1))
    r = express.rank_sum(df, "g", "a", "v", "k", corrected=False).first()
    assert r.u == 1.0 and r.z == pytest.approx(-3.5 / math.sqrt(9 * 7 / 12)) and r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)))


def test_broken_stick():
    assert sum(express.broken_stick(5)) == pytest.approx(1.0)


def test_triangle_places_come_back(spark):
    from sparkweave.operators import merging

    n = 41
    df = spark.range(n * (n - 1) // 2)
    i, j = merging.triangle_pair(F.col("id"), n)
    got = sorted((r.id, r.i, r.j) for r in df.select("id", i.alias("i"), j.alias("j")).collect())
    assert [(a, b) for _, a, b in got] == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_eigenvector_centrality_converges(spark):
    edges = [(0, 1, 0.9), (0, 2, -0.8), (1, 2, 0.5), (2, 3, 0.7)]
    a = np.zeros((5, 5))
    for i, j, r in edges:
        a[i, j] = a[j, i] = abs(r)
    want = np.abs(np.linalg.eigh(a)[1][:, -1])
    df = spark.createDataFrame(edges, "gene_i long, gene_j long, r double")
    got = {r.gene: r.centrality for r in graph.eigenvector_centrality(df, spark.range(5).toDF("gene"), tolerance=1e-9).collect()}
    assert [got[k] for k in range(5)] == pytest.approx(want.tolist(), abs=1e-4)


def test_power_choice(spark):
    rows = [(1, 0.5, 200.0), (4, 0.92, 150.0), (6, 0.95, 80.0), (8, 0.97, 40.0)]
    df = spark.createDataFrame(rows, "power long, fit double, mean_k double")
    assert graph.pick_power(df) == 6
    assert graph.pick_power(df.where("power in (1, 4)")) == 4
    assert graph.pick_power(df.where("power = 1")) == 1


def test_ranks_hold_no_whole_key(spark):
    """Ranks of counted values equal those of rows, and no window is over a whole key."""
    rng = np.random.default_rng(8)
    rows = [(None if k % 50 == 0 else "ab"[k % 2], "xy"[int(rng.integers(2))], float(rng.integers(300))) for k in range(2000)]
    df = spark.createDataFrame(rows, "k string, side string, v double")
    out = express.rank_sum(df, "side", "x", "v", "k")
    got = {r.k: r for r in out.collect()}
    assert len(got) == 3
    for key, r in got.items():
        x, y = (np.array([v for k, s, v in rows if k == key and s == side]) for side in "xy")
        u = (x[:, None] > y[None, :]).sum() + 0.5 * (x[:, None] == y[None, :]).sum()
        assert (r.n1, r.n2, r.u) == (len(x), len(y), u) and (r.median1, r.median2) == (np.median(x), np.median(y))
        assert abs(r.mean1 - x.mean()) < 1e-9 and abs(r.mean2 - y.mean()) < 1e-9
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    specs = [line for line in plan.split("\n") if "Window [" in line and "__v#" in line]
    assert specs and all("__cell" in line for line in specs)
