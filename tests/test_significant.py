"""Significant edges by counted p values against the q values of all pairs; equal correlations are equal numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.operators import diffnet, keyed, significant

P = diffnet.Params(alpha=0.6, threshold=0.1)
DEAL = {"block": 9, "per": 2}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 40)) + np.outer(rng.normal(size=30) > 0, rng.normal(size=40))
    x[5, :6] = 0.5  # ties
    x[6] = 1.0  # no spread
    rows = [(g, s, None if g == 8 and s == 3 else float(v)) for g, row in enumerate(x) for s, v in enumerate(row)]
    long = spark.createDataFrame(rows, "gene long, sample int, value double").cache()
    refs = spark.createDataFrame([(0,), (7,), (23,)], "ref_gene long")
    return long, refs, keyed.edges(long, refs, P).cache()


@pytest.mark.parametrize("where", ["sig_differential", "sig_edge"])
def test_equals_all_pairs(data, where):
    long, refs, every = data
    key = lambda r: (r.ref_gene, r.gene_i, r.gene_j)
    want = {key(r): r for r in every.where(where).collect()}
    got = {key(r): r for r in significant.edges(long, refs, P, where, **DEAL).collect()}
    assert got.keys() == want.keys() and 0 < len(want) < every.count()
    for k, r in want.items():
        assert (got[k].sig_low, got[k].sig_high, got[k].sig_edge) == (r.sig_low, r.sig_high, r.sig_edge)
        assert got[k].r_low == pytest.approx(r.r_low, abs=1e-12) and got[k].p_diff == pytest.approx(r.p_diff, abs=1e-9)
        assert where == "sig_edge" or got[k].q_diff == pytest.approx(r.q_diff, abs=1e-9)


def test_classes(data):
    long, refs, every = data
    same = F.abs(F.abs("r_low") - F.abs("r_high")) < 1e-9  # equal up to rounding: unchanged or a change of sign
    name = F.when(same & F.col("class").isin("strengthen", "weaken"), "unchanged").otherwise(F.col("class"))
    want = every.groupBy("ref_gene", name.alias("class")).agg(F.count("*").alias("n"), F.sum(F.col("sig_edge").cast("long")).alias("n_sig"), F.avg(F.abs("delta")).alias("a"), F.max(F.abs("delta")).alias("b"))
    want = {(r.ref_gene, r["class"]): tuple(r)[2:] for r in want.collect()}
    got = {(r.ref_gene, r["class"]): tuple(r)[2:] for r in significant.classes(long, refs, P, **DEAL).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_no_and_all_edges(data):
    long, refs, every = data
    assert significant.edges(long, refs, diffnet.Params(alpha=0.0), **DEAL).count() == 0
    assert significant.edges(long, refs, diffnet.Params(alpha=2.0), **DEAL).count() == every.count()


def test_equal_correlations_are_equal(spark):
    """The second half holds the first one's values in another order, so both correlations of a pair are the same number."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 32))
    x = np.concatenate([x, x[:, rng.permutation(32)]], axis=1)
    long = spark.createDataFrame([(g, s, float(v)) for g, row in enumerate(x) for s, v in enumerate(row)], "gene long, sample int, value double")
    halves = spark.createDataFrame([(0, "low" if s < 32 else "high", s) for s in range(64)], "ref_gene long, side string, sample long")
    got = significant.two_networks(long, halves, 0.1, block=7).collect()
    assert len(got) > 100 and all(r.w1 == r.w2 for r in got)
    r = np.corrcoef(np.argsort(np.argsort(x[:, :32], axis=1), axis=1))
    assert all(r_.w1 == pytest.approx(abs(r[r_.gene_i, r_.gene_j])) for r_ in got)
    assert len(got) == (np.abs(r[np.triu_indices(40, 1)]) > 0.1).sum()


def test_pairs_below_the_cut_are_left_out_first():
    """Every pair beyond the cut is there with its exact correlations, whether few or most pairs are; the others have no exact product."""
    rng = np.random.default_rng(4)
    x = rng.integers(1, 40, (60, 32))
    x[7], x[11], x[30] = 3, x[12], 41 - x[13]
    sides = [significant._centred(x[:, k : k + 16]) for k in (0, 16)]
    one, two = np.arange(30), np.arange(30, 60)
    pick = np.ones((30, 30), bool)
    pick[2, 3] = False
    at, r = significant._tested(sides, one, two, pick, 16)[:2]
    for cut in (0.0, 0.3, 0.55, 0.9):
        on = (np.abs(r[0]) > cut) | (np.abs(r[1]) > cut)
        got = significant._above(sides, one, two, pick, cut)
        assert (got[0] == at[on]).all() and all((a == b[on]).all() for a, b in zip(got[1], r, strict=True))


def test_summary_degrees_and_union_are_those_of_the_edges(data):
    long, refs, every = data
    edges = every.where("sig_edge")
    close = lambda one, two: [tuple(r) for r in one] == [pytest.approx(tuple(r), abs=1e-9) for r in two]
    same = F.abs(F.abs("r_low") - F.abs("r_high")) < 1e-9
    even = edges.withColumn("class", F.when(same & F.col("class").isin("strengthen", "weaken"), "unchanged").otherwise(F.col("class")))
    assert close(significant.summary(long, refs, P, **DEAL).orderBy("ref_gene").collect(), keyed.reference_summary(even, refs).orderBy("ref_gene").collect())
    focuses = long.select(F.col("gene").alias("focus")).distinct().crossJoin(refs)
    order = lambda df: df.select("ref_gene", "focus", "degree_low", "degree_high", "degree_diff").orderBy("ref_gene", "focus").collect()
    assert order(significant.degrees(long, refs, focuses, P, **DEAL)) == order(keyed.focus_degrees(edges, focuses, P.threshold))
    want = {tuple(r) for r in edges.select("gene_i", "gene_j").collect()}
    for per in (2, 16):
        got = [tuple(r) for r in significant.union(long, refs, P, block=9, per=per).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pairs_without_ties_are_counted_by_number(spark, monkeypatch):
    """Only the pairs of the tied row have p values of their own; the counts are those of single pairs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 40))
    x[5] = np.round(x[5])
    long = spark.createDataFrame([(g, s, float(v)) for g, row in enumerate(x) for s, v in enumerate(row)], "gene long, sample int, value double")
    code = significant._codes(long).orderBy("gene").toPandas()["values"]
    sides = [significant._centred(np.stack(code)[:, k : k + 8]) for k in (0, 8)]
    at = np.delete(np.arange(50), 5)
    full = 8 * 63 // 3
    r = [s[0][at] @ s[0][at].T for s in sides]
    want = (full - r[0]) / 4 * (full // 2 + 1) + (full - r[1]) / 4
    monkeypatch.setattr(significant, "ROWS", 16)
    monkeypatch.setattr(significant, "COLUMNS", 9)
    got = np.zeros((49, 49))
    for a, b, number in significant._numbers(sides, at, at, 8):
        got[a : a + len(number), b : b + number.shape[1]] = number
    assert (got == want).all()
