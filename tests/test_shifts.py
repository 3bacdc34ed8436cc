"""MAD shifts of all references: exact medians from blocks, and no table of references times genes."""

import numpy as np
import pandas as pd
import pytest

from sparkweave.operators import diffnet, express


def test_column_mads():
    rng = np.random.default_rng(1)
    for n in range(1, 18):
        x = rng.integers(0, 9, (n, 200)) * 0.1
        m = np.median(x, axis=0)
        assert (express.column_mads(x) == express.MAD_SCALE * np.median(np.abs(x - m), axis=0)).all()


@pytest.mark.parametrize("sample", [2048, 8])
def test_shifts_hand_on_few_values(spark, monkeypatch, sample):
    monkeypatch.setattr(express, "SAMPLE", sample)
    made, jobs = [], express._mad_jobs
    monkeypatch.setattr(express, "_mad_jobs", lambda *a, **k: made.append(jobs(*a, **k)) or made[-1])
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(160, 20)) * np.repeat([1, 3], 80)[:, None], 1)
    long = spark.createDataFrame(pd.DataFrame({"gene": np.repeat(np.arange(160), 20), "sample": np.tile(np.arange(20), 160), "value": x.ravel()}))
    splits = diffnet.extremes(long, 0.2)
    got = {r["ref_gene"]: r for r in express.mad_shifts(long, splits, block=50).collect()}
    side = splits.toPandas()
    for ref in range(160):
        for name in ("low", "high"):
            picked = side[(side["ref_gene"] == ref) & (side["side"] == name)]["sample"].to_numpy()
            part = np.delete(x, ref, axis=0)[:, picked]
            mads = express.MAD_SCALE * np.median(np.abs(part - np.median(part, axis=1, keepdims=True)), axis=1)
            assert got[ref][f"mean_mad_{name}"] == pytest.approx(mads.mean(), abs=1e-12)
            assert got[ref][f"median_mad_{name}"] == np.median(mads)
        assert got[ref]["n_genes"] == 159
    assert [m.count() for m in made] == [2 * 160, 4 * 2 * 160, 4 * 2 * 160]  # rows by reference, side and block, not by gene
    if sample == 2048:
        assert sum(len(r["v"]) for r in made[2].select("v").collect()) < 160 * 159


def test_mads_of_draws(spark):
    """Of features with missing values and samples too; a row for each feature and draw, made from a row for each feature."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(30, 21)), 1)
    x[3, ::2], x[4] = np.nan, np.nan
    rows = [(g, s, None if np.isnan(v) else float(v)) for g, row in enumerate(x) for s, v in enumerate(row) if g != 7 or s < 9]
    long = spark.createDataFrame(rows, "gene long, sample int, value double")
    draws = {1: [2, 3, 5, 8, 13], 2: list(range(20)), 5: [20]}
    made = express.drawn_mads(long, draws)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.gene, r.b): r.mad for r in made.collect()}
    assert len(got) == 30 * 3
    for (g, b), mad in got.items():
        v = np.array([x[g, s] for s in draws[b] if g != 7 or s < 9])
        v = v[~np.isnan(v)]
        assert mad is None if not len(v) else mad == express.MAD_SCALE * np.median(np.abs(v - np.median(v)))
