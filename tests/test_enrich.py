"""Running scores and enrichment against plain versions."""

import random

import pytest

from sparkweave.operators import enrich


def plain_score(ranking, members):
    """ranking: (gene, score) in order."""
    m, n = len(members), len(ranking)
    total = sum(abs(s) for g, s in ranking if g in members)
    at, best = 0.0, [0.0, 0.0]
    for g, s in ranking:
        at += (abs(s) / total if total else 1 / m) if g in members else -1 / (n - m)
        best = [max(best[0], at), min(best[1], at)]
    return best[0] if round(best[0], 12) >= round(-best[1], 12) else best[1]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    score = {g: rng.gauss(0, 1) for g in range(400)}
    score[7] = score[8]  # a tie
    ranking = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    sets = {"up": [g for g, _ in ranking[:40:2]], "down": [g for g, _ in ranking[-40::2]], "none": rng.sample(range(400), 30), "small": [1, 2], "all": list(range(400))}
    r = spark.createDataFrame([(g, s) for g, s in ranking] + [(ranking[0][0], -9.0), (999, None)], "gene long, score double")
    t = spark.createDataFrame([(k, g) for k, v in sets.items() for g in [*v, v[0], 5000]], "term string, gene long")
    return ranking, sets, r, t


def test_positions(data):
    ranking, _, r, _ = data
    assert [x.gene for x in enrich.positions(r).orderBy("pos").collect()] == [g for g, _ in ranking]
    assert enrich.positions(r.where("score > 99")).count() == 0


def test_scores_and_null(data):
    ranking, sets, r, t = data
    rows = {x.term: x for x in enrich.set_enrichment(r, t, permutations=300).collect()}
    assert rows.keys() == {"up", "down", "none"}
    for term, row in rows.items():
        assert row.es == pytest.approx(plain_score(ranking, set(sets[term])), abs=1e-9) and row.size == len(set(sets[term]))
    assert rows["up"].p < 0.02 and rows["up"].nes > 1.5 and rows["down"].p < 0.02 and rows["down"].nes < -1.5
    assert rows["none"].p > 0.02 and all(x.q >= x.p - 1e-12 for x in rows.values())
    rng = random.Random(1)  # the null against plain random sets
    null = [x for x in (plain_score(ranking, set(rng.sample(range(400), 20))) for _ in range(300)) if x > 0]
    assert abs(rows["up"].es / rows["up"].nes - sum(null) / len(null)) < 0.06


def test_no_terms(data):
    _, _, r, t = data
    assert enrich.set_enrichment(r, t, least=100, most=200).count() == 0
