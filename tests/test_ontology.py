"""Term graphs against plain walks over all paths and all pairs."""

import math
import random

import pytest

from sparkweave.operators import ontology


def _graph(seed, n=40):
    rng = random.Random(seed)
    return [(t, p) for t in range(1, n) for p in {rng.randrange(t) for _ in range(rng.randint(1, 3))}]


def _plain(edges, terms, weight=0.8):
    up = {}
    for t, p in edges:
        up.setdefault(t, []).append(p)
    out = {}
    for t in terms:
        s, stack = {t: 1.0}, [t]
        while stack:
            x = stack.pop()
            for p in up.get(x, []):
                if s[x] * weight > s.get(p, 0):
                    s[p] = s[x] * weight
                    stack.append(p)
        out[t] = s
    return out


def _wang(s, cutoff):
    terms, out = sorted(s), {}
    for i, a in enumerate(terms):
        for b in terms[i + 1 :]:
            v = sum(s[a][x] + s[b][x] for x in s[a].keys() & s[b].keys()) / (sum(s[a].values()) + sum(s[b].values()))
            if v > cutoff:
                out[a, b] = v
    return out


@pytest.mark.parametrize("cutoff", [0.3, 0.5, 0.7, 0.85])
def test_similarity_finds_every_pair(spark, cutoff):
    edges = _graph(3)
    terms = spark.createDataFrame([(t,) for t in range(5, 40)] + [(7,), (None,)], "term int")
    graph = spark.createDataFrame(edges + [edges[0], (None, 1), (2, None), (4, 4)], "term int, parent int")
    closure = ontology.ancestors(terms, graph)
    want = _plain(edges, range(5, 40))
    got = {}
    for r in closure.collect():
        got.setdefault(r.term, {})[r.ancestor] = r.s
    assert got == {t: pytest.approx(s) for t, s in want.items()}
    pairs = {(r.a, r.b): r.similarity for r in ontology.graph_similarity(closure, cutoff).collect()}
    assert pairs == pytest.approx(_wang(want, cutoff))


def test_cycles_and_empty_graphs(spark):
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    graph = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "term string, parent string, w double")
    got = {(r.term, r.ancestor, r.s) for r in ontology.ancestors(terms, graph, "w").collect()}
    assert got == {("a", "a", 1.0), ("a", "b", 1.0), ("b", "b", 1.0), ("b", "a", 1.0)}
    alone = ontology.ancestors(terms, graph.limit(0), "w")
    assert {(r.term, r.ancestor) for r in alone.collect()} == {("a", "a"), ("b", "b")}
    assert ontology.graph_similarity(alone).count() == 0
    assert ontology.ancestors(terms.limit(0), graph, "w").count() == 0


def test_information(spark):
    edges, rng = _graph(5), random.Random(1)
    notes = sorted({(rng.randrange(1, 40), g) for g in range(120) for _ in range(2)})
    annotations = spark.createDataFrame(notes + notes[:5], "term int, gene int")
    closure = ontology.ancestors(annotations, spark.createDataFrame(edges, "term int, parent int"))
    s = _plain(edges, {t for t, _ in notes})
    genes = {}
    for t, g in notes:
        for a in s[t]:
            genes.setdefault(a, set()).add(g)
    total = len({g for _, g in notes})
    ic = {t: math.log(total / len(g)) for t, g in genes.items()}
    content = ontology.information(annotations, closure)
    assert {r.term: r.ic for r in content.collect()} == pytest.approx(ic, abs=1e-12)
    terms = sorted(s)
    for cutoff in (0.4, 0.7):
        want = {}
        for i, a in enumerate(terms):
            for b in terms[i + 1 :]:
                if ic[a] > 0 and ic[b] > 0 and s[a].keys() & s[b].keys():
                    v = 2 * max(ic[x] for x in s[a].keys() & s[b].keys()) / (ic[a] + ic[b])
                    if v > cutoff:
                        want[a, b] = v
        got = {(r.a, r.b): r.similarity for r in ontology.shared_information(closure, content, cutoff).collect()}
        assert got == pytest.approx(want)


def test_not_redundant(spark):
    # a - b - c in a row, d apart, e as good as f, g without a score beside d
    scored = spark.createDataFrame([("a", 0.03), ("b", 0.02), ("c", 0.01), ("d", 0.5), ("e", 0.1), ("f", 0.1), ("g", None)], "term string, q double")
    pairs = spark.createDataFrame([("a", "b", 0.8), ("b", "c", 0.9), ("e", "f", 0.75), ("d", "g", 0.71), ("a", "z", 0.9)], "a string, b string, similarity double")
    # a goes although only b, which goes as well, is similar to it
    assert sorted(r.term for r in ontology.not_redundant(scored, pairs).collect()) == ["c", "d", "e", "f"]
    assert ontology.not_redundant(scored.limit(0), pairs).count() == 0
    assert ontology.not_redundant(scored, pairs.limit(0)).count() == 7
