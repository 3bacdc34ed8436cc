"""Batch removal, correlation inside sets, exports and readers against plain versions."""

import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.operators import counts, pairs, rules, sets
from sparkweave.sources import export, matrix


def _long(spark, x, gene="gene", sample="sample"):
    return spark.createDataFrame([(g, s, float(v)) for g, row in enumerate(x) for s, v in enumerate(row)], f"{gene} long, {sample} long, value double")


def test_batches_are_removed_and_groups_stay(spark):
    rng = np.random.default_rng(2)
    group, batch = np.array([0, 1] * 9)[:17], np.array([0, 0, 1, 2, 2, 1, 2, 0, 1, 1, 2, 0, 0, 1, 2, 2, 2])
    y = rng.normal(size=(6, 17)) + 3 * group + np.array([0, 5, -4])[batch]
    meta = spark.createDataFrame([(s, f"g{group[s]}", int(batch[s])) for s in range(17)], "sample long, grp string, batch int")
    model = counts.design(meta, "sample", "grp", "g0", ("batch",))
    own = np.stack([(batch == b).astype(float) - (batch == 2) for b in (0, 1)], axis=1)
    x = np.column_stack([np.ones(17), group, own])
    beta = np.linalg.lstsq(x, y.T, rcond=None)[0]
    got = np.full(y.shape, np.nan)
    for r in counts.without_effects(_long(spark, y), model, "batch").collect():
        got[r.gene, r.sample] = r.value
    assert got == pytest.approx(y - (own @ beta[2:]).T, abs=1e-9)
    # nothing of the batches is left, and the group's effect is what it was
    again = np.linalg.lstsq(x, got.T, rcond=None)[0]
    assert again[2:] == pytest.approx(0, abs=1e-9) and again[1] == pytest.approx(beta[1])
    with pytest.raises(ValueError):
        counts.without_effects(_long(spark, y), model, "plate")
    short = _long(spark, y).where("not (gene = 2 and sample = 5)")
    assert counts.without_effects(short, model, "batch").select("gene").distinct().count() == 5
    assert counts.without_effects(_long(spark, y).limit(0), model, "batch").count() == 0


@pytest.mark.parametrize("block", [2, 3, 100])
def test_pairs_inside_sets_and_hubs(spark, block):
    x = np.random.default_rng(3).normal(size=(12, 20))
    x[4] = 1.0  # without spread: in no pair
    members = [(0, g) for g in range(8)] + [(1, 3), (1, 9), (1, 10), (2, 11), (0, 0), (1, 77), (None, 5)]
    of = spark.createDataFrame(members, "set long, gene long")
    vectors = pairs.rank_vectors(_long(spark, x))
    rank = x.argsort(axis=1).argsort(axis=1)
    r = np.corrcoef(rank.astype(float) + np.where(np.arange(12) == 4, 1e-9, 0)[:, None] * np.arange(20))
    sets_ = {0: [g for g in range(8) if g != 4], 1: [3, 9, 10]}
    want = {(s, a, b): r[a, b] for s, m in sets_.items() for a in m for b in m if a < b}
    got = {(p.set, p.gene_i, p.gene_j): p.r for p in sets.within_sets(vectors, of, block).collect()}
    assert got == pytest.approx(want)
    strength = {s: {a: sum(abs(r[a, b]) for b in m if b != a) for a in m} for s, m in sets_.items()}
    hubs = {h.set: (h.gene, h.strength) for h in sets.hub_of_each(vectors, of, block).collect()}
    assert hubs == {s: (max(v, key=v.get), pytest.approx(max(v.values()))) for s, v in strength.items()}


def test_random_sets(spark):
    of = spark.createDataFrame([(s, g) for s, size in ((0, 5), (3, 30)) for g in range(size)], "set long, gene long")
    got = sets.random_sets(of, spark.range(40).withColumnRenamed("id", "gene"), 4, 9).collect()
    drawn = {}
    for r in got:
        drawn.setdefault((r.set, r.rep), []).append(r.gene)
    assert set(drawn) == {(s, k) for s in (0, 3) for k in range(1, 5)}
    for (s, _), genes in drawn.items():
        size = {0: 5, 3: 30}[s]
        assert len(genes) == len(set(genes)) == min(size, 40 - size) and min(genes) >= size
    assert len({tuple(sorted(g)) for (s, _), g in drawn.items() if s == 0}) > 1


def test_coherence_tells_a_planted_set(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 30))
    x[:8] += 2 * rng.normal(size=30)
    of = spark.createDataFrame([(1, g) for g in range(8)] + [(2, g) for g in range(20, 28)], "set long, gene long")
    got = {(r.set, r.own): r for r in sets.coherence(pairs.rank_vectors(_long(spark, x)), of, 5).collect()}
    assert got[1, True].n == 28 and got[1, False].n == 5 * 28
    assert got[1, True].mean > 0.6 > 0.35 > got[1, False].mean
    assert abs(got[2, True].mean - got[2, False].mean) < 0.15


def test_required_features_are_kept(spark):
    names = spark.range(50).withColumnRenamed("id", "gene")
    wanted = spark.createDataFrame([(3,), (7,), (99,), (7,)], "gene long")
    for n, size in ((10, 10), (1, 2), (0, 2), (80, 50)):
        got = [r.gene for r in rules.subset(names, n, wanted, 4).collect()]
        assert len(got) == len(set(got)) == size and {3, 7} <= set(got)
    got = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (1.0, 1.0), (None, 1.0), (1.0, None)], "c double, t double").select(rules.gained(F.col("c"), F.col("t")).alias("g"))
    assert [r.g for r in got.collect()] == [2.0, 0.0, 0.0, None, None]


NET = [("r", 0, 1, 0.5, -0.4, "sign_change"), ("r", 0, 2, 0.6, 0.0, "disappear"), ("r", 1, 2, 0.00005, 0.7, "new"), ("r", 2, 3, 0.3, 0.9, "strengthen"), ("q", 1, 3, 0.2, 0.1, "weaken")]


def _network(spark):
    net = spark.createDataFrame([(*e[:5], e[4] - e[3], e[5]) for e in NET], "ref_gene string, gene_i long, gene_j long, r_low double, r_high double, delta double, class string")
    degrees = spark.createDataFrame([("r", 0, 2, 1, 2), ("r", 1, 1, 2, 2), ("r", 2, 2, 2, 3), ("r", 3, 1, 1, 1), ("r", 4, 0, 0, 0), ("q", 1, 1, 1, 1), ("q", 3, 1, 1, 1)], "ref_gene string, focus long, degree_low long, degree_high long, degree_diff long")
    return net, degrees


def test_lists_of_a_network(spark, tmp_path):
    net, degrees = _network(spark)
    export.write_lists(net, degrees, str(tmp_path / "out"))
    read = lambda name: [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / name)).collect()]
    assert ("r", "gene_0", "gene_1", "0.5000", "0.5000") in read("edges_low") and len(read("edges_low")) == 4
    assert len(read("edges_high")) == 4 and ("r", "gene_0", "gene_1", "-0.4000", "0.4000") in read("edges_high")
    assert len(read("edges_diff")) == 5
    nodes = {r[:2]: r[2:] for r in read("nodes")}
    assert nodes["r", "gene_2"] == ("2", "2", "3", "1", "1", "0", "2", "1.9000".replace("1.9000", f"{0.6 + 0.69995 + 0.6:.4f}"))
    assert ("r", "gene_4") not in nodes and len(nodes) == 6
    with pytest.raises(Exception, match="exist"):
        export.write_lists(net, degrees, str(tmp_path / "out"))


def test_ego_documents(spark, tmp_path):
    net, degrees = _network(spark)
    export.write_ego_graphs(export.ego_graphs(net, degrees, 2), str(tmp_path / "egos"))
    found = {}
    for f in (tmp_path / "egos").glob("ref_gene=*/ego=*/*.txt"):
        tree = ET.fromstring(f.read_text().encode())
        ns = {"g": "http://graphml.graphdrawing.org/xmlns"}
        data = lambda e: {d.get("key"): d.text for d in e.findall("g:data", ns)}
        nodes = {n.get("id"): data(n) for n in tree.findall("g:graph/g:node", ns)}
        edges = {(n.get("source"), n.get("target")): data(n) for n in tree.findall("g:graph/g:edge", ns)}
        found[f.parent.parent.name[9:], f.parent.name[4:]] = (nodes, edges)
    assert set(found) == {("r", "2"), ("r", "0"), ("q", "1"), ("q", "3")}
    nodes, edges = found["r", "0"]
    assert set(nodes) == {"gene_0", "gene_1", "gene_2"} and set(edges) == {("gene_0", "gene_1"), ("gene_0", "gene_2"), ("gene_1", "gene_2")}
    assert nodes["gene_0"]["is_ego"] == "true" and nodes["gene_2"] == {"is_ego": "false", "degree_low": "2", "degree_high": "2", "degree_diff": "3"}
    assert edges["gene_0", "gene_1"] == {"r_low": "0.500000", "r_high": "-0.400000", "delta": "-0.900000", "class": "sign_change"}
    assert len(found["r", "2"][1]) == 4


def test_names_are_escaped_and_lone_egos_have_a_document(spark):
    net = spark.createDataFrame([("r", 'a<"', "b&", 0.1, 0.2, 0.1, "weaken")], "ref_gene string, gene_i string, gene_j string, r_low double, r_high double, delta double, class string")
    degrees = spark.createDataFrame([("r", 'a<"', 1, 1, 1), ("r", "b&", 1, 1, 1), ("r", "lone", 0, 0, 0)], "ref_gene string, focus string, degree_low long, degree_high long, degree_diff long")
    rows = export.ego_graphs(net, degrees, 5).orderBy("part", "a", "b").collect()
    for ego, n in (('a<"', 2), ("b&", 2), ("lone", 1)):
        tree = ET.fromstring("\n".join(r.text for r in rows if r.ego == ego).encode())
        assert len([e for e in tree.iter() if e.tag.endswith("}node")]) == n and (ego == "lone" or {e.get("id") for e in tree.iter() if e.tag.endswith("}node")} == {'a<"', "b&"})
    assert export.ego_graphs(net.limit(0), degrees.limit(0)).count() == 0


def test_readers_of_references_and_shapes(spark, tmp_path):
    rows = spark.createDataFrame([("g1", 1, 0.5), ("g2", 1, 0.1), ("g2", 2, 0.2)], "ref_gene string, gene int, r double")
    path = str(tmp_path / "refs")
    matrix.write_by_reference(rows, path)
    assert matrix.read_references(spark, path).count() == 3
    assert {(r.gene, r.r) for r in matrix.read_reference(spark, path, "g2").collect()} == {(1, 0.1), (2, 0.2)}
    with pytest.raises(ValueError, match="g9"):
        matrix.read_reference(spark, path, "g9")
    folder = next((tmp_path / "refs").glob("ref_gene=g1"))
    (folder / "part-broken.zstd.parquet").write_bytes(b"PAR1 no parquet PAR1")
    assert matrix.read_references(spark, path, skip_unreadable=True).select("ref_gene", "gene").count() == 3
    (tmp_path / "m.tsv").write_text("gene_id\ts1\ts2\nA\t1\t2\ngene_id\t3\tNA\n")
    long = matrix.read_wide(spark, str(tmp_path / "m.tsv"))
    assert {(r.gene_id, r.sample_id): r.value for r in matrix.check_shape(long, 2, 2).collect()} == {("A", "s1"): 1.0, ("A", "s2"): 2.0, ("gene_id", "s1"): 3.0, ("gene_id", "s2"): None}
    for bad in (long.where("not (gene_id = 'A' and sample_id = 's1')"), long.union(long.limit(1))):
        with pytest.raises(ValueError, match="samples"):
            matrix.check_shape(bad)
    with pytest.raises(ValueError, match="expected"):
        matrix.check_shape(long, 3)
    (tmp_path / "twice.tsv").write_text("id\ts1\ts1\nA\t1\t2\n")
    with pytest.raises(ValueError, match="repeated"):
        matrix.read_wide(spark, str(tmp_path / "twice.tsv"))
    (tmp_path / "wide.tsv").write_text("\ts1\nA\t1\n")
    wide = matrix.to_wide(matrix.bind(long, matrix.read_wide(spark, str(tmp_path / "wide.tsv")).withColumn("sample_id", F.lit("s3")).withColumnRenamed("V0", "gene_id")))
    assert {r.gene_id: r.s3 for r in wide.collect()} == {"A": 1.0, "gene_id": None}
