"""Queries of term graphs, corrected counts, network exports and correlation inside sets.

The term graph is made from the parts: a term is a name with a type; above it stand the name, and the noun with the type;
above those the adjective, the noun and the type; above all the root.
"""

from pyspark.sql import functions as F

from sparkweave.functions.ranks import drawn_sql
from sparkweave.operators import counts, keyed, ontology, pairs, rules, sets, significant
from sparkweave.sources import export
from sparkweave.sources.matrix import from_embeddings
from sparkweave.sources.scratch import checkpointed

from .catalog import EXPR, ORACLE_SQL, QUERIES, P, query, r6, rounded, z_sql
from .models import COUNTS, DEGREES, KEYED, _counts, _keyed, _references

# ---- terms ---------------------------------------------------------------------------------------------------------
TERMS = """parts AS (SELECT p_partkey AS gene, p_size, p_name AS nm, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, p_type AS ty FROM part),
ann AS MATERIALIZED (SELECT DISTINCT gene, nm || '/' || ty AS term FROM parts),
graph AS MATERIALIZED (SELECT DISTINCT t, p FROM (SELECT unnest([{'t': nm || '/' || ty, 'p': nm}, {'t': nm || '/' || ty, 'p': noun || '/' || ty}, {'t': nm, 'p': 'adjective ' || adj}, {'t': nm, 'p': 'noun ' || noun},
 {'t': noun || '/' || ty, 'p': 'noun ' || noun}, {'t': noun || '/' || ty, 'p': 'type ' || ty}, {'t': 'adjective ' || adj, 'p': 'part'}, {'t': 'noun ' || noun, 'p': 'part'}, {'t': 'type ' || ty, 'p': 'part'}], recursive := true) FROM parts)),
walk(term, ancestor, d) AS (SELECT DISTINCT term, term, 0 FROM ann UNION SELECT term, p, d + 1 FROM walk JOIN graph ON t = ancestor),
cl AS MATERIALIZED (SELECT term, ancestor, pow(0.8::DOUBLE, min(d)) AS s FROM walk GROUP BY ALL)"""
SIMILAR = f"""{TERMS}, total AS (SELECT term, sum(s) AS sv FROM cl GROUP BY term),
sim AS (SELECT a.term AS a, b.term AS b, sum(a.s + b.s) / (any_value(x.sv) + any_value(y.sv)) AS similarity FROM cl a JOIN cl b ON a.ancestor = b.ancestor AND a.term < b.term JOIN total x ON x.term = a.term JOIN total y ON y.term = b.term GROUP BY ALL HAVING similarity > 0.5)"""
CONTENT = f"""{TERMS}, content AS MATERIALIZED (SELECT ancestor AS term, count(DISTINCT gene) AS n, ln((SELECT count(DISTINCT gene) FROM ann)::DOUBLE) - ln(count(DISTINCT gene)::DOUBLE) AS ic FROM ann JOIN cl USING (term) GROUP BY ancestor)"""


def _annotations(spark, sf_dir):
    """gene, score and its term, and the graph above."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("gene"), "p_size", F.col("p_name").alias("nm"), F.col("p_type").alias("ty"))
    p = p.withColumns({"adj": F.split_part("nm", F.lit(" "), F.lit(1)), "noun": F.split_part("nm", F.lit(" "), F.lit(2))})
    join = lambda *c: F.concat_ws("/", *c)
    kind = lambda name, c: F.concat(F.lit(name + " "), c)
    term, low = join("nm", "ty"), join("noun", "ty")
    one = [("adjective", "adj"), ("noun", "noun"), ("type", "ty")]
    links = [(term, F.col("nm")), (term, low), (F.col("nm"), kind("adjective", "adj")), (F.col("nm"), kind("noun", "noun")), (low, kind("noun", "noun")), (low, kind("type", "ty"))]
    links += [(kind(n, c), F.lit("part")) for n, c in one]
    graph = p.select(F.explode(F.array(*[F.struct(t.alias("term"), u.alias("parent")) for t, u in links])).alias("l")).select("l.*").distinct()
    return p.select("gene", "p_size", term.alias("term")), graph


def _closure(spark, sf_dir):
    notes, graph = _annotations(spark, sf_dir)
    return notes, ontology.ancestors(notes, graph)


@query(f"WITH RECURSIVE {TERMS} SELECT term, ancestor, {r6('s')} AS s FROM cl")
def term_ancestors(spark, sf_dir):
    return rounded(_closure(spark, sf_dir)[1])


@query(f"WITH RECURSIVE {CONTENT} SELECT term, n, {r6('ic')} AS ic FROM content")
def term_information(spark, sf_dir):
    return rounded(ontology.information(*_closure(spark, sf_dir)))


@query(f"WITH RECURSIVE {SIMILAR} SELECT a, b, {r6('similarity')} AS similarity FROM sim")
def similar_terms(spark, sf_dir):
    return rounded(ontology.graph_similarity(_closure(spark, sf_dir)[1], 0.5))


@query(f"""WITH RECURSIVE {CONTENT}, sim AS (SELECT a.term AS a, b.term AS b, 2 * max(c.ic) / (any_value(x.ic) + any_value(y.ic)) AS similarity FROM cl a JOIN cl b ON a.ancestor = b.ancestor AND a.term < b.term
 JOIN content c ON c.term = a.ancestor JOIN content x ON x.term = a.term JOIN content y ON y.term = b.term WHERE x.ic > 0 AND y.ic > 0 GROUP BY a.term, b.term)
SELECT a, b, {r6('similarity')} AS similarity FROM sim WHERE similarity > 0.6""")
def terms_by_shared_information(spark, sf_dir):
    notes, closure = _closure(spark, sf_dir)
    return rounded(ontology.shared_information(closure, ontology.information(notes, closure), 0.6))


@query(f"""WITH RECURSIVE {SIMILAR}, sc AS (SELECT nm || '/' || ty AS term, avg(p_size) AS q FROM parts GROUP BY ALL), near AS (SELECT a AS term, b AS centre FROM sim UNION ALL SELECT b, a FROM sim UNION ALL SELECT term, term FROM sc),
best AS (SELECT centre, min(q) AS best FROM near JOIN sc USING (term) GROUP BY centre)
SELECT term, {r6('q')} AS q FROM sc WHERE term NOT IN (SELECT term FROM near JOIN sc USING (term) JOIN best USING (centre) WHERE q > best)""")
def terms_without_redundancy(spark, sf_dir):
    """Terms by the mean size of their parts, as a score; terms similar to better ones go."""
    notes, closure = _closure(spark, sf_dir)
    scored = notes.groupBy("term").agg(F.avg("p_size").alias("q"))
    return rounded(ontology.not_redundant(scored, ontology.graph_similarity(closure, 0.5)))


# ---- counts --------------------------------------------------------------------------------------------------------
@query(f"""WITH {COUNTS}, l AS (SELECT g, s, s % 5 AS batch, log2((n + 0.5) / (size + 1) * 1e6) AS y FROM cnt JOIN lib USING (s)), b AS (SELECT g, batch, avg(y) AS m FROM l GROUP BY ALL), t AS (SELECT g, avg(m) AS level FROM b GROUP BY g)
SELECT g AS gene, s AS sample, {r6('y - m + level')} AS value FROM l JOIN b USING (g, batch) JOIN t USING (g)""")
def batch_free_log_counts(spark, sf_dir):
    """Five batches of unequal size are taken out of the log counts."""
    c = _counts(spark, sf_dir)
    samples = c.select("sample").distinct().select("sample", F.lit("all").alias("group"), (F.col("sample") % 5).alias("batch"))
    model = counts.design(samples, "sample", "group", "all", ("batch",))
    return rounded(counts.without_effects(counts.log_counts(c, counts.library_sizes(c)), model, "batch"))


# ---- exports -------------------------------------------------------------------------------------------------------
def _network_and_degrees(spark, sf_dir):
    """Both from one computation of the networks."""
    refs, net = _keyed(spark, sf_dir)
    net = checkpointed(net)
    genes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("focus"))
    return net, checkpointed(keyed.focus_degrees(net, genes.crossJoin(F.broadcast(refs)), P.threshold))


@query(f"""WITH {KEYED}, x AS (SELECT ref_gene, 'low' AS net, gene_i, gene_j, r_low AS r FROM kn WHERE abs(r_low) >= 0.1 UNION ALL SELECT ref_gene, 'high', gene_i, gene_j, r_high FROM kn WHERE abs(r_high) >= 0.1)
SELECT ref_gene, net, 'gene_' || gene_i AS "from", 'gene_' || gene_j AS "to", {r6('r')} AS r, {r6('abs(r)')} AS abs_r FROM x""")
def exported_edges(spark, sf_dir):
    net = _keyed(spark, sf_dir)[1]
    low, high = (export.edge_list(net, side, P.threshold).withColumn("net", F.lit(side)) for side in ("low", "high"))
    return rounded(low.unionByName(high).select("ref_gene", "net", "from", "to", "r", "abs_r"))


@query(f"""WITH {DEGREES}, e AS (SELECT ref_gene, unnest([gene_i, gene_j]) AS focus, class, delta FROM kn), c AS (SELECT ref_gene, focus, count(*) FILTER (class = 'disappear') AS n_disappear, count(*) FILTER (class = 'new') AS n_new, count(*) FILTER (class = 'sign_change') AS n_sign_change, sum(abs(delta)) AS a FROM e GROUP BY ALL)
SELECT ref_gene, 'gene_' || focus AS gene_id, degree_low, degree_high, degree_diff, n_disappear, n_new, n_sign_change, n_disappear + n_new + n_sign_change AS rewiring_score, {r6('a')} AS sum_abs_delta FROM fd JOIN c USING (ref_gene, focus)""")
def exported_nodes(spark, sf_dir):
    return rounded(export.node_table(*_network_and_degrees(spark, sf_dir)))


@query(f"""WITH {DEGREES}, ego AS (SELECT ref_gene, focus AS ego FROM (SELECT *, row_number() OVER (PARTITION BY ref_gene ORDER BY degree_diff DESC, focus) AS k FROM fd) WHERE k <= 3),
near AS (SELECT DISTINCT ref_gene, ego, CASE WHEN gene_i = ego THEN gene_j ELSE gene_i END AS node FROM ego JOIN kn USING (ref_gene) WHERE ego IN (gene_i, gene_j)), mem AS (SELECT * FROM near UNION ALL SELECT ref_gene, ego, ego FROM ego)
SELECT mem.ref_gene, ego, 1::BIGINT AS part, '<node id="gene_' || node || '"><data key="is_ego">' || (node = ego)::VARCHAR || '</data><data key="degree_low">' || degree_low || '</data><data key="degree_high">' || degree_high || '</data><data key="degree_diff">' || degree_diff || '</data></node>' AS text
FROM mem JOIN fd ON fd.ref_gene = mem.ref_gene AND fd.focus = node UNION ALL
SELECT x.ref_gene, x.ego, 2, '<edge source="gene_' || gene_i || '" target="gene_' || gene_j || '"><data key="r_low">' || printf('%.6f', r_low) || '</data><data key="r_high">' || printf('%.6f', r_high) || '</data><data key="delta">' || printf('%.6f', delta) || '</data><data key="class">' || class || '</data></edge>'
FROM kn JOIN mem x ON x.ref_gene = kn.ref_gene AND x.node = gene_i JOIN mem y ON y.ref_gene = x.ref_gene AND y.ego = x.ego AND y.node = gene_j""")
def exported_ego_graphs(spark, sf_dir):
    """Node and edge lines of the GraphML documents; the head and the tail are the same for all."""
    lines = export.ego_graphs(*_network_and_degrees(spark, sf_dir), 3)
    return lines.where("part in (1, 2)").select("ref_gene", "ego", F.col("part").cast("long").alias("part"), "text")


# ---- sets ----------------------------------------------------------------------------------------------------------
INSIDE = f"{EXPR}, {z_sql('z', 'expr')}, lab AS (SELECT vec_id AS g, label::BIGINT AS grp FROM embeddings), prs AS (SELECT x.grp, a.g AS gi, b.g AS gj, list_dot_product(a.z, b.z) / (len(a.z) - 1) AS r FROM z a JOIN lab x ON x.g = a.g JOIN lab y ON y.grp = x.grp JOIN z b ON b.g = y.g AND a.g < b.g)"


def _labels(long):
    return long.select(F.col("label").cast("long").alias("set"), "gene").distinct()


@query(f"""WITH {INSIDE}, s AS (SELECT grp, g, sum(abs(r)) AS strength FROM (SELECT grp, unnest([gi, gj]) AS g, r FROM prs) GROUP BY ALL)
SELECT grp AS "set", g AS gene, {r6('strength')} AS strength FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(strength, 9) DESC, g) AS k FROM s) WHERE k = 1""")
def set_hubs(spark, sf_dir):
    long = from_embeddings(spark, sf_dir)
    return rounded(sets.hub_of_each(pairs.rank_vectors(long), _labels(long)))


@query(f"""WITH {EXPR}, {z_sql('z', 'expr')}, lab AS (SELECT vec_id AS g, label::BIGINT AS grp FROM embeddings WHERE label IN (0, 1)), own AS (SELECT grp, 0 AS rep, g FROM lab),
rnd AS (SELECT grp, rep, g FROM (SELECT grp, rep, g, row_number() OVER (PARTITION BY grp, rep ORDER BY {drawn_sql(7, 'grp', 'rep', 'g')}, g) AS k FROM (SELECT DISTINCT grp FROM lab) q, range(1, 4) r(rep), z WHERE NOT EXISTS (FROM lab l WHERE l.grp = q.grp AND l.g = z.g)) JOIN (SELECT grp, count(*) AS size FROM lab GROUP BY grp) USING (grp) WHERE k <= size),
mem AS (SELECT * FROM own UNION ALL SELECT * FROM rnd), prs AS (SELECT x.grp, x.rep = 0 AS own, abs(list_dot_product(a.z, b.z) / (len(a.z) - 1)) AS r FROM mem x JOIN mem y ON y.grp = x.grp AND y.rep = x.rep AND x.g < y.g JOIN z a ON a.g = x.g JOIN z b ON b.g = y.g)
SELECT grp AS "set", own, count(*) AS n, {r6('avg(r)')} AS mean, {r6('median(r)')} AS median FROM prs GROUP BY ALL""")
def set_coherence(spark, sf_dir):
    """Correlation inside two labels' features against three random sets of each one's size."""
    long = from_embeddings(spark, sf_dir)
    return rounded(sets.coherence(pairs.rank_vectors(long), _labels(long.where("label in (0, 1)")), 3, 7))


@query(f"""WITH own AS (SELECT vec_id AS gene FROM embeddings WHERE label = 2), rest AS (SELECT vec_id AS gene, row_number() OVER (ORDER BY {drawn_sql(5, 'vec_id')}, vec_id) AS k FROM embeddings WHERE label <> 2)
SELECT gene FROM own UNION ALL SELECT gene FROM rest WHERE k <= (SELECT greatest(0, (SELECT count(*) // 2 FROM embeddings) - count(*)) FROM own)""")
def random_half_with_required(spark, sf_dir):
    """Half of the features, those of one label always among them."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("gene"), "label")
    return rules.subset(e, e.count() // 2, e.where("label = 2"), 5)


@query(f"""WITH {EXPR}, m AS (SELECT g, avg(v) FILTER (s < 32) AS a, avg(v) FILTER (s >= 32) AS b FROM expr GROUP BY g), x AS (SELECT *, round(CASE WHEN b > a THEN b ELSE 0 END, 9) AS score FROM m)
SELECT g AS gene, {r6('a')} AS control, {r6('b')} AS treated, {r6('score')} AS score FROM x ORDER BY score DESC, g LIMIT 20""")
def largest_gains(spark, sf_dir):
    """The 20 features with the largest treated mean among those that rose; the second half of the samples counts as treated."""
    half = lambda on: F.avg(F.when(F.expr(on), F.col("value")))
    m = from_embeddings(spark, sf_dir).groupBy("gene").agg(half("sample < 32").alias("control"), half("sample >= 32").alias("treated"))
    m = m.withColumn("score", F.round(rules.gained(F.col("control"), F.col("treated")), 9))
    return rounded(rules.top(m, 20, F.col("score"), "gene"))


@query(f"WITH {KEYED} SELECT DISTINCT gene_i, gene_j FROM kn")
def edges_of_any_reference(spark, sf_dir):
    """The union of the references' edge sets."""
    return significant.union(from_embeddings(spark, sf_dir), _references(spark, sf_dir), P)
