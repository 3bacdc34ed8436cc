"""Queries of the count models, the networks of many references, path metrics and modules.

Counts are floor(exp(5 + 3 x)) of the embeddings' numbers. Where a fit has no SQL form, the operator's test holds it
against a plain version.
"""

from pyspark.sql import functions as F

from sparkweave.operators import counts, diffnet, enrich, express, graph, keyed, modules, negbin, pairs, paths, resample, significant, wedges
from sparkweave.sources.matrix import from_embeddings

from .catalog import EXPR, NET, ORACLE_SQL, QUERIES, SPLIT, P, _lists, _near, _net, normal_sql, query, r6, rounded, t_sql, with_q

# ---- counts --------------------------------------------------------------------------------------------------------
COUNTS = f"{EXPR}, cnt AS (SELECT g, s, floor(exp(5 + 3 * v))::BIGINT AS n FROM expr), lib AS (SELECT s, sum(n)::DOUBLE AS size FROM cnt GROUP BY s)"
FOCUS = 0


def _counts(spark, sf_dir):
    return from_embeddings(spark, sf_dir).select("gene", "sample", F.floor(F.exp(5 + 3 * F.col("value"))).alias("n"))


def _design(spark, sf_dir):
    """Low and high group by the focus feature's quantiles, and a batch of four levels with sum contrasts."""
    groups = diffnet.quantile_groups(from_embeddings(spark, sf_dir).where(F.col("gene") == FOCUS))
    return counts.design(groups.select("sample", "group", (F.col("sample") % 4).alias("batch")), "sample", "group", "Q1", ("batch",))


@query(f"WITH {COUNTS} SELECT g AS gene, s AS sample, {r6('n / size * 1e6')} AS cpm FROM cnt JOIN lib USING (s)")
def counts_per_million(spark, sf_dir):
    c = _counts(spark, sf_dir)
    return rounded(counts.counts_per_million(c, counts.library_sizes(c)))


@query(f"""WITH {COUNTS}, f AS (SELECT g, avg(ln(n)) AS m FROM cnt GROUP BY g HAVING min(n) > 0)
SELECT s AS sample, {r6('exp(median(ln(n) - m))')} AS size FROM cnt JOIN f USING (g) GROUP BY s""")
def median_ratio_sizes(spark, sf_dir):
    return rounded(counts.median_ratio_sizes(_counts(spark, sf_dir)))


@query(f"""WITH {COUNTS}, used AS (SELECT * FROM cnt WHERE g IN (SELECT g FROM cnt GROUP BY g HAVING max(n) > 0)), up AS (SELECT s, size, quantile_cont(n, 0.75) / size AS q FROM used JOIN lib USING (s) GROUP BY s, size),
ref AS (SELECT s AS rs, size AS rsize FROM up, (SELECT avg(q) AS m FROM up) ORDER BY round(abs(q - m), 12), s LIMIT 1),
x AS (SELECT a.s, a.g, a.n::DOUBLE AS n, size, b.n::DOUBLE AS r, rsize FROM used a JOIN lib USING (s) JOIN used b ON b.g = a.g JOIN ref ON b.s = rs WHERE a.n > 0 AND b.n > 0),
y AS (SELECT s, log2(n / size / (r / rsize)) AS m, (log2(n / size) + log2(r / rsize)) / 2 AS l, (size - n) / size / n + (rsize - r) / rsize / r AS v FROM x),
k AS (SELECT *, count(*) OVER (PARTITION BY s) AS k, rank() OVER (PARTITION BY s ORDER BY m) + (count(*) OVER (PARTITION BY s, m) - 1) / 2.0::DOUBLE AS rm, rank() OVER (PARTITION BY s ORDER BY l) + (count(*) OVER (PARTITION BY s, l) - 1) / 2.0::DOUBLE AS rl FROM y),
o AS (SELECT *, rm BETWEEN floor(k * 0.3) + 1 AND k - floor(k * 0.3) AND rl BETWEEN floor(k * 0.05) + 1 AND k - floor(k * 0.05) AS keep FROM k),
f AS (SELECT s, CASE WHEN max(abs(m)) < 1e-6 THEN 0 ELSE coalesce(sum(m / v) FILTER (keep) / sum(1 / v) FILTER (keep), 0) END AS f FROM o GROUP BY s)
SELECT s AS sample, size, {r6('pow(2, f - avg(f) OVER ())')} AS factor FROM f JOIN lib USING (s)""")
def trimmed_mean_factors(spark, sf_dir):
    return rounded(counts.trimmed_mean_factors(_counts(spark, sf_dir)))


@query()
def log_count_changes(spark, sf_dir):
    d = _design(spark, sf_dir)
    return counts.moderated_t(_counts(spark, sf_dir), d, "groupQ5")


@query()
def negative_binomial_changes(spark, sf_dir):
    return negbin.mean_changes(_counts(spark, sf_dir), _design(spark, sf_dir), "groupQ5")


@query()
def negative_binomial_likelihood_ratios(spark, sf_dir):
    return negbin.mean_changes(_counts(spark, sf_dir), _design(spark, sf_dir), "groupQ5", test="lrt", shrink=False)


@query()
def mean_and_dispersion_changes(spark, sf_dir):
    return negbin.mean_and_dispersion_changes(_counts(spark, sf_dir), _design(spark, sf_dir), "groupQ5")


@query()
def changed_gene_overlap(spark, sf_dir):
    """Genes that the three models call changed, by the set of models that do; classes as the models give them."""
    c, d = _counts(spark, sf_dir), _design(spark, sf_dir)
    both = negbin.mean_and_dispersion_changes(c, d, "groupQ5").select("gene", F.col("class_modelcomp").alias("class"))
    found = [("linear", counts.moderated_t(c, d, "groupQ5")), ("binomial", negbin.mean_changes(c, d, "groupQ5", shrink=False)), ("dispersion", both)]
    members = None
    for name, df in found:
        one = df.where("class <> 'NS'").select(F.lit(name).alias("name"), "gene")
        members = one if members is None else members.unionByName(one)
    return express.venn_members(members).groupBy("pattern").agg(F.count("*").alias("n"))


# ---- networks of several references --------------------------------------------------------------------------------
REFERENCES = "top:6"  # the first six features, each with a network of its own
CLASS = """CASE WHEN (sig_low AND abs(r_low) >= 0.1) AND NOT (sig_high AND abs(r_high) >= 0.1) THEN 'disappear' WHEN NOT (sig_low AND abs(r_low) >= 0.1) AND (sig_high AND abs(r_high) >= 0.1) THEN 'new'
 WHEN NOT (sig_low AND abs(r_low) >= 0.1) THEN 'unchanged' WHEN sign(r_low) <> sign(r_high) THEN 'sign_change' WHEN abs(r_high) > abs(r_low) THEN 'strengthen' WHEN abs(r_high) < abs(r_low) THEN 'weaken' ELSE 'unchanged' END"""
KEYED = f"""{EXPR}, {SPLIT}, refs AS (SELECT vec_id AS ref FROM embeddings ORDER BY vec_id LIMIT 6),
kv AS (SELECT p.g AS ref, p.side, e.g, e.s, e.v FROM expr e JOIN split p ON p.s = e.s WHERE p.g IN (SELECT ref FROM refs)),
kr AS (SELECT *, rank() OVER (PARTITION BY ref, side, g ORDER BY v) + (count(*) OVER (PARTITION BY ref, side, g, v) - 1) / 2.0::DOUBLE AS r FROM kv),
kz AS (SELECT ref, side, g, list((r - m) / sd ORDER BY s) AS z FROM (SELECT *, avg(r) OVER w AS m, stddev_samp(r) OVER w AS sd FROM kr WINDOW w AS (PARTITION BY ref, side, g)) GROUP BY ALL),
kc AS (SELECT a.ref, a.side, a.g AS gi, b.g AS gj, greatest(-1, least(1, list_dot_product(a.z, b.z) / (len(a.z) - 1))) AS r FROM kz a JOIN kz b ON a.ref = b.ref AND a.side = b.side AND a.g < b.g),
kd AS (SELECT l.ref, l.gi AS gene_i, l.gj AS gene_j, l.r AS r_low, h.r AS r_high, h.r - l.r AS delta FROM kc l JOIN kc h USING (ref, gi, gj) WHERE l.side = 'low' AND h.side = 'high'),
kf AS (SELECT *, {t_sql('r_low', 12)} AS p_low, {t_sql('r_high', 12)} AS p_high, (atanh(greatest(-0.9999, least(0.9999, r_high))) - atanh(greatest(-0.9999, least(0.9999, r_low)))) / sqrt(2 / 9.0::DOUBLE) AS z FROM kd),
kp AS (SELECT *, {normal_sql('z')} AS p_diff FROM kf), {with_q('kq', 'kp', ['p_low', 'p_high', 'p_diff'], 'ref')},
ks AS (SELECT ref AS ref_gene, gene_i, gene_j, r_low, r_high, delta, q_low < 0.7 AS sig_low, q_high < 0.7 AS sig_high, q_diff < 0.7 AS sig_diff FROM kq),
kn AS MATERIALIZED (SELECT *, {CLASS} AS class FROM ks WHERE (sig_low OR sig_high) AND sig_diff)"""


def _references(spark, sf_dir):
    return keyed.parse_focus(REFERENCES, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("gene"))).withColumnRenamed("focus", "ref_gene")


def _keyed(spark, sf_dir):
    refs = _references(spark, sf_dir)
    return refs, significant.edges(from_embeddings(spark, sf_dir), refs, P, "sig_edge")


@query(f"WITH {KEYED} SELECT ref_gene, gene_i, gene_j, {r6('r_low')} AS r_low, {r6('r_high')} AS r_high, {r6('delta')} AS delta, class FROM kn")
def reference_edges(spark, sf_dir):
    return rounded(_keyed(spark, sf_dir)[1].select("ref_gene", "gene_i", "gene_j", "r_low", "r_high", "delta", "class"))


def _focus_sql() -> str:
    low, high = "(sig_low AND abs(r_low) >= 0.1)", "(sig_high AND abs(r_high) >= 0.1)"
    cols = []
    for name, on in (("l1", "layer = 'direct'"), ("l2", "layer IN ('inner', 'outer')"), ("full", "layer IS NOT NULL")):
        n = lambda c, on=on: f"count(*) FILTER ({on} AND {c})"
        cols += [f"count(*) FILTER ({on}) AS {name}_n_edges", *[n(f"class = '{c}'") + f" AS {name}_n_{c}" for c in ("disappear", "new", "sign_change", "strengthen", "weaken")], f"{n(low)} AS {name}_n_edges_low", f"{n(high)} AS {name}_n_edges_high"]
        v = lambda f, x, c, on=on: f"coalesce({f}({x}) FILTER ({on} AND {c}), 0)::DOUBLE"
        cols += [f"{v('sum', 'abs(r_low)', low)} AS {name}_conn_low", f"{v('sum', 'abs(r_high)', high)} AS {name}_conn_high", f"{v('avg', 'abs(r_low)', low)} AS {name}_conn_mean_low", f"{v('avg', 'abs(r_high)', high)} AS {name}_conn_mean_high"]
        cols += [f"{v('sum', 'abs(delta)', 'true')} AS {name}_conn_diff", f"{v('avg', 'abs(delta)', 'true')} AS {name}_mean_abs_dr", f"{v('avg', 'delta', 'true')} AS {name}_mean_delta"]
    doubles = [f"{k}_{c}" for k in ("l1", "l2", "full") for c in ("conn_low", "conn_high", "conn_mean_low", "conn_mean_high", "conn_diff", "mean_abs_dr", "mean_delta")]
    share = lambda a, b: r6(f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END")
    rewire = {k: f"{k}_n_disappear + {k}_n_new + {k}_n_sign_change" for k in ("l1", "l2", "full")}
    ratios = {
        "l1_frac_disappear": share("l1_n_disappear", "l1_n_edges"), "l1_frac_new": share("l1_n_new", "l1_n_edges"), "l1_frac_rewire": share(f"({rewire['l1']})", "l1_n_edges"),
        "l1_clique_density": r6("CASE WHEN l1_n_edges > 1 THEN 2 * n_l1_to_l1_edges / (l1_n_edges * (l1_n_edges - 1)) ELSE 0 END"), "l2l1_deg": share("l2_n_nodes", "l1_n_edges"),
        "l2l1_rewire": share(f"({rewire['l2']})", f"({rewire['l1']})"), "l2l1_conn": share("l2_conn_diff", "l1_conn_diff"), "hl_conn_l1": share("l1_conn_high", "l1_conn_low"), "hl_conn_l2": share("l2_conn_high", "l2_conn_low"),
    }
    return f"""WITH {KEYED}, near AS (SELECT ref_gene, CASE WHEN gene_i = ref_gene THEN gene_j ELSE gene_i END AS node FROM kn WHERE ref_gene IN (gene_i, gene_j)),
lay AS (SELECT k.*, CASE WHEN k.ref_gene IN (gene_i, gene_j) THEN 'direct' WHEN x.node IS NOT NULL AND y.node IS NOT NULL THEN 'inner' WHEN x.node IS NOT NULL OR y.node IS NOT NULL THEN 'outer' END AS layer,
 CASE WHEN x.node IS NULL THEN gene_i ELSE gene_j END AS far FROM kn k LEFT JOIN near x ON x.ref_gene = k.ref_gene AND x.node = gene_i LEFT JOIN near y ON y.ref_gene = k.ref_gene AND y.node = gene_j),
ag AS (SELECT ref AS ref_gene, {', '.join(cols)}, count(*) FILTER (layer = 'inner') AS n_l1_to_l1_edges, count(*) FILTER (layer = 'outer') AS n_l1_to_l2_edges, count(DISTINCT far) FILTER (layer = 'outer') AS l2_n_nodes FROM refs LEFT JOIN lay ON ref_gene = ref GROUP BY ref)
SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in doubles)}), ref_gene AS focus, {', '.join(f'{v} AS {k}_rewire' for k, v in rewire.items())}, l1_n_edges AS l1_n_nodes, l1_n_edges_low AS focus_deg_low, l1_n_edges_high AS focus_deg_high, {', '.join(f'{v} AS {k}' for k, v in ratios.items())} FROM ag"""


@query(_focus_sql())
def focus_metrics(spark, sf_dir):
    refs, net = _keyed(spark, sf_dir)
    return rounded(keyed.focus_metrics(net, refs.select("ref_gene", F.col("ref_gene").alias("focus")), P.threshold))


@query(f"""WITH {KEYED}, c AS (SELECT ref_gene, count(*) AS n_sig_edges_diff, {', '.join(f"count(*) FILTER (class = '{c}') AS n_{c}" for c in diffnet.CLASSES)}, avg(abs(delta)) AS a, max(abs(delta)) AS m FROM kn GROUP BY ref_gene)
SELECT ref AS ref_gene, coalesce(n_sig_edges_diff, 0) AS n_sig_edges_diff, {', '.join(f'coalesce(n_{c}, 0) AS n_{c}' for c in diffnet.CLASSES)}, {r6('coalesce(a, 0)')} AS mean_abs_delta, {r6('coalesce(m, 0)')} AS max_abs_delta FROM refs LEFT JOIN c ON ref_gene = ref""")
def reference_summary(spark, sf_dir):
    return rounded(significant.summary(from_embeddings(spark, sf_dir), _references(spark, sf_dir), P))


DEGREES = f"""{KEYED}, ends AS (SELECT ref_gene, unnest([gene_i, gene_j]) AS focus, sig_low AND abs(r_low) >= 0.1 AS low, sig_high AND abs(r_high) >= 0.1 AS high FROM kn),
fd AS (SELECT ref AS ref_gene, vec_id AS focus, count(e.focus) FILTER (low) AS degree_low, count(e.focus) FILTER (high) AS degree_high, count(e.focus) AS degree_diff FROM refs CROSS JOIN embeddings LEFT JOIN ends e ON e.ref_gene = ref AND e.focus = vec_id GROUP BY ALL)"""


def _focus_degrees(spark, sf_dir):
    refs = _references(spark, sf_dir)
    genes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("focus"))
    return significant.degrees(from_embeddings(spark, sf_dir), refs, genes.crossJoin(F.broadcast(refs)), P)


@query(f"WITH {DEGREES} SELECT * FROM fd")
def focus_degrees(spark, sf_dir):
    return rounded(_focus_degrees(spark, sf_dir))


@query(f"""WITH {DEGREES}, v AS (SELECT focus, avg(degree_low) AS a, avg(degree_high) AS b, avg(degree_diff) AS c, var_pop(degree_diff) AS v, min(degree_diff) AS least, max(degree_diff) AS most FROM fd GROUP BY focus),
k AS (SELECT *, row_number() OVER (ORDER BY round(v, 9) DESC, focus) AS k FROM v)
SELECT focus, {r6('a')} AS mean_low, {r6('b')} AS mean_high, {r6('c')} AS mean_diff, {r6('v')} AS variance, least, most, CASE WHEN k <= 5 THEN k END AS context_rank FROM k""")
def context_degrees(spark, sf_dir):
    return rounded(keyed.context_variance(_focus_degrees(spark, sf_dir)))


@query(f"""WITH RECURSIVE {KEYED}, nets AS MATERIALIZED (SELECT ref_gene, 'low' AS net, gene_i, gene_j FROM kn WHERE abs(r_low) >= 0.1 UNION ALL SELECT ref_gene, 'high', gene_i, gene_j FROM kn WHERE abs(r_high) >= 0.1 UNION ALL SELECT ref_gene, 'diff', gene_i, gene_j FROM kn),
ka AS MATERIALIZED (SELECT ref_gene, net, gene_i AS a, gene_j AS b FROM nets UNION ALL SELECT ref_gene, net, gene_j, gene_i FROM nets), d AS MATERIALIZED (SELECT ref_gene, net, a, count(*) AS k FROM ka GROUP BY ALL),
s AS (SELECT ref_gene, net, sum(k)::BIGINT // 2 AS n_edges, count(*) AS n_active, max(k) AS max_degree FROM d GROUP BY ALL),
t AS (SELECT x.ref_gene, x.net, x.a, count(*) / 2 AS t FROM ka x JOIN ka y ON y.ref_gene = x.ref_gene AND y.net = x.net AND y.a = x.a AND y.b <> x.b JOIN ka z ON z.ref_gene = x.ref_gene AND z.net = x.net AND z.a = x.b AND z.b = y.b GROUP BY ALL),
c AS (SELECT d.ref_gene, d.net, avg(2 * coalesce(t, 0) / (k * (k - 1))) AS clustering FROM d LEFT JOIN t ON t.ref_gene = d.ref_gene AND t.net = d.net AND t.a = d.a WHERE k >= 2 GROUP BY ALL),
reach(ref_gene, net, a, root) AS (SELECT ref_gene, net, a, a FROM d UNION SELECT ka.ref_gene, ka.net, ka.b, reach.root FROM reach JOIN ka ON ka.ref_gene = reach.ref_gene AND ka.net = reach.net AND ka.a = reach.a),
p AS (SELECT ref_gene, net, count(DISTINCT root) AS n_components, max(n) AS largest_component FROM (SELECT ref_gene, net, root, count(*) AS n FROM (SELECT ref_gene, net, a, min(root) AS root FROM reach GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
m AS (SELECT n.ref_gene, n.net, corr(x.k::DOUBLE, y.k::DOUBLE) AS r FROM nets n JOIN d x ON x.ref_gene = n.ref_gene AND x.net = n.net AND x.a = gene_i JOIN d y ON y.ref_gene = n.ref_gene AND y.net = n.net AND y.a = gene_j GROUP BY ALL)
SELECT ref AS ref_gene, w.net, coalesce(n_edges, 0)::BIGINT AS n_edges, coalesce(n_active, 0) AS n_active, coalesce(max_degree, 0) AS max_degree, {r6('coalesce(n_edges, 0) * 2 / (SELECT count(*) FROM embeddings)')} AS mean_degree,
{r6('coalesce(clustering, 0)')} AS clustering, coalesce(n_components, 0) AS n_components, coalesce(largest_component, 0) AS largest_component, {r6('CASE WHEN isnan(r) THEN 0 ELSE coalesce(r, 0) END')} AS assortativity
FROM refs CROSS JOIN (VALUES ('low'), ('high'), ('diff')) w(net) LEFT JOIN s ON s.ref_gene = ref AND s.net = w.net LEFT JOIN c ON c.ref_gene = ref AND c.net = w.net LEFT JOIN p ON p.ref_gene = ref AND p.net = w.net LEFT JOIN m ON m.ref_gene = ref AND m.net = w.net""")
def reference_topologies(spark, sf_dir):
    refs, net = _keyed(spark, sf_dir)
    nodes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    got = keyed.topologies(keyed.networks(net, P.threshold), refs, nodes)
    return rounded(got.select("ref_gene", "net", "n_edges", "n_active", "max_degree", "mean_degree", "clustering", "n_components", "largest_component", "assortativity"))


# ---- paths and modules of the full network -------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {NET}, reach(source, node, d) AS (SELECT gene, gene, 0 FROM nodes UNION SELECT source, adj.dst, d + 1 FROM reach JOIN adj ON adj.src = node WHERE d < 25),
b AS (SELECT source, node, min(d) AS d FROM reach GROUP BY ALL)
SELECT source AS gene, count(*) - 1 AS reached, {r6('CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) ELSE 0 END')} AS closeness FROM b GROUP BY source""")
def network_closeness(spark, sf_dir):
    return rounded(wedges.closeness(*_lists(spark, sf_dir)))


@query()
def network_betweenness(spark, sf_dir):
    """From 64 sampled pivots, with lengths 1 / |r|."""
    return paths.betweenness(*_net(spark, sf_dir), count=64, length="inverse")


@query(f"""WITH {NET}, tri AS (SELECT a.src AS gene, sum(abs(a.w) + abs(b.w)) AS s FROM adj a JOIN adj b ON b.src = a.src AND a.dst < b.dst JOIN net c ON c.gene_i = a.dst AND c.gene_j = b.dst GROUP BY a.src)
SELECT gene, {r6('CASE WHEN degree >= 2 THEN coalesce(s, 0) / (strength * (degree - 1)) ELSE 0 END')} AS clustering FROM deg LEFT JOIN tri USING (gene)""")
def weighted_clustering(spark, sf_dir):
    return rounded(wedges.weighted_clustering(*_near(spark, sf_dir)))


def _modules(spark, sf_dir):
    edges, nodes = _net(spark, sf_dir)
    tom = graph.tom(edges).select("gene_i", "gene_j", F.col("tom").alias("s"))
    return modules.cut(modules.linkage(tom, nodes), nodes, cut_height=0.995, least=5)


@query()
def gene_modules(spark, sf_dir):
    """Modules of the topological overlap, merged by eigengene, with each gene's membership."""
    long = from_embeddings(spark, sf_dir)
    vectors = pairs.rank_vectors(long)
    found = modules.merge_close(vectors, _modules(spark, sf_dir))
    k = modules.membership(vectors, found, modules.eigengenes(vectors, found)).select("gene", "k_me")
    return found.join(k, "gene", "left")


@query()
def module_preservation(spark, sf_dir):
    """Whether the labels' groups, as they stand in the first half of the samples, hold in the second."""
    long = from_embeddings(spark, sf_dir)
    one, two = pairs.rank_vectors(long.where("sample < 32")), pairs.rank_vectors(long.where("sample >= 32"))
    return modules.preservation(one, two, long.select("gene", (F.col("label") + 1).alias("module")).distinct(), permutations=100)


# ---- permutations --------------------------------------------------------------------------------------------------
@query()
def focus_permutations(spark, sf_dir):
    """Eight metrics of the first six features' rows against 100 permutations each."""
    refs = _references(spark, sf_dir).withColumnRenamed("ref_gene", "focus")
    return resample.network_permutations(from_embeddings(spark, sf_dir), refs, 100, P)


@query()
def variability_permutations(spark, sf_dir):
    """Shifts of variability of the first six features against 100 permutations each."""
    refs = _references(spark, sf_dir).withColumnRenamed("ref_gene", "focus")
    return resample.variability_permutations(from_embeddings(spark, sf_dir), refs, 100)


@query()
def term_set_enrichment(spark, sf_dir):
    """Enrichment of brands along the parts' prices, with a null of random sets."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    ranked = p.select(F.col("p_partkey").alias("gene"), (F.col("p_retailprice") - 1400).alias("score"))
    return enrich.set_enrichment(ranked, p.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene")), permutations=200)


# ---- rank correlation with missing values --------------------------------------------------------------------------
@query(f"""WITH {EXPR}, x AS (SELECT g, label, s, CASE WHEN abs(v) <= 0.2 THEN v END AS v FROM expr),
p AS (SELECT a.g AS a, b.g AS b, a.v AS x, b.v AS y FROM x a JOIN x b USING (s) WHERE a.label = 0 AND b.label = 1 AND a.v IS NOT NULL AND b.v IS NOT NULL),
r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS y FROM p)
SELECT a, b, count(*) AS n, {r6('corr(x, y)')} AS r FROM r GROUP BY a, b""")
def pairwise_complete(spark, sf_dir):
    """Features of label 0 against those of label 1; values beyond 0.2 count as missing."""
    long = from_embeddings(spark, sf_dir).withColumn("value", F.when(F.abs("value") <= 0.2, F.col("value")))
    return rounded(keyed.pairwise_complete(long.where("label = 0"), long.where("label = 1")))
