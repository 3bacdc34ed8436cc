"""All queries over the driver's tables and, beside each, the SQL that must give the same rows."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweave.functions.ranks import drawn_sql
from sparkweave.operators import dense, diffnet, express, fdr, graph, pairs, significant, wedges
from sparkweave.sources.matrix import from_embeddings
from sparkweave.sources.scratch import checkpointed

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(f"`{c}`").cast("long").alias(c) if t == "int" else F.col(f"`{c}`") for c, t in df.dtypes])


def r6(x: str, d: int = 6) -> str:
    return f"(round(({x})::DOUBLE, {d}) + 0)"  # never minus zero


EXPR = "expr AS (SELECT vec_id AS g, label, unnest(range(len(embedding)))::BIGINT AS s, unnest(embedding)::DOUBLE AS v FROM embeddings)"
SPLIT = """split AS (SELECT g, s, side FROM (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY v, s) AS lo,
  row_number() OVER (PARTITION BY g ORDER BY v DESC, s) AS hi, floor(count(*) OVER (PARTITION BY g) * 0.2::DOUBLE) AS k FROM expr),
  (VALUES ('low'), ('high')) t(side) WHERE (side = 'low' AND lo <= k) OR (side = 'high' AND hi <= k))"""


def z_sql(name: str, source: str) -> str:
    """Array of z-scored average ranks for each gene of a source (g, s, v)."""
    return f"""{name}_r AS (SELECT g, s, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0::DOUBLE AS r FROM {source}),
{name} AS (SELECT g, list((r - m) / sd ORDER BY s) AS z FROM (SELECT *, avg(r) OVER (PARTITION BY g) AS m, stddev_samp(r) OVER (PARTITION BY g) AS sd FROM {name}_r) GROUP BY g)"""


def corr_sql(name: str, z: str) -> str:
    return f"{name} AS (SELECT a.g AS gi, b.g AS gj, greatest(-1, least(1, list_dot_product(a.z, b.z) / (len(a.z) - 1))) AS r FROM {z} a JOIN {z} b ON a.g < b.g)"


def t_sql(r: str, n: int) -> str:
    df = n - 2
    t = f"({r} * sqrt({df}::DOUBLE) / sqrt(greatest(1 - {r} * {r}, 1.19e-7::DOUBLE)))"
    theta = f"atan(abs{t} / sqrt({df}::DOUBLE))"
    inner = "1.0::DOUBLE"
    for j in range(df // 2 - 1, 0, -1):
        inner = f"(1 + {inner} * pow(cos({theta}), 2) * ({2 * j - 1}::DOUBLE / {2 * j}))"
    return f"greatest(0, 1 - sin({theta}) * {inner})"


def normal_sql(z: str) -> str:
    inner = "1.0::DOUBLE"
    for k in range(75, 0, -1):
        inner = f"(1 + {inner} * x2 / {2 * k + 1})"
    return f"(SELECT CASE WHEN abs({z}) > 7 THEN 0 ELSE greatest(0, 1 - sqrt(2 / pi()) * abs({z}) * exp(-x2 / 2) * {inner}) END FROM (SELECT ({z}) * ({z}) AS x2))"


def with_q(name: str, source: str, columns: list[str], by: str = "") -> str:
    """CTE that adds q_<c> for each p column by Benjamini and Hochberg."""
    part = f"PARTITION BY {by}" if by else ""
    raw = ", ".join(f"{c} * count({c}) OVER ({part}) / row_number() OVER ({part} ORDER BY {c}) AS raw_{c}, row_number() OVER ({part} ORDER BY {c} DESC) AS o_{c}" for c in columns)
    low = ", ".join(f"least(1, min(raw_{c}) OVER ({part} ORDER BY {c} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q{c[1:]}" for c in columns)
    return f"{name}_raw AS (SELECT *, {raw} FROM {source}), {name} AS (SELECT *, {low} FROM {name}_raw)"


# ---- differential co-expression ------------------------------------------------------------------------------------
P = diffnet.Params()
EDGES = f"""{EXPR}, {SPLIT},
lowv AS (SELECT e.g, e.s, e.v FROM expr e JOIN split p ON p.g = 0 AND p.side = 'low' AND p.s = e.s),
highv AS (SELECT e.g, e.s, e.v FROM expr e JOIN split p ON p.g = 0 AND p.side = 'high' AND p.s = e.s),
{z_sql('zl', 'lowv')}, {z_sql('zh', 'highv')}, {corr_sql('cl', 'zl')}, {corr_sql('ch', 'zh')},
fz AS (SELECT cl.gi, cl.gj, cl.r AS r_low, ch.r AS r_high, {t_sql('cl.r', 12)} AS p_low, {t_sql('ch.r', 12)} AS p_high,
 (atanh(greatest(-0.9999, least(0.9999, ch.r))) - atanh(greatest(-0.9999, least(0.9999, cl.r)))) / sqrt(2 / 9.0::DOUBLE) AS z FROM cl JOIN ch USING (gi, gj)),
pd AS (SELECT *, {normal_sql('z')} AS p_diff FROM fz),
{with_q('q', 'pd', ['p_low', 'p_high', 'p_diff'])},
m AS (SELECT gi AS gene_i, gj AS gene_j, r_low, r_high, r_high - r_low AS delta, p_low, p_high, p_diff, q_low, q_high, q_diff, q_low < 0.7 AS sig_low, q_high < 0.7 AS sig_high,
 q_low < 0.7 OR q_high < 0.7 AS sig_individual, q_diff < 0.7 AS sig_differential FROM q),
edges AS (SELECT *, sig_individual AND sig_differential AS sig_edge, CASE WHEN (sig_low AND abs(r_low) >= 0.1) AND NOT (sig_high AND abs(r_high) >= 0.1) THEN 'disappear'
 WHEN NOT (sig_low AND abs(r_low) >= 0.1) AND (sig_high AND abs(r_high) >= 0.1) THEN 'new' WHEN NOT (sig_low AND abs(r_low) >= 0.1) THEN 'unchanged'
 WHEN sign(r_low) <> sign(r_high) THEN 'sign_change' WHEN abs(r_high) > abs(r_low) THEN 'strengthen' WHEN abs(r_high) < abs(r_low) THEN 'weaken' ELSE 'unchanged' END AS class FROM m)"""


def _focus(spark):
    return spark.range(P.focus, P.focus + 1).toDF("ref_gene")


def _edges(spark, sf_dir, where="sig_differential"):
    return significant.edges(from_embeddings(spark, sf_dir), _focus(spark), P, where)


@query(f"WITH {EDGES} SELECT gene_i, gene_j, {r6('r_low')} AS r_low, {r6('r_high')} AS r_high, {r6('delta')} AS delta, {r6('q_diff')} AS q_diff, sig_edge, class FROM edges WHERE sig_differential")
def diff_coexpression_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_edges(spark, sf_dir).select("gene_i", "gene_j", "r_low", "r_high", "delta", "q_diff", "sig_edge", "class"))


@query(f"WITH {EDGES} SELECT class, count(*) AS n, sum(sig_edge::INT)::BIGINT AS n_sig, {r6('avg(abs(delta))')} AS mean_abs_delta, {r6('max(abs(delta))')} AS max_abs_delta FROM edges GROUP BY class")
def diff_edge_classes(spark, sf_dir):
    e = significant.classes(from_embeddings(spark, sf_dir), _focus(spark), P).drop("ref_gene")
    return rounded(e)


@query(f"""WITH {EDGES}, ends AS (SELECT unnest([gene_i, gene_j]) AS gene, class, delta FROM edges WHERE sig_differential)
SELECT gene, count(*) AS n_edges, {', '.join(f"sum((class = '{c}')::INT)::BIGINT AS n_{c}" for c in ('disappear', 'new', 'sign_change', 'strengthen', 'weaken', 'unchanged'))},
{r6('avg(abs(delta))')} AS mean_abs_delta, {r6('sum(abs(delta))')} AS sum_abs_delta FROM ends GROUP BY gene""")
def node_rewiring(spark, sf_dir):
    return rounded(graph.rewiring(_edges(spark, sf_dir)))


@query(f"WITH {EXPR}, {SPLIT} SELECT g AS ref_gene, side, s AS sample FROM split")
def split_extremes(spark, sf_dir):
    return diffnet.extremes(from_embeddings(spark, sf_dir)).select("ref_gene", "side", F.col("sample").cast("long").alias("sample"))


@query(f"WITH {EXPR} SELECT g AS gene, s AS sample, ntile(5) OVER (PARTITION BY g ORDER BY v, s) AS tile FROM expr")
def split_tiles(spark, sf_dir):
    return rounded(diffnet.tiles(from_embeddings(spark, sf_dir)))


@query(f"""WITH {EXPR}, c AS (SELECT g, quantile_cont(v, 0.2) AS lo, quantile_cont(v, 0.8) AS hi FROM expr GROUP BY g)
SELECT g AS gene, s AS sample, CASE WHEN v <= lo THEN 'Q1' ELSE 'Q5' END AS "group" FROM expr JOIN c USING (g) WHERE v <= lo OR v >= hi""")
def split_quantiles(spark, sf_dir):
    return rounded(diffnet.quantile_groups(from_embeddings(spark, sf_dir)))


QUINT = f"quint AS (SELECT g AS gene, s AS sample, least(ceil(5 * row_number() OVER (PARTITION BY g ORDER BY v, {drawn_sql(1, 's')}, s) / count(*) OVER (PARTITION BY g)::DOUBLE), 5)::BIGINT AS q FROM expr)"


@query(f"WITH {EXPR}, {QUINT} SELECT * FROM quint")
def rank_quintiles(spark, sf_dir):
    return rounded(diffnet.rank_quintile(from_embeddings(spark, sf_dir)))


@query(f"""WITH {EXPR}, {QUINT}, c AS (SELECT sample, count(*) AS n, {', '.join(f'sum((q = {k})::INT)::BIGINT AS q{k}' for k in range(1, 6))} FROM quint GROUP BY sample),
d AS (SELECT *, {' + '.join(f'(q{k} - n / 5::DOUBLE) * (q{k} - n / 5::DOUBLE) / (n / 5::DOUBLE)' for k in range(1, 6))} AS chi2,
 -({' + '.join(f'greatest(q{k} / n::DOUBLE, 1e-15) * ln(greatest(q{k} / n::DOUBLE, 1e-15))' for k in range(1, 6))}) / ln(5) AS entropy,
 greatest({', '.join(f'abs(q{k} / n::DOUBLE - 0.2::DOUBLE)' for k in range(1, 6))}) AS max_deviation, list_position([q1, q2, q3, q4, q5], greatest(q1, q2, q3, q4, q5))::BIGINT AS dominant FROM c)
SELECT sample, n, q1, q2, q3, q4, q5, {r6('chi2')} AS chi2, {r6('entropy')} AS entropy, {r6('max_deviation')} AS max_deviation, dominant, {r6('exp(-chi2 / 2) * (1 + chi2 / 2)')} AS p, {r6('sqrt(chi2 / (n * 4))')} AS cramer_v FROM d""")
def sample_imbalance(spark, sf_dir):
    return rounded(express.imbalance(diffnet.rank_quintile(from_embeddings(spark, sf_dir))))


@query(f"""WITH {EXPR}, {QUINT}, f AS (SELECT sample, avg((q = 1)::INT) AS f1, avg((q = 5)::INT) AS f5 FROM quint GROUP BY sample),
b AS (SELECT gene, sum(CASE WHEN q = 1 THEN f1 ELSE 0 END) / sum((q = 1)::INT) - 0.2::DOUBLE AS b1, sum(CASE WHEN q = 5 THEN f5 ELSE 0 END) / sum((q = 5)::INT) - 0.2::DOUBLE AS b5 FROM quint JOIN f USING (sample) GROUP BY gene)
SELECT gene, {r6('b1')} AS bias_q1, {r6('b5')} AS bias_q5, {r6('greatest(b1, b5)')} AS bias FROM b""")
def gene_quintile_bias(spark, sf_dir):
    return rounded(express.quintile_bias(diffnet.rank_quintile(from_embeddings(spark, sf_dir))))


@query(f"""WITH {EXPR}, {QUINT}, c AS (SELECT sample, sum((q - 3) * (q - 3)) AS n, {' + '.join(f'pow(sum((q = {k})::INT) - count(*) / 5::DOUBLE, 2)' for k in range(1, 6))} AS x, count(*) AS m FROM quint GROUP BY sample),
dev AS (SELECT sample FROM c ORDER BY round(sqrt(x / (m / 5::DOUBLE) / (m * 4)), 9) DESC, sample LIMIT 7),
t AS (SELECT gene, sum((sample IN (FROM dev) AND q = 5)::INT)::BIGINT AS a, sum((sample IN (FROM dev) AND q <> 5)::INT)::BIGINT AS b, sum((sample NOT IN (FROM dev) AND q = 5)::INT)::BIGINT AS c, sum((sample NOT IN (FROM dev) AND q <> 5)::INT)::BIGINT AS d FROM quint GROUP BY gene)
SELECT *, {r6('(a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))')} AS odds FROM t""")
def deviant_drivers(spark, sf_dir):
    q = diffnet.rank_quintile(from_embeddings(spark, sf_dir))
    return rounded(express.drivers(q, express.deviants(express.imbalance(q), 10), 5))


# ---- expression statistics -----------------------------------------------------------------------------------------
STATS = f"""{EXPR}, med AS (SELECT g, median(v) AS med FROM expr GROUP BY g),
st AS (SELECT g AS gene, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, first(med) AS median, 1.4826::DOUBLE * median(abs(v - med)) AS mad, min(v) AS minimum, max(v) AS maximum FROM expr JOIN med USING (g) GROUP BY g)"""


@query(f"WITH {STATS} SELECT gene, n, {', '.join(f'{r6(c)} AS {c}' for c in ('mean', 'sd', 'median', 'mad', 'minimum', 'maximum'))}, {r6('pow(sd / mean, 2)', 2)} AS cv2 FROM st")
def gene_statistics(spark, sf_dir):
    return rounded(express.gene_statistics(from_embeddings(spark, sf_dir)), cv2=2)


@query(f"WITH {STATS} SELECT gene, {r6('mad')} AS mad, rank() OVER (ORDER BY mad DESC) + (count(*) OVER (PARTITION BY mad) - 1) / 2.0::DOUBLE AS mad_rank, round(cume_dist() OVER (ORDER BY mad), 6) AS ecdf FROM st")
def mad_ranks(spark, sf_dir):
    m = express.gene_statistics(from_embeddings(spark, sf_dir)).select("gene", "mad")
    return rounded(express.global_rank(m, "mad", "mad_rank", "ecdf"))


@query(f"""WITH {EXPR}, {SPLIT}, j AS (SELECT f.g AS ref_gene, f.side, e.g, e.v FROM expr e JOIN split f ON f.s = e.s AND f.g <> e.g),
m AS (SELECT *, median(v) OVER (PARTITION BY ref_gene, side, g) AS med FROM j), d AS (SELECT ref_gene, side, g, 1.4826::DOUBLE * median(abs(v - med)) AS mad FROM m GROUP BY ALL)
SELECT ref_gene, {r6("avg(mad) FILTER (side = 'low')")} AS mean_mad_low, {r6("avg(mad) FILTER (side = 'high')")} AS mean_mad_high, {r6("median(mad) FILTER (side = 'low')")} AS median_mad_low,
{r6("median(mad) FILTER (side = 'high')")} AS median_mad_high, {r6("avg(mad) FILTER (side = 'high') - avg(mad) FILTER (side = 'low')")} AS shift, count(*) FILTER (side = 'low') AS n_genes FROM d GROUP BY ref_gene""")
def mad_shift(spark, sf_dir):
    long = from_embeddings(spark, sf_dir)
    return rounded(express.mad_shifts(long, diffnet.extremes(long, 0.2)))


@query(f"""WITH {EXPR}, d AS (SELECT s, abs(v - avg(v) OVER (PARTITION BY g)) AS d FROM expr) SELECT s AS sample, {r6('median(d)')} AS itv_median, {r6('avg(d)')} AS itv_mean, {r6('sum(d)')} AS itv_sum FROM d GROUP BY s""")
def sample_deviation(spark, sf_dir):
    return rounded(express.sample_deviation(from_embeddings(spark, sf_dir)))


@query(f"""WITH {EXPR}, x AS (SELECT s, pow(2::DOUBLE, v) AS x FROM expr), m AS (SELECT *, median(x) OVER (PARTITION BY s) AS med FROM x),
a AS (SELECT s, avg(x) AS mean, stddev_samp(x) AS sd, 1.4826::DOUBLE * median(abs(x - med)) AS mad, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM m GROUP BY s)
SELECT s AS sample, {', '.join(f'{r6(f"log2({c} + 1)")} AS log2_{c}' for c in ('mean', 'sd', 'mad', 'iqr'))}, {r6('log2(sd + 1) - log2(mean + 1)')} AS cv FROM a""")
def sample_noise(spark, sf_dir):
    return rounded(express.noise(from_embeddings(spark, sf_dir)))


# ---- full network --------------------------------------------------------------------------------------------------
NET = f"{EXPR}, {z_sql('za', 'expr')}, {corr_sql('ca', 'za')}, net AS (SELECT gi AS gene_i, gj AS gene_j, r FROM ca WHERE abs(r) >= 0.30001), nodes AS (SELECT vec_id AS gene FROM embeddings)"
NET += ", adj AS (SELECT gene_i AS src, gene_j AS dst, r AS w FROM net UNION ALL SELECT gene_j, gene_i, r FROM net), deg AS (SELECT gene, count(src) AS degree, coalesce(sum(abs(w)), 0) AS strength FROM nodes LEFT JOIN adj ON src = gene GROUP BY gene)"


CUT = 0.30001


def _dense(spark, sf_dir):
    """Vectors and nodes of the network, for metrics that are summed inside the blocks of pairs."""
    long = from_embeddings(spark, sf_dir)
    return checkpointed(pairs.rank_vectors(long)), long.select("gene").distinct()


def _lists(spark, sf_dir):
    """Each node's neighbours as arrays, and the nodes."""
    vectors, nodes = _dense(spark, sf_dir)
    return wedges.lists(vectors, CUT), nodes


def _near(spark, sf_dir):
    """The network as vectors, for what is found within two steps, and the nodes."""
    vectors, nodes = _dense(spark, sf_dir)
    return wedges.near(vectors, CUT), nodes


def _net(spark, sf_dir):
    vectors, nodes = _dense(spark, sf_dir)
    return pairs.all_pairs(vectors, least=CUT), nodes


@query(f"WITH {NET} SELECT gene_i, gene_j, {r6('r')} AS r FROM net")
def network_edges(spark, sf_dir):
    return rounded(_net(spark, sf_dir)[0])


@query(f"WITH {NET} SELECT gene, degree, {r6('strength')} AS strength FROM deg")
def network_degrees(spark, sf_dir):
    return rounded(dense.degrees(*_dense(spark, sf_dir), CUT))


@query(f"""WITH {NET}, a AS (SELECT count(*) AS n_nodes, count(*) FILTER (degree > 0) AS n_active, avg(degree) AS mean_degree, max(degree) AS max_degree, stddev_pop(degree) FILTER (degree > 0) AS std_active,
{', '.join(f'quantile_cont(degree, {q}) FILTER (degree > 0) AS degree_{n}' for q, n in ((0.25, 'p25'), (0.5, 'p50'), (0.75, 'p75'), (0.9, 'p90'), (0.99, 'p99')))} FROM deg),
b AS (SELECT count(*) AS n_edges, avg(abs(r)) AS mean_abs_r, median(abs(r)) AS median_abs_r, avg((r > 0)::INT) AS positive FROM net),
c AS (SELECT coalesce(corr(x.degree::DOUBLE, y.degree::DOUBLE), 0) AS assortativity FROM net JOIN deg x ON x.gene = gene_i JOIN deg y ON y.gene = gene_j)
SELECT n_nodes, n_active, {r6('mean_degree')} AS mean_degree, max_degree, {r6('std_active')} AS std_active, n_edges, {r6('mean_abs_r')} AS mean_abs_r, {r6('median_abs_r')} AS median_abs_r, {r6('positive')} AS positive,
{r6('assortativity')} AS assortativity, {r6('2 * n_edges / (n_nodes * (n_nodes - 1.0))')} AS density, {', '.join(f'{r6(f"degree_{n}")} AS degree_{n}' for n in ('p25', 'p50', 'p75', 'p90', 'p99'))} FROM a, b, c""")
def network_topology(spark, sf_dir):
    return rounded(dense.topology(*_dense(spark, sf_dir), CUT))


@query(f"""WITH {NET}, b AS (SELECT degree, count(*) AS k FROM deg WHERE degree > 0 GROUP BY degree HAVING count(*) >= 2),
f AS (SELECT count(*) AS bins, -regr_slope(log10(k::DOUBLE), log10(degree::DOUBLE)) AS gamma, regr_r2(log10(k::DOUBLE), log10(degree::DOUBLE)) AS r2 FROM b)
SELECT bins, {r6('gamma')} AS gamma, {r6('r2')} AS r2, gamma BETWEEN 2 AND 3.5 AND r2 > 0.8 AS scale_free FROM f""")
def network_power_law(spark, sf_dir):
    return rounded(graph.power_law(dense.degrees(*_dense(spark, sf_dir), CUT)))


@query(f"""WITH {NET}, tri AS (SELECT unnest([a.gene_i, a.gene_j, b.gene_j]) AS gene FROM net a JOIN net b ON b.gene_i = a.gene_j JOIN net c ON c.gene_i = a.gene_i AND c.gene_j = b.gene_j),
t AS (SELECT gene, count(*) AS triangles FROM tri GROUP BY gene)
SELECT gene, degree, coalesce(triangles, 0) AS triangles, {r6('CASE WHEN degree >= 2 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) END')} AS clustering FROM deg LEFT JOIN t USING (gene)""")
def network_clustering(spark, sf_dir):
    return rounded(wedges.clustering(*_near(spark, sf_dir)))


@query(f"""WITH {NET}, w AS (SELECT a.src AS focus, a.dst AS mid, b.dst AS far, n.dst IS NOT NULL AS l1 FROM adj a JOIN adj b ON b.src = a.dst AND b.dst <> a.src LEFT JOIN adj n ON n.src = a.src AND n.dst = b.dst),
s AS (SELECT focus, count(DISTINCT far) FILTER (NOT l1) AS l2_nodes, count(*) FILTER (l1) // 2 AS l1_l1_edges, count(*) FILTER (NOT l1) AS l1_l2_edges FROM w GROUP BY focus)
SELECT gene AS focus, degree AS l1_nodes, coalesce(l2_nodes, 0) AS l2_nodes, coalesce(l1_l1_edges, 0) AS l1_l1_edges, coalesce(l1_l2_edges, 0) AS l1_l2_edges,
{r6('CASE WHEN degree > 0 THEN coalesce(l2_nodes, 0) / degree ELSE 0 END')} AS l2_l1_ratio FROM deg LEFT JOIN s ON focus = gene""")
def network_neighbourhoods(spark, sf_dir):
    return rounded(wedges.neighbourhoods(*_near(spark, sf_dir)))


@query(f"""WITH RECURSIVE {NET}, reach(gene, root) AS (SELECT gene, gene FROM nodes UNION SELECT adj.dst, reach.root FROM reach JOIN adj ON adj.src = reach.gene)
SELECT gene, min(root) AS component FROM reach GROUP BY gene""")
def network_components(spark, sf_dir):
    return dense.components(*_dense(spark, sf_dir), CUT)


def _rank_sql(steps: int) -> str:
    parts = [f"{NET}, sh AS (SELECT src, dst, abs(w) / sum(abs(w)) OVER (PARTITION BY src) AS share FROM adj), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), p0 AS (SELECT gene, 1 / n AS rank FROM nodes, n)"]
    parts += [f"p{k + 1} AS (SELECT nodes.gene, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * coalesce(sum(share * rank), 0) AS rank FROM nodes CROSS JOIN n LEFT JOIN sh ON dst = nodes.gene LEFT JOIN p{k} ON p{k}.gene = src GROUP BY nodes.gene)" for k in range(steps)]
    return f"WITH {', '.join(parts)} SELECT gene, {r6('rank', 9)} AS rank FROM p{steps}"


@query(_rank_sql(5))
def network_page_rank(spark, sf_dir):
    return rounded(dense.page_rank(*_dense(spark, sf_dir), CUT, steps=5), 9)


@query(f"""WITH {NET}, k AS (SELECT src, sum(abs(w)) AS k FROM adj GROUP BY src), l AS (SELECT a.src AS i, b.src AS j, sum(abs(a.w) * abs(b.w)) AS l FROM adj a JOIN adj b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL),
f AS (SELECT coalesce(i, gene_i) AS gene_i, coalesce(j, gene_j) AS gene_j, coalesce(l, 0) AS l, coalesce(abs(r), 0) AS a FROM l FULL JOIN net ON i = gene_i AND j = gene_j)
SELECT gene_i, gene_j, {r6('(l + a) / (least(x.k, y.k) + 1 - a)')} AS tom FROM f JOIN k x ON x.src = gene_i JOIN k y ON y.src = gene_j""")
def topological_overlap(spark, sf_dir):
    return rounded(wedges.tom(_near(spark, sf_dir)[0]))


MOD = f"{NET}, mods AS (SELECT vec_id AS gene, label AS module FROM embeddings), con AS (SELECT src AS gene, a.module, sum(abs(w)) AS k_total, sum(CASE WHEN a.module = b.module THEN abs(w) ELSE 0 END) AS k_within FROM adj JOIN mods a ON a.gene = src JOIN mods b ON b.gene = dst GROUP BY ALL)"


def _connectivity(spark, sf_dir):
    vectors, _ = _dense(spark, sf_dir)
    modules = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("gene"), F.col("label").alias("module"))
    return dense.module_connectivity(vectors, modules, CUT)


@query(f"WITH {MOD} SELECT gene, module::BIGINT AS module, {r6('k_total')} AS k_total, {r6('k_within')} AS k_within, {r6('k_total - k_within')} AS k_out, {r6('k_within - (k_total - k_within)')} AS k_diff FROM con")
def module_connectivity(spark, sf_dir):
    return rounded(_connectivity(spark, sf_dir))


@query(f"WITH {MOD} SELECT gene, module::BIGINT AS module, {r6('k_within')} AS k_within, rank FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY round(k_within, 9) DESC, gene) AS rank FROM con) WHERE rank <= 5")
def module_hubs(spark, sf_dir):
    return rounded(graph.hubs(_connectivity(spark, sf_dir)).select("gene", "module", "k_within", "rank"))


@query(f"""WITH {NET}, cuts AS (SELECT unnest([{', '.join(f'{round(k / 100 + 0.00001, 6)}::DOUBLE' for k in range(30, 100, 5))}]) AS cut)
SELECT cut, count(r) AS n_edges, {r6('count(r) * 2.0 / (500 * 499)')} AS density, {r6('avg(abs(r))')} AS mean_weight FROM cuts LEFT JOIN net ON abs(r) > cut GROUP BY cut""".replace("(500 * 499)", "((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1))"))
def threshold_sweep(spark, sf_dir):
    vectors, nodes = _dense(spark, sf_dir)
    return rounded(dense.threshold_sweep(vectors, nodes.count(), [round(k / 100 + 0.00001, 6) for k in range(30, 100, 5)], CUT))


@query(f"WITH {EXPR}, {z_sql('za', 'expr')} SELECT b.g AS gene, {r6('list_dot_product(a.z, b.z) / (len(a.z) - 1)')} AS r FROM za a JOIN za b ON a.g = 0 AND b.g <> 0")
def focus_row(spark, sf_dir):
    return rounded(pairs.focus_row(pairs.rank_vectors(from_embeddings(spark, sf_dir)), 0))


# ---- tests, sets, selections over the other tables -----------------------------------------------------------------
@query(f"""WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS r,
 count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS t FROM lineitem),
a AS (SELECT l_returnflag AS flag, count(*) FILTER (l_linestatus = 'O') AS n1, count(*) FILTER (l_linestatus <> 'O') AS n2, avg(x) FILTER (l_linestatus = 'O') AS mean1, avg(x) FILTER (l_linestatus <> 'O') AS mean2,
 median(x) FILTER (l_linestatus = 'O') AS median1, median(x) FILTER (l_linestatus <> 'O') AS median2, coalesce(sum(r) FILTER (l_linestatus = 'O'), 0) AS r1, sum((t * t - 1)::DOUBLE) AS ties FROM r GROUP BY l_returnflag),
b AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, r1 - n1 * (n1 + 1) / 2.0::DOUBLE - n1 * n2 / 2.0::DOUBLE AS d FROM a),
c AS (SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2 THEN (d - 0.5::DOUBLE * sign(d)) / sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0::DOUBLE)))) END AS z FROM b)
SELECT flag, n1, n2, {r6('mean1')} AS mean1, {r6('mean2')} AS mean2, median1, median2, u, {r6('z')} AS z, {r6(normal_sql('z'))} AS p FROM c""")
def rank_sum_test(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_returnflag", "flag")
    return rounded(express.rank_sum(li, "l_linestatus", "O", "l_quantity", "flag"))


@query(f"""WITH d AS (SELECT o_orderpriority AS grp, o_totalprice - 150000::DOUBLE AS d FROM orders WHERE o_totalprice <> 150000), r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY abs(d)) + (count(*) OVER (PARTITION BY grp, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY grp, abs(d)) AS t FROM d),
a AS (SELECT grp, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS v, sum((t * t - 1)::DOUBLE) AS ties FROM r GROUP BY grp),
b AS (SELECT *, v - n * (n + 1) / 4.0::DOUBLE AS o FROM a), c AS (SELECT *, (o - 0.5::DOUBLE * sign(o)) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48) AS z FROM b)
SELECT grp, n, v, {r6('z')} AS z, {r6(normal_sql('z'))} AS p FROM c""")
def signed_rank_test(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("x"), F.lit(150000.0).alias("y"))
    return rounded(express.signed_rank(o, "x", "y", "grp"))


@query("""WITH s AS (SELECT 'a' AS name, l_suppkey AS gene FROM lineitem WHERE l_quantity > 49 UNION SELECT 'b', l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07 UNION SELECT 'c', s_suppkey FROM supplier WHERE s_acctbal < 0),
p AS (SELECT gene, string_agg(name, '&' ORDER BY name) AS pattern FROM s GROUP BY gene), g AS (SELECT unnest(['a', 'b', 'c', 'a&b', 'a&c', 'b&c', 'a&b&c']) AS pattern)
SELECT pattern, count(gene) AS n FROM g LEFT JOIN p USING (pattern) GROUP BY pattern""")
def venn_partition(spark, sf_dir):
    li, su = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    a = li.where("l_quantity > 49").select(F.lit("a").alias("name"), F.col("l_suppkey").alias("gene"))
    b = li.where("l_discount > 0.09d and l_tax > 0.07d").select(F.lit("b").alias("name"), F.col("l_suppkey").alias("gene"))
    c = su.where("s_acctbal < 0").select(F.lit("c").alias("name"), F.col("s_suppkey").alias("gene"))
    return express.venn(a.union(b).union(c), ["a", "b", "c"])


@query(f"""WITH one AS (SELECT p_partkey AS gene, p_brand AS module FROM part), two AS (SELECT p_partkey AS gene, p_size % 5 AS module FROM part), a AS (SELECT module AS m1, count(*) AS n1 FROM one GROUP BY ALL), b AS (SELECT module AS m2, count(*) AS n2 FROM two GROUP BY ALL),
k AS (SELECT one.module AS m1, two.module AS m2, count(*) AS k FROM one JOIN two USING (gene) GROUP BY ALL), j AS (SELECT m1, m2, n1, n2, coalesce(k, 0) AS k FROM a CROSS JOIN b LEFT JOIN k USING (m1, m2))
SELECT m1, m2::BIGINT AS m2, n1, n2, k, {r6('k / (n1 + n2 - k)')} AS jaccard, {r6('k / least(n1, n2)')} AS coefficient, CASE WHEN k / least(n1, n2) >= 0.7 THEN 'high' WHEN k / least(n1, n2) >= 0.4 THEN 'moderate' WHEN k / least(n1, n2) >= 0.2 THEN 'low' ELSE 'none' END AS level FROM j""")
def module_overlap(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    out = express.overlap(p.select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("module")), p.select(F.col("p_partkey").alias("gene"), (F.col("p_size") % 5).alias("module")))
    return rounded(out)


@query(f"""WITH t AS (SELECT p_brand AS a, p_size % 5 AS b, count(*) AS n FROM part GROUP BY ALL) SELECT a, b::BIGINT AS b, n, {r6('100 * n / sum(n) OVER (PARTITION BY a)')} AS percent FROM t""")
def module_transitions(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_brand").alias("a"), (F.col("p_size") % 5).alias("b")).agg(F.count("*").alias("n"))
    return rounded(t.withColumn("percent", 100 * F.col("n") / F.sum("n").over(W.partitionBy("a"))))


@query(f"""WITH {STATS}, x AS (SELECT gene, mean * sqrt(n) / sd AS t, {normal_sql('mean * sqrt(n) / sd')} AS p FROM st), {with_q('q', 'x', ['p'])}
SELECT gene, {r6('p')} AS p, {r6('q')} AS q, {r6('least(1, p * count(*) OVER ())')} AS bonferroni, CASE WHEN q < 0.05 AND t > 0 THEN 'up_deg' WHEN q < 0.05 THEN 'down_deg' ELSE 'NS' END AS class,
CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM q""")
def adjusted_p(spark, sf_dir):
    from sparkweave.functions.special import normal_two_sided

    s = express.gene_statistics(from_embeddings(spark, sf_dir)).select("gene", (F.col("mean") * F.sqrt("n") / F.col("sd")).alias("t"))
    s = fdr.benjamini_hochberg(s.withColumn("p", normal_two_sided(F.col("t"))), "p", "q")
    s = fdr.bonferroni(s, "p", "bonferroni")
    return rounded(s.select("gene", "p", "q", "bonferroni", express.deg_class(F.col("q"), F.col("t")).alias("class"), express.stars(F.col("p")).alias("stars")))


@query("""SELECT p_partkey, p_name, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || ' (' || p_partkey || ')' ELSE p_name END AS label FROM part WHERE NOT regexp_matches(p_type, '^(PROMO|SMALL)') AND length(p_name) <= 30""")
def unique_labels(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where(~F.col("p_type").rlike("^(PROMO|SMALL)") & (F.length("p_name") <= 30))
    many = F.count("*").over(W.partitionBy("p_name")) > 1
    return p.select("p_partkey", "p_name", F.when(many, F.concat("p_name", F.lit(" ("), F.col("p_partkey"), F.lit(")"))).otherwise(F.col("p_name")).alias("label"))


@query("""WITH f AS (SELECT c_nationkey, c_acctbal, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS hi, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS lo FROM customer)
SELECT n_name, c_custkey, c_acctbal, CASE WHEN hi <= 3 THEN 'top' ELSE 'bottom' END AS side FROM f JOIN nation ON n_nationkey = c_nationkey WHERE hi <= 3 OR lo <= 3""")
def top_and_bottom(spark, sf_dir):
    c, n = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    w = W.partitionBy("c_nationkey")
    f = c.withColumns({"hi": F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey")), "lo": F.row_number().over(w.orderBy("c_acctbal", "c_custkey"))}).where("hi <= 3 or lo <= 3")
    return f.join(F.broadcast(n), f.c_nationkey == n.n_nationkey).select("n_name", "c_custkey", "c_acctbal", F.when(F.col("hi") <= 3, "top").otherwise("bottom").alias("side"))


# ---- resampling ----------------------------------------------------------------------------------------------------
def _draws_sql(k: int, m: int, reps: int) -> str:
    return f"""placed AS (SELECT side, s, row_number() OVER (PARTITION BY side ORDER BY s) - 1 AS pos FROM split WHERE g = 0),
grid AS (SELECT b, slot, side, {drawn_sql(P.seed, 'b', 'slot', "CASE WHEN side = 'low' THEN 0 ELSE 1 END")} % {k} AS pos FROM range({reps}) x(b), range({m}) y(slot), (VALUES ('low'), ('high')) t(side)),
draws AS (SELECT b, slot, side, s FROM grid JOIN placed USING (side, pos))"""


@query(f"""WITH {EDGES}, {_draws_sql(12, 9, P.replicates)}, chosen AS (SELECT gene_i, gene_j, delta FROM edges WHERE sig_edge),
genes AS (SELECT gene_i AS g FROM chosen UNION SELECT gene_j FROM chosen), vals AS (SELECT b, side, slot, g, v FROM expr SEMI JOIN genes USING (g) JOIN draws USING (s)),
rk AS (SELECT *, rank() OVER (PARTITION BY b, side, g ORDER BY v) + (count(*) OVER (PARTITION BY b, side, g, v) - 1) / 2.0::DOUBLE AS r FROM vals),
zz AS (SELECT b, side, g, list(CASE WHEN sd > 0 THEN (r - m) / sd END ORDER BY slot) AS z FROM (SELECT *, avg(r) OVER (PARTITION BY b, side, g) AS m, stddev_samp(r) OVER (PARTITION BY b, side, g) AS sd FROM rk) GROUP BY ALL),
d AS (SELECT gene_i, gene_j, delta, b, sum(CASE WHEN x.side = 'high' THEN 1 ELSE -1 END * list_dot_product(x.z, y.z) / (len(x.z) - 1)) AS d FROM chosen JOIN zz x ON x.g = gene_i JOIN zz y USING (b, side) WHERE y.g = gene_j GROUP BY ALL),
a AS (SELECT gene_i, gene_j, delta, avg(d) AS delta_mean, stddev_samp(d) AS delta_std, greatest(least(1, 2 * least(avg((d < 0)::INT), avg((d > 0)::INT))), 1 / {P.replicates}.0::DOUBLE) AS p_boot, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM d GROUP BY ALL)
SELECT gene_i, gene_j, {r6('delta')} AS delta, {r6('delta_mean')} AS delta_mean, {r6('delta_std')} AS delta_std, {r6('p_boot')} AS p_boot, {r6('lo')} AS ci_low, {r6('hi')} AS ci_high, {r6('delta_mean - delta')} AS bias, lo > 0 OR hi < 0 AS excludes_zero FROM a""")
def bootstrap_edges(spark, sf_dir):
    long = from_embeddings(spark, sf_dir)
    return rounded(diffnet.bootstrap(long, _edges(spark, sf_dir, "sig_edge"), P))


PERM = f"""samples AS (SELECT DISTINCT s FROM expr), pr AS (SELECT perm, s, row_number() OVER (PARTITION BY perm ORDER BY {drawn_sql(42, 'perm', 's')}, s) AS rn FROM samples, range(1, 21) t(perm)),
perms AS (SELECT perm, CASE WHEN rn <= 12 THEN 'low' ELSE 'high' END AS side, s FROM pr WHERE rn <= 24 UNION ALL SELECT 0, side, s FROM split WHERE g = 0),
pv AS (SELECT perm, side, s, g, v FROM expr JOIN perms USING (s)), pk AS (SELECT *, rank() OVER (PARTITION BY perm, side, g ORDER BY v) + (count(*) OVER (PARTITION BY perm, side, g, v) - 1) / 2.0::DOUBLE AS r FROM pv),
pz AS (SELECT *, (r - avg(r) OVER w) / stddev_samp(r) OVER w AS z FROM pk WINDOW w AS (PARTITION BY perm, side, g)),
rr AS (SELECT a.perm, a.side, b.g, sum(a.z * b.z) / (count(*) - 1) AS r FROM pz a JOIN pz b ON a.perm = b.perm AND a.side = b.side AND a.s = b.s AND a.g = 0 AND b.g <> 0 GROUP BY ALL),
dd AS (SELECT perm, g, sum(CASE WHEN side = 'high' THEN r ELSE -r END) AS d FROM rr GROUP BY ALL),
met AS (SELECT perm, avg(abs(d)) AS mean_abs_delta, max(abs(d)) AS max_abs_delta, sum((abs(d) > 0.5001)::INT)::DOUBLE AS n_large FROM dd GROUP BY perm)"""


@query(f"""WITH {EXPR}, {SPLIT}, {PERM}, lm AS (SELECT perm, metric, value FROM met UNPIVOT (value FOR metric IN (mean_abs_delta, max_abs_delta, n_large))),
ob AS (SELECT metric, value AS observed FROM lm WHERE perm = 0), nu AS (SELECT metric, value FROM lm WHERE perm > 0)
SELECT metric, {r6('observed')} AS observed, {r6('avg(value)')} AS null_mean, {r6('stddev_pop(value)')} AS null_std, max(abs(value)) = 0 AS all_zero, {r6('greatest(sum((abs(value) >= abs(observed))::INT) / count(*), 1.0 / count(*))')} AS p FROM ob JOIN nu USING (metric) GROUP BY metric, observed""")
def permutation_metrics(spark, sf_dir):
    long = from_embeddings(spark, sf_dir)
    own = diffnet.extremes(long, 0.2, 0).select(F.lit(0).cast("long").alias("perm"), "side", "sample")
    every = diffnet.row_statistics(long, own.unionByName(diffnet.permuted(long, 20)), 0)
    return rounded(diffnet.permutation_p(every.where("perm > 0"), every.where("perm = 0"), ["mean_abs_delta", "max_abs_delta", "n_large"]))


@query(f"""WITH {EXPR}, {SPLIT}, {PERM}, md AS (SELECT *, median(v) OVER (PARTITION BY perm, side, g) AS med FROM pv WHERE g <> 0), m AS (SELECT perm, side, g, 1.4826::DOUBLE * median(abs(v - med)) AS mad FROM md GROUP BY ALL),
sh AS (SELECT perm, avg(mad) FILTER (side = 'high') - avg(mad) FILTER (side = 'low') AS shift FROM m GROUP BY perm)
SELECT {r6('o.shift')} AS observed, {r6('avg(n.shift)')} AS null_mean, {r6('avg((abs(n.shift) >= abs(o.shift))::INT)')} AS p FROM sh o, sh n WHERE o.perm = 0 AND n.perm > 0 GROUP BY o.shift""")
def mad_permutation(spark, sf_dir):
    long = from_embeddings(spark, sf_dir)
    own = diffnet.extremes(long, 0.2, 0).select(F.lit(0).cast("long").alias("perm"), "side", "sample")
    shift = express.mad_shift(long.where("gene <> 0"), own.unionByName(diffnet.permuted(long, 20)), "perm").select("perm", "shift")
    pair = shift.where("perm > 0").crossJoin(F.broadcast(shift.where("perm = 0").select(F.col("shift").alias("observed"))))
    return rounded(pair.groupBy("observed").agg(F.avg("shift").alias("null_mean"), F.avg((F.abs("shift") >= F.abs("observed")).cast("double")).alias("p")))


# ---- exact tests and models: no SQL form; the tests compare them with independent computations ---------------------
@query()
def fisher_tests(spark, sf_dir):
    q = diffnet.rank_quintile(from_embeddings(spark, sf_dir))
    t = express.drivers(q, express.deviants(express.imbalance(q), 10), 5)
    return t.withColumns({"p": express.fisher_p("a", "b", "c", "d"), "odds_mle": express.fisher_odds("a", "b", "c", "d")})


def _choose(n: str, k: str) -> str:
    return f"(lgamma(({n} + 1)::DOUBLE) - lgamma(({k} + 1)::DOUBLE) - lgamma(({n} - {k} + 1)::DOUBLE))"


@query(f"""WITH t AS (SELECT p_brand AS term, p_partkey AS gene FROM part), mine AS (SELECT DISTINCT l_partkey AS gene FROM lineitem SEMI JOIN t ON gene = l_partkey WHERE l_quantity >= 49),
c AS (SELECT term, count(DISTINCT t.gene) AS size, count(m.gene) AS hits, (SELECT count(DISTINCT gene) FROM t) AS total, (SELECT count(*) FROM mine) AS drawn FROM t LEFT JOIN mine m ON m.gene = t.gene GROUP BY term HAVING count(DISTINCT t.gene) >= 5),
k AS (SELECT *, unnest(range(greatest(hits, drawn + size - total, 0), least(drawn, size) + 1)) AS k FROM c),
x AS (SELECT term, size, hits, least(1, sum(exp({_choose('size', 'k')} + {_choose('(total - size)', '(drawn - k)')} - {_choose('total', 'drawn')}))) AS p FROM k GROUP BY term, size, hits), {with_q('y', 'x', ['p'])}
SELECT term, size, hits, {r6('p')} AS p, {r6('q')} AS q FROM y""")
def term_enrichment(spark, sf_dir):
    terms = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene"))
    genes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 49").select(F.col("l_partkey").alias("gene"))
    return rounded(express.enrichment(genes, terms, 5, 10_000_000))


@query(f"""WITH o AS (SELECT p_brand AS term, p_retailprice AS score, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos, count(*) OVER () AS n FROM part),
h AS (SELECT *, score / sum(score) OVER (PARTITION BY term) AS up, sum(score) OVER (PARTITION BY term ORDER BY pos) / sum(score) OVER (PARTITION BY term) AS run, row_number() OVER (PARTITION BY term ORDER BY pos) AS k, count(*) OVER (PARTITION BY term) AS m FROM o),
d AS (SELECT term, max(run - (pos - k) / (n - m)) AS top, min(run - up - (pos - k) / (n - m)) AS bottom FROM h GROUP BY term)
SELECT term, {r6('CASE WHEN round(top, 12) >= round(-bottom, 12) THEN top ELSE bottom END')} AS score FROM d""")
def term_running_scores(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rounded(express.running_score(p.select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("score")), p.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene"))))


# both halves of a design of two balanced contrasts are orthogonal, so the fit has a closed form
@query(f"""WITH {EXPR}, m AS (SELECT g, avg(v) FILTER (s % 2 = 1) - avg(v) FILTER (s % 2 = 0) AS b, avg(v) FILTER (s >= 32) - avg(v) FILTER (s < 32) AS c, var_pop(v) * 64 AS total FROM expr GROUP BY g),
e AS (SELECT g, b, sqrt((total - 16 * b * b - 16 * c * c) / 61 / 16) AS se FROM m)
SELECT g AS gene, {r6('b')} AS coefficient, {r6('se')} AS se, {r6('b / se')} AS t, 61 AS df FROM e""")
def linear_model_coefficients(spark, sf_dir):
    return rounded(express.linear_models(from_embeddings(spark, sf_dir), {s: [1.0, float(s % 2), float(s >= 32)] for s in range(64)}, 1))


@query()
def principal_components(spark, sf_dir):
    s = express.gene_statistics(from_embeddings(spark, sf_dir))
    return express.principal_components(s, ["mean", "sd", "mad", "minimum", "maximum"], 3)[0]
