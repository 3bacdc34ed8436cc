"""The queries of this subpackage: each applies one operator to its whole table and returns the agreed columns."""

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, jaccard, licenses, linedup, packing, pages, periods, pii, quality, simhash, toxicity, webp
from .tables import Scratch, table, vocabulary


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = bpe.encode(docs, vocabulary(), keep=["doc_id"], decode=True)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return toxicity.apply(docs, model).select("doc_id", held, "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "neighbours")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = webp.media(table(spark, sf_dir, "documents"))
    tail = F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32")
    size = F.length("payload").cast("long").alias("payload_bytes")
    return stored.select("doc_id", "n_bytes", size, F.sha2("payload", 256).alias("payload_sha256"), tail, F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.apply(docs, model)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = docs.select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    after = linedup.clean(before)
    left = F.size(F.split("text", "\n")).cast("long")
    return after.select("doc_id", "n_lines", F.length("text").cast("long").alias("n_chars"), left.alias("n_left"), F.sha2("text", 256).alias("text_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = Scratch(spark, "pieces").put(packing.pieces(table(spark, sf_dir, "documents"), vocabulary()), "pieces")
    return packing.place(parts)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", kind).alias(f"n_{kind}") for kind in pii.KINDS[: pii.BASE]]
    return found.select("doc_id", *counts, F.sha2(pii.text_of("base"), 256).alias("base_sha256"), pii.text_of("all").alias("spans"), pii.scores_of("all").alias("scores"))


def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _repeated(words: list, ident: int | None) -> list:
    """The agreed texts with a planted period: one in ten by the checksum of its id; none without an id."""
    check = zlib.crc32(str(ident).encode())
    if ident is None or check % 10 or not words:
        return words
    g, n = check // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find(table(spark, sf_dir, "documents"), rewrite=_repeated)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, period = (-F.col("most.start")).alias("start"), (-F.col("most.period")).alias("period")
    milli = F.expr("1000 * most.length div -most.period").alias("exponent_milli")
    return best.select("doc_id", "n_runs", start, F.col("most.length").alias("length"), period, milli, "runs_sha256", "collapsed_sha256")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe, "op2_toxicity": op2_toxicity, "op3_licenses": op3_licenses, "op4_jaccard": op4_jaccard, "op5_media": op5_media, "op6_quality": op6_quality, "op7_lines": op7_lines, "op8_packing": op8_packing, "op9_pii": op9_pii, "op10_pages": op10_pages, "op11_centroids": op11_centroids, "op12_periods": op12_periods, "op13_simhash": op13_simhash}
#: Classes of near duplicates by all pairs that share a shingle. The other queries have no SQL form for all their columns
#: (tokens, likelihoods, images, trees, packing, files of spans); their tests hold them against brute force.
_JACCARD = """WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS one FROM g), p AS (SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM x a JOIN x b ON a.one = b.one AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM p WHERE 100 * k >= 80 * (n + m - k)), r(doc_id, root) AS (SELECT doc_id, doc_id FROM g UNION SELECT l.j, r.root FROM r JOIN l ON l.i = r.doc_id)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(root) AS component_id FROM g JOIN r USING (doc_id) GROUP BY doc_id"""


def _lloyd(rounds: int = 10, k: int = 8) -> str:
    """Lloyd's rounds over all vectors, a pair of tables for each round."""
    near = """SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, min({{'d': d, 'c': c}}) AS m FROM
(SELECT r, vec_id, v.q, c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - z.q[i]) * (v.q[i] - z.q[i])))::BIGINT AS d FROM v, c{0} z) GROUP BY r"""
    mean = """SELECT c, coalesce(n.q, o.q) AS q FROM c{0} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS q FROM
(SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (SELECT m.c AS c, i, sum(q[i]) AS s, count(*) AS n FROM a{0}, range(1, 65) t(i) GROUP BY ALL)) GROUP BY c) n USING (c)"""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds):
        parts += [f"a{i} AS MATERIALIZED ({near.format(i)})", f"c{i + 1} AS MATERIALIZED ({mean.format(i)})"]
    parts.append(f"a AS MATERIALIZED ({near.format(rounds)})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(z.q, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY a.q) AS n_copies FROM a JOIN c{rounds} z ON z.c = a.m.c"""


ORACLE_SQL: dict[str, str] = {"op4_jaccard": _JACCARD, "op11_centroids": _lloyd()}
