"""Enrichment of gene sets along a ranking, with a null of random sets of the same size.

The ranking is numbered in ranges of scores: each range is sorted on its own, and counts of the ranges before it give
the first number, so no task holds the ranking. The null depends on a set's size only: a permutation orders all genes by
a hash, and its first m genes are a random set of m; sets of one size share their null.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweave.sources.scratch import checkpointed

from . import fdr

RANGES = 64


def positions(ranked: DataFrame) -> DataFrame:
    """gene, score, pos: 1, 2, ... from the highest score down, ties by gene; the first of a repeated gene's scores counts.

    Null scores are left out. ranked: gene, score.
    """
    best = checkpointed(ranked.where("score is not null and not isnan(score)").groupBy("gene").agg(F.max("score").cast("double").alias("score")))
    cuts = sorted(set(best.approxQuantile("score", [k / RANGES for k in range(1, RANGES)], 0.002)))
    cell = sum((F.when(F.col("score") <= c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = best.withColumn("__cell", cell)
    sizes = placed.groupBy("__cell").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("__cell", F.coalesce(F.sum("n").over(W.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy("__cell").orderBy(F.desc("score"), "gene"))
    return placed.join(F.broadcast(before), "__cell").select("gene", "score", (F.col("__before") + within).alias("pos"))


def running_scores(hits: DataFrame, total: int, *by: str, power: float = 1.0) -> DataFrame:
    """by, size, es: the largest deviation of the weighted running sum of each set of hits (by, pos, score).

    A hit moves the sum up by its share of |score| ** power, every other gene down by 1 / (total - size). A set without
    weight counts its hits equally. Sets as large as the ranking are left out.
    """
    keys = list(by)
    w = W.partitionBy(*keys)
    a = F.pow(F.abs("score"), power)
    rows = hits.select(*keys, "pos", a.alias("a")).withColumns({"m": F.count("*").over(w), "total": F.sum("a").over(w)})
    up = F.when(F.col("total") > 0, F.col("a") / F.col("total")).otherwise(1 / F.col("m"))
    run = W.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("up", up).withColumns({"sum": F.sum("up").over(run), "k": F.row_number().over(run)}).where(F.col("m") < total)
    down = (F.col("pos") - F.col("k")) / (total - F.col("m"))
    points = rows.groupBy(*keys).agg(F.max("m").alias("size"), F.max(F.col("sum") - down).alias("top"), F.min(F.col("sum") - F.col("up") - down).alias("bottom"))
    return points.select(*keys, "size", F.when(F.round("top", 12) >= F.round(-F.col("bottom"), 12), F.col("top")).otherwise(F.col("bottom")).alias("es"))


def set_enrichment(ranked: DataFrame, terms: DataFrame, least: int = 10, most: int = 500, permutations: int = 1000, seed: int = 1, power: float = 1.0) -> DataFrame:
    """term, size, es, nes, p, q of gene sets (term, gene) of least to most ranked genes, along a ranking (gene, score).

    p: (1 + null scores of the same sign that are as far out) / (1 + null scores of that sign); nes: es over the mean of
    the null scores of its sign; null if there is none. q: Benjamini and Hochberg over the terms.
    """
    order = checkpointed(positions(ranked))
    total = order.count()
    own = terms.select("term", "gene").distinct().join(order, "gene")
    sizes = own.groupBy("term").agg(F.count("*").alias("m")).where(F.col("m").between(least, most) & (F.col("m") < total))
    own = checkpointed(running_scores(own.join(sizes.select("term"), "term", "left_semi").select("term", "pos", "score"), total, "term", power=power))
    needed = own.select("size").distinct()  # at most `most` rows
    longest = needed.agg(F.max("size")).first()[0]
    if longest is None:
        return own.select("term", "size", "es", *[F.lit(None).cast("double").alias(c) for c in ("nes", "p", "q")])
    perms = order.sparkSession.range(1, permutations + 1).select(F.col("id").alias("perm"))
    # a permutation's first genes by hash: only those below a bound that leaves enough of them are sorted
    part = min(1.0, (longest + 10 * longest**0.5 + 50) / total)
    hashed = order.crossJoin(F.broadcast(perms)).withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "perm", "gene"), F.lit(1 << 30)))
    near = hashed.where(F.col("h") < int(part * (1 << 30)) + 1) if part < 1 else hashed
    first = near.withColumn("k", F.row_number().over(W.partitionBy("perm").orderBy("h", "gene"))).where(F.col("k") <= longest)
    drawn = checkpointed(first.select("perm", "k", "pos", "score"))
    short = drawn.groupBy("perm").agg(F.max("k").alias("k")).where(F.col("k") < longest).count()
    if short:  # the bound left too few genes: far beyond any likely deal
        raise RuntimeError("a permutation has fewer genes than the largest set")
    sets = drawn.join(F.broadcast(needed), F.col("k") <= F.col("size")).select("perm", "size", "pos", "score")
    null = running_scores(sets.withColumnRenamed("size", "want"), total, "perm", "want", power=power).select(F.col("want").alias("size"), F.col("es").alias("null"))
    met = own.join(checkpointed(null), "size").where(F.signum("null") == F.signum("es"))
    got = met.groupBy("term").agg(F.avg("null").alias("mean"), ((1 + F.sum((F.abs("null") >= F.abs("es")).cast("long"))) / (1 + F.count("*"))).alias("p"))
    out = checkpointed(own.join(got, "term", "left").select("term", "size", "es", F.try_divide("es", F.abs("mean")).alias("nes"), "p"))
    return fdr.benjamini_hochberg(out, "p", "q")
