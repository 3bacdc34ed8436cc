"""Term graphs: ancestors, information content, similarity of terms, and removal of redundant terms.

A graph is a table (term, parent) with an optional weight in (0, 1]. Pairs of terms meet only over ancestors that are
rare enough to matter (see `graph_similarity` and `shared_information`), so the root does not pair all terms.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweave.sources.scratch import checkpointed

EDGE_WEIGHT = 0.8  # of a plain is-a relation
MARGIN = 1e-9  # sums of doubles differ by their order


def ancestors(terms: DataFrame, graph: DataFrame, weight: str | None = None) -> DataFrame:
    """term, ancestor, s: all ancestors of the given terms, themselves included with s = 1.

    s is the largest product of edge weights of a path from term to ancestor. Each round follows only rows that became
    better, so the rounds are at most the longest path and cycles end. Null terms and edges are left out.
    """
    up = graph.where("term is not null and parent is not null and term <> parent")
    up = up.groupBy(F.col("term").alias("ancestor"), "parent").agg(F.max(F.col(weight) if weight else F.lit(EDGE_WEIGHT)).cast("double").alias("w"))
    up = checkpointed(up)
    found = last = checkpointed(terms.where("term is not null").select("term").distinct().select("term", F.col("term").alias("ancestor"), F.lit(1.0).alias("s")))
    while not last.isEmpty():
        step = last.join(up, "ancestor").groupBy("term", F.col("parent").alias("ancestor")).agg(F.max(F.col("s") * F.col("w")).alias("s"))
        known = found.withColumnRenamed("s", "__s")
        last = checkpointed(step.join(known, ["term", "ancestor"], "left").where("__s is null or s > __s").select("term", "ancestor", "s"))
        found = checkpointed(found.union(last).groupBy("term", "ancestor").agg(F.max("s").alias("s")))
    return found


def information(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """term, n, ic: genes annotated with a term or a descendant, and -ln of their share of all annotated genes.

    annotations: term, gene; closure: `ancestors` of the annotated terms. Genes under one ancestor are counted once.
    """
    own = annotations.where("term is not null and gene is not null").select("term", "gene").distinct()
    total = F.broadcast(own.agg(F.countDistinct("gene").alias("total")))
    n = own.join(closure.select("term", "ancestor"), "term").select(F.col("ancestor").alias("term"), "gene").distinct().groupBy("term").agg(F.count("*").alias("n"))
    return n.crossJoin(total).select("term", "n", (F.log("total") - F.log("n")).alias("ic"))


def graph_similarity(closure: DataFrame, cutoff: float = 0.7) -> DataFrame:
    """a, b (a < b), similarity: pairs of terms whose shared ancestors weigh more than `cutoff` of all their weights.

    similarity = sum over shared ancestors of (s of a + s of b) / (sum of s of a + sum of s of b). Of a pair above the
    cutoff c, the term with the larger sum shares more than 2c - 1 of it; so its ancestors, rarest first, need be looked
    up only until no more than that is left. Every such pair is found.
    """
    every = W.partitionBy("term")
    rest = every.orderBy(F.desc("__df"), F.desc("ancestor")).rowsBetween(W.unboundedPreceding, 0)
    counted = closure.join(closure.groupBy("ancestor").agg(F.count("*").alias("__df")), "ancestor")
    rows = checkpointed(counted.select("term", "ancestor", "s", F.sum("s").over(every).alias("sum"), F.sum("s").over(rest).alias("rest")))
    first = rows.where(F.col("rest") > (2 * cutoff - 1) * F.col("sum") - MARGIN).select("ancestor", F.col("term").alias("x"), F.col("sum").alias("sx"))
    met = first.join(rows.select("ancestor", F.col("term").alias("y"), F.col("sum").alias("sy")), "ancestor").where((F.col("x") != F.col("y")) & (F.col("sx") >= F.col("sy") - MARGIN))
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda t, s, total: rows.select(F.col("term").alias(t), "ancestor", F.col("s").alias(s), F.col("sum").alias(total))
    shared = met.join(side("a", "s_a", "sum_a"), "a").join(side("b", "s_b", "sum_b"), ["b", "ancestor"])
    pairs = shared.groupBy("a", "b").agg((F.sum(F.col("s_a") + F.col("s_b")) / (F.first("sum_a") + F.first("sum_b"))).alias("similarity"))
    return pairs.where(F.col("similarity") > cutoff)


def shared_information(closure: DataFrame, content: DataFrame, cutoff: float = 0.7) -> DataFrame:
    """a, b (a < b), similarity: pairs with 2 ic(best shared ancestor) / (ic(a) + ic(b)) above the cutoff.

    content: term, ic. As no ancestor holds more than its term, an ancestor of a can be the best one of such a pair only
    if its ic exceeds c / (2 - c) of a's; others are not joined. Terms without content, and of content 0, are in no pair.
    """
    up = content.select(F.col("term").alias("ancestor"), F.col("ic").alias("up"))
    rows = closure.select("term", "ancestor").join(content.select("term", "ic"), "term").join(up, "ancestor").where("ic > 0")
    rows = checkpointed(rows.where(F.col("up") > cutoff / (2 - cutoff) * F.col("ic") - MARGIN))
    side = lambda t, c: rows.select("ancestor", F.col("term").alias(t), F.col("ic").alias(c), "up")
    met = side("a", "ic_a").join(side("b", "ic_b").drop("up"), "ancestor").where("a < b")
    pairs = met.groupBy("a", "b").agg((2 * F.max("up") / (F.first("ic_a") + F.first("ic_b"))).alias("similarity"))
    return pairs.where(F.col("similarity") > cutoff)


def not_redundant(scored: DataFrame, pairs: DataFrame, score: str = "q") -> DataFrame:
    """Rows of scored (term, score, ...) that are the best, or as good as it, in every neighbourhood they stand in.

    The neighbourhood of a term is the term and all that `pairs` (a, b) put beside it; smaller scores are better. A null
    score is worse than any other. The rule does not depend on an order of the terms.
    """
    own = scored.select("term", F.coalesce(F.col(score).cast("double"), F.lit(float("inf"))).alias("__score"))
    pairs = pairs.select("a", "b")
    near = pairs.union(pairs.select("b", "a")).toDF("term", "centre").join(own, "term")
    near = near.unionByName(own.withColumn("centre", F.col("term")))
    best = near.groupBy("centre").agg(F.min("__score").alias("__best"))
    # centres that are no scored terms stand for none
    best = best.join(own.select(F.col("term").alias("centre")), "centre", "left_semi")
    worse = near.join(best, "centre").where("__score > __best").select("term").distinct()
    return scored.join(worse, "term", "left_anti")
