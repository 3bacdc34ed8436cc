"""Correlation inside sets of features: hubs of modules, and sets against random ones of their size."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweave.functions.ranks import drawn
from sparkweave.sources.scratch import checkpointed

from .pairs import BLOCK


def within_sets(vectors: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """set, gene_i < gene_j, r of all pairs of features with vectors (gene long, z) that share a set (set long, gene).

    A set is dealt into blocks by its own size; a group holds two of its blocks at most, however large the set is.
    """
    own = checkpointed(sets.where("set is not null").select(F.col("set").cast("long").alias("set"), "gene").distinct())
    sizes = own.groupBy("set").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    keyed = own.join(sizes, "set").withColumn("b", F.pmod(F.xxhash64("gene"), "blocks").cast("int")).join(vectors.where("z is not null"), "gene")
    dealt = keyed.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("set", "gene", "z", "b", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"))

    def run(key, pdf):
        name, lo, hi = key
        ids, z, b = pdf["gene"].to_numpy(), np.array(pdf["z"].to_list()), pdf["b"].to_numpy()
        one, two = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        r = np.clip(z[one] @ z[two].T / (z.shape[1] - 1), -1, 1)
        i, j = np.broadcast_arrays(ids[one][:, None], ids[two][None, :])
        pick = i < j if lo == hi else np.ones(r.shape, bool)
        return pd.DataFrame({"set": name, "gene_i": np.minimum(i, j)[pick], "gene_j": np.maximum(i, j)[pick], "r": r[pick]})

    return dealt.groupBy("set", "lo", "hi").applyInPandas(run, "set long, gene_i long, gene_j long, r double")


def hub_of_each(vectors: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """set, gene, strength: the member with the largest sum of |r| with the others of its set; ties go to the smaller gene."""
    ends = within_sets(vectors, sets, block).select("set", F.explode(F.array("gene_i", "gene_j")).alias("gene"), F.abs("r").alias("a"))
    sums = ends.groupBy("set", "gene").agg(F.sum("a").alias("strength"))
    best = sums.groupBy("set").agg(F.min(F.struct((-F.round("strength", 9)).alias("k"), "gene", "strength")).alias("m"))
    return best.select("set", "m.gene", "m.strength")


def random_sets(sets: DataFrame, genes: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """set, rep, gene: for each set and repetition as many genes outside it as it has (fewer if there are not so many).

    The order is a seeded number; only genes whose number is below a bound that leaves more than enough are sorted.
    """
    own = checkpointed(sets.select("set", "gene").distinct())
    total = genes.select("gene").distinct().count()
    sizes = own.groupBy("set").agg(F.count("*").alias("size"))
    jobs = checkpointed(sizes.crossJoin(F.broadcast(sizes.sparkSession.range(1, repetitions + 1).toDF("rep"))))
    part = (F.col("size") + 12 * F.sqrt("size") + 60) / F.greatest(total - F.col("size"), F.lit(1))
    dealt = genes.select("gene").distinct().join(jobs.withColumn("bound", part * 2147483647), how="cross").withColumn("h", drawn(seed, F.col("set"), F.col("rep"), F.col("gene")))
    near = dealt.where("h < bound").join(own, ["set", "gene"], "left_anti")
    got = checkpointed(near.withColumn("k", F.row_number().over(W.partitionBy("set", "rep").orderBy("h", "gene"))).where("k <= size").select("set", "rep", "gene"))
    short = jobs.join(got.groupBy("set", "rep").agg(F.count("*").alias("n")), ["set", "rep"], "left").where(F.coalesce("n", F.lit(0)) < F.least("size", total - F.col("size")))
    if not short.isEmpty():  # far beyond any likely deal
        raise RuntimeError("the bound left too few genes for a random set")
    return got


def coherence(vectors: DataFrame, sets: DataFrame, repetitions: int, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """set, own, n, mean, median: |r| of the pairs of each set (own) and of all its random sets together.

    Members without vectors are left out first; sets of fewer than two others have no row.
    """
    good = checkpointed(vectors.where("z is not null"))
    members = checkpointed(sets.select("set", "gene").distinct().join(good.select("gene"), "gene", "left_semi"))
    drawn_sets = random_sets(members, good, repetitions, seed)
    named = members.withColumn("rep", F.lit(0).cast("long")).unionByName(drawn_sets)
    keyed = named.withColumn("set", F.col("set") * (repetitions + 1) + F.col("rep"))
    r = within_sets(good, keyed, block)
    source = F.floor(F.col("set") / (repetitions + 1))
    own = F.pmod("set", F.lit(repetitions + 1)) == 0
    return r.groupBy(source.alias("set"), own.alias("own")).agg(F.count("*").alias("n"), F.avg(F.abs("r")).alias("mean"), F.median(F.abs("r")).alias("median"))
