"""Differential co-expression: splits by a reference feature, tests, masks, classes, resampling."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweave.functions.ranks import average_rank, drawn, z_score
from sparkweave.functions.special import normal_tail, t_angle, t_tail
from sparkweave.sources.scratch import checkpointed

from . import fdr, pairs

FLOOR = 1.19e-7  # of 1 - r * r
CLASSES = ("unchanged", "disappear", "new", "sign_change", "strengthen", "weaken")


@dataclass(frozen=True)
class Params:
    focus: int = 0
    fraction: float = 0.2
    alpha: float = 0.7
    threshold: float = 0.1
    min_effect: float = 0.0
    replicates: int = 20
    share: float = 0.8  # of a side's samples that a replicate draws
    seed: int = 42


def extremes(long: DataFrame, fraction: float = 0.2, *refs: int) -> DataFrame:
    """ref_gene, side, sample: the k = floor(n * fraction) samples of lowest and of highest value, ties by sample."""
    src = long.where(F.col("gene").isin(*refs)) if refs else long
    n = F.count("*").over(W.partitionBy("gene"))
    low = F.row_number().over(W.partitionBy("gene").orderBy("value", "sample"))
    high = F.row_number().over(W.partitionBy("gene").orderBy(F.desc("value"), "sample"))
    ranked = src.select("gene", "sample", low.alias("lo"), high.alias("hi"), F.floor(n * fraction).alias("k"))
    sides = ranked.select(F.col("gene").alias("ref_gene"), "sample", F.explode(F.array(F.struct(F.lit("low").alias("side"), (F.col("lo") <= F.col("k")).alias("on")), F.struct(F.lit("high").alias("side"), (F.col("hi") <= F.col("k")).alias("on")))).alias("s"))
    return sides.where("s.on").select("ref_gene", "s.side", "sample")


def tiles(long: DataFrame, n: int = 5) -> DataFrame:
    """ntile of each sample within its feature, larger tiles first."""
    return long.select("gene", "sample", F.ntile(n).over(W.partitionBy("gene").orderBy("value", "sample")).alias("tile"))


def quantile_groups(long: DataFrame, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Q1 at or below the low quantile, Q5 at or above the high one; the middle is dropped."""
    cut = long.groupBy("gene").agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("q"))
    group = F.when(F.col("value") <= F.col("q")[0], "Q1").when(F.col("value") >= F.col("q")[1], "Q5")
    return long.join(cut, "gene").select("gene", "sample", group.alias("group")).where("group is not null")


def rank_quintile(long: DataFrame, seed: int = 1) -> DataFrame:
    """min(ceil(5 rank / n), 5) with ties broken by a seeded hash of the sample."""
    order = W.partitionBy("gene").orderBy("value", drawn(seed, F.col("sample")), "sample")
    n = F.count("*").over(W.partitionBy("gene"))
    return long.select("gene", "sample", F.least(F.ceil(5 * F.row_number().over(order) / n), F.lit(5)).cast("int").alias("q"))


def test_angle(r: Column, n: int) -> Column:
    """Angle of a correlation's t statistic over n samples, for t_two_sided with n - 2 degrees of freedom."""
    return t_angle(r * F.lit((n - 2) ** 0.5) / F.sqrt(F.greatest(F.lit(1.0) - r * r, F.lit(FLOOR))), n - 2)


def tests_of(low, high, n: int):
    """Arrays r_low, r_high and p of both correlations over n samples each and of their difference."""
    angle = lambda r: np.arctan(np.abs(r) / np.sqrt(np.maximum(1 - r * r, FLOOR)))
    z = (np.arctanh(np.clip(high, -0.9999, 0.9999)) - np.arctanh(np.clip(low, -0.9999, 0.9999))) / (2 / (n - 3)) ** 0.5
    return low, high, t_tail(angle(low), n - 2), t_tail(angle(high), n - 2), normal_tail(z)


def classify(r_low: Column, r_high: Column, sig_low: Column, sig_high: Column, threshold: float) -> Column:
    """Six-way class of an edge; absent on both sides and equal strength are unchanged."""
    low, high = sig_low & (F.abs(r_low) >= threshold), sig_high & (F.abs(r_high) >= threshold)
    both = low & high
    return (
        F.when(low & ~high, "disappear").when(~low & high, "new").when(both & (F.signum(r_low) != F.signum(r_high)), "sign_change")
        .when(both & (F.abs(r_high) > F.abs(r_low)), "strengthen").when(both & (F.abs(r_high) < F.abs(r_low)), "weaken").otherwise("unchanged")
    )


def side_vectors(long: DataFrame, split: DataFrame, side: str) -> DataFrame:
    """Rank vectors of all features over one side of one reference feature's split; the split's rows are few."""
    mine = split.where(F.col("side") == side).select("sample")
    return pairs.rank_vectors(long.join(F.broadcast(mine), "sample", "left_semi"))


def edges(long: DataFrame, params: Params = Params()) -> DataFrame:
    """gene_i, gene_j, r, p, q of both sides and of their difference, masks and class, for one reference feature."""
    split = extremes(long, params.fraction, params.focus)
    n = split.where("side = 'low'").count()
    low, high = side_vectors(long, split, "low"), side_vectors(long, split, "high")
    both = low.where("z is not null").join(high.where("z is not null").withColumnRenamed("z", "z2"), "gene")
    both = pairs.all_pairs_of_two(both, lambda a, b: tests_of(a, b, n), "r_low double, r_high double, p_low double, p_high double, p_diff double")
    both = both.withColumn("delta", F.col("r_high") - F.col("r_low"))
    # written once: three rankings read it
    both = checkpointed(both)
    for side in ("low", "high", "diff"):
        both = fdr.benjamini_hochberg(both, f"p_{side}", f"q_{side}")
    sig = {f"sig_{s}": F.col(f"q_{s}") < params.alpha for s in ("low", "high")}
    both = both.withColumns(sig).withColumns({"sig_individual": F.col("sig_low") | F.col("sig_high"), "sig_differential": F.col("q_diff") < params.alpha})
    both = both.withColumn("sig_edge", F.col("sig_individual") & F.col("sig_differential"))
    return both.withColumn("class", classify(F.col("r_low"), F.col("r_high"), F.col("sig_low"), F.col("sig_high"), params.threshold))


def bootstrap(long: DataFrame, chosen: DataFrame, params: Params = Params()) -> DataFrame:
    """chosen (gene_i, gene_j, delta) with mean, spread, interval, bias and p of the resampled difference.

    A replicate draws floor(k * share) samples of each side with replacement, by an arithmetic hash. Ranks are taken
    once for each replicate and feature that an edge needs; correlations only for the edges.
    """
    split = extremes(long, params.fraction, params.focus)
    k = split.where("side = 'low'").count()
    m = int(k * params.share)
    spark = long.sparkSession
    placed = split.withColumn("pos", F.row_number().over(W.partitionBy("side").orderBy("sample")) - 1)
    grid = spark.range(params.replicates).select(F.col("id").alias("b")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("side", F.explode(F.array(F.lit("low"), F.lit("high"))))
    pick = drawn(params.seed, F.col("b"), F.col("slot"), F.when(F.col("side") == "low", 0).otherwise(1)) % k
    draws = grid.withColumn("pos", pick.cast("int")).join(F.broadcast(placed), ["side", "pos"]).select("b", "side", "slot", "sample")
    genes = chosen.select(F.explode(F.array("gene_i", "gene_j")).alias("gene")).distinct()
    values = long.join(genes, "gene", "left_semi").join(F.broadcast(draws), "sample")
    ranked = values.withColumn("r", average_rank("value", "b", "side", "gene")).withColumn("zr", z_score("r", "b", "side", "gene"))
    z = ranked.groupBy("b", "side", "gene").agg(F.array_sort(F.collect_list(F.struct("slot", "zr"))).alias("a")).select("b", "side", "gene", F.transform("a", lambda x: x["zr"]).alias("z"))
    got = pairs.listed(chosen.select("gene_i", "gene_j", "delta"), z)
    wide = got.groupBy("gene_i", "gene_j", "delta", "b").agg(F.sum(F.when(F.col("side") == "high", F.col("r")).otherwise(-F.col("r"))).alias("d"))
    below, above = F.avg((F.col("d") < 0).cast("double")), F.avg((F.col("d") > 0).cast("double"))
    out = wide.groupBy("gene_i", "gene_j", "delta").agg(
        F.avg("d").alias("delta_mean"), F.stddev_samp("d").alias("delta_std"), F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"),
        F.greatest(F.least(F.lit(1.0), 2 * F.least(below, above)), F.lit(1.0 / params.replicates)).alias("p_boot"),
    )
    out = out.withColumns({"ci_low": F.col("ci")[0], "ci_high": F.col("ci")[1], "bias": F.col("delta_mean") - F.col("delta")}).drop("ci")
    return out.withColumn("excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0)).where(F.abs("delta") >= params.min_effect)


def permuted(long: DataFrame, count: int, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """perm, side, sample: samples dealt at random into two sides of floor(n * fraction), without replacement."""
    samples = long.select("sample").distinct()
    order = W.partitionBy("perm").orderBy(drawn(seed, F.col("perm"), F.col("sample")), "sample")
    perms = long.sparkSession.range(1, count + 1).select(F.col("id").alias("perm"))
    rows = samples.crossJoin(F.broadcast(perms)).select("perm", "sample", F.row_number().over(order).alias("rn"), F.floor(F.count("*").over(W.partitionBy("perm")) * fraction).alias("k"))
    side = F.when(F.col("rn") <= F.col("k"), "low").when(F.col("rn") <= 2 * F.col("k"), "high")
    return rows.select("perm", side.alias("side"), "sample").where("side is not null")


def row_statistics(long: DataFrame, splits: DataFrame, focus: int) -> DataFrame:
    """perm and, over the focus row's partners, mean and largest |delta| and count of |delta| > 0.5."""
    values = long.join(F.broadcast(splits), "sample")
    ranked = values.withColumn("r", average_rank("value", "perm", "side", "gene")).withColumn("z", z_score("r", "perm", "side", "gene"))
    row = ranked.where(F.col("gene") == focus).select("perm", "side", "sample", F.col("z").alias("zf"))
    joined = ranked.where(F.col("gene") != focus).join(F.broadcast(row), ["perm", "side", "sample"])
    r = joined.groupBy("perm", "side", "gene").agg((F.sum(F.col("z") * F.col("zf")) / (F.count("*") - 1)).alias("r"))
    d = r.groupBy("perm", "gene").agg(F.sum(F.when(F.col("side") == "high", F.col("r")).otherwise(-F.col("r"))).alias("d"))
    return d.groupBy("perm").agg(F.avg(F.abs("d")).alias("mean_abs_delta"), F.max(F.abs("d")).alias("max_abs_delta"), F.sum((F.abs("d") > 0.5001).cast("long")).alias("n_large"))


def permutation_p(null: DataFrame, observed: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, observed, null_mean, null_std, p: two-sided, floored at 1 / n; null without permutations."""
    long_null = null.unpivot("perm", [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    long_obs = observed.unpivot("perm", [F.col(m).cast("double").alias(m) for m in metrics], "metric", "observed").drop("perm")
    n = F.count("value")
    hits = F.sum((F.abs("value") >= F.abs("observed")).cast("long"))
    return long_obs.join(long_null, "metric", "left").groupBy("metric", "observed").agg(
        F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_std"), F.max(F.abs("value")).eqNullSafe(0.0).alias("all_zero"),
        F.when(n > 0, F.greatest(hits / n, 1 / n)).alias("p"),
    )
