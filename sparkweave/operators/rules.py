"""Row rules of the analysis: classes, levels, masks and transforms as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweave.functions.ranks import drawn


def hard_threshold(x: Column, cut: float) -> Column:
    """Values at or below the cut become 0."""
    return F.when(x > cut, x).otherwise(0.0)


def mean_and_spread_class(q_mean: Column, q_spread: Column, lfc: Column, spread_change: Column, alpha: float = 0.05) -> Column:
    """up_deg, down_deg, up_dvg, down_dvg, Both or NS from two q values; a null q is NS."""
    mean, spread = q_mean < alpha, q_spread < alpha
    return (
        F.when(mean & ~spread & (lfc > 0), "up_deg").when(mean & ~spread & (lfc <= 0), "down_deg")
        .when(~mean & spread & (spread_change > 0), "up_dvg").when(~mean & spread & (spread_change <= 0), "down_dvg")
        .when(mean & spread, "Both").otherwise("NS")
    )


def directed_class(label: Column, lfc: Column, spread_change: Column) -> Column:
    """Labels of either generation in one form; Both is split by the sign of the mean's change."""
    same = label.isin("up_deg", "down_deg", "up_dvg", "down_dvg")
    return (
        F.when(same, label).when((label == "Both") & (lfc > 0), "both_up_deg").when((label == "Both") & (lfc <= 0), "both_down_deg")
        .when((label == "DEG") & (lfc > 0), "up_deg").when((label == "DEG") & (lfc <= 0), "down_deg")
        .when((label == "DVG") & (spread_change > 0), "up_dvg").when((label == "DVG") & (spread_change <= 0), "down_dvg").otherwise("NS")
    )


def preservation_level(p_weight: Column, p_coherence: Column) -> Column:
    both = lambda cut: (p_weight < cut) & (p_coherence < cut)
    weak = (p_weight < 0.1) | (p_coherence < 0.1)
    return F.when(both(0.001), "Strong preservation").when(both(0.05), "Moderate preservation").when(weak, "Weak preservation").otherwise("No preservation")


def direction(expression: Column, connectivity: Column) -> Column:
    up, linked = expression > 0, connectivity > 0
    down, unlinked = expression < 0, connectivity < 0
    return F.when(up & linked, "Both Increased").when(up & unlinked, "Expr Up, Connect Down").when(down & linked, "Expr Down, Connect Up").when(down & unlinked, "Both Decreased").otherwise("No Change")


def finite_or(x: Column, other: float) -> Column:
    """other for null, NaN and infinite values."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), other).otherwise(x)


def capped_log(p: Column, most: float) -> Column:
    return F.least(-F.log10(p + 1e-300), F.lit(most))


def symbol_like(line: Column) -> Column:
    """Is a trimmed line a gene symbol: one word that starts with a letter, at most 30 characters, no run of four digits?"""
    return line.rlike("^[A-Za-z][A-Za-z0-9_.\\-]*$") & (F.length(line) <= 30) & ~line.rlike("[0-9]{4}")


def coding_only(name: Column) -> Column:
    """Not a non-coding RNA by its prefix, nor a ribosomal protein by its symbol."""
    return ~(name.rlike("^(lncRNA|asRNA|snRNA|hpRNA):") | name.rlike("^Rp[SsLl]"))


def quadrant_candidates(points: DataFrame, quadrant: str) -> DataFrame:
    """Points (x, y, baseline) strictly beyond the baseline's thresholds in a quadrant, the baseline itself left out.

    The thresholds are the baseline's extremes towards the origin, held at 0; Q4 takes the least y, as is the rule there.
    """
    own = points.where("baseline").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    right, left = F.greatest("x_min", F.lit(0.0)), F.least("x_max", F.lit(0.0))
    above, below = F.greatest("y_min", F.lit(0.0)), F.least("y_max", F.lit(0.0))
    x, y = F.col("x"), F.col("y")
    passed = {"Q1": (x > right) & (y > above), "Q2": (x < left) & (y > above), "Q3": (x < left) & (y < below), "Q4": (x > right) & (y < above)}[quadrant]
    return points.crossJoin(F.broadcast(own)).where(passed & ~F.col("baseline")).select(*points.columns)


def slopes(points: DataFrame) -> DataFrame:
    """One row: the baseline's slope by least squares, through the origin, and by mean unit vectors."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    own = points.where("baseline").withColumn("r", r)
    unit = F.avg(F.when(F.col("r") > 0, F.col("y") / F.col("r"))) / F.avg(F.when(F.col("r") > 0, F.col("x") / F.col("r")))
    return own.agg(F.regr_slope("y", "x").alias("ols"), (F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("origin"), unit.alias("unit"))


def in_band(points: DataFrame, method: str, width: float) -> DataFrame:
    """points with band: is |y - slope * x| at most width?"""
    slope = F.broadcast(slopes(points).select(F.col(method).alias("__slope")))
    return points.crossJoin(slope).withColumn("band", F.abs(F.col("y") - F.col("__slope") * F.col("x")) <= width).drop("__slope")


def rescaled(df: DataFrame, column: str, low: float, high: float, out: str) -> DataFrame:
    """Min-max of a column onto [low, high]; the middle where it has one value only."""
    ends = F.broadcast(df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi")))
    share = F.when(F.col("__hi") > F.col("__lo"), (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.5)
    return df.crossJoin(ends).withColumn(out, low + share * (high - low)).drop("__lo", "__hi")


def width_bins(df: DataFrame, column: str, bins: int, out: str) -> DataFrame:
    """Number from 1 of the equal-width bin of each value; the largest value is in the last."""
    ends = F.broadcast(df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi")))
    place = F.floor((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins) + 1
    return df.crossJoin(ends).withColumn(out, F.when(F.col("__hi") > F.col("__lo"), F.least(place, F.lit(bins))).otherwise(1)).drop("__lo", "__hi")


def scaled(df: DataFrame, *columns: str) -> DataFrame:
    """Columns less their mean, over their standard deviation; null without spread. Means travel as one row."""
    sums = F.broadcast(df.agg(*[f(c).alias(f"__{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]))
    z = {f"z_{c}": F.when(F.col(f"__{c}_s") > 0, (F.col(c) - F.col(f"__{c}_m")) / F.col(f"__{c}_s")) for c in columns}
    return df.crossJoin(sums).withColumns(z).select(*df.columns, *z)


def top(df: DataFrame, n: int, by: Column, *ties: str) -> DataFrame:
    """The n rows of the largest values; nulls come last, ties by the given columns."""
    return df.orderBy(by.desc_nulls_last(), *ties).limit(n)


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key, by an aggregate of one struct: no key's rows are gathered."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__row"))
    return got.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def top_of_each(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """df with rank, its first n rows of each key."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def subset(names: DataFrame, n: int, required: DataFrame, seed: int) -> DataFrame:
    """gene: all required ones among names (gene, whole numbers), and of the others as many as n leaves, in a seeded order."""
    every = names.select("gene").distinct()
    own = every.join(required.select("gene").distinct(), "gene", "left_semi")
    rest = every.join(required.select("gene"), "gene", "left_anti")
    return own.union(rest.orderBy(drawn(seed, F.col("gene")), "gene").limit(max(0, n - own.count())))


def gained(control: Column, treated: Column) -> Column:
    """The treated value where it is the larger, else 0; null if either is missing."""
    return F.when(treated > control, treated).when(control.isNotNull() & treated.isNotNull(), 0.0)
