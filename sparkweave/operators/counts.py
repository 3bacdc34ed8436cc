"""Normalisation of count matrices, designs, and linear models of log counts with moderated t statistics.

Counts come in long form (gene, sample, n), zeros included. What is gathered on the driver is one number or row a sample; genes stay
distributed, and a gene's counts are one array.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweave.functions import special
from sparkweave.functions.ranks import average_rank
from sparkweave.sources.scratch import checkpointed

from . import fdr

MOST_SAMPLES = 100_000  # samples whose numbers come to the driver


def library_sizes(counts: DataFrame) -> DataFrame:
    """sample, size: counts of each sample."""
    return counts.groupBy("sample").agg(F.sum("n").cast("double").alias("size"))


def counts_per_million(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """gene, sample, cpm; sizes: sample, size. Samples without counts have null values."""
    return counts.join(sizes, "sample").select("gene", "sample", (F.try_divide("n", "size") * 1e6).alias("cpm"))


def log_counts(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """gene, sample, value: log2 of counts a million, with half a count and one read added; sizes: sample, size (scaled, if wished)."""
    return counts.join(sizes, "sample").select("gene", "sample", F.log2((F.col("n") + 0.5) / (F.col("size") + 1) * 1e6).alias("value"))


def median_ratio_sizes(counts: DataFrame) -> DataFrame:
    """sample, size: median ratio of a sample's counts to the geometric means of the genes that all samples have."""
    w = W.partitionBy("gene")
    logs = counts.select("gene", "sample", F.when(F.col("n") > 0, F.log("n")).alias("l"), (F.min("n").over(w) > 0).alias("every"), F.avg(F.when(F.col("n") > 0, F.log("n"))).over(w).alias("m"))
    return logs.where("every").groupBy("sample").agg(F.exp(F.median(F.col("l") - F.col("m"))).alias("size"))


def trimmed_mean_factors(counts: DataFrame, ratio_trim: float = 0.3, level_trim: float = 0.05) -> DataFrame:
    """sample, size, factor: doubly trimmed weighted means of log ratios to the sample of the most typical upper quartile.

    Genes without any count are left out; ratios need counts on both sides. Factors multiply to one.
    """
    used = counts.join(counts.groupBy("gene").agg(F.max("n").alias("__most")).where("__most > 0").select("gene"), "gene", "left_semi")
    sizes = library_sizes(counts).where("size > 0")
    upper = used.join(sizes, "sample").groupBy("sample", "size").agg((F.percentile("n", F.lit(0.75)) / F.col("size")).alias("quartile"))
    upper = checkpointed(upper)  # a row for each sample
    mean = upper.agg(F.avg("quartile").alias("m"))
    reference = upper.crossJoin(F.broadcast(mean)).orderBy(F.round(F.abs(F.col("quartile") - F.col("m")), 12), "sample").limit(1).select(F.col("sample").alias("__ref"), F.col("size").alias("rs"))
    ref = used.join(F.broadcast(reference), F.col("sample") == F.col("__ref")).select("gene", F.col("n").alias("r"), "rs").where("r > 0")
    x = used.where("n > 0").join(sizes, "sample").join(ref, "gene")
    share, own = F.col("n") / F.col("size"), F.col("r") / F.col("rs")
    x = x.select("sample", F.log2(share / own).alias("ratio"), ((F.log2(share) + F.log2(own)) / 2).alias("level"), ((F.col("size") - F.col("n")) / F.col("size") / F.col("n") + (F.col("rs") - F.col("r")) / F.col("rs") / F.col("r")).alias("v"))
    w = W.partitionBy("sample")
    x = x.select("sample", "ratio", "v", F.count("*").over(w).alias("k"), average_rank("ratio", "sample").alias("rr"), average_rank("level", "sample").alias("rl"))

    def inside(rank: str, trim: float) -> Column:
        low = F.floor(F.col("k") * trim) + 1
        return F.col(rank).between(low, F.col("k") + 1 - low)

    kept = x.withColumn("on", inside("rr", ratio_trim) & inside("rl", level_trim))
    weighted = F.sum(F.when(F.col("on"), F.col("ratio") / F.col("v"))) / F.sum(F.when(F.col("on"), 1 / F.col("v")))
    log = kept.groupBy("sample").agg(F.when(F.max(F.abs("ratio")) < 1e-6, 0.0).otherwise(F.coalesce(weighted, F.lit(0.0))).alias("log"))
    log = checkpointed(sizes.join(log, "sample", "left").select("sample", "size", F.coalesce("log", F.lit(0.0)).alias("log")))
    middle = log.agg(F.avg("log").alias("m"))
    return log.crossJoin(F.broadcast(middle)).select("sample", "size", F.pow(F.lit(2.0), F.col("log") - F.col("m")).alias("factor"))


@dataclass(frozen=True)
class Design:
    """A model matrix: a row for each sample, a column for each name."""

    samples: tuple
    names: tuple[str, ...]
    matrix: np.ndarray

    def column(self, name: str) -> int:
        return self.names.index(name)

    def without(self, name: str) -> "Design":
        keep = [i for i, n in enumerate(self.names) if n != name]
        return Design(self.samples, tuple(self.names[i] for i in keep), self.matrix[:, keep])


def design(metadata: DataFrame, sample: str, treatment: str, reference: str, summed: tuple[str, ...] = (), numbers: tuple[str, ...] = (), most: int = MOST_SAMPLES) -> Design:
    """Intercept, a 0/1 column for each treatment level but the reference, sum contrasts of factors, and numbers.

    Levels are sorted; the last level of a summed factor is -1 in all its columns. A column that depends on those before
    it is dropped; if that is a treatment's column, the treatment cannot be told from the rest, which is an error, as are
    missing values, an absent reference, a repeated sample and more than `most` samples.
    """
    columns = [sample, treatment, *summed, *numbers]
    rows = metadata.select(*[F.col(f"`{c}`") for c in columns]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} samples")
    rows = sorted((tuple(r) for r in rows), key=lambda r: r[0])
    if len({r[0] for r in rows}) < len(rows) or any(v is None for r in rows for v in r):
        raise ValueError("samples must be given once, without missing values")
    levels = sorted({r[1] for r in rows})
    if reference not in levels:
        raise ValueError(f"no sample of the reference {reference!r}")
    named = [("(Intercept)", [1.0] * len(rows))]
    named += [(f"{treatment}{v}", [float(r[1] == v) for r in rows]) for v in levels if v != reference]
    for k, c in enumerate(summed, start=2):
        own = sorted({r[k] for r in rows})
        named += [(f"{c}{i + 1}", [float(r[k] == v) - float(r[k] == own[-1]) for r in rows]) for i, v in enumerate(own[:-1])]
    named += [(c, [float(r[k]) for r in rows]) for k, c in enumerate(numbers, start=2 + len(summed))]
    kept: list = []
    for name, values in named:
        matrix = np.array([v for _, v in kept] + [values]).T
        if np.linalg.matrix_rank(matrix) == matrix.shape[1]:
            kept.append((name, values))
        elif name.startswith(treatment) and name not in summed + numbers:
            raise ValueError(f"{name} depends on the other columns")
    return Design(tuple(r[0] for r in rows), tuple(n for n, _ in kept), np.array([v for _, v in kept]).T)


def arrays(long: DataFrame, samples: tuple, value: str = "n") -> DataFrame:
    """gene, y: values in the order of the samples; genes that lack one of them are left out."""
    spark = long.sparkSession
    kind = long.schema["sample"].dataType.simpleString()
    place = spark.createDataFrame(list(zip(samples, range(len(samples)), strict=True)), f"sample {kind}, __pos int")  # samples
    packed = long.join(F.broadcast(place), "sample").where(F.col(value).isNotNull()).groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("__pos", F.col(value).cast("double").alias("v")))).alias("a"))
    return packed.where(F.size("a") == len(samples)).select("gene", F.transform("a", lambda x: x["v"]).alias("y"))


def by_sample(table: DataFrame, column: str, samples: tuple) -> np.ndarray:
    """A column of a table of samples in the order of the design's samples."""
    found = {r[0]: r[1] for r in table.select("sample", column).collect()}  # a row for each sample
    if missing := [s for s in samples if found.get(s) is None]:
        raise ValueError(f"samples without a value of {column}: {missing[:5]}")
    return np.array([found[s] for s in samples], dtype=float)


def matrix_of(batch, column: str = "y") -> np.ndarray:
    """An Arrow column of equally long arrays as a matrix."""
    a = batch.column(column)
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def local_trend(df: DataFrame, x: str, y: str, span: float = 0.5, knots: int = 48, rounds: int = 3) -> list[tuple[float, float]]:
    """Knots of a robust locally linear trend of y over x: tricube weights over the nearest `span` of rows.

    Knots stand at quantiles of x; a knot's reach is read from the quantiles, so that it holds about `span` of all rows.
    Each round is one aggregation of five sums a knot; rows that lie off the trend weigh less in the next round. Nothing
    but the sums comes to the driver. Between knots the trend is linear.
    """
    rows = checkpointed(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    grid = 512
    cuts = rows.agg(F.percentile_approx("x", [k / grid for k in range(grid + 1)], 20_000)).first()[0]
    if not cuts:
        return []
    cuts = np.array(cuts)
    at = np.unique(cuts[np.linspace(0, grid, knots).astype(int)])
    count = max(1, int(np.ceil(span * grid)))
    reach = np.array([np.sort(np.abs(cuts - a))[min(count, grid)] for a in at])
    reach = np.maximum(reach, 1e-9 + 1e-6 * (cuts[-1] - cuts[0]))
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(h).alias("h")) for k, (a, h) in enumerate(zip(at.tolist(), reach.tolist(), strict=True))])
    weighed, fit = rows.withColumn("w", F.lit(1.0)), np.zeros(len(at))
    for step in range(rounds + 1):
        near = weighed.select("x", "y", "w", F.explode(places).alias("p")).where(F.abs(F.col("x") - F.col("p.a")) < F.col("p.h"))
        u = F.col("x") - F.col("p.a")
        d = F.abs(u) / F.col("p.h")
        near = near.select(F.col("p.k").alias("k"), u.alias("u"), "y", (F.col("w") * F.pow(1 - d * d * d, 3)).alias("w"))
        u, y_, w = F.col("u"), F.col("y"), F.col("w")
        sums = near.groupBy("k").agg(F.sum(w), F.sum(w * u), F.sum(w * u * u), F.sum(w * y_), F.sum(w * u * y_)).collect()  # a row for each knot
        for r in sums:
            s0, s1, s2, t0, t1 = map(float, r[1:])
            det = s0 * s2 - s1 * s1
            fit[r.k] = (s2 * t0 - s1 * t1) / det if det > 1e-12 * max(s0 * s2, 1e-300) else t0 / s0 if s0 > 0 else fit[r.k]
        if step == rounds:
            break
        off = rows.withColumn("off", F.abs(F.col("y") - between(F.col("x"), at.tolist(), fit.tolist())))
        scale = 6 * (off.agg(F.percentile_approx("off", 0.5, 20_000)).first()[0] or 0.0)
        if scale <= 0:
            break
        weighed = off.select("x", "y", F.when(F.col("off") < scale, F.pow(1 - F.pow(F.col("off") / scale, 2), 2)).otherwise(0.0).alias("w"))
    return list(zip(at.tolist(), fit.tolist(), strict=True))


def between(x: Column, at: list[float], fit: list[float]) -> Column:
    """Linear interpolation between knots, constant outside."""
    out = F.when(x <= at[0], fit[0])
    for a, b, f, g in zip(at, at[1:], fit, fit[1:]):
        out = out.when(x <= b, f + (x - a) * ((g - f) / (b - a)))
    return out.otherwise(fit[-1])


def _fits(x: np.ndarray, size: np.ndarray, knots: list | None):
    """gene, mean, coefficients, unscaled deviations, sigma of weighted least squares of log counts a million."""
    n, p = x.shape
    lib = np.log2((size + 1) / 1e6)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.log2(matrix_of(batch) + 0.5) - lib
            plain = y @ x @ np.linalg.inv(x.T @ x)
            w = np.ones_like(y)
            if knots:
                at, fit = zip(*knots, strict=True)
                w = np.maximum(np.interp(plain @ x.T + lib, at, fit), 1e-6) ** -4
            normal = np.einsum("gi,ij,ik->gjk", w, x, x)
            inverse = np.linalg.inv(normal)
            beta = np.einsum("gjk,gk->gj", inverse, np.einsum("gi,gi,ij->gj", w, y, x))
            rest = (w * (y - beta @ x.T) ** 2).sum(axis=1)
            sigma = np.sqrt(rest / (n - p)) if n > p else np.full(len(y), np.nan)
            dev = np.sqrt(np.einsum("gjj->gj", inverse))
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * p, pa.int32()), pa.array(a.ravel()))
            yield pa.record_batch([batch.column("gene"), pa.array(y.mean(axis=1)), lists(beta), lists(dev), pa.array(sigma)], ["gene", "mean", "beta", "dev", "sigma"])

    return run


def without_effects(values: DataFrame, model: Design, *factors: str) -> DataFrame:
    """gene, sample, value: values (gene, sample, value) less what least squares of the model give to the columns of the factors.

    Columns of a summed factor average to 0 over its levels, so the level of a feature stays, and so does what the model's
    other columns explain. A task holds the model's columns only; features lacking a sample are left out.
    """
    own = [k for k, name in enumerate(model.names) if any(name == f or (name.startswith(f) and name[len(f) :].isdigit()) for f in factors)]
    if not own:
        raise ValueError(f"the model has no column of {factors}")
    x = model.matrix
    fit, back = (x @ np.linalg.inv(x.T @ x))[:, own], x[:, own].T

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix_of(batch)
            left = y - (y @ fit) @ back
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(left) + 1) * left.shape[1], pa.int32()), pa.array(left.ravel()))
            yield pa.record_batch([batch.column("gene"), lists], ["gene", "y"])

    kinds = {f.name: f.dataType.simpleString() for f in values.schema}
    place = values.sparkSession.createDataFrame(list(enumerate(model.samples)), f"pos int, sample {kinds['sample']}")  # samples
    packed = arrays(values, model.samples, "value").mapInArrow(run, f"gene {kinds['gene']}, y array<double>")
    return packed.select("gene", F.posexplode("y").alias("pos", "value")).join(F.broadcast(place), "pos").select("gene", "sample", "value")


def variance_prior(fits: DataFrame, df: int) -> tuple[float, float]:
    """Degrees of freedom and variance of the prior that a scaled F distribution of the genes' variances gives."""
    z = 2 * F.log("sigma")
    shift = float(special.digamma(df / 2)) - np.log(df / 2)
    row = fits.where("sigma > 0").agg(F.avg(z).alias("m"), F.var_samp(z).alias("v")).first()
    if row.m is None:
        return np.inf, np.nan
    mean, spread = row.m - shift, (row.v or 0.0) - float(special.trigamma(df / 2))
    if spread <= 0:
        return np.inf, float(np.exp(mean))
    prior = 2 * special.trigamma_inverse(spread)
    return prior, float(np.exp(mean + float(special.digamma(prior / 2)) - np.log(prior / 2)))


def moderated_t(counts: DataFrame, model: Design, tested: str, alpha: float = 0.05) -> DataFrame:
    """gene, mean, log_fc, t, p, q, class: log counts with precision weights from the trend of variance over level.

    Library sizes are multiplied by trimmed-mean factors. Each gene's variance is drawn towards a prior that all genes
    give. Genes that lack one of the samples, or have no count at all, are left out; genes of one constant have null t.
    """
    sizes = trimmed_mean_factors(counts.where(F.col("sample").isin(*model.samples)))
    size = by_sample(sizes.withColumn("s", F.col("size") * F.col("factor")), "s", model.samples)
    genes = checkpointed(arrays(counts, model.samples).where(F.exists("y", lambda v: v > 0)))
    kind = f"gene {genes.schema['gene'].dataType.simpleString()}, mean double, beta array<double>, dev array<double>, sigma double"
    plain = genes.mapInArrow(_fits(model.matrix, size, None), kind)
    level = F.col("mean") + F.lit(float(np.mean(np.log2(size + 1))) - np.log2(1e6))
    knots = local_trend(plain.select(level.alias("x"), F.sqrt("sigma").alias("y")), "x", "y")
    fits = checkpointed(genes.mapInArrow(_fits(model.matrix, size, knots), kind))
    df = len(model.samples) - len(model.names)
    prior, variance = variance_prior(fits, df)
    k = model.column(tested)
    own = F.col("sigma") * F.col("sigma")
    post = F.lit(variance) if np.isinf(prior) else (F.lit(prior * variance) + df * own) / F.lit(prior + df)
    total = float(min(df + prior, df * fits.count())) if np.isfinite(prior) else np.inf
    tests = fits.select("gene", "mean", F.col("beta")[k].alias("log_fc"), F.when(post > 0, F.col("beta")[k] / (F.col("dev")[k] * F.sqrt(post))).alias("t"))
    tested_p = fdr.benjamini_hochberg(with_p(tests, "t", lambda t: special.t_tail_of(t, total)), "p", "q")
    return tested_p.withColumn("class", change_class(F.col("q"), F.col("log_fc"), alpha))


def with_p(df: DataFrame, column: str, tail) -> DataFrame:
    """df with p, what `tail` makes of arrays of a column; null where the column is null."""

    def run(batches):
        for batch in batches:
            x = batch.column(column).to_numpy(zero_copy_only=False).astype(float)
            p = tail(np.where(np.isnan(x), 0, x))
            yield pa.record_batch([*batch.columns, pa.array(p, mask=np.isnan(x))], [*batch.schema.names, "p"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", p double")


def change_class(q: Column, change: Column, alpha: float) -> Column:
    return F.when((q < alpha) & (change > 0), "up_deg").when(q < alpha, "down_deg").otherwise("NS")
