"""Expression variability, sample imbalance, group tests, sets and selections over long matrices."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.ranks import MAD_SCALE, average_rank, mad
from sparkweave.functions.special import chi_square_4, fisher_two_sided, hypergeometric_greater, normal_two_sided, odds_ratio
from sparkweave.sources.scratch import checkpointed

CELLS = 64  # ranges of values that ranks are taken in


def gene_statistics(long: DataFrame) -> DataFrame:
    """gene, n, mean, sd, median, mad, minimum, maximum, cv2."""
    middle = long.groupBy("gene").agg(F.median("value").alias("median"))
    off = long.join(middle, "gene")
    out = off.groupBy("gene").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.first("median").alias("median"),
        (MAD_SCALE * F.median(F.abs(F.col("value") - F.col("median")))).alias("mad"), F.min("value").alias("minimum"), F.max("value").alias("maximum"),
    )
    return out.withColumn("cv2", F.pow(F.try_divide("sd", "mean"), 2))


def mad_shift(long: DataFrame, splits: DataFrame, *by: str) -> DataFrame:
    """For each reference: mean and median MAD of the other genes on both sides, and the shift (high - low)."""
    keys = list(by) or ["ref_gene"]
    values = long.join(F.broadcast(splits), "sample")
    if "ref_gene" in keys:
        values = values.where("gene <> ref_gene")
    per = values.groupBy(*keys, "side", "gene").agg(mad(F.collect_list("value")).alias("mad"))
    sides = per.groupBy(*keys).pivot("side", ["low", "high"]).agg(F.avg("mad").alias("mean"), F.median("mad").alias("median"), F.count("mad").alias("n"))
    return sides.select(*keys, F.col("low_mean").alias("mean_mad_low"), F.col("high_mean").alias("mean_mad_high"), F.col("low_median").alias("median_mad_low"), F.col("high_median").alias("median_mad_high"), (F.col("high_mean") - F.col("low_mean")).alias("shift"), F.col("low_n").alias("n_genes"))


def _sorted_rows(x: np.ndarray) -> list:
    """Rows of x exchanged column by column until each column ascends (Batcher's odd-even merge sort)."""
    x, n, p = list(x), len(x), 1
    while p < n:
        k = p
        while k:
            for j in range(k % p, n - k, 2 * k):
                for i in range(j, min(j + k, n - k)):
                    if i // (2 * p) == (i + k) // (2 * p):
                        x[i], x[i + k] = np.minimum(x[i], x[i + k]), np.maximum(x[i], x[i + k])
            k //= 2
        p *= 2
    return x


def column_mads(x: np.ndarray) -> np.ndarray:
    """Scaled median absolute deviation of each column.

    Distances from the median ascend on either side of it, so their median is one of a few of them: the t-th of two
    ascending rows is the least of the larger ones of i of one and t - i of the other.
    """
    s, n = _sorted_rows(x), len(x)
    middle = (s[(n - 1) // 2] + s[n // 2]) / 2
    below, above = [middle - v for v in s[: n // 2][::-1]], [v - middle for v in s[n // 2 :]]

    def place(t):
        least = None
        for i in range(max(0, t - len(above)), min(t, len(below)) + 1):
            ends = ([below[i - 1]] if i else []) + ([above[t - i - 1]] if i < t else [])
            most = np.maximum(*ends) if len(ends) == 2 else ends[0]
            least = most if least is None else np.minimum(least, most)
        return least

    return MAD_SCALE * ((place((n - 1) // 2 + 1) + place(n // 2 + 1)) / 2)


def drawn_mads(long: DataFrame, draws: dict[int, list[int]]) -> DataFrame:
    """gene, b, mad over the samples of each draw (samples drawn once each); nulls count for nothing, and mad is null where no value is left.

    A feature's values are one row, so that there are features times draws rows and no table of their values.
    """
    packed = long.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct(F.col("sample").cast("long").alias("sample"), F.col("value").cast("double").alias("v")))).alias("a"))
    packed = packed.select("gene", F.transform("a", lambda x: x["sample"]).alias("samples"), F.transform("a", lambda x: F.coalesce(x["v"], F.lit(float("nan")))).alias("values"))
    schema = T.StructType([long.schema["gene"], T.StructField("b", T.LongType()), T.StructField("mad", T.DoubleType())])

    def run(batches):
        for batch in batches:
            samples, values = batch.column("samples"), batch.column("values")
            sizes = np.diff(samples.offsets.to_numpy())
            for size in np.unique(sizes):  # features of equally many samples
                at = np.flatnonzero(sizes == size)
                s, v = (c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) for c in (samples, values))
                for b, mine in draws.items():
                    x = np.where(np.isin(s, mine), v, np.nan)
                    mads = np.full(len(at), np.nan)
                    n = (~np.isnan(x)).sum(axis=1)
                    x = np.sort(x, axis=1)  # what is missing comes last
                    for k in np.unique(n[n > 0]):
                        mads[n == k] = column_mads(np.ascontiguousarray(x[n == k, :k].T))
                    yield pa.RecordBatch.from_arrays([batch.column("gene").take(pa.array(at)), pa.array(np.full(len(at), b), pa.int64()), pa.array(mads, pa.float64(), from_pandas=True)], names=["gene", "b", "mad"])

    return packed.mapInArrow(run, schema)


SIDES = ("low", "high")
GENES, SAMPLE, EDGES = 8192, 2048, 33  # most features in a block, features that ranges are guessed from, ends of ranges


def _mad_jobs(genes: DataFrame, refs: DataFrame, samples: list[int], blocks: int, work, schema: str, one: bool = False) -> DataFrame:
    """work(reference's row, side, MADs of the other genes) of every reference, side and block of genes; one: genes are one block."""
    place = {s: k for k, s in enumerate(samples)}
    number = F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    as_gene = genes.select("gene", "values", F.lit(0).alias("g") if one else number.alias("g"), every.alias("r"))
    as_ref = refs.withColumn("r", number).withColumn("g", F.lit(0) if one else every)
    fields = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}

    def run(key, rows, table):
        out = []
        if rows.num_rows and table.num_rows:
            ids = table.column("gene").to_numpy()
            x = np.ascontiguousarray(table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).T)
            strips = [np.ascontiguousarray(x[:, k : k + 4096]) for k in range(0, len(ids), 4096)]  # that fit the processor's cache
            for row in rows.to_pylist():
                own = np.flatnonzero(ids == row["gene"])
                for side in SIDES:
                    if row[side]:
                        at = [place[s] for s in row[side]]
                        mads = np.concatenate([column_mads(part[at]) for part in strips])
                        out.append((row["gene"], side, *work(row, side, np.delete(mads, own) if len(own) else mads)))
        return pa.table({n: pa.array([o[k] for o in out], kinds[t]) for k, (n, t) in enumerate(fields)})

    return as_ref.groupBy("r", "g").cogroup(as_gene.groupBy("r", "g")).applyInArrow(run, schema)


def mad_shifts(long: DataFrame, splits: DataFrame, block: int | None = None) -> DataFrame:
    """mad_shift for every reference at once. Genes without nulls; splits: ref_gene, side, sample.

    References and genes are dealt into blocks; a group holds one block of each. No table of references times genes is
    made: blocks are summed where they are computed. A median lies in one of EDGES + 1 ranges, whose ends come from a sample of
    genes; a first pass counts the values below each end, a second hands on those of the one range. Whatever the
    sample, the result is exact; it only sets how many values are handed on. Nothing is broadcast.
    """
    samples = sorted(r[0] for r in long.select(F.col("sample").cast("long")).distinct().collect())
    placed = long.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("a"))
    genes = checkpointed(placed.select(F.col("gene").cast("long").alias("gene"), F.transform("a", lambda x: x["value"].cast("double")).alias("values")))
    sides = checkpointed(splits.groupBy(F.col("ref_gene").cast("long").alias("gene")).agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("sample").cast("long")))).alias(s) for s in SIDES]))
    count = genes.count()
    blocks = max(1, -(-count // (block or min(GENES, max(256, -(-count // 8))))))

    def guess(row, side, v):
        if not len(v):
            return ([0.0] * EDGES,)
        v, off = np.sort(v), 2 / len(v) ** 0.5
        return (v[np.clip(np.linspace(0.5 - off, 0.5 + off, EDGES) * len(v), 0, len(v) - 1).astype(int)],)

    def below(row, side, v):
        edges = np.array(row[f"edges_{side}"])
        near = np.sort(v[(v >= edges[0]) & (v < edges[-1])])
        return len(v), float(v.sum()), np.searchsorted(near, edges) + int((v < edges[0]).sum())

    def inside(row, side, v):
        least, most = row[f"least_{side}"], row[f"most_{side}"]
        return (v[(v >= (-np.inf if least is None else least)) & (v < (np.inf if most is None else most))],)

    keys = ["gene", "side"]

    def beside(df, *columns):
        """sides with the columns of df (by gene and side) as <column>_<side>."""
        wide = df.groupBy("gene").agg(*[F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True).alias(f"{c}_{s}") for c in columns for s in SIDES])
        return checkpointed(sides.join(wide, "gene"))

    few = genes.where(F.pmod(F.xxhash64("gene", F.lit(11)), F.lit(max(1, count // SAMPLE))) == 0)
    ends = checkpointed(_mad_jobs(few, sides, samples, blocks, guess, "gene long, side string, edges array<double>", one=True))
    counted = _mad_jobs(genes, beside(ends, "edges"), samples, blocks, below, "gene long, side string, n long, total double, below array<long>")
    counted = counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.array(*[F.sum(F.col("below")[k]) for k in range(EDGES)]).alias("below")).where("n > 0")
    first, last = F.size(F.filter("below", lambda x: x <= F.floor((F.col("n") - 1) / 2))), F.size(F.filter("below", lambda x: x <= F.floor(F.col("n") / 2)))
    ranges = counted.join(ends, keys).select(*keys, "n", "total", F.when(first > 0, F.get("below", first - 1)).otherwise(0).alias("before"), F.get("edges", first - 1).alias("least"), F.get("edges", last).alias("most"))
    ranges = checkpointed(ranges)
    values = _mad_jobs(genes, beside(ranges, "least", "most"), samples, blocks, inside, "gene long, side string, v array<double>")
    values = values.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("v"))).alias("v"))
    at = lambda n: F.get("v", (F.floor(n / 2) - F.col("before")).cast("int"))
    per = ranges.join(values, keys).select(F.col("gene").alias("ref_gene"), "side", "n", (F.col("total") / F.col("n")).alias("mean"), ((at(F.col("n") - 1) + at(F.col("n"))) / 2).alias("median"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = per.groupBy("ref_gene").agg(of("low", "mean").alias("mean_mad_low"), of("high", "mean").alias("mean_mad_high"), of("low", "median").alias("median_mad_low"), of("high", "median").alias("median_mad_high"), of("low", "n").alias("n_genes"))
    return wide.select("ref_gene", "mean_mad_low", "mean_mad_high", "median_mad_low", "median_mad_high", (F.col("mean_mad_high") - F.col("mean_mad_low")).alias("shift"), "n_genes")


def sample_deviation(long: DataFrame) -> DataFrame:
    """sample and the median, mean and sum over genes of its distance from the gene's mean."""
    means = long.groupBy("gene").agg(F.avg("value").alias("m"))
    d = long.join(means, "gene").select("sample", F.abs(F.col("value") - F.col("m")).alias("d"))
    return d.groupBy("sample").agg(F.median("d").alias("itv_median"), F.avg("d").alias("itv_mean"), F.sum("d").alias("itv_sum"))


def imbalance(quintiles: DataFrame) -> DataFrame:
    """sample, counts of each quintile over genes, chi-square against equal shares and its p, Cramer V, entropy, largest deviation, dominant quintile."""
    n = F.count("*")
    wide = quintiles.groupBy("sample").agg(n.alias("n"), *[F.sum((F.col("q") == k).cast("long")).alias(f"q{k}") for k in range(1, 6)])
    f = [F.col(f"q{k}") / F.col("n") for k in range(1, 6)]
    chi = sum(((F.col(f"q{k}") - F.col("n") / 5) * (F.col(f"q{k}") - F.col("n") / 5) / (F.col("n") / 5) for k in range(1, 6)), F.lit(0.0))
    entropy = -sum((F.greatest(x, F.lit(1e-15)) * F.ln(F.greatest(x, F.lit(1e-15))) for x in f), F.lit(0.0)) / math.log(5)
    top = F.array(*[F.col(f"q{k}") for k in range(1, 6)])
    out = wide.withColumns({"chi2": chi, "entropy": entropy, "max_deviation": F.greatest(*[F.abs(x - 0.2) for x in f]), "dominant": F.array_position(top, F.array_max(top)).cast("int")})
    return out.withColumns({"p": chi_square_4(F.col("chi2")), "cramer_v": F.sqrt(F.col("chi2") / (F.col("n") * 4))})


def noise(long: DataFrame) -> DataFrame:
    """sample, mean, sd, MAD, IQR and CV of 2^value on the log2(x + 1) scale."""
    raw = long.select("sample", F.pow(F.lit(2.0), F.col("value")).alias("x"))
    middle = raw.groupBy("sample").agg(F.median("x").alias("med"))
    agg = raw.join(middle, "sample").groupBy("sample").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), (MAD_SCALE * F.median(F.abs(F.col("x") - F.col("med")))).alias("mad"), (F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"))
    out = agg.select("sample", *[F.log2(F.col(c) + 1).alias(f"log2_{c}") for c in ("mean", "sd", "mad", "iqr")])
    return out.withColumn("cv", F.col("log2_sd") - F.col("log2_mean"))


def quintile_bias(quintiles: DataFrame) -> DataFrame:
    """gene, share of extreme-quintile samples weighted by how often the sample is extreme, less 0.2 for either end."""
    own = quintiles.groupBy("sample").agg(F.avg((F.col("q") == 1).cast("double")).alias("f1"), F.avg((F.col("q") == 5).cast("double")).alias("f5"))
    j = quintiles.join(own, "sample")
    out = j.groupBy("gene").agg((F.sum(F.when(F.col("q") == 1, F.col("f1")).otherwise(0.0)) / F.sum((F.col("q") == 1).cast("long")) - 0.2).alias("bias_q1"), (F.sum(F.when(F.col("q") == 5, F.col("f5")).otherwise(0.0)) / F.sum((F.col("q") == 5).cast("long")) - 0.2).alias("bias_q5"))
    return out.withColumn("bias", F.greatest("bias_q1", "bias_q5"))


def deviants(table: DataFrame, percent: float = 10) -> DataFrame:
    """The ceil(n * percent / 100) samples with the largest Cramer V."""
    n = table.count()
    keep = math.ceil(n * percent / 100)
    return table.orderBy(F.desc(F.round("cramer_v", 9)), "sample").limit(keep)


def drivers(quintiles: DataFrame, deviant: DataFrame, q: int) -> DataFrame:
    """gene, its 2x2 counts of quintile q in deviant and other samples, and the odds ratio with half counts added."""
    mark = deviant.select("sample", F.lit(True).alias("dev"))
    j = quintiles.join(F.broadcast(mark), "sample", "left").select("gene", F.coalesce("dev", F.lit(False)).alias("dev"), (F.col("q") == q).alias("hit"))
    c = lambda x: F.sum(x.cast("long"))
    out = j.groupBy("gene").agg(c(F.col("dev") & F.col("hit")).alias("a"), c(F.col("dev") & ~F.col("hit")).alias("b"), c(~F.col("dev") & F.col("hit")).alias("c"), c(~F.col("dev") & ~F.col("hit")).alias("d"))
    return out.withColumn("odds", (F.col("a") + 0.5) * (F.col("d") + 0.5) / ((F.col("b") + 0.5) * (F.col("c") + 0.5)))


def _placed(counts: DataFrame, value: str, columns: list[str], by: tuple[str, ...]) -> DataFrame:
    """counts (by, value and numbers of rows) with, for each of the columns, its sum over the key's smaller values
    (before_<c>) and over all of them (all_<c>).

    Ranges of values, cut at approximate quantiles, are placed first, so that no window holds a whole key.
    """
    counts = checkpointed(counts)
    cuts = counts.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [k / CELLS for k in range(1, CELLS)], 1 / (4 * CELLS))
    counts = counts.withColumn("__cell", sum((F.when(F.col(value) >= c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)))
    per = counts.groupBy(*by, "__cell").agg(*[F.sum(c).alias(c) for c in columns])
    key = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ahead = key.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__cell").alias("__at"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__{c}_ahead") for c in columns], *[F.sum(c).over(key).alias(f"all_{c}") for c in columns])
    same = F.col("__cell") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    own = W.partitionBy(*by, "__cell").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.join(per, same)
    return placed.select(*counts.columns[:-1], *[f"all_{c}" for c in columns], *[(F.col(f"__{c}_ahead") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"before_{c}") for c in columns])


def _middle(value: Column, n: str) -> Column:
    """Aggregate over placed counts: the median of the rows that a column counts."""
    at = lambda k: F.max(F.when((F.col(f"before_{n}") <= k) & (k < F.col(f"before_{n}") + F.col(n)), value))
    return (at(F.floor((F.col(f"all_{n}") - 1) / 2)) + at(F.floor(F.col(f"all_{n}") / 2))) / 2


def rank_sum(df: DataFrame, group: str, one: str, value: str, *by: str, corrected: bool = True) -> DataFrame:
    """Mann-Whitney test of group one against the rest for each key: n, mean, median of both, U, z, p.

    corrected: ties and continuity are corrected for; else the plain normal approximation. Rows are counted by value
    first; a rank is a value's, not a row's.
    """
    mine = F.col(group) == one
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("t"), F.count_if(mine).alias("n1"), F.count_if(~mine).alias("n2"))
    t, v = F.col("t").cast("double"), F.col("__v").cast("double")
    agg = _placed(counts, "__v", ["t", "n1", "n2"], by).groupBy(*by).agg(
        F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.try_divide(F.sum(v * F.col("n1")), F.sum("n1")).alias("mean1"), F.try_divide(F.sum(v * F.col("n2")), F.sum("n2")).alias("mean2"),
        _middle(v, "n1").alias("median1"), _middle(v, "n2").alias("median2"),
        F.sum(F.col("n1") * (F.col("before_t") + (t + 1) / 2)).alias("r1"), F.sum(t * (t * t - 1)).alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    d = u - n1 * n2 / 2
    if corrected:
        var = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
        z = F.try_divide(d - 0.5 * F.signum(d), F.sqrt(var))
    else:
        z = F.try_divide(d, F.sqrt(n1 * n2 * (n + 1) / 12))
    good = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    return agg.withColumns({"u": u, "z": F.when(good, z)}).withColumn("p", F.when(good, normal_two_sided(F.col("z")))).drop("r1", "ties")


def signed_rank(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Paired Wilcoxon signed-rank with ties and continuity corrected; pairs with a null, and equal pairs, are left out together."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__d", F.col(x) - F.col(y)).where("__d <> 0")
    counts = d.groupBy(*by, F.abs("__d").alias("__a")).agg(F.count("*").alias("t"), F.count_if(F.col("__d") > 0).alias("up"))
    t = F.col("t").cast("double")
    agg = _placed(counts, "__a", ["t"], by).groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("up") * (F.col("before_t") + (t + 1) / 2)).alias("v"), F.sum(t * (t * t - 1)).alias("ties"))
    n = F.col("n").cast("double")
    off = F.col("v") - n * (n + 1) / 4
    z = (off - 0.5 * F.signum(off)) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return agg.withColumn("z", z).withColumn("p", normal_two_sided(z)).drop("ties")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def deg_class(q: Column, lfc: Column, alpha: float = 0.05) -> Column:
    return F.when((q < alpha) & (lfc > 0), "up_deg").when((q < alpha) & (lfc <= 0), "down_deg").otherwise("NS")


def venn(members: DataFrame, sets: list[str]) -> DataFrame:
    """pattern (names joined by &) and number of genes in exactly these sets, for all non-empty patterns. members: name, gene."""
    per = members.distinct().groupBy("gene").agg(F.array_join(F.array_sort(F.collect_set("name")), "&").alias("pattern"))
    names = sorted(sets)
    patterns = ["&".join(n for k, n in enumerate(names) if mask >> k & 1) for mask in range(1, 1 << len(names))]
    grid = members.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    return grid.join(per.groupBy("pattern").agg(F.count("*").alias("n")), "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


def overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """All pairs of modules of two assignments (gene, module): sizes, common genes, Jaccard, overlap coefficient, level."""
    a, b = one.groupBy("module").agg(F.count("*").alias("n1")), two.groupBy("module").agg(F.count("*").alias("n2"))
    common = one.withColumnRenamed("module", "m1").join(two.withColumnRenamed("module", "m2"), "gene").groupBy("m1", "m2").agg(F.count("*").alias("k"))
    grid = a.withColumnRenamed("module", "m1").crossJoin(F.broadcast(b.withColumnRenamed("module", "m2")))
    out = grid.join(common, ["m1", "m2"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    c = F.col("k") / F.least("n1", "n2")
    level = F.when(c >= 0.7, "high").when(c >= 0.4, "moderate").when(c >= 0.2, "low").otherwise("none")
    return out.withColumns({"jaccard": F.col("k") / (F.col("n1") + F.col("n2") - F.col("k")), "coefficient": c, "level": level})


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def fisher_odds(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([odds_ratio(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def over_representation_p(hits: pd.Series, drawn: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_greater(*map(int, x)) for x in zip(hits, drawn, marked, total, strict=True)], dtype=float)


def enrichment(genes: DataFrame, terms: DataFrame, least: int = 10, most: int = 500) -> DataFrame:
    """term, size, hits, p, q of a gene list against gene sets (term, gene) of bounded size; the background are all genes with a term."""
    from .fdr import benjamini_hochberg

    total = terms.select("gene").distinct().count()
    mine = genes.select("gene").distinct().join(terms.select("gene").distinct(), "gene", "left_semi")
    drawn = mine.count()
    hit = terms.join(mine.withColumn("hit", F.lit(1)), "gene", "left").groupBy("term").agg(F.count_distinct("gene").alias("size"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    tested = hit.where(F.col("size").between(least, most)).withColumn("p", over_representation_p("hits", F.lit(drawn), "size", F.lit(total)))
    return benjamini_hochberg(tested, "p", "q")


def running_score(ranked: DataFrame, terms: DataFrame) -> DataFrame:
    """term, score: the largest deviation of the weighted running sum along the ranking (gene, score)."""
    from . import enrich

    order = checkpointed(enrich.positions(ranked))
    found = enrich.running_scores(terms.select("term", "gene").distinct().join(order, "gene").select("term", "pos", "score"), order.count(), "term")
    return found.select("term", F.col("es").alias("score"))


def linear_models(long: DataFrame, design: dict[int, list[float]], tested: int) -> DataFrame:
    """gene, coefficient, se, t, df of one column of a design (sample -> row) fitted to each gene by least squares."""
    samples = sorted(design)
    x = np.array([design[s] for s in samples])
    inverse = np.linalg.pinv(x.T @ x)
    place = {s: k for k, s in enumerate(samples)}

    def run(batches):
        for pdf in batches:
            y = np.array([[v for _, v in sorted((place[e["sample"]], e["value"]) for e in row)] for row in pdf["a"]])
            if not len(y):
                continue
            beta = y @ x @ inverse
            rest = ((y - beta @ x.T) ** 2).sum(axis=1)
            df = len(samples) - np.linalg.matrix_rank(x)
            se = np.sqrt(rest / df * inverse[tested, tested])
            yield pd.DataFrame({"gene": pdf["gene"], "coefficient": beta[:, tested], "se": se, "t": beta[:, tested] / se, "df": df})

    packed = long.where(F.col("sample").isin(samples)).groupBy("gene").agg(F.collect_list(F.struct("sample", "value")).alias("a")).where(F.size("a") == len(samples))
    return packed.mapInPandas(run, "gene long, coefficient double, se double, t double, df long")


def principal_components(wide: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, list[float]]:
    """Scores of centred and scaled complete cases on k components (largest loading positive), and their shares of variance."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=columns, outputCol="__v").transform(wide.dropna(subset=columns))
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="__v", outputCol="__s").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="__s", outputCol="__p").fit(scaled)
    sign = [1.0 if c[np.abs(c).argmax()] > 0 else -1.0 for c in model.pc.toArray().T]
    scores = model.transform(scaled).withColumn("__a", vector_to_array("__p"))
    return scores.select(*wide.columns, *[(F.col("__a")[i] * sign[i]).alias(f"PC{i + 1}") for i in range(k)]), list(model.explainedVariance)


def broken_stick(n: int) -> list[float]:
    return [sum(1 / j for j in range(i, n + 1)) / n for i in range(1, n + 1)]


def feature_tests(features: DataFrame, covariates: DataFrame, key: str, n: int) -> DataFrame:
    """feature, covariate, n, r, p: Spearman test of each feature against each covariate over the rows that have both.

    n: number of rows, which sets the degrees of freedom of p; pairs with fewer complete rows have a null p.
    """
    from sparkweave.functions.special import t_two_sided

    from .diffnet import test_angle

    tall = lambda df, name, value: df.unpivot(key, [F.col(c).cast("double").alias(c) for c in df.columns if c != key], name, value)
    both = tall(features, "feature", "x").join(tall(covariates, "covariate", "y"), key).where("x is not null and y is not null")
    keys = ["feature", "covariate"]
    ranked = both.withColumns({"rx": average_rank("x", *keys), "ry": average_rank("y", *keys)})
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("r")).withColumn("__a", test_angle(F.col("r"), n))
    return out.withColumn("p", F.when(F.col("n") == n, t_two_sided(F.col("__a"), n - 2))).drop("__a")


def global_rank(df: DataFrame, column: str, out: str, share: str | None = None) -> DataFrame:
    """df with the average rank of a column, largest first, and with `share` the part of values up to each; nulls have none.

    Distinct values are counted first; counts of CELLS ranges of values, cut at approximate quantiles, place the
    ranges, so no window holds more than one range.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    cuts = counts.approxQuantile(column, [k / 64 for k in range(1, 64)], 0.005) or [0.0]
    cell = sum((F.when(F.col(column) < c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    counts = counts.withColumn("__cell", cell)
    before = counts.groupBy("__cell").agg(F.sum("__n").alias("__m"))  # at most 64 rows
    w = W.partitionBy(F.lit(0)).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    before = before.select("__cell", F.coalesce(F.sum("__m").over(w), F.lit(0)).alias("__before"), F.sum("__m").over(W.partitionBy(F.lit(0))).alias("__all"))
    own = W.partitionBy("__cell").orderBy(F.desc(column)).rowsBetween(W.unboundedPreceding, 0)
    placed = counts.join(F.broadcast(before), "__cell").withColumn("__upto", F.sum("__n").over(own))
    upto = F.col("__before") + F.col("__upto")
    parts = [((F.col("__all") - upto + F.col("__n")) / F.col("__all")).alias(share)] if share else []
    ranks = placed.select(column, (upto - (F.col("__n") - 1) / 2).alias(out), *parts)
    return df.join(ranks, column, "left").select(*df.columns, out, *[share] * bool(share))


def class_summary(classes: DataFrame, *by: str) -> DataFrame:
    """Counts of each class of mean_and_spread_class and shares; genes of Both count as of either spread class."""
    n = lambda c: F.sum((F.col("class") == c).cast("long"))
    raw = classes.groupBy(*by).agg(F.count("*").alias("total"), *[n(c).alias(a) for c, a in (("up_deg", "up_deg"), ("down_deg", "down_deg"), ("up_dvg", "__u"), ("down_dvg", "__d"), ("Both", "n_both"))])
    deg = F.col("up_deg") + F.col("down_deg") + F.col("n_both")
    return raw.select(*by, "total", "up_deg", "down_deg", (F.col("__u") + F.col("n_both")).alias("up_dvg"), (F.col("__d") + F.col("n_both")).alias("down_dvg"), "n_both", (F.col("total") - deg - F.col("__u") - F.col("__d")).alias("ns"), (100 * deg / F.col("total")).alias("percent_deg"))


def venn_members(members: DataFrame) -> DataFrame:
    """gene, pattern: names of all sets that hold it, joined by &. members: name, gene."""
    return members.groupBy("gene").agg(F.array_join(F.array_sort(F.collect_set("name")), "&").alias("pattern"))


def context_variance(values: DataFrame, key: str, value: str) -> DataFrame:
    return values.groupBy(key).agg(F.var_pop(value).alias("variance"), F.min(value).alias("least"), F.max(value).alias("most"))


def mapping_rate(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """One row: distinct names, those that a pattern finds, and their share to four places."""
    named = F.count_distinct(F.when(F.col(name).rlike(pattern), F.col(name)))
    return df.agg(F.count_distinct(name).alias("total"), named.alias("named")).withColumn("rate", F.round(F.col("named") / F.col("total"), 4))


def metric_correlations(wide: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for every pair of columns, from one pass."""
    row = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a in columns for b in columns])
    tall = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a in columns for b in columns])).alias("x"))
    return tall.select("x.*")
