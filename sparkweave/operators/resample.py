"""Permutation tests of focus features: row metrics of differential networks, and shifts of variability.

The permutation is a key of the block product: a group holds a block of features and a block of (focus, permutation)
splits with the focuses' own values, so memory is set by the two block sizes. Permutation 0 is the observed split.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweave.functions.ranks import MAD_SCALE, drawn
from sparkweave.sources.scratch import checkpointed

from . import diffnet, express, fdr, significant
from .diffnet import Params
from .keyed import rank_rows, wide

BLOCK, ROW, SPLITS = 512, 8192, 256
METRICS = ("n_diff_edges", "focus_deg_low", "focus_deg_high", "mean_abs_delta", "max_abs_delta", "l1_n_nodes", "l1_rewire", "l1_frac_rewire")


def splits(long: DataFrame, focuses: DataFrame, count: int, fraction: float = 0.2, seed: int = 9999) -> DataFrame:
    """focus, perm, low, high (arrays of samples): the extremes of each focus as perm 0, and `count` deals at random.

    A deal draws both sides without replacement from all samples, by a hash of focus, permutation and sample.
    """
    own = diffnet.extremes(long.join(focuses.select(F.col("focus").alias("gene")), "gene", "left_semi"), fraction)
    own = own.select(F.col("ref_gene").alias("focus"), F.lit(0).cast("long").alias("perm"), "side", F.col("sample").cast("long").alias("sample"))
    samples = long.select(F.col("sample").cast("long").alias("sample")).distinct()
    keys = focuses.select("focus").withColumn("perm", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(count).cast("long")))) if count else None
    if keys is not None:
        w = W.partitionBy("focus", "perm")
        dealt = keys.crossJoin(F.broadcast(samples)).select("focus", "perm", "sample", F.row_number().over(w.orderBy(drawn(seed, F.col("focus"), F.col("perm"), F.col("sample")), "sample")).alias("rn"), F.floor(F.count("*").over(w) * fraction).alias("k"))
        side = F.when(F.col("rn") <= F.col("k"), "low").when(F.col("rn") <= 2 * F.col("k"), "high")
        own = own.unionByName(dealt.select("focus", "perm", side.alias("side"), "sample").where("side is not null"))
    return own.groupBy("focus", "perm").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("sample")))).alias(s) for s in ("low", "high")])


def _dealt(long: DataFrame, every: DataFrame, work, schema: str, block: int, per: int) -> DataFrame:
    """work(ids, values, place, split rows) of each block of features and block of splits."""
    genes = checkpointed(wide(long))
    every = checkpointed(every.join(genes.select(F.col("gene").alias("focus"), F.col("values").alias("own")), "focus"))
    blocks, groups = max(1, -(-genes.count() // block)), max(1, -(-every.count() // per))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = genes.withColumn("b", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int")).withColumn("g", spread(groups))
    s = every.withColumn("g", F.pmod(F.xxhash64("focus", "perm"), F.lit(groups)).cast("int")).withColumn("b", spread(blocks))
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64() if c.split()[1] == "long" else pa.float64() for c in schema.split(", ")]

    def run(key, table, rows):
        parts = []
        if table.num_rows and rows.num_rows:
            ids = table.column("gene").to_numpy()
            x = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            place = {v: k for k, v in enumerate(table.column("samples")[0].as_py())}
            for r in rows.select(["focus", "perm", "low", "high", "own"]).to_pylist():
                low, high = ([place[v] for v in r[c]] for c in ("low", "high"))
                parts += work(r["focus"], r["perm"], ids, x, np.array(r["own"], dtype=float), low, high)
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(names))]
        return pa.table({n: pa.array(c, t, from_pandas=True) for n, c, t in zip(names, columns, kinds, strict=True)})

    return a.groupBy("b", "g").cogroup(s.groupBy("b", "g")).applyInArrow(run, schema)


def row_correlations(long: DataFrame, every: DataFrame, block: int = BLOCK, per: int = SPLITS) -> DataFrame:
    """focus, perm, gene, r_low, r_high, p_low, p_high, p_diff of each focus with all other features."""

    def work(focus, perm, ids, x, own, low, high):
        rest = ids != focus
        r = []
        for side in (low, high):
            z, f = rank_rows(x[:, side]), rank_rows(own[None, side])[0]
            r.append(np.clip(z @ f / (len(side) - 1), -1, 1))
        good = rest & ~np.isnan(r[0]) & ~np.isnan(r[1])
        n = int(good.sum())
        return [(np.full(n, focus), np.full(n, perm), ids[good], *diffnet.tests_of(r[0][good], r[1][good], len(low)))] if n else []

    return _dealt(long, every, work, "focus long, perm long, gene long, r_low double, r_high double, p_low double, p_high double, p_diff double", block, per)


def row_metrics(rows: DataFrame, every: DataFrame, params: Params = Params()) -> DataFrame:
    """focus, perm and METRICS of each split; false discovery is controlled within the focus's row. Zeros without edges."""
    rows = checkpointed(rows)
    for side in ("low", "high", "diff"):
        rows = fdr.benjamini_hochberg(rows, f"p_{side}", f"q_{side}", "focus", "perm")
    low, high, diff = (F.col(f"q_{s}") < params.alpha for s in ("low", "high", "diff"))
    edge = (low | high) & diff
    kind = diffnet.classify(F.col("r_low"), F.col("r_high"), low, high, params.threshold)
    marked = rows.select("focus", "perm", edge.alias("edge"), (low & (F.abs("r_low") >= params.threshold)).alias("low"), (high & (F.abs("r_high") >= params.threshold)).alias("high"), F.abs(F.col("r_high") - F.col("r_low")).alias("d"), kind.isin("disappear", "new", "sign_change").alias("re"))
    n = lambda c: F.sum(c.cast("long"))
    got = marked.groupBy("focus", "perm").agg(n(F.col("edge")).alias("n_diff_edges"), n(F.col("low")).alias("focus_deg_low"), n(F.col("high")).alias("focus_deg_high"), F.avg(F.when(F.col("edge"), F.col("d"))).alias("mean_abs_delta"), F.max(F.when(F.col("edge"), F.col("d"))).alias("max_abs_delta"), n(F.col("edge") & F.col("re")).alias("l1_rewire"))
    got = every.select("focus", "perm").join(got, ["focus", "perm"], "left").fillna(0).fillna(0.0)
    share = F.when(F.col("n_diff_edges") > 0, F.col("l1_rewire") / F.col("n_diff_edges")).otherwise(0.0)
    return got.withColumn("l1_n_nodes", F.col("n_diff_edges")).withColumn("l1_frac_rewire", share).select("focus", "perm", *METRICS)


def _row_jobs(genes: DataFrame, samples: list[int], sides: DataFrame, work, schema: str, block: int | None = None, per: int = SPLITS) -> DataFrame:
    """work(split's row, correlations, p values, none) of every block of features and every split, as rows of a schema.

    The pairs are those of the split's focus with the features of the block. genes: as significant._prepared has them; sides:
    ref_gene (the split's number), focus, low, high, own (the focus's values) and what work reads.
    """
    count = genes.count()
    blocks, groups = max(1, -(-count // (block or min(ROW, max(BLOCK, -(-count // 8)))))), max(1, -(-sides.count() // per))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = genes.withColumn("b", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int")).withColumn("g", spread(groups))
    s = sides.withColumn("g", F.pmod(F.xxhash64("ref_gene"), F.lit(groups)).cast("int")).withColumn("b", spread(blocks))
    place = {v: k for k, v in enumerate(samples)}
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]

    def run(key, table, rows):
        parts = []
        if table.num_rows and rows.num_rows:
            ids = table.column("gene").to_numpy()
            x = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for row in rows.to_pylist():
                both = np.vstack([x, np.array(row["own"], dtype=x.dtype)])
                sides = [significant._centred(both[:, [place[v] for v in row[c]]]) for c in ("low", "high")]
                _, r, p = significant._tested(sides, np.array([len(ids)]), np.arange(len(ids)), (ids != row["focus"])[None, :], len(row["low"]))
                parts.append(work(row, r, p, None))
        return pa.table({n: pa.array(np.concatenate([p[k] for p in parts]) if parts else [], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return a.groupBy("b", "g").cogroup(s.groupBy("b", "g")).applyInArrow(run, schema)


def split_metrics(long: DataFrame, every: DataFrame, params: Params = Params(), **deal) -> DataFrame:
    """As row_metrics of row_correlations, summed inside the blocks: no table of splits times features is made.

    The largest significant p of each split comes from counts of p values (significant._with_cuts).
    """
    samples = sorted(r[0] for r in long.select(F.col("sample").cast("long")).distinct().collect())
    genes = checkpointed(significant._codes(long))
    numbered = every.select("focus", "perm", "low", "high", F.monotonically_increasing_id().alias("ref_gene"))
    sides = checkpointed(numbered.join(genes.select(F.col("gene").alias("focus"), F.col("values").alias("own")), "focus"))
    sides = significant._with_cuts(genes, samples, sides, params.alpha, _row_jobs, **deal)

    def add(row, r, p, _):
        low, high = p[0] <= row["cut_low"], p[1] <= row["cut_high"]
        edge = (low | high) & (p[2] <= row["cut_diff"])
        low, high = (s & (np.abs(x) >= params.threshold) for s, x in zip((low, high), r, strict=True))
        rewired = edge & ((low != high) | (low & high & (np.sign(r[0]) != np.sign(r[1]))))
        d = np.abs(r[1] - r[0])[edge]
        return [[v] for v in (row["focus"], row["perm"], int(edge.sum()), int(low.sum()), int(high.sum()), float(d.sum()), float(d.max(initial=0)), int(rewired.sum()))]

    got = _row_jobs(genes, samples, sides, add, "focus long, perm long, n_diff_edges long, focus_deg_low long, focus_deg_high long, total double, max_abs_delta double, l1_rewire long", **deal)
    got = got.groupBy("focus", "perm").agg(F.max("max_abs_delta").alias("max_abs_delta"), *[F.sum(c).alias(c) for c in got.columns if c not in ("focus", "perm", "max_abs_delta")])
    got = every.select("focus", "perm").join(got, ["focus", "perm"], "left").fillna(0).fillna(0.0)
    share = lambda c: F.when(F.col("n_diff_edges") > 0, F.col(c) / F.col("n_diff_edges")).otherwise(0.0)
    return got.withColumns({"mean_abs_delta": share("total"), "l1_n_nodes": F.col("n_diff_edges"), "l1_frac_rewire": share("l1_rewire")}).select("focus", "perm", *METRICS)


def network_permutations(long: DataFrame, focuses: DataFrame, count: int = 100, params: Params = Params(), seed: int = 9999, mode: str = "matched", observed: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """focus, metric, observed, null_mean, null_std, all_zero, p, n_metrics_sig, any_sig.

    mode "matched" takes the observed values from the focus's row as the null takes its own; "reference" takes those of
    `observed` (focus and METRICS, from whole networks). p is two-sided and floored at 1 / count; a focus without any
    observed edge is not tested: its null statistics and p are null.
    """
    if mode not in ("matched", "reference") or (mode == "reference") != (observed is not None):
        raise ValueError("mode is matched, or reference with observed values")
    every = checkpointed(splits(long, focuses, count, params.fraction, seed))
    metrics = checkpointed(split_metrics(long, every, params))
    tall = lambda df, *keys: df.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in METRICS], "metric", "value")
    seen = metrics.where("perm = 0").drop("perm") if observed is None else observed.select("focus", *METRICS)
    tested = seen.select("focus", (F.col("n_diff_edges") > 0).alias("tested"))
    seen = tall(seen, "focus").withColumnRenamed("value", "observed").join(tested, "focus")
    null = tall(metrics.where("perm > 0"), "focus", "perm").drop("perm")
    joined = seen.join(null, ["focus", "metric"], "left").withColumn("value", F.when(F.col("tested"), F.col("value")))
    n, hits = F.count("value"), F.sum((F.abs("value") >= F.abs("observed")).cast("long"))
    got = joined.groupBy("focus", "metric", "observed").agg(F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_std"), F.max(F.abs("value")).eqNullSafe(0.0).alias("all_zero"), F.when(n > 0, F.greatest(hits / n, 1 / n)).alias("p"))
    got = checkpointed(got)
    sig = got.groupBy("focus").agg(F.sum(F.coalesce(F.col("p") < alpha, F.lit(False)).cast("long")).alias("n_metrics_sig"))
    return got.join(sig, "focus").withColumn("any_sig", F.col("n_metrics_sig") > 0)


def _mads(x: np.ndarray) -> np.ndarray:
    middle = np.median(x, axis=1, keepdims=True)
    return MAD_SCALE * np.median(np.abs(x - middle), axis=1)


def variability_permutations(long: DataFrame, focuses: DataFrame, count: int = 100, fraction: float = 0.2, seed: int = 9999, alpha: float = 0.05) -> DataFrame:
    """focus, mean_mad_low, mean_mad_high, shift, null_mean, wilcoxon_p, perm_p, both adjusted, validated.

    shift: mean MAD of all other features over the focus's high samples less that over its low ones. perm_p: share of
    deals whose shift is as large, without a floor. validated: both adjusted p values are below alpha. Features with
    missing values are left out.
    """
    every = checkpointed(splits(long, focuses, count, fraction, seed))

    def sums(focus, perm, ids, x, own, low, high):
        keep = (ids != focus) & ~np.isnan(x).any(axis=1)
        a, b = _mads(x[keep][:, low]), _mads(x[keep][:, high])
        one = lambda v: np.array([v])
        return [(one(focus), one(perm), one(float(a.sum())), one(float(b.sum())), one(len(a)))]

    parts = _dealt(long, every, sums, "focus long, perm long, low double, high double, n long", BLOCK, SPLITS)
    means = checkpointed(parts.groupBy("focus", "perm").agg((F.try_divide(F.sum("low"), F.sum("n"))).alias("mean_mad_low"), (F.try_divide(F.sum("high"), F.sum("n"))).alias("mean_mad_high")).withColumn("shift", F.col("mean_mad_high") - F.col("mean_mad_low")))

    def rows(focus, perm, ids, x, own, low, high):
        keep = (ids != focus) & ~np.isnan(x).any(axis=1)
        a, b = _mads(x[keep][:, low]), _mads(x[keep][:, high])
        n = len(a)
        return [(np.full(2 * n, focus), np.repeat([0, 1], n), np.concatenate([a, b]))]

    mads = _dealt(long, every.where("perm = 0"), rows, "focus long, high long, mad double", BLOCK, SPLITS)
    tests = express.rank_sum(mads, "high", 0, "mad", "focus").select("focus", F.col("p").alias("wilcoxon_p"))
    seen = means.where("perm = 0").drop("perm")
    null = means.where("perm > 0").select("focus", F.col("shift").alias("value"))
    perm = seen.select("focus", "shift").join(null, "focus", "left").groupBy("focus").agg(F.avg("value").alias("null_mean"), F.avg((F.abs("value") >= F.abs("shift")).cast("double")).alias("perm_p"))
    out = checkpointed(seen.join(perm, "focus").join(tests, "focus", "left"))
    out = fdr.benjamini_hochberg(fdr.benjamini_hochberg(out, "wilcoxon_p", "wilcoxon_p_adj"), "perm_p", "perm_p_adj")
    return out.withColumn("validated", F.coalesce((F.col("wilcoxon_p_adj") < alpha) & (F.col("perm_p_adj") < alpha), F.lit(False)))
