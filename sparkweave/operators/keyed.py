"""Differential networks of many reference features in one job, and what is told of them reference by reference.

The reference is a key of the block product: a group holds two blocks of features and the splits of a block of
references, ranks the two sides of each split and multiplies. Values are shuffled once for each pair of blocks and block
of references, never once for each reference; a group's memory is set by the two block sizes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweave.functions.ranks import correlation
from sparkweave.sources.scratch import checkpointed

from . import diffnet, fdr
from .diffnet import CLASSES, Params

BLOCK, REFERENCES = 256, 16


def rank_rows(x: np.ndarray) -> np.ndarray:
    """z-scored average ranks of each row; NaN for rows without spread or with a missing value."""
    n = x.shape[1]
    order = np.argsort(x, axis=1, kind="stable")
    s = np.take_along_axis(x, order, axis=1)
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    last = np.minimum.accumulate(np.where(np.concatenate([new[:, 1:], np.ones((len(x), 1), bool)], axis=1), at, n - 1)[:, ::-1], axis=1)[:, ::-1]
    rank = np.empty_like(s)
    np.put_along_axis(rank, order, (first + last) / 2 + 1, axis=1)
    rank[np.isnan(x).any(axis=1)] = np.nan
    rank -= rank.mean(axis=1, keepdims=True)
    sd = rank.std(axis=1, ddof=1, keepdims=True)
    return rank / np.where(sd > 0, sd, np.nan)


def wide(long: DataFrame) -> DataFrame:
    """gene, values: each feature's values in sample order."""
    packed = long.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct(F.col("sample").cast("long").alias("sample"), F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("v")))).alias("a"))
    return packed.select("gene", F.transform("a", lambda x: x["v"]).alias("values"), F.transform("a", lambda x: x["sample"]).alias("samples"))


def correlations(long: DataFrame, splits: DataFrame, block: int = BLOCK, references: int = REFERENCES) -> DataFrame:
    """ref_gene, gene_i < gene_j, r_low, r_high, p_low, p_high, p_diff for every reference of splits (ref_gene, side, sample).

    Samples must be the same for all features; pairs without a correlation on either side are left out.
    """
    genes = wide(long)
    count, sides = genes.count(), splits.groupBy("ref_gene").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("sample").cast("long")))).alias(s) for s in ("low", "high")])
    blocks = max(1, -(-count // block))
    groups = max(1, -(-splits.select("ref_gene").distinct().count() // references))
    number = F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = genes.withColumn("b", number).withColumn("c", every(blocks)).withColumn("g", every(groups))
    dealt = dealt.select("gene", "values", "samples", "b", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"), "g")
    refs = sides.withColumn("g", F.pmod(F.xxhash64("ref_gene"), F.lit(groups)).cast("int")).withColumn("lo", every(blocks)).withColumn("hi", every(blocks)).where("lo <= hi")

    def run(key, table, splits_):
        lo, hi, _ = (k.as_py() for k in key)
        out: list = [[] for _ in range(8)]
        ids = table.column("gene").to_numpy()
        if len(ids) and splits_.num_rows:
            b = table.column("b").to_numpy()
            x = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            place = {s: k for k, s in enumerate(table.column("samples")[0].as_py())}
            one, two = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
            i, j = np.broadcast_arrays(ids[one][:, None], ids[two][None, :])
            pick = i < j if lo == hi else np.ones(i.shape, bool)
            i, j = i[pick], j[pick]
            for ref, low, high in zip(splits_.column("ref_gene").to_pylist(), splits_.column("low").to_pylist(), splits_.column("high").to_pylist(), strict=True):
                r = []
                for side in (low, high):
                    z = rank_rows(x[:, [place[s] for s in side]])
                    r.append(np.clip(z[one] @ z[two].T / (len(side) - 1), -1, 1)[pick])
                good = ~np.isnan(r[0]) & ~np.isnan(r[1])
                got = diffnet.tests_of(r[0][good], r[1][good], len(low))
                for store, values in zip(out, (np.full(good.sum(), ref), np.minimum(i, j)[good], np.maximum(i, j)[good], *got), strict=True):
                    store.append(values)
        names = ["ref_gene", "gene_i", "gene_j", "r_low", "r_high", "p_low", "p_high", "p_diff"]
        return pa.table({n: pa.array(np.concatenate(v) if v else np.zeros(0), pa.int64() if k < 3 else pa.float64()) for k, (n, v) in enumerate(zip(names, out, strict=True))})

    schema = "ref_gene long, gene_i long, gene_j long, r_low double, r_high double, p_low double, p_high double, p_diff double"
    return dealt.groupBy("lo", "hi", "g").cogroup(refs.groupBy("lo", "hi", "g")).applyInArrow(run, schema)


def edges(long: DataFrame, references: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of diffnet.edges for each of the references (ref_gene), with q values within each reference."""
    source = long.join(references.select(F.col("ref_gene").alias("gene")).distinct(), "gene", "left_semi")
    both = checkpointed(correlations(long, checkpointed(diffnet.extremes(source, params.fraction))).withColumn("delta", F.col("r_high") - F.col("r_low")))
    for side in ("low", "high", "diff"):
        both = fdr.benjamini_hochberg(both, f"p_{side}", f"q_{side}", "ref_gene")
    sig = {f"sig_{s}": F.col(f"q_{s}") < params.alpha for s in ("low", "high")}
    both = both.withColumns(sig).withColumns({"sig_individual": F.col("sig_low") | F.col("sig_high"), "sig_differential": F.col("q_diff") < params.alpha})
    both = both.withColumn("sig_edge", F.col("sig_individual") & F.col("sig_differential"))
    return both.withColumn("class", diffnet.classify(F.col("r_low"), F.col("r_high"), F.col("sig_low"), F.col("sig_high"), params.threshold))


def _present(side: str, threshold: float):
    return F.col(f"sig_{side}") & (F.abs(f"r_{side}") >= threshold)


def focus_edges(network: DataFrame, focuses: DataFrame) -> DataFrame:
    """ref_gene, focus, layer and the network's columns: edges at the focus ("direct"), between its partners ("inner") and
    from a partner to a node that is neither ("outer"). focuses: ref_gene, focus."""
    ends = lambda df: df.withColumn("node", F.explode(F.array("gene_i", "gene_j")))
    direct = ends(network).join(focuses.withColumnRenamed("focus", "node"), ["ref_gene", "node"]).withColumnRenamed("node", "focus")
    other = F.when(F.col("gene_i") == F.col("focus"), F.col("gene_j")).otherwise(F.col("gene_i"))
    partners = direct.select("ref_gene", "focus", other.alias("node"))
    keys = ["ref_gene", "focus", "gene_i", "gene_j"]
    met = ends(network).join(partners, ["ref_gene", "node"]).where("gene_i <> focus and gene_j <> focus")
    rest = [c for c in network.columns if c not in keys]
    met = met.groupBy(*keys).agg(F.count("*").alias("__k"), F.min("node").alias("partner"), *[F.first(c).alias(c) for c in rest])
    far = F.when(F.col("gene_i") == F.col("partner"), F.col("gene_j")).otherwise(F.col("gene_i"))
    outer = met.select(*keys, *rest, F.when(F.col("__k") == 2, "inner").otherwise("outer").alias("layer"), F.when(F.col("__k") == 1, far).alias("far"))
    return direct.select(*keys, *rest, F.lit("direct").alias("layer"), F.lit(None).cast("long").alias("far")).unionByName(outer)


def focus_metrics(network: DataFrame, focuses: DataFrame, threshold: float = Params.threshold) -> DataFrame:
    """The flat table of a focus in each reference's differential network: counts of classes, connectivity, changes and
    ratios of its direct edges (l1), of those around its partners (l2) and of both (full).

    An edge counts as present on a side if it is significant there and |r| reaches the threshold. Sums and means over no
    edge, and ratios over 0, are 0; a focus without edges has a row of zeros.
    """
    rows = focus_edges(network, focuses)
    of = {"l1": F.col("layer") == "direct", "l2": F.col("layer") != "direct", "full": F.lit(True)}
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    mean = lambda c, v: F.coalesce(F.avg(F.when(c, v)), F.lit(0.0))
    low, high = _present("low", threshold), _present("high", threshold)
    cols = []
    for name, on in of.items():
        cols += [n(on).alias(f"{name}_n_edges"), *[n(on & (F.col("class") == c)).alias(f"{name}_n_{c}") for c in CLASSES if c != "unchanged"], n(on & low).alias(f"{name}_n_edges_low"), n(on & high).alias(f"{name}_n_edges_high")]
        cols += [total(on & low, F.abs("r_low")).alias(f"{name}_conn_low"), total(on & high, F.abs("r_high")).alias(f"{name}_conn_high"), mean(on & low, F.abs("r_low")).alias(f"{name}_conn_mean_low"), mean(on & high, F.abs("r_high")).alias(f"{name}_conn_mean_high")]
        cols += [total(on, F.abs("delta")).alias(f"{name}_conn_diff"), mean(on, F.abs("delta")).alias(f"{name}_mean_abs_dr"), mean(on, F.col("delta")).alias(f"{name}_mean_delta")]
    cols += [n(F.col("layer") == "inner").alias("n_l1_to_l1_edges"), n(F.col("layer") == "outer").alias("n_l1_to_l2_edges"), F.count_distinct("far").alias("l2_n_nodes")]
    got = focuses.join(rows.groupBy("ref_gene", "focus").agg(*cols), ["ref_gene", "focus"], "left").fillna(0).fillna(0.0)
    rewire = lambda k: F.col(f"{k}_n_disappear") + F.col(f"{k}_n_new") + F.col(f"{k}_n_sign_change")
    got = got.withColumns({f"{k}_rewire": rewire(k) for k in of}).withColumns({"l1_n_nodes": F.col("l1_n_edges"), "focus_deg_low": F.col("l1_n_edges_low"), "focus_deg_high": F.col("l1_n_edges_high")})
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    k = F.col("l1_n_nodes")
    return got.withColumns({
        "l1_frac_disappear": share("l1_n_disappear", "l1_n_nodes"), "l1_frac_new": share("l1_n_new", "l1_n_nodes"), "l1_frac_rewire": share("l1_rewire", "l1_n_nodes"),
        "l1_clique_density": F.when(k > 1, F.col("n_l1_to_l1_edges") * 2 / (k * (k - 1))).otherwise(0.0), "l2l1_deg": share("l2_n_nodes", "l1_n_nodes"),
        "l2l1_rewire": share("l2_rewire", "l1_rewire"), "l2l1_conn": share("l2_conn_diff", "l1_conn_diff"), "hl_conn_l1": share("l1_conn_high", "l1_conn_low"), "hl_conn_l2": share("l2_conn_high", "l2_conn_low"),
    })


def reference_summary(network: DataFrame, references: DataFrame) -> DataFrame:
    """ref_gene, n_sig_edges_diff, counts of classes, mean and largest |delta| of each reference's network; zeros without edges."""
    got = network.groupBy("ref_gene").agg(F.count("*").alias("n_sig_edges_diff"), *[F.sum((F.col("class") == c).cast("long")).alias(f"n_{c}") for c in CLASSES], F.avg(F.abs("delta")).alias("mean_abs_delta"), F.max(F.abs("delta")).alias("max_abs_delta"))
    return references.select("ref_gene").distinct().join(got, "ref_gene", "left").fillna(0).fillna(0.0)


def focus_degrees(network: DataFrame, focuses: DataFrame, threshold: float = Params.threshold) -> DataFrame:
    """ref_gene, focus, degree_low, degree_high, degree_diff; a side counts significant edges that reach the threshold."""
    ends = network.select("ref_gene", F.explode(F.array("gene_i", "gene_j")).alias("focus"), _present("low", threshold).alias("low"), _present("high", threshold).alias("high"))
    got = ends.groupBy("ref_gene", "focus").agg(F.sum(F.col("low").cast("long")).alias("degree_low"), F.sum(F.col("high").cast("long")).alias("degree_high"), F.count("*").alias("degree_diff"))
    return focuses.select("ref_gene", "focus").join(got, ["ref_gene", "focus"], "left").fillna(0)


def context_variance(degrees: DataFrame, top: int = 5) -> DataFrame:
    """focus, mean degrees, variance (population) and range of degree_diff over references, context_rank of the `top` most
    varied focuses (ties to the smaller focus; null below)."""
    got = checkpointed(degrees.groupBy("focus").agg(F.avg("degree_low").alias("mean_low"), F.avg("degree_high").alias("mean_high"), F.avg("degree_diff").alias("mean_diff"), F.var_pop("degree_diff").alias("variance"), F.min("degree_diff").alias("least"), F.max("degree_diff").alias("most")))
    first = got.orderBy(F.desc(F.round("variance", 9)), "focus").limit(top).select("focus", F.round("variance", 9).alias("v"))
    rank = first.select("focus", F.row_number().over(W.orderBy(F.desc("v"), "focus")).alias("context_rank"))  # `top` rows
    return got.join(F.broadcast(rank), "focus", "left")


def networks(network: DataFrame, threshold: float = Params.threshold) -> DataFrame:
    """ref_gene, net, gene_i, gene_j: the low and the high network (|r| reaches the threshold there) and all edges as diff."""
    nets = [F.when(F.abs("r_low") >= threshold, "low"), F.when(F.abs("r_high") >= threshold, "high"), F.lit("diff")]
    return network.select("ref_gene", F.explode(F.array_compact(F.array(*nets))).alias("net"), "gene_i", "gene_j")


def topologies(nets: DataFrame, references: DataFrame, nodes: int) -> DataFrame:
    """ref_gene, net and, of each of a reference's networks: edges, density, degrees, clustering, components, assortativity,
    power law. Networks without edges have zeros; exponents of fewer than 10 active nodes or 5 bins are null."""
    keys = ["ref_gene", "net"]
    nets = checkpointed(nets)
    adj = nets.select(*keys, F.col("gene_i").alias("gene"), F.col("gene_j").alias("other")).unionByName(nets.select(*keys, F.col("gene_j").alias("gene"), F.col("gene_i").alias("other")))
    deg = checkpointed(adj.groupBy(*keys, "gene").agg(F.count("*").alias("degree")))
    size = deg.groupBy(*keys).agg((F.sum("degree") / 2).cast("long").alias("n_edges"), F.count("*").alias("n_active"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_active"), F.median("degree").alias("median_active"), F.stddev_pop("degree").alias("std_active"))
    x, y = deg.toDF(*keys, "gene_i", "x"), deg.toDF(*keys, "gene_j", "y")
    ends = nets.join(x, [*keys, "gene_i"]).join(y, [*keys, "gene_j"])
    mixed = ends.groupBy(*keys).agg(F.coalesce(correlation(F.col("x").cast("double"), F.col("y").cast("double")), F.lit(0.0)).alias("assortativity"))
    # triangles: edges point to the end of higher degree, so that hubs open few wedges
    ahead = F.struct("x", "gene_i") < F.struct("y", "gene_j")
    out = checkpointed(ends.select(*keys, F.when(ahead, F.col("gene_i")).otherwise(F.col("gene_j")).alias("u"), F.when(ahead, F.col("gene_j")).otherwise(F.col("gene_i")).alias("v")))
    wedge = out.join(out.withColumnRenamed("v", "w"), [*keys, "u"]).where("v < w")
    closed = wedge.join(nets.select(*keys, F.col("gene_i").alias("v"), F.col("gene_j").alias("w")), [*keys, "v", "w"], "left_semi")
    tri = closed.select(*keys, F.explode(F.array("u", "v", "w")).alias("gene")).groupBy(*keys, "gene").agg(F.count("*").alias("t"))
    local = deg.where("degree >= 2").join(tri, [*keys, "gene"], "left").groupBy(*keys).agg(F.avg(2 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).alias("clustering"))
    parts = components(nets.select(F.struct(*keys, F.col("gene_i").alias("gene")).alias("a"), F.struct(*keys, F.col("gene_j").alias("gene")).alias("b")))
    parts = parts.groupBy("root").agg(F.count("*").alias("n")).groupBy("root.ref_gene", "root.net").agg(F.count("*").alias("n_components"), F.max("n").alias("largest_component"))
    bins = deg.groupBy(*keys, "degree").agg(F.count("*").alias("k")).where("k >= 2")
    lx, ly = F.log10(F.col("degree").cast("double")), F.log10(F.col("k").cast("double"))
    law = bins.groupBy(*keys).agg(F.count("*").alias("bins"), (-F.regr_slope(ly, lx)).alias("gamma"), F.regr_r2(ly, lx).alias("fit"))
    out = references.select("ref_gene").distinct().select("ref_gene", F.explode(F.array(*map(F.lit, ("low", "high", "diff")))).alias("net"))
    for part in (size, mixed, local, parts, law):
        out = out.join(part, keys, "left")
    enough = (F.col("bins") >= 5) & (F.col("n_active") >= 10)
    out = out.withColumns({"gamma": F.when(enough, F.col("gamma")), "fit": F.when(enough, F.col("fit"))}).drop("bins")
    filled = [c for c in out.columns if c not in (*keys, "gamma", "fit")]
    out = out.fillna(0, filled).fillna(0.0, filled)
    share = {"density": F.col("n_edges") * 2 / (nodes * (nodes - 1)), "mean_degree": F.col("n_edges") * 2 / nodes, "largest_fraction": F.col("largest_component") / nodes}
    return out.withColumns(share).withColumn("scale_free", F.coalesce(F.col("gamma").between(2, 3.5) & (F.col("fit") > 0.8), F.lit(False)))


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node that links reach) of every node of links (a, b of any ordered type), by alternating stars.

    Each round links a node's larger neighbours to its smallest one, then smaller neighbours to the smallest; rounds grow
    with the logarithm of the longest path.
    """
    now = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = checkpointed(small.where("a <> b").distinct())
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if found == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = found


def parse_focus(spec: str, genes: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """focus: features named by a list "3,5,8", by "top:N" (the first N, or with scores (gene, score) the N highest), or "all".

    Unknown or malformed names are an error.
    """
    spec = spec.strip()
    if spec == "all":
        return genes.select(F.col("gene").alias("focus")).distinct()
    if spec.startswith("top:"):
        if not spec[4:].isdigit():
            raise ValueError(f"not a number: {spec[4:]!r}")
        ranked = genes.select("gene").distinct().orderBy("gene") if scores is None else scores.orderBy(F.desc_nulls_last("score"), "gene")
        return ranked.limit(int(spec[4:])).select(F.col("gene").alias("focus"))
    try:
        ids = sorted({int(x) for x in spec.split(",")})
    except ValueError as e:
        raise ValueError(f"not a list of features: {spec!r}") from e
    found = genes.where(F.col("gene").isin(ids)).select(F.col("gene").alias("focus")).distinct()
    if found.count() != len(ids):
        raise ValueError(f"unknown features in {spec!r}")
    return found


def _order(row: np.ndarray) -> np.ndarray:
    """For each place s and t half the sign of row[s] - row[t], 0 where either is missing; summed over the t that are on, it is
    the centred average rank of s among them."""
    return np.sign(np.nan_to_num(row[:, None] - row[None, :])) / 2


def pairwise_complete(one: DataFrame, two: DataFrame, block: int = 128, least: int = 3) -> DataFrame:
    """a, b, n, r of every feature of one with every feature of two (long form), over the samples where both have values.

    Ranks are taken anew for each pair among its complete samples. r is null below `least` of them or without spread.
    Both matrices must name the same samples; a group holds a block of each.
    """
    left, right = checkpointed(wide(one)), checkpointed(wide(two))  # both may come from one table
    n_left, n_right = (max(1, -(-df.count() // block)) for df in (left, right))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda n: F.pmod(F.xxhash64("gene"), F.lit(n)).cast("int")
    x = left.withColumn("i", number(n_left)).withColumn("j", every(n_right))
    y = right.withColumn("j", number(n_right)).withColumn("i", every(n_left))

    def run(key, p, q):
        out: list = [[], [], [], []]
        if p.num_rows and q.num_rows:
            if p.column("samples")[0] != q.column("samples")[0]:
                raise ValueError("both matrices must have the same samples")
            v = [t.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (p, q)]
            b = q.column("gene").to_numpy()
            # ranks of one side's rows among the places that each row of the other has are products with 0 and 1; sums of few halves are exact in floats
            kind = np.float32 if v[0].shape[1] <= 256 else np.float64
            on = [(~np.isnan(x)).astype(kind) for x in v]
            ranks = np.stack([on[0] @ _order(row).T.astype(kind) for row in v[1]])  # rows of the right, of the left, places
            for k, (a, row) in enumerate(zip(p.column("gene").to_pylist(), v[0], strict=True)):
                both = on[1] * on[0][k]
                x, y = (on[1] @ _order(row).T.astype(kind)) * both, ranks[:, k] * both
                count = both.sum(axis=1).astype(np.int64)
                xy, xx, yy = (np.einsum("ij,ij->i", f, g).astype(np.float64) for f, g in ((x, y), (x, x), (y, y)))
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = np.clip(xy / np.sqrt(xx * yy), -1, 1)
                for store, values in zip(out, (np.full(len(b), a), b, count, np.where(count >= least, r, np.nan)), strict=True):
                    store.append(values)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0), k, from_pandas=True) for n, c, k in zip(("a", "b", "n", "r"), out, kinds, strict=True)})

    return x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInArrow(run, "a long, b long, n long, r double")
