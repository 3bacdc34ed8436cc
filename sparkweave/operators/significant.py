"""Significant edges of differential networks without a table of all pairs.

Benjamini and Hochberg's q stays below alpha up to the largest p with p * m / rank < alpha. That p is found for each
reference and test in two block jobs: the first counts p values in cells of equal ratio (the upper bits of the double), which
tells in which few cells it may lie; the second counts the values of those cells. A third job gives the edges below it, or
sums over all of them; so what is written grows with the edges asked for, and no job ranks all pairs.

Correlations are quotients of whole numbers (sums of products of doubled, centred ranks), so equal ones are equal doubles
in any order of summation. Without ties there are few such numbers: their p values come from tables.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweave.sources.scratch import checkpointed

from . import diffnet, fdr
from .diffnet import CLASSES, Params
from .keyed import wide

BLOCK, LEAST, REFERENCES = 8192, 128, 16  # most and fewest features in a block, references in a group
ROWS, COLUMNS, PAIRS = 256, 2048, 2**20  # rows and columns of a product that fits the processor's cache, pairs whose p values are taken at a time
WIDE = 4096  # most features in a block whose pairs are mostly left out
SHIFT = 45  # bits of a p value below its cell: 128 cells from one power of two to the next
ENTRIES = 1024  # correlations of which a table of all pairs is made, at most
FEW = 24  # samples of a side whose ranks are counted, not sorted
TESTS = ("low", "high", "diff")


def _codes(long: DataFrame) -> DataFrame:
    """gene, values: the number of each value among the feature's distinct ones, from 1 upwards; 0 for missing ones."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            order = np.argsort(x, axis=1, kind="stable")
            s = np.take_along_axis(x, order, axis=1)
            new = np.ones(s.shape, np.int32)
            new[:, 1:] = s[:, 1:] != s[:, :-1]
            code = np.empty(s.shape, np.int32)
            np.put_along_axis(code, order, np.cumsum(new, axis=1, dtype=np.int32), axis=1)
            code[np.isnan(x)] = 0
            offsets = pa.array(np.arange(len(code) + 1, dtype=np.int32) * code.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(code.ravel()))], names=["gene", "values"])

    return wide(long).select("gene", "values").mapInArrow(run, "gene long, values array<int>")


def _centred(x: np.ndarray):
    """Twice the centred average ranks of each row, which are whole numbers, and the sum of their squares; zeros for rows
    with a missing value."""
    n = x.shape[1]
    if n <= FEW:  # a rank is what the places add: the signs of the differences from all others
        columns, ranks = np.ascontiguousarray(x.T), np.zeros((n, len(x)), np.int16)
        for s in range(n):
            for t in range(s):
                sign = (columns[s] > columns[t]).view(np.int8) - (columns[s] < columns[t]).view(np.int8)
                ranks[s] += sign
                ranks[t] -= sign
        out = ranks.T.astype(float, order="C")
        out[(x == 0).any(axis=1)] = 0
        return out, (out * out).sum(axis=1)
    order = np.argsort(x, axis=1, kind="stable")
    s = np.take_along_axis(x, order, axis=1)
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    last = np.minimum.accumulate(np.where(np.concatenate([new[:, 1:], np.ones((len(x), 1), bool)], axis=1), at, n - 1)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(s.shape)
    np.put_along_axis(out, order, (first + last + 1 - n).astype(float), axis=1)
    out[(x == 0).any(axis=1)] = 0
    return out, (out * out).sum(axis=1)


@lru_cache(maxsize=8)
def _tables(n: int):
    """p of every correlation of n untied ranks, and p of the difference of every two; None if they are many."""
    full = n * (n * n - 1) // 3
    if full // 2 + 1 > ENTRIES:
        return None
    r = (full - 4 * np.arange(full // 2 + 1)) / full
    low, high = (a.ravel() for a in np.meshgrid(r, r, indexing="ij"))
    _, _, p, _, diff = diffnet.tests_of(low, high, n)
    return p.reshape(len(r), -1)[:, 0].copy(), diff.reshape(len(r), -1)


def _tested(sides, one, two, pick, n: int):
    """Places (row of one * len(two) + row of two) of the pairs that have both correlations, these, and p values."""
    full = n * (n * n - 1) // 3
    ok, plain, r, dots = pick, True, [], []
    for d, norm in sides:
        dot, scale = d[one] @ d[two].T, norm[one][:, None] * norm[two][None, :]
        ok = ok & (scale > 0)
        plain = plain & (scale == float(full) * full) if full else False
        with np.errstate(divide="ignore", invalid="ignore"):
            r.append(np.clip(dot / np.sqrt(scale), -1, 1))
        dots.append(dot)
    at = np.flatnonzero(ok)
    r = [x.ravel()[at] for x in r]
    tables = _tables(n)
    if tables is None:
        return at, r, [p + 0.0 for p in diffnet.tests_of(*r, n)[2:]]
    entry = [np.clip((full - x.ravel()[at]) / 4, 0, full // 2).astype(np.int64) for x in dots]
    p = [tables[0][entry[0]], tables[0][entry[1]], tables[1][entry[0], entry[1]]]
    rest = ~plain.ravel()[at]
    if rest.any():
        for mine, other in zip(p, diffnet.tests_of(r[0][rest], r[1][rest], n)[2:], strict=True):
            mine[rest] = other
    return at, r, [x + 0.0 for x in p]


def _above(sides, one, two, pick, cut: float):
    """Places and both correlations of the pairs that have both, one of them beyond the cut. What single precision finds well
    below it is left out first."""
    on = np.zeros(pick.shape, bool)
    for d, norm in sides:
        u = (d / np.sqrt(np.where(norm > 0, norm, 1))[:, None]).astype(np.float32)
        on |= np.abs(u[one] @ u[two].T) > cut - 1e-4
    on &= pick
    at = np.flatnonzero(on)
    a, b = one[at // len(two)], two[at % len(two)]
    r, ok = [], np.ones(len(at), bool)
    for d, norm in sides:
        dot = (d[one] @ d[two].T).ravel()[at] if 8 * len(at) > on.size else np.einsum("ij,ij->i", d[a], d[b])
        scale = norm[a] * norm[b]
        ok &= scale > 0
        r.append(np.clip(dot / np.sqrt(np.where(scale > 0, scale, 1)), -1, 1))
    ok &= (np.abs(r[0]) > cut) | (np.abs(r[1]) > cut)
    return at[ok], [x[ok] for x in r]


@lru_cache(maxsize=8)
def _joint(n: int):
    """r and p of every two correlations of n untied ranks, the first one's number times their count plus the second's; None if they are many."""
    tables = _tables(n) if n > 2 else None
    if tables is None:
        return None
    k, full = len(tables[0]), n * (n * n - 1) // 3
    r = (full - 4 * np.arange(k)) / full
    return (np.repeat(r, k), np.tile(r, k)), [x + 0.0 for x in (np.repeat(tables[0], k), np.tile(tables[0], k), tables[1].ravel())]


def _numbers(sides, one, two, n: int):
    """First row, first column and the numbers (see _joint) of the pairs of rows without ties, tile by tile.

    Both correlations' whole numbers come from one product, whose sums are exact in single precision.
    """
    full, k = n * (n * n - 1) // 3, n * (n * n - 1) // 6 + 1
    (low, _), (high, _) = sides
    left = np.concatenate([low[one] * (-k / 4), high[one] / -4, np.full((len(one), 1), full * (k + 1) / 4)], axis=1).astype(np.float32)
    right = np.concatenate([low[two], high[two], np.ones((len(two), 1))], axis=1).astype(np.float32)
    for a in range(0, len(one), ROWS):
        for b in range(0, len(two), COLUMNS):
            yield a, b, (left[a : a + ROWS] @ right[b : b + COLUMNS].T).astype(np.intp)


def _jobs(genes: DataFrame, samples: list[int], refs: DataFrame, work, schema: str, cut: float | None = None, block: int | None = None, per: int = REFERENCES, wanted=None, at_once=None) -> DataFrame:
    """What work makes of every pair of blocks and every reference, as rows of a schema. refs: ref_gene, low, high (arrays of
    samples) and what work reads.

    Without more, work(row, r, p, n) gets the correlations and p values that occur and how many pairs have them. wanted(row, r, p): work(row,
    r, p, ends) gets the pairs for which it is true, ends being their smaller and larger features. cut: pairs of which one |r| is above
    it, without p values. at_once(parts): makes one of what work gave for the references of a group.

    Rows without ties have few correlations: their pairs are counted, or looked up, by number; p values of other pairs are taken one by one.
    """
    count = genes.count()
    if block is None:
        block = min(BLOCK, max(LEAST, -(-count // 8)))
    blocks, groups = max(1, -(-count // block)), max(1, -(-refs.count() // per))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = genes.withColumn("b", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int")).withColumn("c", every(blocks)).withColumn("g", every(groups))
    dealt = dealt.select("gene", "values", "b", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"), "g")
    keyed = refs.withColumn("g", F.pmod(F.xxhash64("ref_gene"), F.lit(groups)).cast("int")).withColumn("lo", every(blocks)).withColumn("hi", every(blocks)).where("lo <= hi")
    place = {s: k for k, s in enumerate(samples)}
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]

    def tested(row, sides, one, two, ids, same):
        """r, p, and how many pairs or their ends."""
        n = len(row["low"])
        joint, full = _joint(n), float(n * (n * n - 1) // 3)
        plain = (sides[0][1] == full) & (sides[1][1] == full) & (joint is not None)
        parts = []
        a, b = one[plain[one]], two[plain[two]]
        if len(a) and len(b):
            r, p = joint
            if wanted is None:
                counts = np.zeros(len(r[0]), np.int64)
                for _, _, number in _numbers(sides, a, b, n):
                    counts += np.bincount(number.ravel(), minlength=len(counts))
                if same:  # both orders, and each row with itself
                    counts[0] -= len(a)
                    counts //= 2
                at = np.flatnonzero(counts)
                parts.append(([x[at] for x in r], [x[at] for x in p], counts[at]))
            else:
                on = np.ascontiguousarray(wanted(row, r, p))
                for k, m, number in _numbers(sides, a, b, n) if on.any() else ():
                    at = np.flatnonzero(on[number].ravel())
                    i, j = np.divmod(at, number.shape[1])
                    i, j, number = ids[a[k + i]], ids[b[m + j]], number.ravel()[at]
                    if same:
                        i, j, number = (x[i < j] for x in (i, j, number))
                    parts.append(([x[number] for x in r], [x[number] for x in p], (np.minimum(i, j), np.maximum(i, j))))
        for a, b in ((one[~plain[one]], two), (one[plain[one]], two[~plain[two]])):
            for k in range(0, len(a) if len(b) else 0, max(1, PAIRS // max(1, len(b)))):
                c = a[k : k + max(1, PAIRS // len(b))]
                pick = ids[c][:, None] < ids[b][None, :] if same else np.ones((len(c), len(b)), bool)
                at, r, p = _tested(sides, c, b, pick, n)
                if wanted is None:
                    parts.append((r, p, np.ones(len(at), np.int64)))
                    continue
                on = np.flatnonzero(wanted(row, r, p))
                i, j = ids[c[at[on] // len(b)]], ids[b[at[on] % len(b)]]
                parts.append(([x[on] for x in r], [x[on] for x in p], (np.minimum(i, j), np.maximum(i, j))))
        if not parts:
            return None
        both = lambda k, m: np.concatenate([q[k][m] for q in parts])
        ends = np.concatenate([q[2] for q in parts]) if wanted is None else (both(2, 0), both(2, 1))
        return [both(0, m) for m in range(2)], [both(1, m) for m in range(3)], ends

    def run(key, table, rows):
        lo, hi, _ = (k.as_py() for k in key)
        parts = []
        if table.num_rows and rows.num_rows:
            ids, b = table.column("gene").to_numpy(), table.column("b").to_numpy()
            x = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            one, two = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
            for row in rows.to_pylist() if len(one) and len(two) else ():
                sides = [_centred(x[:, [place[s] for s in row[c]]]) for c in ("low", "high")]
                if cut is None:
                    got = tested(row, sides, one, two, ids, lo == hi)
                    parts += [work(row, *got)] if got else []
                    continue
                i, j = ids[one], ids[two]
                at, r = _above(sides, one, two, i[:, None] < j[None, :] if lo == hi else np.ones((len(i), len(j)), bool), cut)
                a, c = i[at // len(j)], j[at % len(j)]
                parts.append(work(row, r, None, (np.minimum(a, c), np.maximum(a, c))))
        if at_once and parts:
            parts = [at_once(parts)]
        return pa.table({n: pa.array(np.concatenate([p[k] for p in parts]) if parts else [], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return dealt.groupBy("lo", "hi", "g").cogroup(keyed.groupBy("lo", "hi", "g")).applyInArrow(run, schema)


def _counted(x: np.ndarray, n: np.ndarray | None):
    """Distinct values, ascending, and how many there are; n: how often each one counts."""
    if n is None:
        return np.unique(x, return_counts=True)
    values, at = np.unique(x, return_inverse=True)
    return values, np.bincount(at, weights=n, minlength=len(values)).astype(np.int64)


def _cells(p: np.ndarray) -> np.ndarray:
    return p.view(np.int64) >> SHIFT


def _prepared(long: DataFrame, splits: DataFrame):
    """Codes of the features, the samples in their order, and each reference's two sides. splits: ref_gene, side, sample."""
    samples = sorted(r[0] for r in long.select(F.col("sample").cast("long")).distinct().collect())
    sides = splits.groupBy(F.col("ref_gene").cast("long").alias("ref_gene")).agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("sample").cast("long")))).alias(s) for s in ("low", "high")])
    return checkpointed(_codes(long)), samples, checkpointed(sides)


def _with_cuts(genes: DataFrame, samples: list[int], sides: DataFrame, alpha: float, jobs=_jobs, **deal) -> DataFrame:
    """sides with m (pairs) and, for each test, the largest p whose q is below alpha (-1: none). jobs: what hands the pairs on."""

    def count(row, r, p, many):
        out = []
        for k, x in enumerate(p):
            cells, n = _counted(_cells(x), many)
            out.append((np.full(len(n), row["ref_gene"]), np.full(len(n), k), cells, n))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    keys = ["ref_gene", "test"]
    cells = jobs(genes, samples, sides, count, "ref_gene long, test long, cell long, n long", **deal)
    cells = checkpointed(cells.groupBy(*keys, "cell").agg(F.sum("n").alias("n")))

    def bound(pdf):
        """The cells in which the cut may lie, with the number of smaller p values and the end of the last one surely below."""
        pdf = pdf.sort_values("cell")
        cell, n = pdf["cell"].to_numpy(), pdf["n"].to_numpy()
        after, m = np.cumsum(n), n.sum()
        start, end = ((c << SHIFT).view(np.float64) for c in (cell, cell + 1))
        sure = np.flatnonzero(end * m / after < alpha)
        sure = sure[-1] if len(sure) else -1
        may = np.flatnonzero(start * m / after < alpha)
        may = np.arange(sure + 1, (may[-1] if len(may) else sure) + 1)
        top = float(((cell[sure : sure + 1] + 1 << SHIFT) - 1).view(np.float64)[0]) if sure >= 0 else -1.0
        out = pdf.iloc[may][["ref_gene", "test", "cell"]].assign(before=(after - n)[may])
        if not len(out):
            out = pdf.iloc[:1][["ref_gene", "test", "cell"]].assign(cell=-1, before=0)
        return out.assign(m=m, top=top)

    near = checkpointed(cells.groupBy(*keys).applyInPandas(bound, "ref_gene long, test long, cell long, before long, m long, top double"))
    per = near.groupBy(*keys).agg(F.min("cell").alias("first"), F.max("cell").alias("last"), F.first("m").alias("m"), F.first("top").alias("top"))
    of = lambda k, c: F.max(F.when(F.col("test") == k, F.col(c)))
    ranges = per.groupBy("ref_gene").agg(F.array(*[of(k, "first") for k in range(3)]).alias("first"), F.array(*[of(k, "last") for k in range(3)]).alias("last"))

    def values(row, r, p, many):
        out = []
        for k, x in enumerate(p):
            c = _cells(x)
            near = (c >= row["first"][k]) & (c <= row["last"][k])
            v, n = _counted(x[near], None if many is None else many[near])
            out.append((np.full(len(n), row["ref_gene"]), np.full(len(n), k), _cells(v), v, n))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    found = jobs(genes, samples, checkpointed(sides.join(ranges, "ref_gene")), values, "ref_gene long, test long, cell long, p double, n long", **deal)
    found = found.groupBy(*keys, "cell", "p").agg(F.sum("n").alias("n")).join(near, [*keys, "cell"])
    rank = F.col("before") + F.sum("n").over(W.partitionBy(*keys, "cell").orderBy("p"))
    below = found.withColumn("rank", rank).where(F.col("p") * F.col("m") / F.col("rank") < alpha).groupBy(*keys).agg(F.max("p").alias("p"))
    cuts = per.join(below, keys, "left").withColumn("cut", F.coalesce("p", "top"))
    cuts = cuts.groupBy("ref_gene").agg(F.max("m").alias("m"), *[of(k, "cut").alias(f"cut_{t}") for k, t in enumerate(TESTS)])
    return checkpointed(sides.join(cuts, "ref_gene"))


def edges(long: DataFrame, references: DataFrame, params: Params = Params(), where: str = "sig_differential", **deal) -> DataFrame:
    """The rows of keyed.edges that are `where` (sig_differential or sig_edge), without p and q of each side.

    Rows that are sig_differential have q_diff; it needs all of them, so sig_edge alone has none.
    """
    source = long.join(references.select(F.col("ref_gene").alias("gene")).distinct(), "gene", "left_semi")
    genes, samples, sides = _prepared(long, diffnet.extremes(source, params.fraction))
    sides = _with_cuts(genes, samples, sides, params.alpha, **deal)

    def wanted(row, r, p):
        on = p[2] <= row["cut_diff"]
        return on & ((p[0] <= row["cut_low"]) | (p[1] <= row["cut_high"])) if where == "sig_edge" else on

    def pick(row, r, p, ends):
        n = len(r[0])
        return [np.full(n, row["ref_gene"]), *ends, *r, p[2], np.full(n, row["m"]), p[0] <= row["cut_low"], p[1] <= row["cut_high"]]

    got = _jobs(genes, samples, sides, pick, "ref_gene long, gene_i long, gene_j long, r_low double, r_high double, p_diff double, m long, sig_low boolean, sig_high boolean", wanted=wanted, **deal)
    got = checkpointed(got)
    if where == "sig_differential":
        got = fdr.benjamini_hochberg(got, "p_diff", "q_diff", "ref_gene", total="m")
    got = got.drop("m").withColumns({"delta": F.col("r_high") - F.col("r_low"), "sig_individual": F.col("sig_low") | F.col("sig_high"), "sig_differential": F.lit(True)})
    got = got.withColumn("sig_edge", F.col("sig_individual"))
    return got.withColumn("class", diffnet.classify(F.col("r_low"), F.col("r_high"), F.col("sig_low"), F.col("sig_high"), params.threshold))


def classes(long: DataFrame, references: DataFrame, params: Params = Params(), edges_only: bool = False, **deal) -> DataFrame:
    """ref_gene, class, n, n_sig, mean_abs_delta, max_abs_delta over all pairs of each reference, or those that are sig_edge, summed inside the blocks."""
    source = long.join(references.select(F.col("ref_gene").alias("gene")).distinct(), "gene", "left_semi")
    genes, samples, sides = _prepared(long, diffnet.extremes(source, params.fraction))
    sides = _with_cuts(genes, samples, sides, params.alpha, **deal)

    def add(row, r, p, many):
        sig = [p[0] <= row["cut_low"], p[1] <= row["cut_high"]]
        on = (sig[0] | sig[1]) & (p[2] <= row["cut_diff"])
        if edges_only:
            r, sig, many, on = [x[on] for x in r], [x[on] for x in sig], many[on], on[on]
        size = [np.abs(x) for x in r]
        low, high = (s & (a >= params.threshold) for s, a in zip(sig, size, strict=True))
        code = np.select([low & ~high, ~low & high, ~low, np.sign(r[0]) != np.sign(r[1]), size[1] > size[0], size[1] < size[0]], [1, 2, 0, 3, 4, 5], 0)
        delta, most = np.abs(r[1] - r[0]), np.zeros(len(CLASSES))
        np.maximum.at(most, code, delta)
        n, n_sig, total = (np.bincount(code, weights=w, minlength=len(CLASSES)) for w in (many, many * on, many * delta))
        k = np.flatnonzero(n)
        return [np.full(len(k), row["ref_gene"]), k, n[k].astype(np.int64), n_sig[k].astype(np.int64), total[k], most[k]]

    got = _jobs(genes, samples, sides, add, "ref_gene long, code long, n long, n_sig long, total double, most double", **deal)
    name = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("code") + 1).cast("int")).alias("class")
    got = got.groupBy("ref_gene", name).agg(F.sum("n").alias("n"), F.sum("n_sig").alias("n_sig"), F.sum("total").alias("total"), F.max("most").alias("max_abs_delta"))
    return got.select("ref_gene", "class", "n", "n_sig", (F.col("total") / F.col("n")).alias("mean_abs_delta"), "max_abs_delta")


def two_networks(long: DataFrame, splits: DataFrame, cut: float, **deal) -> DataFrame:
    """gene_i, gene_j, w1, w2: |r| over the samples of side low and of side high, of pairs where either is above the cut; 0 below it."""
    genes, samples, sides = _prepared(long, splits)

    def pick(row, r, p, ends):
        w = [np.where(np.abs(x) > cut, np.abs(x), 0) for x in r]
        return [*ends, *w]

    deal = {"block": min(WIDE, max(LEAST, -(-genes.count() // 16)))} | deal
    return _jobs(genes, samples, sides, pick, "gene_i long, gene_j long, w1 double, w2 double", cut, **deal)


def summary(long: DataFrame, references: DataFrame, params: Params = Params(), **deal) -> DataFrame:
    """As keyed.reference_summary of the edges that are sig_edge; no table of edges is made."""
    c = classes(long, references, params, True, **deal)
    n = F.sum("n")
    got = c.groupBy("ref_gene").agg(n.alias("n_sig_edges_diff"), *[F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in CLASSES], (F.sum(F.col("mean_abs_delta") * F.col("n")) / n).alias("mean_abs_delta"), F.max("max_abs_delta").alias("max_abs_delta"))
    return references.select("ref_gene").distinct().join(got, "ref_gene", "left").fillna(0).fillna(0.0)


def _edge_jobs(long: DataFrame, references: DataFrame, params: Params, work, schema: str, at_once=None, **deal) -> DataFrame:
    """work(row, r, p, ends) of the pairs that are sig_edge."""
    source = long.join(references.select(F.col("ref_gene").alias("gene")).distinct(), "gene", "left_semi")
    genes, samples, sides = _prepared(long, diffnet.extremes(source, params.fraction))
    sides = _with_cuts(genes, samples, sides, params.alpha, **deal)
    wanted = lambda row, r, p: (p[2] <= row["cut_diff"]) & ((p[0] <= row["cut_low"]) | (p[1] <= row["cut_high"]))
    return _jobs(genes, samples, sides, work, schema, wanted=wanted, at_once=at_once, **deal)


def degrees(long: DataFrame, references: DataFrame, focuses: DataFrame, params: Params = Params(), **deal) -> DataFrame:
    """As keyed.focus_degrees of the edges that are sig_edge, summed inside the blocks. focuses: ref_gene, focus."""

    def add(row, r, p, ends):
        ids, at = np.unique(np.concatenate(ends), return_inverse=True)
        on = [(q <= row[c]) & (np.abs(x) >= params.threshold) for q, c, x in zip(p, ("cut_low", "cut_high"), r, strict=False)]
        low, high = (np.bincount(at, weights=np.concatenate([x, x]), minlength=len(ids)).astype(np.int64) for x in on)
        return [np.full(len(ids), row["ref_gene"]), ids, low, high, np.bincount(at, minlength=len(ids))]

    got = _edge_jobs(long, references, params, add, "ref_gene long, focus long, degree_low long, degree_high long, degree_diff long", **deal)
    got = got.groupBy("ref_gene", "focus").agg(*[F.sum(c).alias(c) for c in ("degree_low", "degree_high", "degree_diff")])
    return focuses.select("ref_gene", "focus").join(got, ["ref_gene", "focus"], "left").fillna(0)


def union(long: DataFrame, references: DataFrame, params: Params = Params(), **deal) -> DataFrame:
    """gene_i, gene_j of the pairs that are sig_edge for any reference. A group has its pairs for all of its references, so rows are
    compared with others only if references fill several groups."""

    def once(parts):
        i, j = (np.concatenate(c) for c in zip(*parts, strict=True))
        a, b = np.unique(i), np.unique(j)
        at = np.unique(np.searchsorted(a, i) * len(b) + np.searchsorted(b, j)) if len(i) else np.zeros(0, np.int64)
        return [a[at // max(1, len(b))], b[at % max(1, len(b))]]

    got = _edge_jobs(long, references, params, lambda row, r, p, ends: list(ends), "gene_i long, gene_j long", once, **deal)
    return got if references.select("ref_gene").distinct().count() <= deal.get("per", REFERENCES) else got.distinct()
