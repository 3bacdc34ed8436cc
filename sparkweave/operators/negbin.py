"""Negative binomial models of a count matrix: changes of the mean with shrunken dispersions, and of mean and dispersion.

Genes are fitted in Arrow batches, a gene's counts as one array; what all genes share (trend, prior) comes from
aggregations over the genes' tables, so the driver sees a few numbers only.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.functions import negbin, special
from sparkweave.sources.scratch import checkpointed

from . import fdr
from .counts import Design, arrays, by_sample, change_class, matrix_of, median_ratio_sizes, trimmed_mean_factors
from .rules import mean_and_spread_class

BATCH = 512  # genes fitted side by side: memory in proportion to this and to the samples
LN2 = float(np.log(2.0))


def _batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _rough(size: np.ndarray, x: np.ndarray, most: float):
    """gene, y, mean, gene_wise: each gene's own dispersion; null where the gene has no counts."""
    offset = np.log(size)

    def run(batches):
        for batch in _batches(batches):
            y = matrix_of(batch)
            some = np.flatnonzero(y.sum(axis=1) > 0)
            own = np.full(len(y), np.nan)
            if len(some):
                a = np.full((len(some), 1), 0.1)
                for _ in range(3):  # means and dispersion in turn
                    _, mu = negbin.fit_mean(y[some], offset, x, a)
                    mu = np.maximum(mu, negbin.FLOOR)
                    a = negbin.fit_dispersion(y[some], mu, x, most)[:, None]
                own[some] = a[:, 0]
            yield pa.record_batch([batch.column("gene"), batch.column("y"), pa.array((y / size).mean(axis=1)), pa.array(own, mask=np.isnan(own))], ["gene", "y", "mean", "gene_wise"])

    return run


def dispersion_trend(genes: DataFrame, rounds: int = 20) -> tuple[float, float]:
    """a, b of the trend a + b / mean of dispersions (columns mean, gene_wise), as a gamma model with identity link.

    Genes far off the trend of a round (below 1e-4 or above 15 times it) do not count in it. If no positive trend is
    found, it is the mean of the dispersions.
    """
    used = genes.where((F.col("gene_wise") > 100 * negbin.LEAST) & (F.col("mean") > 0)).select((1 / F.col("mean")).alias("x"), F.col("gene_wise").alias("y"))
    a, b = 0.1, 1.0
    for _ in range(rounds):
        fit = F.lit(a) + F.lit(b) * F.col("x")
        near = used.where((F.col("y") / fit > 1e-4) & (F.col("y") / fit < 15))
        w = 1 / (fit * fit)
        x, y = F.col("x"), F.col("y")
        s = near.agg(*[F.sum(w * v).alias(n) for n, v in (("s0", F.lit(1.0)), ("s1", x), ("s2", x * x), ("t0", y), ("t1", x * y))]).first()
        det = (s.s0 or 0) * (s.s2 or 0) - (s.s1 or 0) ** 2
        if det <= 0:
            break
        new = (s.s2 * s.t0 - s.s1 * s.t1) / det, (s.s0 * s.t1 - s.s1 * s.t0) / det
        if min(new) <= 0:
            a, b = -1.0, -1.0
            break
        moved = np.log(new[0] / a) ** 2 + np.log(new[1] / b) ** 2
        a, b = new
        if moved < 1e-6:
            break
    if a > 0 and b > 0:
        return a, b
    return used.agg(F.avg("y")).first()[0] or 0.1, 0.0


def _tests(size: np.ndarray, model: Design, k: int, reduced: Design | None, trend: tuple[float, float], width: float, off: float, most: float, prior: float | None):
    """Per gene: dispersion, log2 change, its error, statistic, p; with prior, the change and nothing else is shrunken."""
    offset, x = np.log(size), model.matrix

    def run(batches):
        for batch in _batches(batches):
            y, own = matrix_of(batch), batch.column("gene_wise").to_numpy(zero_copy_only=False).astype(float)
            mean = batch.column("mean").to_numpy()
            out = {c: np.full(len(y), np.nan) for c in ("dispersion", "change", "error", "stat", "p", "shrunken")}
            i = np.flatnonzero(~np.isnan(own))
            if len(i):
                expected = np.log(trend[0] + trend[1] / mean[i])
                _, mu = negbin.fit_mean(y[i], offset, x, own[i][:, None])
                a = negbin.fit_dispersion(y[i], np.maximum(mu, negbin.FLOOR), x, most, expected, width)
                a = np.where(np.log(own[i]) > expected + off, own[i], a)  # far above the trend: the gene's own
                beta, mu = negbin.fit_mean(y[i], offset, x, a[:, None])
                error = np.sqrt(negbin.covariance(mu, x, a[:, None])[:, k, k])
                out["dispersion"][i], out["change"][i], out["error"][i] = a, beta[:, k] / LN2, error / LN2
                if reduced is None:
                    out["stat"][i] = beta[:, k] / error
                    out["p"][i] = special.normal_tail(out["stat"][i])
                else:
                    _, less = negbin.fit_mean(y[i], offset, reduced.matrix, a[:, None])
                    out["stat"][i] = np.maximum(0, 2 * (negbin.log_likelihood(y[i], mu, a[:, None]) - negbin.log_likelihood(y[i], less, a[:, None])))
                    out["p"][i] = special.chi_square_tail(out["stat"][i], x.shape[1] - reduced.matrix.shape[1])
                if prior:
                    ridge = np.full(x.shape[1], negbin.RIDGE)
                    ridge[k] = 1 / prior**2
                    out["shrunken"][i] = negbin.fit_mean(y[i], offset, x, a[:, None], ridge)[0][:, k] / LN2
            yield pa.record_batch([batch.column("gene"), batch.column("mean"), *[pa.array(v, mask=np.isnan(v)) for v in out.values()]], ["gene", "mean", *out])

    return run


def mean_changes(counts: DataFrame, model: Design, tested: str, test: str = "wald", shrink: bool = True, alpha: float = 0.05) -> DataFrame:
    """gene, mean, dispersion, log2_fc, error, stat, p, q, log2_fc_shrunken, class of one column of a design.

    Sizes are median ratios. A gene's own dispersion is drawn towards a + b / mean, by the spread around this trend that
    sampling does not explain; a gene far above it keeps its own. test: "wald", or "lrt" against the design without the
    column. shrunken changes have a normal prior whose width the upper 5 % of changes set. Genes that lack a sample are
    left out; genes without counts have nulls; q is over the genes that have p.
    """
    if test not in ("wald", "lrt"):
        raise ValueError("test is wald or lrt")
    n, p = model.matrix.shape
    most = max(negbin.MOST, float(n))
    size = by_sample(median_ratio_sizes(counts.where(F.col("sample").isin(*model.samples))), "size", model.samples)
    genes = arrays(counts, model.samples)
    kind = f"gene {genes.schema['gene'].dataType.simpleString()}"
    rough = checkpointed(genes.mapInArrow(_rough(size, model.matrix, most), f"{kind}, y array<double>, mean double, gene_wise double"))
    trend = dispersion_trend(rough)
    off = F.log("gene_wise") - F.log(F.lit(trend[0]) + F.lit(trend[1]) / F.col("mean"))
    known = rough.where(F.col("gene_wise") >= 100 * negbin.LEAST).select(off.alias("off"))
    middle = known.agg(F.percentile_approx("off", 0.5, 20_000)).first()[0] or 0.0
    spread = 1.4826 * (known.agg(F.percentile_approx(F.abs(F.col("off") - middle), 0.5, 20_000)).first()[0] or 0.0)
    width = max(spread**2 - float(special.trigamma(max(n - p, 1) / 2)), 0.25)
    k, reduced = model.column(tested), model.without(tested) if test == "lrt" else None
    columns = f"{kind}, mean double, dispersion double, change double, error double, stat double, p double, shrunken double"
    args = (size, model, k, reduced, trend, width, 2 * spread, most)
    found = rough.mapInArrow(_tests(*args, None), columns)
    if shrink:
        first = checkpointed(found)
        top = first.agg(F.percentile_approx(F.abs("change"), 0.95, 20_000)).first()[0]
        found = rough.mapInArrow(_tests(*args, max(top * LN2 / 1.959964, 1e-3)), columns) if top else first
    out = fdr.benjamini_hochberg(checkpointed(found), "p", "q")
    return out.select("gene", "mean", "dispersion", F.col("change").alias("log2_fc"), "error", "stat", "p", "q", F.col("shrunken").alias("log2_fc_shrunken"), change_class(F.col("q"), F.col("change"), alpha).alias("class"))


def _both(size: np.ndarray, model: Design, spread: Design, k: int, j: int):
    offset, x, z = np.log(size), model.matrix, spread.matrix
    less_x, less_z = np.delete(x, k, axis=1), np.delete(z, j, axis=1)
    names = ("mu_ctrl", "mu_trt", "cpm_ctrl", "cpm_trt", "sigma_ctrl", "sigma_trt", "p_mu", "p_sigma", "p_mu_single", "p_sigma_single")

    def run(batches):
        for batch in _batches(batches):
            y = matrix_of(batch)
            out = {c: np.full(len(y), np.nan) for c in names}
            i = np.flatnonzero(y.sum(axis=1) > 0)
            if len(i):
                beta, gamma, like, mu = negbin.fit_both(y[i], offset, x, z)
                _, _, no_spread, _ = negbin.fit_both(y[i], offset, x, less_z)
                _, _, no_mean, _ = negbin.fit_both(y[i], offset, less_x, z)
                out["mu_ctrl"][i], out["mu_trt"][i] = beta[:, 0], beta[:, 0] + beta[:, k]
                out["cpm_ctrl"][i], out["cpm_trt"][i] = np.exp(beta[:, 0] + offset.mean()), np.exp(beta[:, 0] + beta[:, k] + offset.mean())
                out["sigma_ctrl"][i], out["sigma_trt"][i] = gamma[:, 0], gamma[:, 0] + gamma[:, j]
                out["p_mu"][i] = special.chi_square_tail(2 * (like - no_mean), 1)
                out["p_sigma"][i] = special.chi_square_tail(2 * (like - no_spread), 1)
                a = np.exp(np.clip(gamma @ z.T, np.log(negbin.LEAST), np.log(100.0)))
                df = y.shape[1] - x.shape[1] - z.shape[1]
                error = np.sqrt(negbin.covariance(mu, x, a, floor=1e-8)[:, k, k])
                out["p_mu_single"][i] = special.t_tail_of(beta[:, k] / error, df)
                info = negbin.information(y[i], mu, gamma, z) + 1e-9 * np.eye(z.shape[1])
                known = np.linalg.inv(info)[:, j, j]
                with np.errstate(invalid="ignore"):
                    out["p_sigma_single"][i] = np.where(known > 0, special.t_tail_of(gamma[:, j] / np.sqrt(np.where(known > 0, known, 1)), df), np.nan)
            yield pa.record_batch([batch.column("gene"), *[pa.array(v, mask=np.isnan(v)) for v in out.values()]], ["gene", *out])

    return run


def mean_and_dispersion_changes(counts: DataFrame, model: Design, tested: str, spread: Design | None = None, alpha: float = 0.05) -> DataFrame:
    """Changes of mean and of dispersion of one treatment, with likelihood-ratio tests of both, a row for each gene.

    Three models a gene: the full one, one whose dispersion and one whose mean does not know the treatment. spread: the
    design of log dispersions (default: intercept and the tested column). Library sizes are multiplied by trimmed-mean
    factors and enter as offsets in millions. bcv is the square root of a dispersion. log2_fc compares expected counts;
    log2_fc_mu, the ratio of log-scale coefficients, is null where their signs differ. Genes without counts have nulls;
    genes that lack a sample are left out.
    """
    k = model.column(tested)
    spread = spread or Design(model.samples, ("(Intercept)", tested), np.stack([np.ones(len(model.samples)), model.matrix[:, k]], axis=1))
    sizes = trimmed_mean_factors(counts.where(F.col("sample").isin(*model.samples)))
    size = by_sample(sizes.withColumn("s", F.col("size") * F.col("factor") / 1e6), "s", model.samples)
    genes = arrays(counts, model.samples)
    columns = ", ".join(f"{c} double" for c in ("mu_ctrl", "mu_trt", "cpm_ctrl", "cpm_trt", "sigma_ctrl", "sigma_trt", "p_mu", "p_sigma", "p_mu_single", "p_sigma_single"))
    fits = checkpointed(genes.mapInArrow(_both(size, model, spread, k, spread.column(tested)), f"gene {genes.schema['gene'].dataType.simpleString()}, {columns}"))
    for name in ("mu", "sigma", "mu_single", "sigma_single"):
        fits = fdr.benjamini_hochberg(fits, f"p_{name}", f"q_{name}")
    bcv = {f"bcv_{s}": F.exp(F.col(f"sigma_{s}") / 2) for s in ("ctrl", "trt")}
    ratio = F.try_divide(F.col("mu_trt"), F.col("mu_ctrl"))
    out = fits.withColumns(bcv).withColumns({
        "log2_fc": F.log2(F.col("cpm_trt") / F.col("cpm_ctrl")), "log2_fc_mu": F.when(ratio > 0, F.log2(ratio)), "log2_fc_bcv": F.log2(F.col("bcv_trt") / F.col("bcv_ctrl")), "diff_bcv": F.col("bcv_trt") - F.col("bcv_ctrl"),
    })
    named = {f"class_{n}": mean_and_spread_class(F.col(f"q_mu{s}"), F.col(f"q_sigma{s}"), F.col("log2_fc"), F.col("log2_fc_bcv"), alpha) for n, s in (("single", "_single"), ("modelcomp", ""))}
    return out.withColumns(named)
