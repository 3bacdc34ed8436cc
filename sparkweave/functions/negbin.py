"""Negative binomial likelihoods over arrays: a row for each gene, a column for each sample.

The variance of a count with mean m is m + a m^2; a is its dispersion. All genes of a batch are fitted side by side.
"""

import numpy as np

from .special import digamma, log_gamma, trigamma

LEAST, MOST = 1e-8, 10.0  # dispersions
RIDGE = 1e-6
FLOOR = 0.5  # of a mean, in weights


def log_likelihood(y: np.ndarray, mu: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Of each gene; a has a column for each sample, or one."""
    r, s = 1 / a, a * mu
    each = log_gamma(y + r) - log_gamma(r * np.ones_like(y)) - log_gamma(y + 1) + y * (np.log(s) - np.log1p(s)) - r * np.log1p(s)
    return each.sum(axis=1)


def solved(normal: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.linalg.solve(normal, right[..., None])[..., 0]


def fit_mean(y: np.ndarray, offset: np.ndarray, x: np.ndarray, a: np.ndarray, ridge: np.ndarray | None = None, rounds: int = 60, floor: float = FLOOR, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (natural logarithms) and means of log-linear models by reweighted least squares."""
    lam = np.full(x.shape[1], RIDGE) if ridge is None else ridge
    beta = np.log(y + 0.1) - offset if start is None else None
    beta = beta @ x @ np.linalg.inv(x.T @ x + np.diag(lam)) if start is None else start.copy()
    open_ = np.ones(len(y), bool)
    for _ in range(rounds):
        eta = np.clip(beta[open_] @ x.T + offset, -30, 30)
        mu = np.maximum(np.exp(eta), floor)
        mine = a[open_] if a.shape[0] == len(y) else a
        w = mu / (1 + mine * mu)
        z = np.log(mu) - offset + (y[open_] - mu) / mu
        normal = np.einsum("gi,ij,ik->gjk", w, x, x) + np.diag(lam)
        new = solved(normal, np.einsum("gi,gi,ij->gj", w, z, x))
        moved = np.abs(new - beta[open_]).max(axis=1)
        beta[open_] = new
        open_[np.flatnonzero(open_)[moved < 1e-8]] = False
        if not open_.any():
            break
    return beta, np.exp(np.clip(beta @ x.T + offset, -30, 30))


def covariance(mu: np.ndarray, x: np.ndarray, a: np.ndarray, ridge: np.ndarray | None = None, floor: float = FLOOR) -> np.ndarray:
    """Of the coefficients."""
    lam = np.full(x.shape[1], RIDGE) if ridge is None else ridge
    mu = np.maximum(mu, floor)
    info = np.einsum("gi,ij,ik->gjk", mu / (1 + a * mu), x, x)
    inverse = np.linalg.inv(info + np.diag(lam))
    return inverse @ info @ inverse


def fit_dispersion(y: np.ndarray, mu: np.ndarray, x: np.ndarray, most: float, centre: np.ndarray | None = None, width: float = 0.0) -> np.ndarray:
    """Dispersion that is likeliest for given means, adjusted for the coefficients (Cox and Reid).

    centre, width: logarithms of the dispersions expected, and the variance around them. The maximum is bracketed on a
    grid and then narrowed by golden sections, for all genes at once.
    """

    def value(log_a):
        a = np.exp(log_a)[:, None]
        info = np.einsum("gi,ij,ik->gjk", mu / (1 + a * mu), x, x)
        out = log_likelihood(y, mu, a) - 0.5 * np.linalg.slogdet(info)[1]
        return out - (log_a - centre) ** 2 / (2 * width) if width > 0 else out

    grid = np.linspace(np.log(LEAST), np.log(most), 25)
    best = np.argmax([value(np.full(len(y), g)) for g in grid], axis=0)
    low, high = grid[np.maximum(best - 1, 0)], grid[np.minimum(best + 1, len(grid) - 1)]
    ratio = (5**0.5 - 1) / 2
    c, d = high - ratio * (high - low), low + ratio * (high - low)
    fc, fd = value(c), value(d)
    for _ in range(30):
        left = fc > fd
        low, high = np.where(left, low, c), np.where(left, d, high)
        c2 = np.where(left, high - ratio * (high - low), d)
        d2 = np.where(left, c, low + ratio * (high - low))
        new = value(np.where(left, c2, d2))
        fc, fd = np.where(left, new, fd), np.where(left, fc, new)
        c, d = c2, d2
    return np.exp((low + high) / 2)


def fit_both(y: np.ndarray, offset: np.ndarray, x: np.ndarray, z: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients of log means (design x) and of log dispersions (design z), log likelihood, and means.

    The two are improved in turn: means by reweighted least squares, dispersions by scored Newton steps that are halved
    until the likelihood does not fall.
    """
    genes = len(y)
    beta, mu = fit_mean(y, offset, x, np.full((genes, y.shape[1]), 0.1), floor=1e-8)
    rough = ((y - mu) ** 2 - mu).sum(axis=1) / np.maximum((mu**2).sum(axis=1), 1e-9)
    gamma = np.zeros((genes, z.shape[1]))
    gamma[:, 0] = np.log(np.clip(rough, 1e-3, MOST))
    spread = lambda g: np.exp(np.clip(g @ z.T, np.log(LEAST), np.log(100.0)))
    last = log_likelihood(y, mu, spread(gamma))
    open_ = np.arange(genes)
    for _ in range(rounds):
        yy, g = y[open_], gamma[open_]
        for _ in range(3):
            a, m = spread(g), mu[open_]
            r, s = 1 / a, a * m
            psi, psi1 = digamma(yy + r) - digamma(r), trigamma(yy + r) - trigamma(r)
            slope = -r * psi + yy - (yy + r) * s / (1 + s) + r * np.log1p(s)
            bend = r * psi + r * r * psi1 + 2 * r * s / (1 + s) - (yy + r) * s / (1 + s) ** 2 - r * np.log1p(s)
            w = np.maximum(-bend, np.maximum(slope * slope * 0.1, 1e-4))
            normal = np.einsum("gi,ij,ik->gjk", w, z, z) + 1e-6 * np.eye(z.shape[1])
            step = np.clip(solved(normal, np.einsum("gi,ij->gj", slope, z)), -2, 2)
            now, scale = log_likelihood(yy, m, a), np.ones(len(open_))
            for _ in range(12):
                worse = log_likelihood(yy, m, spread(g + scale[:, None] * step)) < now - 1e-12 * np.abs(now)
                if not worse.any():
                    break
                scale[worse] /= 2
            else:
                scale[worse] = 0
            g = g + scale[:, None] * step
        gamma[open_] = g
        beta[open_], mu[open_] = fit_mean(yy, offset, x, spread(g), rounds=4, floor=1e-8, start=beta[open_])
        like = log_likelihood(yy, mu[open_], spread(g))
        moved = np.abs(like - last[open_])
        last[open_] = like
        open_ = open_[moved > 1e-9 * (np.abs(like) + 1)]
        if not len(open_):
            break
    return beta, gamma, last, mu


def information(y: np.ndarray, mu: np.ndarray, gamma: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Observed information of the coefficients of log dispersions."""
    a = np.exp(np.clip(gamma @ z.T, np.log(LEAST), np.log(100.0)))
    r, s = 1 / a, a * mu
    psi, psi1 = digamma(y + r) - digamma(r), trigamma(y + r) - trigamma(r)
    bend = r * psi + r * r * psi1 + 2 * r * s / (1 + s) - (y + r) * s / (1 + s) ** 2 - r * np.log1p(s)
    return np.einsum("gi,ij,ik->gjk", -bend, z, z)
