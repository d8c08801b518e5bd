"""Numerics that Spark has no expression for, in numpy, for use inside tasks."""

from __future__ import annotations

import math

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, out = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny), 0.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 300):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + up * d or tiny)
        c = 1 + up / c or tiny
        out *= c * d
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + down * d or tiny)
        c = 1 + down / c or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_two_sided(t: float, freedom: float) -> float:
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def incomplete_betas(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """:func:`incomplete_beta` of whole arrays: all continued fractions step together."""
    a, b, x = (np.array(v, dtype=np.float64) for v in np.broadcast_arrays(a, b, x))
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(y) + b * np.log1p(-y)) / a
    solid = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c = np.ones_like(y)
    d = 1 / solid(1 - (a + b) * y / (a + 1))
    out = d.copy()
    for m in range(1, 300):
        up = m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / solid(1 + up * d), solid(1 + up / c)
        out = out * c * d
        down = -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / solid(1 + down * d), solid(1 + down / c)
        out = out * c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    value = np.where(inside, front * out, (x >= 1).astype(float))
    return np.where(turned, 1 - value, value)


def welch(mean_a, var_a, n_a, mean_b, var_b, n_b) -> np.ndarray:
    """Two-sided p-values of Welch's t-test, of whole arrays; nan without two values a side or any spread."""
    mean_a, var_a, n_a, mean_b, var_b, n_b = (np.asarray(v, dtype=np.float64) for v in (mean_a, var_a, n_a, mean_b, var_b, n_b))
    with np.errstate(all="ignore"):
        a, b = var_a / n_a, var_b / n_b
        ok = (n_a >= 2) & (n_b >= 2) & (a + b > 0)
        a, b = np.where(ok, a, 1.0), np.where(ok, b, 1.0)
        freedom = np.where(ok, (a + b) ** 2 / (a * a / np.maximum(n_a - 1, 1) + b * b / np.maximum(n_b - 1, 1)), 1.0)
        square = np.where(ok, (mean_a - mean_b) ** 2 / (a + b), 0.0)
        return np.where(ok, incomplete_betas(freedom / 2, np.full_like(freedom, 0.5), freedom / (freedom + square)), np.nan)


def corrected_variance(mean: np.ndarray, variance: np.ndarray, expected_sd: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Variance raised by a sigmoid of how far the coefficient of variation lies below the expected one, over the fold change."""
    with np.errstate(all="ignore"):
        cv, expected = 100 * np.sqrt(variance) / mean, 100 * expected_sd / mean
        raised = cv + expected / (1 + np.exp(np.minimum(cv - expected / 2, 700))) / fold
        return (raised * mean / 100) ** 2


def loess(x: np.ndarray, y: np.ndarray, bandwidth: float = 0.3, robust: int = 2) -> np.ndarray:
    """Local linear regression with tricube weights and bisquare robustness; x ascends."""
    n = len(x)
    span = min(n, max(3, int(math.ceil(bandwidth * n))))
    weight, out = np.ones(n), np.zeros(n)
    for _ in range(robust + 1):
        for i in range(n):
            low = max(0, min(i - span // 2, n - span))
            own = slice(low, low + span)
            far = np.abs(x[own] - x[i])
            reach = far.max() or 1.0
            w = (1 - (far / (reach * 1.0001)) ** 3) ** 3 * weight[own]
            sw = w.sum()
            if sw <= 0:
                out[i] = y[i]
                continue
            mx, my = (w * x[own]).sum() / sw, (w * y[own]).sum() / sw
            sxx = (w * (x[own] - mx) ** 2).sum()
            slope = (w * (x[own] - mx) * (y[own] - my)).sum() / sxx if sxx > 1e-12 else 0.0
            out[i] = my + slope * (x[i] - mx)
        residual = np.abs(y - out)
        scale = 6 * np.median(residual)
        if scale <= 0:
            break
        weight = np.where(residual < scale, (1 - (residual / scale) ** 2) ** 2, 0)
    return out


def ratio_fit(x: np.ndarray) -> np.ndarray:
    """:func:`ratio_fits` of one matrix."""
    return ratio_fits(x[None])[0]


def ratio_fits(x: np.ndarray) -> np.ndarray:
    """Abundance of each column whose log ratios fit the median log ratios of all column pairs, by least squares; of many matrices at once.

    x: matrices by rows by columns, nan where missing. A result has the total of its x; columns without a pair are nan.
    """
    count, height, n = x.shape
    at = np.arange(count)
    logs = np.log(np.where(x > 0, x, np.nan))
    a, b = np.zeros((count, n, n)), np.zeros((count, n))
    for i in range(n):
        for j in range(i + 1, n):
            d = np.sort(logs[:, :, j] - logs[:, :, i], axis=1)  # nan last
            m = (~np.isnan(d)).sum(axis=1)
            has = m > 0
            r = np.where(has, (d[at, np.maximum(m - 1, 0) // 2] + d[at, np.minimum(m // 2, height - 1)]) / 2, 0.0)
            a[:, i, i] += has
            a[:, j, j] += has
            a[:, i, j] -= has
            a[:, j, i] -= has
            b[:, j] += r
            b[:, i] -= r
    linked = np.diagonal(a, axis1=1, axis2=2) > 0
    solved = (np.linalg.pinv(a, rcond=np.finfo(float).eps * n, hermitian=True) @ b[:, :, None])[:, :, 0]
    fit = np.where(linked, np.exp(solved), np.nan)
    total = np.nansum(np.where(linked[:, None, :], x, np.nan), axis=(1, 2))
    with np.errstate(invalid="ignore"):
        fit = fit * (total / np.nansum(fit, axis=1))[:, None]
    alone = np.where(np.isnan(x).all(axis=1), np.nan, np.nansum(x, axis=1))
    return np.where(linked.any(axis=1)[:, None], fit, alone)
