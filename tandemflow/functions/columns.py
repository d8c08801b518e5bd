"""Scalar functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 4) -> Column:
    """Half-up rounding that gives the same double in every engine."""
    return F.floor(c * float(10**digits) + 5e-1) / float(10**digits)


def between(low: Column, high: Column, share: Column) -> Column:
    """low (1 - share) + high share as SQL's quantile_cont rounds it: the first product isn't rounded before it is added.

    The product's rounding error and the sum's are found by splitting the factors (Dekker, Knuth) and added at the end.
    """
    rest = 1 - share
    a, b = low * rest, high * share
    half = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    lh, rh = half(low), half(rest)
    ll, rl = low - lh, rest - rh
    lost = ((lh * rh - a) + lh * rl + ll * rh) + ll * rl
    total = a + b
    part = total - a
    exact = total + (((a - (total - part)) + (b - part)) + lost)
    return F.when((low == high) | (share == 0), low).when(F.abs(low) + F.abs(high) < 1e290, exact).otherwise(total)


def defined(c: Column) -> Column:
    """Null for what counts as missing in abundances: null, NaN and 0."""
    return F.when(~F.isnan(c) & (c != 0), c)


def log10_p(score: Column) -> Column:
    """p-value of a -10 log10 score."""
    return F.pow(F.lit(1e1), score / -1e1)


def identity_threshold(candidates: Column, p: float) -> Column:
    """Score above which a match among so many candidates is one by chance with less than p."""
    return 1e1 * F.log10(candidates * (0.05 / p))


def candidates_of(threshold: Column, p: float) -> Column:
    """Number of candidates that gives an identity threshold at p."""
    return F.pow(F.lit(1e1), threshold / 1e1) * (p / 0.05)


def chance_p(score: Column, candidates: Column) -> Column:
    """p-value of a score among so many candidates."""
    return F.pow(F.lit(1e1), -score / 1e1) * candidates * 0.05


def moved_threshold(threshold: Column, p_from: float, p_to: float) -> Column:
    """A threshold at one p-value, moved to another."""
    return threshold - 10 * math.log10(p_to / p_from)


def adjusted_evalue(score: Column, lowest_threshold: Column) -> Column:
    """Expectation value against the lower of identity and homology threshold."""
    return 5e-2 * F.pow(F.lit(1e1), (lowest_threshold - score) / 1e1)


def ppm_to_da(mz: Column, ppm: Column | float) -> Column:
    return mz * ppm / 1e6


def symmetric_ratio(r: Column) -> Column:
    """r - 1 from 1 up, 1 - 1 / r below: equal changes up and down are equally far from 0."""
    return F.when(r >= 1, r - 1).otherwise(1 - 1 / r)


def from_symmetric_ratio(x: Column) -> Column:
    return F.when(x >= 0, x + 1).otherwise(1 / (1 - x))


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear between two points; beyond them, the nearer point's value."""
    inside = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return F.when(x1.isNull() | (x <= x0), y0).when(x0.isNull() | (x >= x1), y1).otherwise(inside)


def legacy_percentile(values: Column, p: float) -> Column:
    """Percentile at position p (n + 1) of an array, clamped to the ends."""
    s = F.array_sort(values)
    n = F.size(values)
    at = p * (n + 1)
    low = F.floor(at).cast("int")
    between = F.element_at(s, low) + (at - low) * (F.element_at(s, low + 1) - F.element_at(s, low))
    return F.when(n == 0, None).when(at < 1, F.element_at(s, 1)).when(at >= n, F.element_at(s, -1)).otherwise(between)


def z_quantile(p: Column) -> Column:
    """Standard normal quantile by a rational approximation (absolute error below 4.5e-4)."""
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return F.when(p < 0.5, -z).otherwise(z)


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal p-value, by a rational approximation of erfc (relative error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    series = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        series = c + t * series
    return t * F.exp(-x * x + series)


def first_match(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first alternative pattern that matches; null without one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))
