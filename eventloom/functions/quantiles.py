"""Quantiles of the chi-square distribution."""

from __future__ import annotations

from math import exp, lgamma, log


def chi2_cdf(x: float, k: float) -> float:
    """By the series of the incomplete gamma function, all of whose terms are positive."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * exp(a * log(x) - x - lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    """The least x of which ``chi2_cdf`` is ``p``, by halving."""
    lo, hi = 0.0, max(1.0, k)
    while chi2_cdf(hi, k) < p:
        lo, hi = hi, 2 * hi
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi
