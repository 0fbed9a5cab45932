"""Statistics of evaluations that have no closed SQL form. They work on per-query deltas, which are few."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def bootstrap_ci(deltas, b: int = 10_000, seed: int = 7, alpha: float = 0.05) -> tuple[float, float, float]:
    """Mean and percentile interval of resampled means; zeros without data."""
    x = np.asarray(deltas, float)
    if not len(x):
        return 0.0, 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = x[rng.integers(0, len(x), (b, len(x)))].mean(axis=1)
    low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(x.mean()), float(low), float(high)


def paired_permutation(deltas, b: int = 10_000, seed: int = 7) -> float:
    """Two-sided sign-flip p value: all sign patterns up to 20 deltas, else sampled ones with the +1 correction."""
    x = np.asarray(deltas, float)
    if not len(x) or not np.any(x):
        return 1.0
    seen = abs(x.sum()) - 1e-12
    if len(x) <= 20:
        n = len(x)
        hits = 0
        for lo in range(0, 1 << n, 1 << 14):
            codes = np.arange(lo, min(1 << n, lo + (1 << 14)))
            signs = 1 - 2 * ((codes[:, None] >> np.arange(n)) & 1)
            hits += int((np.abs(signs @ x) >= seen).sum())
        return hits / (1 << n)
    rng = np.random.default_rng(seed)
    signs = rng.choice((-1, 1), (b, len(x)))
    return (int((np.abs(signs @ x) >= seen).sum()) + 1) / (b + 1)


def benjamini_hochberg(p, alpha: float = 0.05) -> tuple[list[float], list[bool]]:
    """Step-up adjusted p values and rejections."""
    x = np.asarray(p, float)
    m = len(x)
    order = np.argsort(x, kind="stable")
    adjusted = np.minimum.accumulate((x[order] * m / np.arange(1, m + 1))[::-1])[::-1].clip(max=1)
    out = np.empty(m)
    out[order] = adjusted
    return out.tolist(), (out <= alpha).tolist()


def minimum_detectable_effect(n: int, sd: float, alpha: float = 0.05, power: float = 0.8) -> float:
    if n <= 0 or sd <= 0:
        return math.inf if n <= 0 else 0.0
    z = NormalDist().inv_cdf
    return (z(1 - alpha / 2) + z(power)) * sd / math.sqrt(n)


def achieved_power(effect: float, n: int, sd: float, alpha: float = 0.05) -> float:
    if n <= 0 or sd <= 0:
        return 0.0
    nd = NormalDist()
    shift = abs(effect) * math.sqrt(n) / sd
    return 1 - nd.cdf(nd.inv_cdf(1 - alpha / 2) - shift)
