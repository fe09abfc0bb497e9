"""Noise scales for Gaussian releases under (epsilon, delta) differential privacy."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

#: Sensitivities: of a count, of within-group pairs, and of a size histogram under add-or-remove of a child row.
COUNT, PAIRS, SIZES = 1.0, 2.0, math.sqrt(2.0)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def gamma(epsilon: float, delta: float) -> float:
    """The largest g in [0, 1000] with cdf(g/2 - epsilon/g) - e^epsilon cdf(-g/2 - epsilon/g) <= delta."""
    if epsilon <= 0 or not 0 < delta < 1:
        raise ValueError("epsilon must be positive and delta between 0 and 1")

    def spent(g: float) -> float:
        return normal_cdf(g / 2 - epsilon / g) - math.exp(epsilon) * normal_cdf(-g / 2 - epsilon / g)

    lo, hi = 0.0, 1000.0
    while hi - lo > 1e-10:
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if spent(mid) <= delta:
            lo = mid
        else:
            hi = mid
    return lo


def equal_sigma(epsilon: float, delta: float, n_queries: int, sensitivity: float = COUNT) -> float:
    """The scale of each of n queries that share the budget alike."""
    return sensitivity * math.sqrt(2.0 * n_queries) / gamma(epsilon, delta)


def weighted_sigmas(
    epsilon: float, delta: float, sensitivities: Mapping[str, float], weights: Mapping[str, float]
) -> dict[str, float]:
    """Scales for shares of the squared budget in proportion to weight times squared sensitivity."""
    g2 = gamma(epsilon, delta) ** 2
    whole = sum(weights.get(q, 1.0) * s * s for q, s in sensitivities.items())
    return {q: s * math.sqrt(2.0 * whole / (g2 * weights.get(q, 1.0) * s * s)) for q, s in sensitivities.items()}


def split_sigmas(
    epsilon: float, delta: float, one_way: Sequence[str], joint: Sequence[str], w_one: float, w_joint: float
) -> dict[str, float]:
    """Scales for one-way and joint queries of relative weights; sum of 1/sigma^2 is gamma^2 / 2."""
    weights = dict.fromkeys(one_way, w_one) | dict.fromkeys(joint, w_joint)
    return weighted_sigmas(epsilon, delta, dict.fromkeys(weights, COUNT), weights)


def delta_of(leaf_rows: int) -> float:
    return 1.0 / leaf_rows


def tau_of(p95: float, lo: int = 12, hi: int = 1024) -> int:
    """The group-size cap from the 95th percentile of the sizes of groups that have rows."""
    return int(min(max(p95, lo), hi))


def half_even(x: float) -> int:
    return round(x)


def geometric_bins(most: int, bins: int = 12, least: int = 1) -> tuple[list[int], list[int]]:
    """(edges, representatives): strictly rising edges in geometric steps from `least`.

    A bin is represented by the geometric midpoint of its first and last size.
    """
    if most < least:
        raise ValueError("most must not be below least")
    edges = {least}
    for k in range(1, bins):
        edges.add(half_even(least * (most / least) ** (k / bins)))
    found = sorted(e for e in edges if least <= e <= most)
    return found, _middles(found, most)


def hybrid_bins(tau: int, most: int, tail: int = 8, least: int = 1) -> tuple[list[int], list[int]]:
    """(edges, representatives): every size up to tau, then a geometric tail up to most."""
    exact = list(range(least, tau + 1))
    if most <= tau:
        return exact, list(exact)
    edges, reps = geometric_bins(most, tail, tau + 1)
    return exact + edges, exact + reps


def _middles(edges: Sequence[int], most: int) -> list[int]:
    ends = [*(e - 1 for e in edges[1:]), most]
    return [
        max(a, min(b, half_even(math.sqrt(a * b)) if a else (a + b) // 2)) for a,
        b in zip(edges, ends, strict=True)
    ]


def accepted_total(noisy: float, fallback: float, lo: float = 0.0) -> float:
    """A noisy total if it is finite, above lo and within a factor of 100 of the fallback; else the fallback."""
    fine = math.isfinite(noisy) and noisy > lo and 0.01 * fallback <= noisy <= 100 * fallback
    return noisy if fine else fallback


#: The mean of the positive part of a standard normal, by which clipping at 0 lifts an empty cell.
CLIP_LIFT = 0.39894


def debiased(values: Sequence[float], sigma: float, kappa: float = CLIP_LIFT) -> list[float]:
    """Cells of a clipped noisy histogram less kappa sigma, not below 0."""
    return [max(v - kappa * sigma, 0.0) for v in values]
