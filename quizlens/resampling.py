"""Driver-side resampling of sufficient statistics; nothing here sees a row of the corpus.

Resampled statistics are averages over items, so items with equal outcome vectors are
exchangeable: a multinomial over the distinct vectors, with their counts as weights, has exactly the
distribution of resampling the items. Cost depends on the number of distinct vectors only.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
TINY = 1e-12  # values nearer to zero count as zero
MAX_PLAYERS = 14  # 16,384 coalitions; beyond that the presented items, not this module, are the limit


def chi_square_tail(x: float, dof: int) -> float:
    """P(X >= x): the regularised upper incomplete gamma function, by series or continued fraction."""
    a, y = dof / 2, x / 2
    if y <= 0:
        return 1.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - front * total)
    b = y + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def percentiles(replicates: np.ndarray, alpha: float) -> tuple[float, float]:
    low, high = np.quantile(replicates, [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)


def corrected_levels(point: float, replicates: np.ndarray, left_out: np.ndarray, counts: np.ndarray, alpha: float) -> np.ndarray:
    """Quantile levels of a bias-corrected, accelerated interval; ``counts`` says how many items have each left-out value.

    The bias is the normal score of the point's mid-rank among the replicates, kept half a replicate away from
    either end; the acceleration is the left-out values' skewness over six root n, none where they do not vary. Both are thus
    always defined, and where they are zero the levels are the plain ones. Levels whose scale turns negative are at the end.
    """
    size = len(replicates)
    rank = (np.sum(replicates < point) + np.sum(replicates <= point)) / 2
    bias = _NORMAL.inv_cdf(float(np.clip(rank, 0.5, size - 0.5)) / size)
    away = np.average(left_out, weights=counts) - left_out
    spread = counts @ away**2
    bend = counts @ away**3 / (6 * spread**1.5) if spread > TINY**2 else 0.0
    shifted = bias + np.array([_NORMAL.inv_cdf(alpha / 2), _NORMAL.inv_cdf(1 - alpha / 2)])
    scale = 1 - bend * shifted
    ends = np.array([0.0, 1.0])
    return np.array([_NORMAL.cdf(float(bias + z / s)) if s > 0 else e for z, s, e in zip(shifted, scale, ends)])


def bca_interval(point: float, replicates: np.ndarray, left_out: np.ndarray, counts: np.ndarray, alpha: float) -> tuple[float, float]:
    low, high = np.quantile(replicates, np.sort(corrected_levels(point, replicates, left_out, counts, alpha)))
    return float(low), float(high)


def resampled_means(rng: np.random.Generator, values: np.ndarray, counts: np.ndarray, draws: int) -> np.ndarray:
    """Bootstrap replicates of the mean of ``values`` (one row per distinct vector), ``counts`` items each."""
    n = int(counts.sum())
    chunk = max(1, (1 << 22) // max(1, len(counts)))
    parts = [rng.multinomial(n, counts / n, size=min(chunk, draws - at)) @ values / n for at in range(0, draws, chunk)]
    return np.concatenate(parts)


def left_out_means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean without one item, for an item of each distinct vector."""
    n = int(counts.sum())
    if n < 2:
        raise ValueError("leaving one out needs two items")
    return (counts @ values - values) / (n - 1)


def bootstrap_p(point: float, replicates: np.ndarray) -> float:
    """Two-sided p from the share of replicates on the other side of zero."""
    if not len(replicates) or abs(point) <= TINY or np.all(np.abs(replicates) <= TINY):
        return 1.0
    beyond = int(np.sum(replicates * math.copysign(1, point) <= TINY))
    return min(1.0, 2 * (1 + beyond) / (len(replicates) + 1))


def randomisation_p(point: float, simulated: np.ndarray) -> float:
    """(1 + simulated values at least as far from zero) / (1 + number of them)."""
    return (1 + int(np.sum(np.abs(simulated) >= abs(point) - TINY))) / (1 + len(simulated))


def shapley_weights(players: int) -> np.ndarray:
    """Row i times the vector of coalition accuracies (by bit mask) is the drop that player i causes.

    Among the s others that a mask holds, player i comes next in 1 of players * C(players - 1, s) equally likely orders; it
    counts for the mask without i, and against the one with it.
    """
    if not 1 <= players <= MAX_PLAYERS:
        raise ValueError(f"between 1 and {MAX_PLAYERS} players are supported")
    masks = np.arange(1 << players)
    held = (masks >> np.arange(players)[:, None]) & 1  # player by mask
    others = held.sum(axis=0) - held
    orders = players * np.array([math.comb(players - 1, s) for s in range(players)])
    return (1 - 2 * held) / orders[others]
