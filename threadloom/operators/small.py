"""Driver-side steps over tables whose size is bounded by the number of labels or requests."""

from __future__ import annotations

import numpy as np


def leaf_order(features: np.ndarray, method: str = "ward") -> list[int]:
    """Leaf order of an agglomerative clustering by Ward or average linkage.

    ``features`` has a row per label. Distances are updated by the Lance-Williams rule; ties join the
    clusters met first, and the cluster met first stands left.
    """
    n = len(features)
    if n == 0:
        return []
    x = np.asarray(features, float)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    if method != "ward":
        d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    size, order, live = [1] * n, [[i] for i in range(n)], set(range(n))
    while len(live) > 1:
        at = sorted(live)
        sub = d[np.ix_(at, at)]
        i, j = (at[k] for k in np.unravel_index(int(sub.argmin()), sub.shape))
        i, j = min(i, j), max(i, j)
        for k in live - {i, j}:
            if method == "ward":
                a, b, c = size[i], size[j], size[k]
                d[i, k] = d[k, i] = ((a + c) * d[i, k] + (b + c) * d[j, k] - c * d[i, j]) / (a + b + c)
            else:
                d[i, k] = d[k, i] = (size[i] * d[i, k] + size[j] * d[j, k]) / (size[i] + size[j])
        size[i] += size[j]
        order[i] += order[j]
        live.discard(j)
    return order[live.pop()]


def packed(costs: list[int], budget: int) -> list[bool]:
    """Which requests fit a token budget, in order, those too large for the rest being skipped."""
    left, out = budget, []
    for c in costs:
        fits = c <= left
        out.append(fits)
        left -= c if fits else 0
    return out
