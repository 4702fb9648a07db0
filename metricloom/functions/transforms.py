"""Maps of pivot distances and the intervals that a query ball covers under them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distances below this count as this where a map has a pole at 0.
EPS = 1e-12


def power(d: Column, rho: float) -> Column:
    """d ** rho; rho must not be 0. For a negative rho a distance of 0 counts as EPS."""
    if rho == 0:
        raise ValueError("rho must not be 0")
    return F.pow(F.when(d == 0, EPS).otherwise(d) if rho < 0 else d, F.lit(float(rho)))


def log(d: Column) -> Column:
    """ln d, d at least EPS."""
    return F.ln(F.greatest(d, F.lit(EPS)))


def linear(terms: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum; terms of weight 0 are left out."""
    used = [t * float(w) for t, w in zip(terms, weights, strict=True) if w]
    out = F.lit(0.0)
    for t in used:
        out = out + t
    return out


def ball(d: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to a pivot that points within r of a query may have, if the query's is d."""
    return np.maximum(d - r, 0.0), d + r


def power_interval(lo: np.ndarray, hi: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Image of [lo, hi]; a negative rho turns it round, with infinity at 0."""
    with np.errstate(divide="ignore"):
        if rho > 0:
            return lo**rho, hi**rho
        return np.maximum(hi, EPS) ** rho, np.where(lo <= EPS, np.inf, np.maximum(lo, EPS) ** rho)


def log_interval(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(lo <= EPS, -np.inf, np.log(np.maximum(lo, EPS))), np.log(np.maximum(hi, EPS))


def linear_interval(lo: np.ndarray, hi: np.ndarray, weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Range of the weighted sum over boxes (n, k), by interval arithmetic. Undefined bounds are infinite."""
    a, b = np.zeros(len(lo)), np.zeros(len(lo))
    with np.errstate(invalid="ignore"):
        for j, w in enumerate(weights):
            if w > 0:
                a, b = a + w * lo[:, j], b + w * hi[:, j]
            elif w < 0:
                a, b = a + w * hi[:, j], b + w * lo[:, j]
    return np.where(np.isnan(a), -np.inf, a), np.where(np.isnan(b), np.inf, b)


def intersects(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Closed intervals."""
    return (lo1 <= hi2) & (lo2 <= hi1)


def contains(lo: Column, hi: Column, x: Column) -> Column:
    return (lo <= x) & (x <= hi)
