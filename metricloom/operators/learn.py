"""Learners of cuts, directions and coordinate maps for cell indexes.

They choose on a bounded sample of embedded rows (and of training queries) on the driver; what they choose only changes how
much a search prunes, never its result, since every index keeps the true bounds of its cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations, product

import numpy as np
from pyspark.sql import functions as F

from metricloom.functions import transforms as X
from metricloom.operators import index as I
from metricloom.operators.pivots import SAMPLE, Pivot, embed
from metricloom.operators.table import MetricTable

#: Tried exponents and quantiles of the grid searches.
RHOS = (-4.0, -2.0, -1.0, 1.0, 2.0, 4.0)
QUANTILES = (0.3, 0.4, 0.5, 0.6, 0.7)


def coordinates(table: MetricTable, pivots: list[Pivot], rows: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """Pivot distances of the rows with the smallest hashes (rows, pivots)."""
    got = embed(table, pivots, scalar=False).withColumn("_h", F.xxhash64("id", F.lit(seed))).orderBy("_h", "id").limit(rows).select("pd").collect()
    return np.array([r["pd"] for r in got], float).reshape(len(got), len(pivots))


def median_cut(score: np.ndarray) -> float:
    """The value of rank n / 2."""
    return float(np.sort(score)[len(score) // 2])


def gap_cut(score: np.ndarray) -> float:
    """Middle of the widest gap."""
    s = np.sort(score)
    i = int(np.diff(s).argmax()) if len(s) > 1 else 0
    return float((s[i] + s[min(i + 1, len(s) - 1)]) / 2)


def otsu_cut(score: np.ndarray) -> float:
    """The cut with the largest variance between its sides."""
    s = np.sort(score)
    n = np.arange(1, len(s))
    if not len(n):
        return float(s[0])
    left = np.cumsum(s)[:-1]
    between = n * (len(s) - n) * (left / n - (s.sum() - left) / (len(s) - n)) ** 2
    between[s[1:] == s[:-1]] = -1
    i = int(between.argmax())
    return float((s[i] + s[i + 1]) / 2)


CUTS: dict[str, Callable[[np.ndarray], float]] = {"median": median_cut, "max_gap": gap_cut, "otsu": otsu_cut}


def excluded(score: np.ndarray, cut: float, reach: np.ndarray) -> float:
    """Expected share of rows that a query at a sampled row's place leaves out, if its ball covers `reach` to both sides."""
    low = score < cut
    return float(np.mean(np.where(score + reach < cut, (~low).mean(), np.where(score - reach >= cut, low.mean(), 0.0))))


def expected_exclusion_cut(score: np.ndarray, reach: float | np.ndarray, steps: int = 19) -> float:
    """Of evenly spaced quantiles the one with the highest expected exclusion, ties to the first."""
    cuts = np.quantile(score, np.arange(1, steps + 1) / (steps + 1), method="nearest")
    return float(cuts[int(np.argmax([excluded(score, c, np.broadcast_to(reach, score.shape)) for c in cuts]))])


def exclusion_curve(score: np.ndarray, reach: float, steps: int = 19) -> list[tuple[float, float]]:
    """(cut, expected exclusion) at each quantile."""
    cuts = np.quantile(score, np.arange(1, steps + 1) / (steps + 1), method="nearest")
    return [(float(c), excluded(score, c, np.full(len(score), reach))) for c in cuts]


def directions(k: int, kind: str = "all", xs: np.ndarray | None = None, steps: int = 4) -> list[list[float]]:
    """Weight vectors over k pivots: axes ("vp"), sums and differences of pairs ("cgh"), principal axes of xs ("pca"), a grid
    on the sphere ("sphere"), or all."""
    out: list[list[float]] = []
    if kind in ("vp", "all"):
        out += np.eye(k).tolist()
    if kind in ("cgh", "all"):
        for a, b in combinations(range(k), 2):
            for sign in (1.0, -1.0):
                w = [0.0] * k
                w[a], w[b] = 1.0, sign
                out.append(w)
    if kind in ("pca", "all") and xs is not None and len(xs) > 1:
        out += np.linalg.svd(xs - xs.mean(0), full_matrices=False)[2].tolist()
    if kind == "sphere":
        grid = [g for g in product(range(-steps, steps + 1), repeat=k) if any(g) and next(x for x in g if x) > 0 and np.gcd.reduce(g) == 1]
        out += [(np.array(g) / np.linalg.norm(g)).tolist() for g in grid]
    return out


def best_directions(xs: np.ndarray, r: float, n: int = 2, kind: str = "all") -> list[list[float]]:
    """The n directions of highest expected exclusion at radius r, none nearly parallel to an earlier one."""
    def score(w: list[float]) -> float:
        s = xs @ np.array(w)
        return excluded(s, median_cut(s), np.full(len(s), r * np.abs(w).sum()))

    out: list[list[float]] = []
    for w in sorted(directions(xs.shape[1], kind, xs), key=score, reverse=True):
        if all(abs(np.dot(w, v)) < 0.95 * np.linalg.norm(w) * np.linalg.norm(v) for v in out):
            out.append(w)
        if len(out) == n:
            break
    return out


def complete_linear(xs: np.ndarray, r: float, n: int = 2, parts: int = 2, kind: str = "all") -> I.Level:
    return I.linear(best_directions(xs, r, n, kind), parts)


def projection(xs: np.ndarray, cut: str = "median", queries: np.ndarray | None = None) -> I.Level:
    """First principal axis of the coordinates (with queries: of rows and queries together), cut by a rule of CUTS."""
    data = xs if queries is None else np.concatenate([xs, queries])
    w = np.linalg.svd(data - data.mean(0), full_matrices=False)[2][0]
    return I.linear([w.tolist()], thresholds=((CUTS[cut](xs @ w),),), name="projection")


def density_valley(xs: np.ndarray) -> I.Level:
    """Of principal axes, pivot axes and pairs the cut with the largest gap / range * sqrt(balance)."""
    best: tuple[float, list[float], float] = (-1.0, np.eye(xs.shape[1])[0].tolist(), float(np.median(xs[:, 0])))
    for w in directions(xs.shape[1], "all", xs):
        s = np.sort(xs @ np.array(w))
        spread = s[-1] - s[0]
        if spread <= 0:
            continue
        n = np.arange(1, len(s))
        value = np.diff(s) / spread * np.sqrt(np.minimum(n, len(s) - n) / len(s))
        i = int(value.argmax())
        if value[i] > best[0]:
            best = (float(value[i]), list(w), float((s[i] + s[i + 1]) / 2))
    return I.linear([best[1]], thresholds=((best[2],),), name="density_valley")


def density_envelope(xs: np.ndarray, eps: float | None = None, min_samples: int = 4, margin: float = 0.02) -> I.Level:
    """Boxes about the dense clusters of the sample's coordinates, widened by a margin; eps by default from the distances to
    the min_samples-th neighbours."""
    d = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(2))
    eps = eps or float(np.quantile(np.sort(d, 1)[:, min(min_samples, len(d) - 1)], 0.9))
    near = d <= eps
    core = near.sum(1) > min_samples
    label = np.full(len(xs), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], label.max() + 1
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & (label < 0)):
                    label[j] = label[i]
                    if core[j]:
                        todo.append(j)
    groups = [xs[label == c] for c in range(label.max() + 1)]
    if not groups:
        return I.vp(range(xs.shape[1]))
    lo, hi = np.stack([g.min(0) for g in groups]), np.stack([g.max(0) for g in groups])
    pad = margin * np.maximum(hi - lo, 1e-12)
    return I.boxes(lo - pad, hi + pad)


def kmeans_cuts(score: np.ndarray, parts: int = 2, rounds: int = 50) -> tuple[float, ...]:
    """Cuts midway between the centres of a one-dimensional k-means, seeded by the peaks of a histogram."""
    lo, hi = float(score.min()), float(score.max())
    if hi <= lo:
        return ()
    bins = max(min(len(score) // 10, 50 * parts), parts)
    n, edges = np.histogram(score, bins)
    peak = [i for i in range(bins) if n[i] > 0 and n[i] >= n[max(i - 1, 0)] and n[i] >= n[min(i + 1, bins - 1)]]
    peak = sorted(sorted(peak, key=lambda i: -n[i])[:parts])
    c = np.array([(edges[i] + edges[i + 1]) / 2 for i in peak])
    for _ in range(rounds):
        into = np.abs(score[:, None] - c[None]).argmin(1)
        new = np.array([score[into == j].mean() if (into == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c, atol=1e-12):
            break
        c = new
    c = np.unique(c)
    return tuple(((c[1:] + c[:-1]) / 2).tolist())


def clustered_vp(xs: np.ndarray, parts: int = 2) -> I.Level:
    """Vantage-point rings by one-dimensional k-means for each pivot; pivots that don't split are left whole."""
    return I.vp_cut([kmeans_cuts(xs[:, j], parts) for j in range(xs.shape[1])], range(xs.shape[1]))


def pivot_wise(xs: np.ndarray, r: float, parts: int = 2) -> I.Level:
    """Cuts pivot by pivot at valleys of a histogram with bins of r / 10; where nothing splits, r shrinks to a quarter of the
    range."""
    def cuts(s: np.ndarray) -> tuple[float, ...]:
        spread = s.max() - s.min()
        if spread <= 0:
            return ()
        width = r if spread > 2 * r else spread / 4
        inner = np.arange(s.min() + width, s.max() - width, max(width / 10, spread / 1000))
        if not len(inner):
            return ()
        inside = np.array([((s > t - width) & (s <= t + width)).mean() for t in inner])
        out: list[float] = []
        for i in np.argsort(inside, kind="stable"):
            if all(abs(inner[i] - t) > 2 * width for t in out):
                out.append(float(inner[i]))
            if len(out) == parts - 1:
                break
        return tuple(sorted(out))

    return I.vp_cut([cuts(xs[:, j]) for j in range(xs.shape[1])], range(xs.shape[1]))


def iat_cuts(xs: np.ndarray, a: int = 0, b: int = 1, mode: str = "balanced", scale: float = 1.0) -> tuple[float, float]:
    """Two cuts of the ratio: its thirds ("quantile"), or of 24 candidate pairs the least largest cover radius plus a quarter
    of the mean one plus the imbalance ("balanced")."""
    ratio = np.where(xs[:, b] == 0, I.BIG, xs[:, a] / np.where(xs[:, b] == 0, 1, xs[:, b]))
    thirds = tuple(float(np.quantile(ratio, q, method="lower")) for q in (1 / 3, 2 / 3))
    if mode == "quantile":
        return thirds
    best = (np.inf, thirds)
    for lo, hi in product((0.15, 0.2, 0.25, 0.3, 0.35, 0.4), (0.55, 0.65, 0.75, 0.85)):
        c1, c2 = (float(np.quantile(ratio, q, method="lower")) for q in (lo, hi))
        part = (ratio >= c1).astype(int) + (ratio >= c2)
        cover = [min(xs[part == j, a].max(initial=0), xs[part == j, b].max(initial=0)) for j in range(3)]
        share = np.bincount(part, minlength=3) / len(part)
        value = max(cover) + 0.25 * np.mean(cover) + scale * xs.max() * (share.max() - share.min())
        if value < best[0]:
            best = (value, (c1, c2))
    return best[1]


def visit_cost(level: I.Level, score_lo: np.ndarray, score_hi: np.ndarray, cuts: Sequence[float], counts: np.ndarray) -> float:
    """Mean share of rows in the cells that query intervals meet."""
    edges = np.r_[-np.inf, cuts, np.inf]
    meets = (score_lo[:, None] < edges[None, 1:]) & (score_hi[:, None] >= edges[None, :-1])
    return float((meets * (counts / max(1, counts.sum()))[None]).sum(1).mean())


def _grid(xs: np.ndarray, queries: np.ndarray, r: float, make: Callable[..., I.Level], options: Sequence[tuple], score: Callable[..., np.ndarray], holdout: float = 0.3, top: int = 16) -> I.Level:
    """Grid search: the cheapest cuts on training queries, the best of the top ones on those held out."""
    n = max(1, int(len(queries) * (1 - holdout)))
    tried = []
    for option in options:
        s = score(xs, *option)
        s = s[np.isfinite(s)]
        if len(s) < 2 or s.max() <= s.min():
            continue
        for q in QUANTILES:
            cut = float(np.quantile(s, q, method="nearest"))
            level = make(*option, cut)
            tried.append((_cost(level, cut, queries[:n], r, s), option, cut, s))
    if not tried:
        return I.gh(0, 1)
    tried.sort(key=lambda t: t[0])
    held = queries[n:] if n < len(queries) else queries
    best = min(tried[:top], key=lambda t: _cost(make(*t[1], t[2]), t[2], held, r, t[3]))
    return make(*best[1], best[2])


def _cost(level: I.Level, cut: float, queries: np.ndarray, r: float, s: np.ndarray) -> float:
    lo, hi = level.bounds(queries, np.full(len(queries), r))
    return visit_cost(level, lo[:, 0], hi[:, 0], [cut], np.array([(s < cut).sum(), (s >= cut).sum()]))


def _angles(n: int = 12) -> list[tuple[float, float]]:
    return [(float(np.cos(t)), float(np.sin(t))) for t in np.pi * np.arange(n) / n]


def learned_power(xs: np.ndarray, queries: np.ndarray, r: float) -> I.Level:
    """Exponent, direction and cut of a power-distance index by grid search."""
    options = [(rho, w) for rho in RHOS for w in _angles()]
    score = lambda x, rho, w: np.maximum(x[:, :2], X.EPS) ** rho @ np.array(w)
    return _grid(xs, queries, r, lambda rho, w, cut: I.power(rho, w, thresholds=(cut,)), options, score)


def learned_log(xs: np.ndarray, queries: np.ndarray, r: float) -> I.Level:
    """Direction and cut of a log-distance index by grid search."""
    score = lambda x, w: np.log(np.maximum(x[:, :2], X.EPS)) @ np.array(w)
    return _grid(xs, queries, r, lambda w, cut: I.log(w, thresholds=(cut,)), [(w,) for w in _angles()], score)


def _least_cost(xs: np.ndarray, queries: np.ndarray, r: float, make: Callable[..., I.Level], options: Sequence[tuple], score: Callable[..., np.ndarray]) -> float:
    best = 1.0
    for option in options:
        s = score(xs, *option)
        s = s[np.isfinite(s)]
        if len(s) > 1 and s.max() > s.min():
            for q in QUANTILES:
                cut = float(np.quantile(s, q, method="nearest"))
                best = min(best, _cost(make(*option, cut), cut, queries, r, s))
    return best


def power_cost(xs: np.ndarray, queries: np.ndarray, r: float) -> float:
    """Share of rows that queries visit at the best boundary of the power family."""
    options = [(rho, w) for rho in RHOS for w in _angles(4)]
    return _least_cost(xs, queries, r, lambda rho, w, cut: I.power(rho, w, thresholds=(cut,)), options, lambda x, rho, w: np.maximum(x, X.EPS) ** rho @ np.array(w))


def log_cost(xs: np.ndarray, queries: np.ndarray, r: float) -> float:
    """As `power_cost`, for the log family."""
    return _least_cost(xs, queries, r, lambda w, cut: I.log(w, thresholds=(cut,)), [(w,) for w in _angles(8)], lambda x, w: np.log(np.maximum(x, X.EPS)) @ np.array(w))


def expected_exclusion(xs: np.ndarray, r: float) -> I.Level:
    """Of all directions the one whose best cut has the highest expected exclusion."""
    best: tuple[float, list[float], float] = (-1.0, [1.0], 0.0)
    for w in directions(xs.shape[1], "all", xs):
        s, reach = xs @ np.array(w), r * np.abs(w).sum()
        cut = expected_exclusion_cut(s, reach)
        if (e := excluded(s, cut, np.full(len(s), reach))) > best[0]:
            best = (e, list(w), cut)
    return I.linear([best[1]], thresholds=((best[2],),), name="expected_exclusion")


def pct_centres(xs: np.ndarray, k: int, method: str = "kmeans", seed: int = 0, rounds: int = 500, tol: float = 1e-4) -> np.ndarray:
    """Centres in pivot space by k-means or, as rows of the sample, by PAM."""
    rng = np.random.default_rng(seed)
    if method == "pam":
        d = np.sqrt(((xs[:256, None] - xs[None, :256]) ** 2).sum(2))
        m = [int(d.sum(1).argmin())]
        while len(m) < min(k, len(d)):
            m.append(int(np.maximum(d[:, m].min(1)[:, None] - d, 0).sum(0).argmax()))
        for _ in range(20):
            into = d[:, m].argmin(1)
            new = [int(np.flatnonzero(into == j)[d[np.ix_(into == j, into == j)].sum(1).argmin()]) if (into == j).any() else m[j] for j in range(len(m))]
            if new == m:
                break
            m = new
        return xs[m]
    c = xs[rng.permutation(len(xs))[:k]]
    for _ in range(rounds):
        into = ((xs[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.stack([xs[into == j].mean(0) if (into == j).any() else c[j] for j in range(len(c))])
        moved = np.sqrt(((new - c) ** 2).sum(1)).max()
        c = new
        if moved <= tol:
            break
    return c
