"""Pivot selection: k rows of a table whose distances describe the others.

Farthest-first traversal and the density methods run over the whole table as aggregations. Methods that need all pairs of
distances work on a sample of at most SAMPLE rows, drawn by a hash of the id; its rows are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.metrics import Metric
from metricloom.operators.table import MetricTable

SAMPLE = 1_024


@dataclass(frozen=True)
class Pivot:
    id: Any
    value: Any

    def column(self) -> Column:
        """The value as a literal."""
        return literal(self.value)


def literal(value: Any) -> Column:
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple, np.ndarray)):
        # one call into the JVM instead of one for each value
        values = ", ".join(f"{float(x)!r}D" if np.isfinite(x) else f"double('{float(x)}')" for x in value)
        return F.expr(f"array({values})") if len(value) else F.array().cast("array<double>")
    return F.lit(value)


def fixed(table: MetricTable, ids: list) -> list[Pivot]:
    """The rows of these ids as pivots, in this order."""
    got = {r["id"]: plain(r["v"]) for r in table.rows().where(F.col("id").isin(ids)).dropDuplicates(["id"]).collect()}
    return [Pivot(i, got[i]) for i in ids]


def plain(v: Any) -> Any:
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    return [float(x) for x in v] if isinstance(v, (list, np.ndarray)) else v


def distances(table: MetricTable, pivots: list[Pivot]) -> list[Column]:
    return [table.metric.column(F.col("v"), p.column()) for p in pivots]


def sample(table: MetricTable, n: int = SAMPLE, seed: int = 0) -> list[Pivot]:
    """At most n rows, those with the smallest hashes, by hash: a top-k, no sort of the table."""
    rows = table.rows().withColumn("_h", F.xxhash64("id", F.lit(seed))).orderBy("_h", "id").limit(n).collect()
    return [Pivot(r["id"], plain(r["v"])) for r in rows]


def distance_matrix(metric: Metric, a: list[Pivot], b: list[Pivot]) -> np.ndarray:
    """Of bounded samples, on the driver."""
    if metric.name == "l2" and a and b:
        x, y = np.array([p.value for p in a], float), np.array([p.value for p in b], float)
        return np.sqrt(np.maximum(((x[:, None] - y[None]) ** 2).sum(2), 0)) if len(x) * len(y) * x.shape[1] < 2e7 else np.stack([np.sqrt(((y - r) ** 2).sum(1)) for r in x])
    return np.array([[metric.value(p.value, q.value) for q in b] for p in a], float).reshape(len(a), len(b))


def farthest_first(table: MetricTable, k: int, start: Any = None) -> list[Pivot]:
    """Begins with the row of smallest id (or `start`); each next pivot is the row farthest from those so far, ties to the
    smallest id. One aggregation over the table for each pivot. Stops early when every row equals a pivot."""
    rows = table.rows()
    first = rows.where(F.col("id") == start) if start is not None else rows
    got = first.agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id")).first()
    if got is None or got["id"] is None:
        return []
    out = [Pivot(got["id"], plain(got["v"]))]
    while len(out) < k:
        near = distances(table, out)
        d = F.least(*near) if len(near) > 1 else near[0]
        far = rows.select("id", "v", d.alias("d")).where("d > 0")
        best = far.agg(F.min_by(F.struct("id", "v"), F.struct(-F.col("d"), "id")).alias("x")).first()["x"]
        if best is None:
            break
        out.append(Pivot(best["id"], plain(best["v"])))
    return out


def _fft_matrix(d: np.ndarray, k: int, start: int = 0) -> list[int]:
    out, near = [start], d[start].copy()
    while len(out) < min(k, len(d)):
        i = int(near.argmax())
        if near[i] <= 0:
            break
        out.append(i)
        near = np.minimum(near, d[i])
    return out


def random_pivots(table: MetricTable, k: int, seed: int = 0) -> list[Pivot]:
    """Rows of the smallest hashes, with distance above 0 from one another."""
    out: list[Pivot] = []
    for p in sample(table, max(SAMPLE, 4 * k), seed):
        if all(table.metric.value(p.value, q.value) > 0 for q in out):
            out.append(p)
        if len(out) == k:
            break
    return out


def _components(d: np.ndarray, k: int) -> np.ndarray:
    """Principal axes (columns) of the rows of d."""
    z = d - d.mean(0)
    return np.linalg.svd(z, full_matrices=False)[2][:k].T


def pca_pivots(table: MetricTable, k: int, seed: int = 0) -> list[Pivot]:
    """Of a sample's distance matrix, for each principal axis the column with the largest share in it."""
    s = sample(table, SAMPLE // 2, seed)
    return [s[i] for i in _axis_columns(distance_matrix(table.metric, s, s), k)]


def _axis_columns(d: np.ndarray, k: int) -> list[int]:
    out: list[int] = []
    for axis in _components(d, k).T:
        out.append(next(int(i) for i in np.argsort(-np.abs(axis), kind="stable") if i not in out))
    return out


def pca_on_fft(table: MetricTable, k: int, scale: int = 10, seed: int = 0) -> list[Pivot]:
    """scale * k farthest-first candidates of a sample; those nearest in angle to the principal axes of their coordinates."""
    s = sample(table, SAMPLE, seed)
    d = distance_matrix(table.metric, s, s)
    cand = _fft_matrix(d, scale * k)
    return [s[cand[i]] for i in _axis_columns(d[:, cand], min(k, len(cand)))]


def epcaf(table: MetricTable, k: int, seed: int = 0) -> list[Pivot]:
    """10 k farthest-first candidates, ranked by their summed projections on the first 2 k principal axes."""
    s = sample(table, SAMPLE, seed)
    d = distance_matrix(table.metric, s, s)
    cand = _fft_matrix(d, 10 * k)
    weight = np.abs(_components(d[:, cand], min(2 * k, len(cand)))).sum(1)
    return [s[cand[i]] for i in np.argsort(-weight, kind="stable")[:k]]


def _radius_sum(d: np.ndarray, medoids: list[int]) -> float:
    near = d[:, medoids].argmin(1)
    own = d[np.arange(len(d)), np.array(medoids)[near]]
    return float(sum(own[near == j].max(initial=0.0) for j in range(len(medoids))))


def _swap(d: np.ndarray, medoids: list[int], rounds: int = 20) -> list[int]:
    """Swaps a medoid for a row as long as the sum of the clusters' radii falls."""
    best = _radius_sum(d, medoids)
    for _ in range(rounds):
        found = None
        for j in range(len(medoids)):
            for i in range(len(d)):
                if i not in medoids:
                    other = medoids[:j] + [i] + medoids[j + 1 :]
                    if (c := _radius_sum(d, other)) < best:
                        best, found = c, other
        if found is None:
            break
        medoids = found
    return medoids


def pam(table: MetricTable, k: int, seed: int = 0, rows: int = 128) -> list[Pivot]:
    s = sample(table, rows, seed)
    d = distance_matrix(table.metric, s, s)
    start = np.random.default_rng(seed).permutation(len(s))[:k].tolist()
    return [s[i] for i in _swap(d, start)]


def clara(table: MetricTable, k: int, seed: int = 0, samples: int = 20) -> list[Pivot]:
    """Of 20 samples of 50 + 2 k rows the medoids with the smallest sum of radii over a larger sample."""
    pool = sample(table, SAMPLE, seed)
    rng = np.random.default_rng(seed)
    best: tuple[float, list[Pivot]] = (np.inf, [])
    for _ in range(samples):
        s = [pool[i] for i in rng.permutation(len(pool))[: 50 + 2 * k]]
        d = distance_matrix(table.metric, s, s)
        got = [s[i] for i in _swap(d, list(range(min(k, len(s)))), 3)]
        cost = _radius_sum(distance_matrix(table.metric, pool, got), list(range(len(got)))) if got else np.inf
        if cost < best[0]:
            best = (cost, got)
    return best[1]


def pair_score(x: np.ndarray, y: np.ndarray, apart: float) -> float:
    """How well two pivots serve a partition by thirds of their distance ratio; x, y: distances of rows to them, apart: theirs.

    In favour: gaps of the log ratio at both cuts, even parts, rows near either pivot for their mean distance, a wide ratio.
    Against: large cover radii of the parts, and pivots nearer to or farther from each other than rows are on average."""
    n = len(x)
    tiny = 1e-12
    ratio = np.log((x + tiny) / (y + tiny))
    s = np.sort(ratio)
    at = np.array([n // 3, 2 * n // 3])
    low, high = s[at]
    if n < 9 or high <= low + tiny:
        return -np.inf
    near = np.minimum(x, y)
    mean = (x.mean() + y.mean()) / 2 + tiny
    spread = float(np.subtract(*np.quantile(s, [0.9, 0.1])))
    gaps = (s[np.minimum(at + 2, n - 1)] - s[np.maximum(at - 2, 0)]).sum() / (spread + tiny)
    parts = [(ratio < low, x), (ratio > high, y), ((ratio >= low) & (ratio <= high), near)]
    even = 1 - sum(abs(m.mean() - 1 / 3) for m, _ in parts)
    cover = sum(d[m].max(initial=0.0) for m, d in parts) / (3 * mean)
    # Weights of gaps, evenness, nearness, spread (which counts up to 4), cover radii and the pivots' distance.
    return float(1.8 * gaps + 2.0 * even + 0.7 * near.mean() / mean + 0.2 * min(spread, 4.0) - 1.6 * cover - 0.5 * abs(apart / mean - 1))


def right_up_pair(table: MetricTable, seed: int = 0, candidates: int = 64, evaluated: int = 384) -> list[Pivot]:
    """The pair of farthest-first candidates with the best `pair_score`, over rows of a sample; the first two candidates if no
    pair has one."""
    s = sorted(sample(table, max(candidates, evaluated), seed), key=lambda p: p.id)
    if len(s) < 3:
        return s
    d = distance_matrix(table.metric, s, s)
    cand = _fft_matrix(d, candidates)
    pairs = [(pair_score(d[a], d[b], d[a, b]), -i, a, b) for i, (a, b) in enumerate((a, b) for n, a in enumerate(cand) for b in cand[n + 1 :]) if d[a, b] > 0]
    best = max(pairs, default=(-np.inf, 0, *cand[:2]))
    return [s[i] for i in (best[2:] if best[0] > -np.inf else cand[:2])]


def incremental(table: MetricTable, k: int, seed: int = 0, pairs: int = 300, candidates: int = 100) -> list[Pivot]:
    """Greedy: the next pivot adds most to the sum over sample pairs of their largest pivot-distance difference."""
    s = sample(table, SAMPLE, seed)
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(s), (2, pairs))
    cand = rng.permutation(len(s))[:candidates]
    d = distance_matrix(table.metric, [s[i] for i in cand], s)
    gap = np.abs(d[:, a] - d[:, b])
    seen, out = np.zeros(pairs), []
    for _ in range(min(k, len(cand))):
        gain = np.maximum(gap, seen).sum(1)
        gain[out] = -1
        i = int(gain.argmax())
        out.append(i)
        seen = np.maximum(seen, gap[i])
    return [s[cand[i]] for i in out]


def medoid_pair(table: MetricTable, kind: str = "power", queries: list[Pivot] | None = None, radius: float | None = None, share: float = 0.25, seed: int = 0, rows: int = 256, candidates: int = 12) -> list[Pivot]:
    """Of pairs of central sample rows at least `share` of the largest distance apart, the one whose best boundary (of the
    power or log family, see `learn`) lets training queries visit the fewest rows; the farthest-first pair if none is better.
    Of equally good pairs the farther apart. Without queries a third of the sample asks, at a tenth of its largest distance."""
    from metricloom.operators import learn

    s = sorted(sample(table, rows, seed), key=lambda p: p.id)
    if len(s) < 3:
        return s
    d = distance_matrix(table.metric, s, s)
    asked = d[::3] if queries is None else distance_matrix(table.metric, queries, s)
    r = float(d.max()) / 10 if radius is None else radius
    cost = {"power": learn.power_cost, "log": learn.log_cost}[kind]
    value = lambda a, b: (cost(d[:, [a, b]], asked[:, [a, b]], r), -d[a, b])
    first = _fft_matrix(d, 2)
    if len(first) < 2:
        return [s[i] for i in first]
    best, pair = value(*first), first
    med = np.argsort(d.sum(1), kind="stable")[:candidates].tolist()
    far = share * d[np.ix_(med, med)].max()
    for i, a in enumerate(med):
        for b in med[i + 1 :]:
            if d[a, b] >= far and d[a, b] > 0 and (v := value(a, b)) < best:
                best, pair = v, [a, b]
    return [s[i] for i in pair]


def density_segments(table: MetricTable, k: int, segments: int = 20, width: str = "count") -> list[Pivot]:
    """Rows in the middle of the densest segments of the distance to the first farthest-first pivot: segments of equal count,
    narrowest first (width "count"), or of equal width, fullest first ("range")."""
    first = farthest_first(table, 1)
    if not first:
        return []
    rows = table.rows().select("id", "v", distances(table, first)[0].alias("d"))
    if width == "count":
        cuts = rows.agg(F.percentile_approx("d", [i / segments for i in range(1, segments)], 10_000)).first()[0]
        edges = sorted(set(cuts))
        seg = F.aggregate(F.array(*[F.lit(float(c)) for c in edges]), F.lit(0), lambda n, c: n + (F.col("d") >= c).cast("int")) if edges else F.lit(0)
    else:
        lo, hi = rows.agg(F.min("d"), F.max("d")).first()
        seg = F.least(F.floor((F.col("d") - lo) / ((hi - lo) / segments or 1.0)), F.lit(segments - 1))
    placed = rows.withColumn("seg", seg)
    stats = placed.groupBy("seg").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n"))
    order = [(F.col("hi") - F.col("lo")) / F.col("n"), F.col("seg")] if width == "count" else [-F.col("n"), F.col("seg")]
    top = stats.orderBy(*order).limit(k).select("seg", ((F.col("lo") + F.col("hi")) / 2).alias("mid"))
    near = placed.join(F.broadcast(top), "seg").groupBy("seg").agg(F.min(F.struct(F.abs(F.col("d") - F.col("mid")).alias("g"), "id")).alias("x"))  # k rows
    ids = [r["id"] for r in near.select(F.col("x.id").alias("id")).orderBy("id").collect()]
    return fixed(table, ids)


def density_peaks(table: MetricTable, k: int, share: float = 0.4, seed: int = 0) -> list[Pivot]:
    """Sample rows with most sample rows within `share` of the largest distance; each next one outside the earlier balls."""
    s = sample(table, SAMPLE, seed)
    d = distance_matrix(table.metric, s, s)
    r = share * d.max()
    rho = (d <= r).sum(1)
    out: list[int] = []
    for i in np.argsort(-rho, kind="stable"):
        if all(d[i, j] > r for j in out) or len(s) - len(out) <= k - len(out):
            out.append(int(i))
        if len(out) == k:
            break
    for i in _fft_matrix(d, len(s), out[0]) if len(out) < k else []:
        if i not in out and len(out) < k:
            out.append(i)
    return [s[i] for i in out]


def density_farthest(table: MetricTable, k: int, candidates: int = 20, width: str = "count") -> list[Pivot]:
    """Farthest-first among density candidates."""
    cand = density_segments(table, candidates, max(candidates, 2), width)
    return [cand[i] for i in _fft_matrix(distance_matrix(table.metric, cand, cand), k)] if cand else []


def density_peak_farthest(table: MetricTable, k: int, share: float = 0.4, seed: int = 0) -> list[Pivot]:
    """The sample row with most sample rows within `share` of the largest distance, ties to the smallest id, and from there on
    farthest first."""
    s = sorted(sample(table, SAMPLE, seed), key=lambda p: p.id)
    if not s:
        return []
    d = distance_matrix(table.metric, s, s)
    return [s[i] for i in _fft_matrix(d, k, int((d <= share * d.max()).sum(1).argmax()))]


METHODS: dict[str, Callable[..., list[Pivot]]] = {
    "fft": farthest_first, "random": random_pivots, "pca": pca_pivots, "epcaf": epcaf, "pam": pam, "clara": clara,
    "at_right_up": lambda t, k=2, **o: right_up_pair(t, **o), "incremental": incremental, "pca_on_fft": pca_on_fft,
    "power_medoid": lambda t, k=2, **o: medoid_pair(t, "power", **o), "log_medoid": lambda t, k=2, **o: medoid_pair(t, "log", **o),
    "density": density_segments, "density_peak": density_peaks, "density_peak_farthest": density_peak_farthest, "density_dispar": lambda t, k, **o: density_segments(t, k, width="range", **o),
    "density_farthest": density_farthest, "dispar_farthest": lambda t, k, **o: density_farthest(t, k, width="range", **o),
}


def select_pivots(table: MetricTable, k: int, method: str | Callable[..., list[Pivot]] = "fft", **options: Any) -> list[Pivot]:
    """By name or by a function (table, k, ...) of the user's."""
    return (method if callable(method) else METHODS[method])(table, k, **options)


def pivot_rows(spark: SparkSession, pivots: list[Pivot]) -> DataFrame:
    """(no, id, value as JSON)."""
    import json

    return spark.createDataFrame([(i, str(p.id), json.dumps(p.value)) for i, p in enumerate(pivots)], "no int, id string, value string")


def embed(table: MetricTable, pivots: list[Pivot], scalar: bool = True) -> DataFrame:
    """(id, v, pd0, pd1, ... or pd): the distances to the pivots, in one pass without a shuffle. Scalar columns keep Parquet
    statistics that an array would not have."""
    rows, d = table.rows(), distances(table, pivots)
    return rows.select("id", "v", *[c.alias(f"pd{i}") for i, c in enumerate(d)]) if scalar else rows.select("id", "v", F.array(*d).alias("pd"))
