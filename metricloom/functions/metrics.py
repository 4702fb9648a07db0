"""Distance functions as column expressions.

A `Metric` pairs a Column builder, which Catalyst compiles into the plan, with a Python function on plain values, used on the
driver for bounded samples. Distances of null values, of null elements and of vectors of different lengths are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from metricloom.functions.sequences import WeightMatrix


@dataclass(frozen=True)
class Metric:
    """column(a, b) and value(a, b) compute the same distance. triangle: whether it obeys the triangle inequality, without
    which no pruning is sound."""

    name: str
    column: Callable[[Column, Column], Column]
    value: Callable[[Any, Any], float]
    triangle: bool = True


def _terms(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, term))


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def l1(a: Column, b: Column) -> Column:
    return _total(_terms(a, b, lambda x, y: F.abs(x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_total(_terms(a, b, lambda x, y: (x - y) * (x - y))))


def linf(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_max(_terms(a, b, lambda x, y: F.abs(x - y))), F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)))


def lp(p: float) -> Callable[[Column, Column], Column]:
    """p >= 1."""
    if p < 1:
        raise ValueError("p must be at least 1")
    return lambda a, b: F.pow(_total(_terms(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def fixed(kind: str, dim: int) -> Callable[[Column, Column], Column]:
    """l1, l2 or linf for vectors of `dim` values, unrolled: compiled with its stage, while the general form is interpreted for
    each element. It takes long to compile for many dimensions, so use it up to 16 or so. Vectors of another length have a null
    distance."""

    def column(a: Column, b: Column) -> Column:
        gaps = [a.getItem(i) - b.getItem(i) for i in range(dim)]
        if kind == "linf":
            out = F.abs(gaps[0]) if dim == 1 else F.greatest(*[F.abs(g) for g in gaps])
        else:
            terms = [F.abs(g) if kind == "l1" else g * g for g in gaps]
            while len(terms) > 1:  # a balanced sum keeps the expression flat
                terms = [x + y for x, y in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) - len(terms) % 2 :]
            out = F.sqrt(terms[0]) if kind == "l2" else terms[0]
        return F.when((F.size(a) == dim) & (F.size(b) == dim), out)

    return column


def edit(a: Column, b: Column) -> Column:
    """Levenshtein distance, unit costs."""
    return F.levenshtein(a, b).cast("double")


def partial_l2(start: int, end: int) -> Callable[[Column, Column], Column]:
    """L2 over the dimensions start (from 0) to end, exclusive."""
    return lambda a, b: l2(F.slice(a, start + 1, end - start), F.slice(b, start + 1, end - start))


def hamming(matrix: WeightMatrix) -> Callable[[Column, Column], Column]:
    """Sum of the weights of opposite symbols. Fragments of different lengths have a null distance."""

    def column(a: Column, b: Column) -> Column:
        weights, x, y = matrix.column(), F.upper(a), F.upper(b)
        same = F.length(x) == F.length(y)
        pairs = F.zip_with(F.split(x, ""), F.split(y, ""), lambda s, t: F.when(s == t, F.lit(0.0)).otherwise(F.coalesce(F.element_at(weights, F.concat(s, t)), F.lit(matrix.other))))
        return F.when(same, F.when(F.length(x) == 0, F.lit(0.0)).otherwise(_total(pairs)))

    return column


#: Blocks of image features and the largest distance of each.
IMAGE_BLOCKS, IMAGE_MAX, IMAGE_WEIGHT = ((1, 3), (4, 48), (52, 15)), (1.0, 60.0, 1.0), 0.333333


def image(a: Column, b: Column, most: tuple[float, float, float] = IMAGE_MAX) -> Column:
    """Weighted sum of the L2 distances of the three feature blocks, each relative to its largest distance."""
    parts = [l2(F.slice(a, s, n), F.slice(b, s, n)) / F.lit(m) * IMAGE_WEIGHT for (s, n), m in zip(IMAGE_BLOCKS, most, strict=True)]
    return parts[0] + parts[1] + parts[2]


def pearson(a: Column, b: Column) -> Column:
    """1 - correlation; null where a series is constant. Not a metric. The public sources leave it open; this is our definition."""
    n = F.size(a).cast("double")
    sa, sb = _total(a), _total(b)
    sab = _total(_terms(a, b, lambda x, y: x * y))
    saa, sbb = _total(F.transform(a, lambda x: x * x)), _total(F.transform(b, lambda x: x * x))
    return 1 - (n * sab - sa * sb) / F.nullif(F.sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)), F.lit(0.0))


def euclid_hamming(numeric: int) -> Callable[[Column, Column], Column]:
    """L2 over the first `numeric` values plus the number of differing rest values (our definition)."""

    def column(a: Column, b: Column) -> Column:
        rest = lambda c: F.slice(c, numeric + 1, F.greatest(F.size(c) - numeric, F.lit(0)))
        return l2(F.slice(a, 1, numeric), F.slice(b, 1, numeric)) + _total(_terms(rest(a), rest(b), lambda x, y: F.when(x == y, 0.0).otherwise(1.0)))

    return column


#: Peaks match within MS_TOLERANCE, precursors within MS_PRECURSOR; cosines this near to 1 count as 1.
MS_TOLERANCE, MS_PRECURSOR, MS_SNAP = 0.2, 2.0, 5e-5


def ms_value(a: Any, b: Any, tolerance: float = MS_TOLERANCE) -> float | None:
    """Angle between two ascending peak lists; peaks within the tolerance match, each once, in order."""
    if a is None or b is None:
        return None
    n, m = len(a), len(b)
    if not n or not m:
        return None
    hits = i = j = 0
    while i < n and j < m:
        gap = a[i] - b[j]
        if abs(gap) <= tolerance:
            hits, i, j = hits + 1, i + 1, j + 1
        elif gap < 0:
            i += 1
        else:
            j += 1
    cos = hits / (math.sqrt(n) * math.sqrt(m))
    return 0.0 if abs(cos - 1) < MS_SNAP else math.acos(min(1.0, cos))


@F.pandas_udf(DoubleType())
def _ms(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([ms_value(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ms(a: Column, b: Column) -> Column:
    """Fuzzy cosine angle of peak lists (sorted here); an ordered merge, hence an Arrow UDF. Empty lists give null."""
    return _ms(F.array_sort(a), F.array_sort(b))


def msms(a: Column, b: Column) -> Column:
    """Of structs (precursor, peaks): `ms` of the peaks plus the precursors' difference where it exceeds the tolerance."""
    gap = F.abs(a["precursor"] - b["precursor"])
    return ms(a["peaks"], b["peaks"]) + F.when(gap <= MS_PRECURSOR, F.lit(0.0)).otherwise(gap)


def _np(f: Callable[[np.ndarray, np.ndarray], float]) -> Callable[[Any, Any], float]:
    return lambda a, b: float(f(np.asarray(a, float), np.asarray(b, float)))


def edit_value(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = row[0]
        row[0] = i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return float(row[-1])


L1 = Metric("l1", l1, _np(lambda a, b: np.abs(a - b).sum()))
L2 = Metric("l2", l2, _np(lambda a, b: np.sqrt(((a - b) ** 2).sum())))
LINF = Metric("linf", linf, _np(lambda a, b: np.abs(a - b).max(initial=0.0)))
EDIT = Metric("edit", edit, edit_value)
IMAGE = Metric("image", image, _np(lambda a, b: sum(np.sqrt(((a[s - 1 : s - 1 + n] - b[s - 1 : s - 1 + n]) ** 2).sum()) / m * IMAGE_WEIGHT for (s, n), m in zip(IMAGE_BLOCKS, IMAGE_MAX, strict=True))))
MS = Metric("ms", ms, lambda a, b: ms_value(sorted(a), sorted(b)), triangle=False)
MSMS = Metric("msms", msms, lambda a, b: ms_value(sorted(a["peaks"]), sorted(b["peaks"])) + (0.0 if abs(a["precursor"] - b["precursor"]) <= MS_PRECURSOR else abs(a["precursor"] - b["precursor"])), triangle=False)
PEARSON = Metric("pearson", pearson, _np(lambda a, b: 1 - float(np.corrcoef(a, b)[0, 1])), triangle=False)


def lp_metric(p: float) -> Metric:
    return Metric(f"l{p:g}", lp(p), _np(lambda a, b: (np.abs(a - b) ** p).sum() ** (1 / p)))


def fixed_metric(kind: str, dim: int) -> Metric:
    return Metric(kind, fixed(kind, dim), {"l1": L1, "l2": L2, "linf": LINF}[kind].value)


def hamming_metric(matrix: WeightMatrix) -> Metric:
    return Metric(f"hamming_{matrix.name}", hamming(matrix), lambda a, b: float(sum(matrix.weight(x, y) for x, y in zip(a.upper(), b.upper(), strict=True))))


METRICS: dict[str, Metric] = {m.name: m for m in (L1, L2, LINF, EDIT, IMAGE, MS, MSMS, PEARSON)}


def register(metric: Metric) -> Metric:
    """Adds a user-defined metric to the names that the command line and the catalog know."""
    METRICS[metric.name] = metric
    return metric
