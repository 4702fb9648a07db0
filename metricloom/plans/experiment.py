"""Batch experiments: index families against one another and against the linear scan."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.operators import index, learn, pivots
from metricloom.operators.table import MetricTable

#: Exponents of the power-distance runs.
RHOS = (-4.0, -2.0, -1.0, 1.0, 2.0, 4.0)

Make = Callable[[MetricTable, list[pivots.Pivot]], list[index.Level]]


def standard(r: float) -> dict[str, Make]:
    """The families compared by default, for queries of radius r."""
    out: dict[str, Make] = {
        "GH": lambda t, p: [index.gh()], "VP1": lambda t, p: [index.vp([0], 3)], "VP2": lambda t, p: [index.vp(range(2), 3)], "RGH": lambda t, p: [index.rgh()], "AT": lambda t, p: [index.apollonian()],
        "CGHT": lambda t, p: [index.cght()], "PCA": lambda t, p: [learn.projection(learn.coordinates(t, p))], "DENSITY_VALLEY": lambda t, p: [learn.density_valley(learn.coordinates(t, p))],
        "LOG": lambda t, p: [index.log()],
    }
    for rho in RHOS:
        out[f"POWER({rho:g})"] = lambda t, p, rho=rho: [index.power(rho)]
    out["LEARNED_POWER"] = lambda t, p: [learn.learned_power(x := learn.coordinates(t, p), x[:120], r)]
    return out


def compare(table: MetricTable, queries: DataFrame, r: float, families: dict[str, Make] | None = None, k: int = 2, verify: bool = False) -> DataFrame:
    """(family, build_ms, query_ms, avg_distance_count, avg_exclusion_rate, avg_prune_rate, cells, results, correct): a row for
    each family; correct is null unless verify, which compares the results with a scan in blocks."""
    p = pivots.select_pivots(table, k)
    truth = index.scan_join(table, queries, r).select("query_id", "id").persist() if verify else None
    rows = []
    for name, make in (families or standard(r)).items():
        began = time.perf_counter()
        ix = index.build_index(table, p, make(table, p))
        built = time.perf_counter()
        s = ix.stats(queries, r).agg(F.avg("distance_count").alias("d"), F.avg("exclusion_rate").alias("e"), F.avg("prune_rate").alias("p"), F.sum("results").alias("n")).first()
        done = time.perf_counter()
        correct = None
        if truth is not None:
            found = ix.range_join(queries, r).select("query_id", "id")
            correct = found.exceptAll(truth).limit(1).count() == 0 and truth.exceptAll(found).limit(1).count() == 0
        ix.members.unpersist()
        rows.append((name, (built - began) * 1e3, (done - built) * 1e3, s["d"], s["e"], s["p"], len(ix.cells), s["n"] or 0, correct))
    if truth is not None:
        truth.unpersist()
    return table.df.sparkSession.createDataFrame(rows, "family string, build_ms double, query_ms double, avg_distance_count double, avg_exclusion_rate double, avg_prune_rate double, cells int, results bigint, correct boolean")
