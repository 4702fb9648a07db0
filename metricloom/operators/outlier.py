"""Distance-based outliers: the n rows of largest neighbour weight.

One exact plan serves the classical block-nested-loop algorithms, which differ only in the order of their scan: `weights` by a
nearest-neighbour join over a cell index. `top_outliers` prunes as they do, by a cutoff from a first sample of rows: a row is
dropped as soon as an upper bound of its weight, from its cell, falls below the n-th best weight so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metricloom.operators.durable import cut
from metricloom.operators.index import CellIndex


def weights(index: CellIndex, k: int, kind: str = "sum", skip: int = 0, rows: DataFrame | None = None) -> DataFrame:
    """(id, weight): of each row (or of `rows`) the sum of the distances to the k nearest others ("sum") or the distance to
    the k-th ("kth"); the first `skip` of them don't count. Rows with fewer others use those there are; without any, 0."""
    asked = (rows if rows is not None else index.table.rows()).withColumnRenamed("id", "query_id")
    near = index.knn_join(asked, k + skip + 1).where("query_id <> id")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    near = near.withColumn("r", F.row_number().over(w)).where((F.col("r") > skip) & (F.col("r") <= k + skip))
    got = near.groupBy("query_id").agg((F.sum("distance") if kind == "sum" else F.max("distance")).alias("weight"))
    return asked.select(F.col("query_id")).join(got, "query_id", "left").select(F.col("query_id").alias("id"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def top_outliers(index: CellIndex, n: int, k: int, kind: str = "sum", skip: int = 0, seed: int = 0) -> DataFrame:
    """(id, weight) of the n rows of largest weight, ties to the smaller id.

    The weights of a sample of rows give a cutoff (its n-th best). A row in a cell with more than k + skip rows has its
    neighbours within the cell's diameter, at most twice the smallest upper pivot distance; if that bound is below the cutoff,
    the row needs no search."""
    some = index.members.select("id", "v", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h", "id").limit(max(4 * n, 64)).select("id", "v")
    best = weights(index, k, kind, skip, some).orderBy(F.desc("weight"), "id").limit(n).collect()  # n rows
    cutoff = best[-1]["weight"] if len(best) == n else 0.0
    dull = []
    p = len(index.pivots)
    for cell, count, high in zip(index.cells, index.counts, index.high, strict=True):
        bound = 2 * float(high[-p:].min()) * (k if kind == "sum" else 1)
        if count > k + skip and bound * (1 + 1e-9) < cutoff:
            dull.append(cell)
    rows = index.members.where(~F.col("cell").isin(dull)) if dull else index.members
    return weights(index, k, kind, skip, rows.select("id", "v")).orderBy(F.desc("weight"), "id").limit(n)


def hidden_outliers(index: CellIndex, n: int, k: int, candidates: int | None = None) -> DataFrame:
    """(rank, id, weight): greedy outliers that don't hide one another. Each found outlier leaves the neighbour lists of the
    others, which are then weighed anew; lists hold k + n - 1 neighbours.

    A row's weight never exceeds the one over its last k listed neighbours, so rows below the n-th best plain weight by that
    bound are no candidates. What is left, lists of k + n - 1 neighbours, is decided on the driver for at most `candidates`
    rows (default 50 n), else by a pass over the lists for each outlier."""
    lists = index.knn_join(index.table.rows().withColumnRenamed("id", "query_id"), k + n).where("query_id <> id")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    lists = lists.select("query_id", "id", "distance", F.row_number().over(w).alias("r")).where(F.col("r") < k + n)
    per = lists.groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, F.col("distance"))).alias("least"), F.sum(F.when(F.col("r") >= n, F.col("distance"))).alias("most"), F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
    per = cut(per)
    top = per.orderBy(F.desc("least")).limit(n).agg(F.min("least").alias("c")).first()["c"]
    most = candidates or 50 * n
    left = per.where(F.col("most") >= F.lit(top)).select("query_id", "near").limit(most + 1).collect()
    kind = index.members.schema["id"].dataType.simpleString()
    if len(left) > most:
        gone, out = [], []
        for rank in range(1, n + 1):
            near = F.filter("near", lambda x: ~x["id"].isin(gone)) if gone else F.col("near")
            weigh = F.aggregate(F.slice(near, 1, k), F.lit(0.0), lambda a, x: a + x["distance"])
            rest = per.where(F.col("most") >= F.lit(top))
            rest = rest.where(~F.col("query_id").isin(gone)) if gone else rest
            best = rest.select("query_id", weigh.alias("w")).orderBy(F.desc("w"), "query_id").limit(1).collect()
            if not best:
                break
            gone.append(best[0]["query_id"])
            out.append((rank, best[0]["query_id"], float(best[0]["w"])))
        return index.members.sparkSession.createDataFrame(out, f"rank int, id {kind}, weight double")
    near = {r["query_id"]: [(x["distance"], x["id"]) for x in r["near"]] for r in left}
    gone: set = set()
    out = []
    for rank in range(1, min(n, len(near)) + 1):
        weigh = {i: sum(d for d, j in [x for x in lst if x[1] not in gone][:k]) for i, lst in near.items() if i not in gone}
        i = min(weigh, key=lambda x: (-weigh[x], x))
        out.append((rank, i, float(weigh[i])))
        gone.add(i)
    return index.members.sparkSession.createDataFrame(out, f"rank int, id {kind}, weight double")


#: Names of the classical algorithms and what they compute.
ALGORITHMS = {"orca": ("sum", 0), "iorca": ("sum", 0), "eorca": ("sum", 0), "knn": ("sum", 0), "kth": ("kth", 0)}


def detect(index: CellIndex, algorithm: str, n: int, k: int, m: int = 0) -> DataFrame:
    """By name: orca, iorca, eorca, knn, kth, pfod (the first m neighbours don't count), hod, ihod."""
    if algorithm in ("hod", "ihod"):
        return hidden_outliers(index, n, k).select("id", "weight")
    if algorithm == "pfod":
        return top_outliers(index, n, k, "sum", m)
    kind, skip = ALGORITHMS[algorithm]
    return top_outliers(index, n, k, kind, skip)
