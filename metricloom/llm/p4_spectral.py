"""Spectral clusters for a wanted number of clusters, by power iteration on anchored affinities.

The leaf means of a cluster-feature tree are the anchors of a group.  A row is tied to its TIES nearest anchors by Gaussian
affinities that sum to 1 (Z); one pass adds up Z'Z between anchors, which is all that the iteration needs: u <- D^-1 (Z'Z) u
over several random vectors is the power iteration of the normalised affinity between rows, seen from the anchors.  The
anchors are clustered by k-means in the space of the iterated vectors, rows go with the centre nearest to their own point
Z u, and members are ranked by their affinity to the rows of their cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metricloom.llm.p3_subset import LEAVES, _matrix, _squares, cluster_features, weighted
from metricloom.llm.shared import cut, usable_rows

#: Anchors of a row; iterated vectors; iterations.
TIES, VECTORS, ROUNDS = 3, 6, 30


def ties(x: np.ndarray, anchors: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest anchors of each row, their weights (summing to 1) and squared distances."""
    d = _squares(x, anchors)
    s = min(TIES, len(anchors))
    near = np.argpartition(d, s - 1, axis=1)[:, :s]
    sq = np.take_along_axis(d, near, 1)
    w = np.exp(-(sq - sq.min(1, keepdims=True)) / (2 * scale[near] ** 2)) + 1e-300
    return near, w / w.sum(1, keepdims=True), sq


def iterate(m: np.ndarray, vectors: int = VECTORS, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Early-stopped power iteration of the row-normalised affinity m from random vectors (columns), each centred and scaled."""
    degree = np.maximum(m.sum(1), 1e-300)
    u = np.random.default_rng(seed).standard_normal((len(m), vectors))
    for _ in range(rounds):
        u = (m @ u) / degree[:, None]
        u = u - (degree[:, None] * u).sum(0) / degree.sum()  # the constant vector tells nothing
        u = u / np.maximum(np.abs(u).max(0), 1e-300)
    return u


def lloyd(u: np.ndarray, weight: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Centres of a weighted k-means, seeded farthest first from the heaviest point."""
    c = [int(weight.argmax())]
    while len(c) < min(k, len(u)):
        d = _squares(u, u[c]).min(1)
        if d.max() <= 1e-18:
            break
        c.append(int((d * weight).argmax()))
    centre = u[c]
    for _ in range(rounds):
        into = _squares(u, centre).argmin(1)
        new = np.stack([np.average(u[into == j], axis=0, weights=weight[into == j]) if (into == j).any() else centre[j] for j in range(len(centre))])
        if np.allclose(new, centre, atol=1e-12):
            break
        centre = new
    return centre


def spectral_clusters(df: DataFrame, group_col: str, id_col: str, vec_col: str, k: int, leaves: int = LEAVES) -> DataFrame:
    """(grp, id, cluster, affinity): at most k clusters in each group; a group of fewer distinct rows has fewer.

    Vectors of a group are finite and of one length. Rows with a null column are left out; an id that stands several times
    counts once. The anchors of a group, at most `leaves`, are what reaches the driver and the tasks."""
    spark = df.sparkSession
    rows = df.select(F.col(group_col).cast("int").alias("grp"), F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).where("grp is not null and id is not null and vec is not null")
    groups = [r["grp"] for r in rows.select("grp").distinct().collect()]  # a row for each group
    found = cluster_features(weighted(rows.withColumn("grp", F.col("grp").cast("bigint"))), dict.fromkeys(groups, leaves)).toPandas()
    anchors: dict = {}
    for g, part in found.groupby("grp"):
        mean = np.stack(part["mean"].to_numpy())
        d = np.sqrt(np.sort(_squares(mean, mean), 1)[:, 1 : 1 + TIES * 2])
        scale = d.mean(1) if d.shape[1] else np.ones(len(mean))
        anchors[int(g)] = (mean, np.maximum(scale, 1e-12), part["n"].to_numpy())
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(anchors))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cloudpickle.loads(sent.value)
        total: dict = {}
        for batch in batches:
            group = batch.column(0).to_numpy()
            for g in np.unique(group).tolist():
                a, s, _ = known[g]
                x = _matrix(batch.filter(pa.array(group == g)).column(2))
                near, w, _ = ties(x, a, s)
                m = total.setdefault(g, np.zeros((len(a), len(a))))
                for i in range(near.shape[1]):
                    for j in range(near.shape[1]):
                        np.add.at(m, (near[:, i], near[:, j]), w[:, i] * w[:, j])
        for g, m in total.items():
            i, j = np.nonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), g, np.int32)), pa.array(i), pa.array(j), pa.array(m[i, j])], ["grp", "a", "b", "w"])

    edges = rows.mapInArrow(pairs, "grp int, a bigint, b bigint, w double").groupBy("grp", "a", "b").agg(F.sum("w").alias("w"))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["a"].max(), pdf["b"].max())) + 1
        m = np.zeros((n, n))
        m[pdf["a"], pdf["b"]] = pdf["w"]
        u = iterate(m)
        c = lloyd(u, m.sum(1), k)
        return pd.DataFrame({"grp": key[0], "kind": ["u"] * n + ["c"] * len(c), "i": [*range(n), *range(len(c))], "p": [*u.tolist(), *c.tolist()]})

    solved: dict = {}
    for g, part in edges.groupBy("grp").applyInPandas(solve, "grp int, kind string, i bigint, p array<double>").toPandas().groupby("grp"):
        part = part.sort_values("i")
        u, c = (np.stack(part.loc[part["kind"] == t, "p"].to_numpy()) for t in ("u", "c"))
        mean, scale, n = (x[: len(u)] for x in anchors[int(g)])
        solved[int(g)] = (mean, scale, n, u, c, _squares(u, c).argmin(1))
    final = spark.sparkContext.broadcast(cloudpickle.dumps(solved))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cloudpickle.loads(final.value)
        for batch in batches:
            group = batch.column(0).to_numpy()
            for g in np.unique(group).tolist():
                mean, scale, n, u, c, own = known[g]
                part = batch.filter(pa.array(group == g))
                near, w, sq = ties(_matrix(part.column(2)), mean, scale)
                into = _squares((w[:, :, None] * u[near]).sum(1), c).argmin(1)
                inside = own[near] == into[:, None]
                affinity = (n[near] * np.exp(-sq / (2 * scale[near] ** 2)) * inside).sum(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(into.astype(np.int32)), pa.array(affinity)], ["grp", "id", "cluster", "affinity"])

    out = rows.mapInArrow(place, "grp int, id bigint, cluster int, affinity double")
    return out.groupBy("grp", "id").agg(F.min("cluster").alias("cluster"), F.max("affinity").alias("affinity"))


def q_spectral(spark: SparkSession, d: str) -> DataFrame:
    """Ten clusters of each matrix, by size, with the three most typical rows of each."""
    found = cut(spectral_clusters(usable_rows(spark, d), "matrix_id", "row_id", "elements", 10))
    w = Window.partitionBy("grp", "cluster").orderBy(F.desc("affinity"), "id")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3)
    sizes = found.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("size"))
    return top.join(sizes, ["grp", "cluster"]).select(F.col("grp").alias("matrix_id"), "cluster", "size", "rank", F.col("id").alias("row_id"))


QUERIES = {"p4_spectral": q_spectral}
ORACLES: dict = {}
