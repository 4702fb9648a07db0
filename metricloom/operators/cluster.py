"""Clustering: k-means, density clusters, cluster-feature trees, and their validation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.metrics import L2, Metric
from metricloom.operators.durable import cut, stored
from metricloom.operators.index import CellIndex
from metricloom.operators.pivots import Pivot, embed
from metricloom.operators.table import MetricTable


def nearest_centre(value: str, centres: list[list[float]], metric: Metric = L2) -> Column:
    """(d, i) of the nearest centre, ties to the first: the argmin join without a shuffle. Centres are literals."""
    return F.array_min(F.array(*[F.struct(metric.column(F.col(value), Pivot(i, c).column()).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))


def centroids(assigned: DataFrame, value: str = "v", by: str = "cluster") -> DataFrame:
    """(cluster, n, centre): count and mean vector. Vectors are summed within tasks (sums and counts, one row for each cluster
    and task), so a hot cluster shuffles no more than a small one."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            c = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.empty((0, 0))
            for k in np.unique(c).tolist():
                part = x[c == k]
                n, s = held.get(k, (0, 0.0))
                held[k] = (n + len(part), s + part.sum(0))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.float64()))], ["cluster", "n", "s"])

    parts = assigned.where(F.col(value).isNotNull()).select(F.col(by).cast("int").alias("cluster"), value).mapInArrow(partial, "cluster int, n bigint, s array<double>")
    flat = parts.select("cluster", "n", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return flat.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("m")))), lambda s: s["m"]).alias("centre"))


def kmeans(rows: DataFrame, k: int, value: str = "v", rounds: int = 300, tol: float = 1e-4, seed: int | None = None, start: list[list[float]] | None = None) -> tuple[DataFrame, list[list[float]]]:
    """Rows with a column cluster (0..k-1), and the centres. Seeds are k distinct values: those of the smallest ids, or drawn
    by a hash. An emptied cluster keeps its centre; it ends when all centres move at most tol. Null values get no cluster."""
    if start is None:
        order = F.min("id") if seed is None else F.min(F.xxhash64("id", F.lit(seed)))
        start = [list(r[value]) for r in rows.where(F.col(value).isNotNull()).groupBy(value).agg(order.alias("_o")).orderBy("_o").limit(k).collect()]
    centres = start
    for _ in range(rounds if centres else 0):
        got = {r["cluster"]: r["centre"] for r in centroids(rows.withColumn("cluster", nearest_centre(value, centres)["i"]), value).collect()}  # k rows
        new = [list(got.get(i, c)) for i, c in enumerate(centres)]
        moved = max(float(np.linalg.norm(np.subtract(a, b))) for a, b in zip(new, centres, strict=True))
        centres = new
        if moved <= tol:
            break
    if not centres:
        return rows.withColumn("cluster", F.lit(None).cast("int")), []
    return rows.withColumn("cluster", F.when(F.col(value).isNotNull(), nearest_centre(value, centres)["i"])), centres


def neighbours(index: CellIndex, eps: float) -> DataFrame:
    """(query_id, id): the other rows within eps of each row. Pairs are formed cell by cell."""
    return index.range_join(index.table.rows().withColumnRenamed("id", "query_id"), eps).where("query_id <> id").select("query_id", "id")


def dbscan(index: CellIndex, eps: float, min_samples: int, rounds: int | None = None) -> DataFrame:
    """(id, cluster): -1 for noise, else the smallest id of a core row of the cluster. A core row has at least min_samples
    other rows within eps; a border row goes with the smallest label among its core neighbours. It ends when no label changes,
    and raises if that takes more than `rounds`, if given."""
    pairs = stored(neighbours(index, eps))  # formed once: every round below reads them
    core = cut(pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).select(F.col("query_id").alias("id")))
    label = core.withColumn("label", F.col("id"))
    edges = stored(pairs.join(core, "id").join(core.withColumnRenamed("id", "query_id"), "query_id").select("query_id", "id"))
    for i in count():
        if i == rounds:
            raise RuntimeError(f"labels still change after {rounds} rounds")
        near = edges.join(label, "id").groupBy("query_id").agg(F.min("label").alias("m")).withColumnRenamed("query_id", "id")
        step = label.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("new"))
        # a label's own label is nearer to the smallest of its component
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("_up"))
        step = cut(step.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("_up", "new")).alias("new")))
        done = step.where("label <> new").limit(1).count() == 0
        label = step.select("id", F.col("new").alias("label"))
        if done:
            break
    border = pairs.join(label, "id").groupBy("query_id").agg(F.min("label").alias("b")).withColumnRenamed("query_id", "id")
    out = index.table.rows().select("id").join(label, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("label", "b", F.lit(-1)).alias("cluster"))


def core_points(index: CellIndex, eps: float, min_samples: int) -> DataFrame:
    """(id, n): rows with at least min_samples others within eps."""
    return neighbours(index, eps).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).withColumnRenamed("query_id", "id")


class FeatureTree:
    """Cluster-feature tree: leaves take a vector if their radius stays within the threshold; nodes split at `branching`.
    Features are (n, mean, squared deviation), which add up and keep their digits far from the origin."""

    def __init__(self, threshold: float, branching: int) -> None:
        self.threshold, self.branching = threshold, branching
        self.root: dict = {"leaf": True, "f": []}

    @staticmethod
    def add(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return (n, a[1] + gap * (b[0] / n), a[2] + b[2] + float(gap @ gap) * a[0] * b[0] / n)

    def insert(self, f: tuple) -> None:
        split = self._insert(self.root, f)
        if split is not None:
            self.root = {"leaf": False, "f": [self._sum(x) for x in split], "kids": list(split)}

    def _sum(self, node: dict) -> tuple:
        out = node["f"][0]
        for f in node["f"][1:]:
            out = self.add(out, f)
        return out

    def _insert(self, node: dict, f: tuple) -> tuple | None:
        if node["f"]:
            i = int(np.argmin([((x[1] - f[1]) ** 2).sum() for x in node["f"]]))
            if node["leaf"]:
                both = self.add(node["f"][i], f)
                if np.sqrt(both[2] / both[0]) <= self.threshold:
                    node["f"][i] = both
                    return None
            else:
                split = self._insert(node["kids"][i], f)
                if split is None:
                    node["f"][i] = self.add(node["f"][i], f)
                    return None
                node["kids"][i : i + 1] = list(split)
                node["f"][i : i + 1] = [self._sum(x) for x in split]
                return self._split(node) if len(node["f"]) > self.branching else None
        node["f"].append(f)
        return self._split(node) if len(node["f"]) > self.branching else None

    def _split(self, node: dict) -> tuple:
        m = np.stack([f[1] for f in node["f"]])
        d = ((m[:, None] - m[None]) ** 2).sum(2)
        a, b = np.unravel_index(int(d.argmax()), d.shape)
        left = d[:, a] <= d[:, b]
        if left.all():
            left = np.arange(len(m)) < len(m) // 2
        halves = []
        for side in (left, ~left):
            at = np.flatnonzero(side)
            half = {"leaf": node["leaf"], "f": [node["f"][i] for i in at]}
            if not node["leaf"]:
                half["kids"] = [node["kids"][i] for i in at]
            halves.append(half)
        return tuple(halves)

    def leaves(self) -> list[tuple]:
        todo, out = [self.root], []
        while todo:
            node = todo.pop()
            if node["leaf"]:
                out += node["f"]
            else:
                todo += node["kids"]
        return out


#: Leaf features that a task passes on at most; beyond it the task doubles its threshold and rebuilds.
LEAVES = 2_000
#: Trees merged by one task.
FAN_IN = 16


def _condensed(tree: FeatureTree) -> FeatureTree:
    """The tree, or one of a higher threshold with at most LEAVES leaf features."""
    while len(got := tree.leaves()) > LEAVES:
        tree = FeatureTree(max(tree.threshold * 2, 1e-9), tree.branching)
        for f in got:
            tree.insert(f)
    return tree


def birch(rows: DataFrame, k: int, value: str = "v", threshold: float = 0.5, branching: int = 50) -> tuple[DataFrame, list[list[float]]]:
    """Rows with a column cluster, and the centres: a cluster-feature tree in each task, merged FAN_IN at a time by tasks until
    one of at most LEAVES features is left, its leaves agglomerated by the least distance of weighted centres to k, rows to the
    nearest."""
    schema = "part bigint, n bigint, m array<double>, d double"

    def frame(part: int, tree: FeatureTree) -> pd.DataFrame:
        got = tree.leaves()
        return pd.DataFrame({"part": part, "n": [f[0] for f in got], "m": [f[1].tolist() for f in got], "d": [f[2] for f in got]})

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = FeatureTree(threshold, branching)
        for b in batches:
            for v in b[value]:
                if v is not None:
                    tree.insert((1, np.asarray(v, float), 0.0))
            tree = _condensed(tree)
        if tree.leaves():
            yield frame(TaskContext.get().partitionId(), tree)

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = FeatureTree(threshold, branching)
        for n, m, d in part.sort_values(["n", "d"])[["n", "m", "d"]].itertuples(index=False):
            tree.insert((n, np.asarray(m, float), d))
        return frame(int(key[0]), _condensed(tree))

    parts = cut(rows.select(value).mapInPandas(trees, schema))
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        parts = cut(parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("part")).applyInPandas(merge, schema))
    tree = FeatureTree(threshold, branching)
    for r in parts.orderBy("m").collect():  # LEAVES features
        tree.insert((r["n"], np.array(r["m"]), r["d"]))
    leaves = tree.leaves()
    if not leaves:
        return rows.withColumn("cluster", F.lit(None).cast("int")), []
    n, m = np.array([f[0] for f in leaves], float), np.stack([f[1] for f in leaves])
    alive = np.ones(len(n), bool)
    d = ((m[:, None] - m[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    while alive.sum() > k:
        a, b = np.unravel_index(int(d.argmin()), d.shape)
        m[a] = (n[a] * m[a] + n[b] * m[b]) / (n[a] + n[b])
        n[a], alive[b] = n[a] + n[b], False
        d[b, :] = d[:, b] = np.inf
        row = ((m - m[a]) ** 2).sum(1)
        row[~alive], row[a] = np.inf, np.inf
        d[a, :] = d[:, a] = row
    centres = sorted(m[alive].tolist())
    return rows.withColumn("cluster", F.when(F.col(value).isNotNull(), nearest_centre(value, centres)["i"])), centres


def davies_bouldin(assigned: DataFrame, value: str = "v", variant: str = "standard") -> DataFrame:
    """(davies_bouldin) of rows with a cluster (-1 is left out). "reference" takes the worst neighbour among later clusters
    only. Null for fewer than two clusters."""
    rows = assigned.where(F.col("cluster").isNotNull() & (F.col("cluster") >= 0))
    means = {r["cluster"]: list(r["centre"]) for r in centroids(rows, value).collect()}  # a row for each cluster
    if len(means) < 2:
        return rows.sparkSession.createDataFrame([(None,)], "davies_bouldin double")
    names = sorted(means)
    given = F.create_map(*[x for c in names for x in (F.lit(c), Pivot(c, means[c]).column())])
    spread = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.avg(L2.column(F.col(value), given[F.col("cluster")])).alias("s")).collect()}
    worst = []
    for i, a in enumerate(names):
        others = names[i + 1 :] if variant == "reference" else [b for b in names if b != a]
        worst.append(max(((spread[a] + spread[b]) / max(float(np.linalg.norm(np.subtract(means[a], means[b]))), 1e-300) for b in others), default=0.0))
    return rows.sparkSession.createDataFrame([(float(np.mean(worst)),)], "davies_bouldin double")


def cluster_pipeline(table: MetricTable, pivots: list[Pivot], method: str, k: int = 3, **options: object) -> DataFrame:
    """Embeds the objects by their pivot distances (as 32-bit floats) and clusters the coordinates: (id, v, cluster), v the
    coordinates. method: kmeans, birch or dbscan (with eps and min_samples)."""
    rows = embed(table, pivots, scalar=False).select("id", F.transform("pd", lambda x: x.cast("float").cast("double")).alias("v"))
    if method == "kmeans":
        return kmeans(rows, k, **options)[0]
    if method == "birch":
        return birch(rows, k, **options)[0]
    if method == "dbscan":
        from metricloom.operators.index import build

        coords = MetricTable(rows, "id", "v", L2)
        return rows.join(dbscan(build(coords, "vp", 2, 4), **options), "id")
    raise ValueError(f"unknown method {method}")

