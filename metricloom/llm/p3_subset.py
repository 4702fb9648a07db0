"""A varied subset of given size by cluster-feature trees and Ward linkage.

Each task puts its rows into cluster-feature trees, one for each group: a row descends through nodes of at most BRANCHES
entries to the nearest leaf entry, which takes it if it lies within a threshold; the threshold rises, and the tree is built
anew from its leaf entries, when there are more than `leaves` of them.  Features are kept as (count, mean, squared deviation),
since sums of squares lose all digits far from the origin.  The trees of the tasks are merged FAN_IN at a time.  The leaf
entries of a group, their weights damped to sqrt(count) so that a large group of similar rows gets no more than its due, are
agglomerated by Ward linkage and cut at the wanted number; the row nearest each group centre is then found exactly over all
rows.

A request for more than ONE rows is divided first: the leaf entries of its group are cut into regions, each gets its share of
the rows wanted by damped weight, and goes on as a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metricloom.llm.shared import cut, small, usable_rows

#: Leaf entries of a group: four for each wanted row, at least LEAVES. Rows that one Ward linkage chooses, at most.
LEAVES, ONE = 512, 1_024
#: Entries of a node, and leaf entries that a task holds in all before it passes them on.
BRANCHES, HELD = 64, 200_000
#: Summaries merged at once, and rows added at once.
FAN_IN, ROWS = 16, 2_048

Features = tuple[np.ndarray, np.ndarray, np.ndarray]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    c = y.mean(0)
    a, b = x - c, y - c
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def _absorb(f: Features, into: np.ndarray, m: int) -> Features:
    """Features of f united by their number in `into`."""
    n, mean, dev = f
    total = np.bincount(into, n, m)
    centre = np.stack([np.bincount(into, n * mean[:, j], m) for j in range(mean.shape[1])], axis=1) / total[:, None]
    # a second pass about the centre keeps the digits that one far from the origin loses
    gap = mean - centre[into]
    centre += np.stack([np.bincount(into, n * gap[:, j], m) for j in range(mean.shape[1])], axis=1) / total[:, None]
    gap = mean - centre[into]
    return total, centre, np.bincount(into, dev + n * (gap * gap).sum(1), m)


def _group(mean: np.ndarray, limit: float, start: int) -> np.ndarray:
    """Number of a feature within the squared distance `limit` for each; the first `start` keep theirs."""
    into = np.arange(len(mean))
    if start and len(mean) > start:
        d = _squares(mean[start:], mean[:start])
        best = d.argmin(1)
        near = d[np.arange(len(best)), best] <= limit
        into[start:][near] = best[near]
    left = np.flatnonzero(into[start:] == np.arange(start, len(mean))) + start
    if not len(left):
        return np.unique(into, return_inverse=True)[1]
    d = _squares(mean[left], mean[left]) <= limit
    free = np.ones(len(left), bool)
    for i in range(len(left)):
        if free[i]:
            mine = free & d[i]
            mine[i] = True
            into[left[mine]] = left[i]
            free &= ~mine
    return np.unique(into, return_inverse=True)[1]


def _take(f: Features, at: np.ndarray) -> Features:
    return f[0][at], f[1][at], f[2][at]


def _both(f: Features, g: Features) -> Features:
    return tuple(np.concatenate(c) for c in zip(f, g, strict=True))


class FeatureTree:
    """Leaf entries take features within the squared distance `limit`; a node of more than `branches` entries is split along
    its widest coordinate, and so on up to the root."""

    def __init__(self, limit: float = 0.0, branches: int = BRANCHES) -> None:
        self.limit, self.branches, self.root = limit, branches, None

    def insert(self, f: Features) -> None:
        if self.root is None:
            self.root = {"f": _take(f, np.arange(0)), "kids": None}
        nodes = self._insert(self.root, f)
        while len(nodes) > 1:
            nodes = self._split({"f": self._sums(nodes), "kids": nodes})
        self.root = nodes[0]

    def _sums(self, nodes: list[dict]) -> Features:
        each = [_absorb(n["f"], np.zeros(len(n["f"][0]), np.int64), 1) for n in nodes]
        return tuple(np.concatenate([e[i] for e in each]) for i in range(3))

    def _insert(self, node: dict, f: Features) -> list[dict]:
        if node["kids"] is None:
            start = len(node["f"][0])
            both = _both(node["f"], f)
            into = _group(both[1], self.limit, start)
            node["f"] = _absorb(both, into, int(into.max()) + 1)
            return self._split(node)
        nearest = _squares(f[1], node["f"][1]).argmin(1)
        kids: list[dict] = []
        for i, kid in enumerate(node["kids"]):
            at = np.flatnonzero(nearest == i)
            kids += self._insert(kid, _take(f, at)) if len(at) else [kid]
        return self._split({"f": self._sums(kids), "kids": kids})

    def _split(self, node: dict) -> list[dict]:
        todo, out = [np.arange(len(node["f"][0]))], []
        while todo:
            at = todo.pop()
            if len(at) <= self.branches:
                out.append({"f": _take(node["f"], at), "kids": None if node["kids"] is None else [node["kids"][i] for i in at]})
                continue
            x = node["f"][1][at]
            order = np.argsort(x[:, int(x.var(0).argmax())], kind="stable")
            todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
        return out

    def leaf_nodes(self) -> list[Features]:
        todo, out = [self.root] if self.root else [], []
        while todo:
            node = todo.pop()
            if node["kids"] is None:
                out.append(node["f"])
            else:
                todo += node["kids"]
        return out


def condense(tree: FeatureTree, leaves: int) -> FeatureTree:
    """The tree, or one built anew with a higher threshold, of at most `leaves` leaf entries."""
    while True:
        nodes = tree.leaf_nodes()
        if sum(len(f[0]) for f in nodes) <= leaves:
            return tree
        gaps = [np.partition(_squares(f[1], f[1]), 1, axis=1)[:, 1] for f in nodes if len(f[0]) > 1]
        limit = max(tree.limit * 1.5, float(np.quantile(np.concatenate(gaps), 0.25)) if gaps else 0.0, np.finfo(float).tiny)
        again = FeatureTree(limit, tree.branches)
        every = tuple(np.concatenate([f[i] for f in nodes]) for i in range(3))
        for a in range(0, len(every[0]), ROWS):
            again.insert(_take(every, np.arange(a, min(a + ROWS, len(every[0])))))
        tree = again


def entries(tree: FeatureTree) -> Features:
    nodes = tree.leaf_nodes()
    return tuple(np.concatenate([f[i] for f in nodes]) for i in range(3))


def ward_cut(f: Features, k: int) -> np.ndarray:
    """Group number of each feature: Ward linkage with damped weights, cut at k groups (nearest-neighbour chains)."""
    m = len(f[0])
    weight, centre = np.sqrt(f[0]), f[1] - f[1].mean(0)
    weight, centre = weight.copy(), centre.copy()
    alive, merges, chain = np.ones(m, bool), [], []
    root = list(range(m))

    def cost(i: int) -> np.ndarray:
        d = ((centre - centre[i]) ** 2).sum(1) * (weight * weight[i] / (weight + weight[i]))
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    while alive.sum() > 1:
        if not chain:
            chain.append(int(alive.argmax()))
        d = cost(chain[-1])
        best = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[best]:
            a, b = chain.pop(), chain.pop()
            merges.append((float(d[b]), a, b))
            total = weight[a] + weight[b]
            centre[a] = (weight[a] * centre[a] + weight[b] * centre[b]) / total
            weight[a], alive[b] = total, False
        else:
            chain.append(best)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, a, b in sorted(merges)[: max(0, m - k)]:
        root[find(b)] = find(a)
    return np.unique([find(i) for i in range(m)], return_inverse=True)[1]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_SUMMARY = "grp bigint, part bigint, n double, mean array<double>, dev double"


def _batch(g: int, part: int, f: Features) -> pa.RecordBatch:
    m, dim = f[1].shape
    mean = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * dim, pa.int32()), pa.array(f[1].ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, g, np.int64)), pa.array(np.full(m, part)), pa.array(f[0]), mean, pa.array(f[2])], ["grp", "part", "n", "mean", "dev"])


def _summarise(leaves: dict[int, int], held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, FeatureTree] = {}
        me = TaskContext.get().partitionId()
        for batch in batches:
            group = batch.column(0).to_numpy()
            for g in np.unique(group).tolist():
                part = batch.filter(pa.array(group == g))
                x, n = _matrix(part.column(2)), part.column(3).to_numpy()
                for a in range(0, len(x), ROWS):
                    tree = state.setdefault(g, FeatureTree())
                    tree.insert((n[a : a + ROWS], x[a : a + ROWS], np.zeros(len(x[a : a + ROWS]))))
                    state[g] = condense(tree, leaves[g])
            if sum(min(leaves[g], held) for g in state) > held:  # of many groups
                for g in [*state]:
                    yield _batch(g, me, entries(state.pop(g)))
        for g, tree in state.items():
            yield _batch(g, me, entries(tree))

    return run


def _merge(leaves: dict[int, int]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = FeatureTree()
        mean = np.stack(pdf["mean"].to_numpy())
        for a in range(0, len(pdf), ROWS):
            tree.insert((pdf["n"].to_numpy()[a : a + ROWS], mean[a : a + ROWS], pdf["dev"].to_numpy()[a : a + ROWS]))
            tree = condense(tree, leaves[int(key[0])])
        f = entries(tree)
        return pd.DataFrame({"grp": key[0], "part": key[1], "n": f[0], "mean": list(f[1]), "dev": f[2]})

    return run


def cluster_features(rows: DataFrame, leaves: dict[int, int], held: int = HELD) -> DataFrame:
    """(grp, part, n, mean, dev): at most leaves[grp] features of each group, from rows (grp, id, vec, w); w is how much a row
    counts."""
    out = cut(rows.mapInArrow(_summarise(leaves, held), _SUMMARY))
    while True:
        many = out.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("part")).agg(F.max("part")).first()[0] or 0
        if not many:
            return out
        # FAN_IN summaries of a group at most in one task
        out = cut(out.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("grp", "part").applyInPandas(_merge(leaves), _SUMMARY))


def weighted(rows: DataFrame) -> DataFrame:
    """Rows (grp, id, vec) with w, such that the copies of an id count as one row."""
    copies, hint = small(rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
    return rows.join(hint(copies), "id", "left").select("grp", "id", "vec", (1 / F.coalesce("_n", F.lit(1))).alias("w"))


def _nearest(centres):
    """Of each request and centre the row of the batch that is nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = cloudpickle.loads(centres.value)
        for batch in batches:
            group = batch.column(0).to_numpy()
            for g in np.unique(group).tolist():
                part = batch.filter(pa.array(group == g))
                ids, x = part.column(1).to_numpy(), _matrix(part.column(2))
                for request, c in asked.get(g, ()):
                    best = np.concatenate([_squares(x[a : a + ROWS], c).argmin(1) for a in range(0, len(x), ROWS)])
                    d = ((x - c[best]) ** 2).sum(1)
                    o = np.lexsort((ids, d, best))
                    o = o[np.r_[True, best[o][1:] != best[o][:-1]]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), request, np.int32)), pa.array(np.full(len(o), g, np.int64)), pa.array(best[o]), pa.array(d[o]), pa.array(ids[o])], ["request", "grp", "no", "d", "id"])

    return run


def _farthest(chosen):
    """Of each request the rows not chosen: (request, no, d, id), no and d of the nearest row chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = cloudpickle.loads(chosen.value)
        for batch in batches:
            group = batch.column(0).to_numpy()
            for g in np.unique(group).tolist():
                part = batch.filter(pa.array(group == g))
                ids, x = part.column(1).to_numpy(), _matrix(part.column(2))
                for request, (c, taken) in asked.get(g, {}).items():
                    left = np.flatnonzero(~np.isin(ids, taken))
                    for a in range(0, len(left), ROWS):
                        some = left[a : a + ROWS]
                        best = _squares(x[some], c).argmin(1)
                        d = ((x[some] - c[best]) ** 2).sum(1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), request, np.int32)), pa.array(best), pa.array(d), pa.array(ids[some])], ["request", "no", "d", "id"])

    return run


def _regions(trees: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Rows (grp, id, vec, w) of divided groups, once for each request, in the region of their nearest leaf entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cloudpickle.loads(trees.value)
        for batch in batches:
            group = batch.column(0).to_numpy()
            for g in known.keys() & {*np.unique(group).tolist()}:
                part = batch.filter(pa.array(group == g))
                x = _matrix(part.column(2))
                for mean, region in known[g]:
                    near = np.concatenate([_squares(x[a : a + ROWS], mean).argmin(1) for a in range(0, len(x), ROWS)])
                    yield pa.RecordBatch.from_arrays([pa.array(region[near]), *part.columns[1:]], ["grp", "id", "vec", "w"])

    return run


ROW = "grp bigint, id bigint, vec array<double>, w double"


def _divide(rows: DataFrame, wanted: list[tuple], one: int, first: int) -> tuple[DataFrame, list[tuple]]:
    """Rows and requests (request, group, size) in which no size is above `one`, as far as regions differ. Regions are numbered
    from `first`. A group's leaf entries, four for each of at most `one` rows, reach the driver."""
    spark = rows.sparkSession
    done, calm, whole = [], rows.limit(0), set()
    while True:
        big = [w for w in wanted if w[2] > one and w[1] not in whole]
        small_ = [w for w in wanted if w[2] <= one or w[1] in whole]
        done += small_
        if small_:
            calm = calm.unionByName(rows.where(F.col("grp").isin(sorted({g for _, g, _ in small_}))))
        if not big:
            return calm, done
        source = rows.where(F.col("grp").isin(sorted({g for _, g, _ in big})))
        by = {int(g): part.sort_values(["n", "dev"], ascending=False) for g, part in cluster_features(source, {g: 4 * one for _, g, _ in big}).toPandas().groupby("grp")}
        trees: dict[int, list] = {}
        wanted = []
        for request, g, k in big:
            if g not in by:
                continue
            n, mean, dev = by[g]["n"].to_numpy(), np.stack(by[g]["mean"].to_numpy()), by[g]["dev"].to_numpy()
            into = ward_cut((n, mean, dev), min(-(-2 * k // one), 2 * one))
            share = _quotas(min(k, round(n.sum())), np.bincount(into, np.sqrt(n)), np.round(np.bincount(into, n)))
            trees.setdefault(g, []).append((mean, first + into))
            if len(share) == 1:  # equal rows
                whole.add(first)
            wanted += [(request, first + i, int(q)) for i, q in enumerate(share) if q > 0]
            first += len(share)
        rows = cut(source.mapInArrow(_regions(spark.sparkContext.broadcast(cloudpickle.dumps(trees))), ROW))  # the leaf entries of the divided groups


def _quotas(k: int, due: np.ndarray, most: np.ndarray) -> np.ndarray:
    """k split in proportion to `due` by largest remainders, at most `most` each."""
    most = most.astype(np.int64)
    out, free = np.zeros(len(due), np.int64), due > 0
    while free.any() and k > 0:
        exact = np.where(free, k * due / due[free].sum(), 0.0)
        full = free & (exact >= most)
        if not full.any():
            out[free] = np.floor(exact[free]).astype(np.int64)
            rest = np.where(free & (out < most), exact - np.floor(exact), -1.0)
            more = np.argsort(-rest, kind="stable")[: k - int(out[free].sum())]
            out[more[rest[more] >= 0]] += 1
            break
        out[full] = most[full]
        k -= int(most[full].sum())
        free &= ~full
    return out


def varied_subset(df: DataFrame, group_col: str, id_col: str, vec_col: str, requests: DataFrame, one: int = ONE) -> DataFrame:
    """(request, grp, id): for each request (request, grp, size) `size` distinct rows of the group, or all if there are fewer.

    Vectors of a group are finite and of one length. Rows with a null column are left out; an id counts once. Where several
    rows are as near, the smallest id is taken. If fewer groups than wanted come out (equal rows, or a centre that no row is
    nearest to), rows far from those chosen follow, one for each chosen row's surroundings at a time. A request for an unknown
    group or for no rows gives none. one: rows that one linkage chooses; larger requests are divided into regions.
    """
    spark = df.sparkSession
    asked = [tuple(r) for r in requests.select("request", "grp", "size").where("request is not null and grp is not null and size > 0").collect()]  # the requests, a row each
    rows = df.select(F.col(group_col).cast("bigint").alias("grp"), F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).where("grp is not null and id is not null and vec is not null")
    groups = sorted({g for _, g, _ in asked})
    rows = weighted(rows.where(F.col("grp").isin(groups)) if groups else rows.limit(0))
    owner = {r: g for r, g, _ in asked}
    work, wanted = (rows, asked) if all(k <= one for *_, k in asked) else _divide(rows, asked, one, 1 << 40)
    most: dict[int, int] = {}
    for _, g, k in wanted:
        most[g] = max(most.get(g, 0), k)
    tree = cluster_features(work, {g: max(LEAVES, 4 * min(k, one)) for g, k in most.items()})

    def centres(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = (pdf["n"].to_numpy(), np.stack(pdf["mean"].to_numpy()), pdf["dev"].to_numpy())
        into = ward_cut(f, int(pdf["size"].iloc[0]))
        damped = (np.sqrt(f[0]), f[1], f[2])
        c = _absorb(damped, into, int(into.max()) + 1)[1]
        return pd.DataFrame({"request": key[0], "grp": key[1], "mean": list(c)})

    sizes = spark.createDataFrame(wanted, "request int, grp bigint, size int")
    found = tree.join(F.broadcast(sizes), "grp").groupBy("request", "grp").applyInPandas(centres, "request int, grp bigint, mean array<double>")  # sizes: a row for each request and region
    by: dict[int, list] = {}
    for (request, g), part in found.toPandas().groupby(["request", "grp"]):  # as many vectors as rows are wanted
        by.setdefault(int(g), []).append((int(request), np.stack(part["mean"].to_numpy())))
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(by))
    near = work.mapInArrow(_nearest(sent), "request int, grp bigint, no bigint, d double, id bigint")
    chosen = cut(near.groupBy("request", "grp", "no").agg(F.min(F.struct("d", "id"))["id"].alias("id")).select("request", "id").distinct())
    have = {r["request"]: r["n"] for r in chosen.groupBy("request").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = {r: k - have.get(r, 0) for r, _, k in asked if k > have.get(r, 0) > 0}
    names = spark.createDataFrame(list(owner.items()), "request int, grp int")
    chosen = chosen.join(F.broadcast(names), "request").select("request", "grp", "id")  # a row for each request
    if not short:
        return chosen
    few = chosen.where(F.col("request").isin(list(short)))
    held: dict[int, dict] = {}
    few, hint = small(few.select("request", "id"))
    for request, part in rows.select("id", "vec").join(hint(few), "id").dropDuplicates(["request", "id"]).toPandas().groupby("request"):  # the rows chosen so far
        held.setdefault(owner[int(request)], {})[int(request)] = (np.stack(part["vec"].to_numpy()), part["id"].to_numpy())
    told = spark.sparkContext.broadcast(cloudpickle.dumps(held))
    need = spark.createDataFrame(list(short.items()), "request int, need int")
    away = rows.mapInArrow(_farthest(told), "request int, no bigint, d double, id bigint").groupBy("request", "id").agg(F.min("no").alias("no"), F.min("d").alias("d"))
    within = Window.partitionBy("request", "no").orderBy(F.desc("d"), "id")
    order = Window.partitionBy("request").orderBy("turn", F.desc("d"), "id")
    most_short = max(short.values())
    spare = away.withColumn("turn", F.row_number().over(within)).where(F.col("turn") <= most_short).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most_short)
    spare = spare.join(F.broadcast(need), "request").where("r <= need").join(F.broadcast(names), "request")
    return chosen.unionByName(spare.select("request", "grp", "id"))


def coverage(df: DataFrame, group_col: str, id_col: str, vec_col: str, chosen: DataFrame) -> DataFrame:
    """(request, n, mean_d, max_d): for subsets (request, grp, id) the rows of the group and how far they are from the nearest
    row chosen. The rows chosen are sent to all tasks."""
    spark = df.sparkSession
    rows = df.select(F.col(group_col).cast("bigint").alias("grp"), F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).where("grp is not null and id is not null and vec is not null")
    few, hint = small(chosen.select("request", "id"))
    held: dict[int, dict] = {}
    for (g, request), part in rows.join(hint(few), "id").dropDuplicates(["request", "id"]).toPandas().groupby(["grp", "request"]):  # as many vectors as rows were wanted
        held.setdefault(int(g), {})[int(request)] = (np.stack(part["vec"].to_numpy()), np.empty(0, np.int64))
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(held))
    away = rows.mapInArrow(_farthest(sent), "request int, no bigint, d double, id bigint").groupBy("request", "id").agg(F.min("d").alias("d"))
    return away.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.avg(F.sqrt("d")).alias("mean_d"), F.sqrt(F.max("d")).alias("max_d"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/subset_requests.parquet").select(F.col("request_id").alias("request"), F.col("matrix_id").alias("grp"), F.col("subset_size").alias("size"))


def q_subset(spark: SparkSession, d: str) -> DataFrame:
    out = varied_subset(usable_rows(spark, d), "matrix_id", "row_id", "elements", _requests(spark, d))
    return out.select(F.col("request").alias("request_id"), F.col("grp").alias("matrix_id"), F.col("id").alias("row_id"))


def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each request the rows of its matrix, and those chosen that are usable rows of it."""
    rows, asked = usable_rows(spark, d), _requests(spark, d)
    ids = rows.select(F.col("matrix_id").alias("grp"), F.col("row_id").alias("id")).distinct()
    chosen, hint = small(varied_subset(rows, "matrix_id", "row_id", "elements", asked))
    taken = ids.join(hint(chosen), ["grp", "id"]).groupBy("request").agg(F.count_distinct("id").alias("n_chosen"))
    n = ids.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"))
    return n.join(F.broadcast(asked), "grp").join(taken, "request").select(F.col("request").alias("request_id"), "n_rows", "n_chosen")  # asked: a row for each request


def q_spread(spark: SparkSession, d: str) -> DataFrame:
    """Of each request the mean and largest distance of a row to the nearest chosen one, and to the nearest of as many rows
    drawn by a hash."""
    rows, asked = usable_rows(spark, d), _requests(spark, d)
    w = Window.partitionBy("request").orderBy(F.xxhash64("id"), "id")
    most = asked.agg(F.max("size")).first()[0] or 0
    ids = rows.select(F.col("matrix_id").alias("grp"), F.col("row_id").alias("id")).distinct()
    drawn = ids.join(F.broadcast(asked), "grp").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).where("r <= size").select("request", "grp", "id")
    far = lambda x: coverage(rows, "matrix_id", "row_id", "elements", x)
    other = far(drawn).select("request", F.col("mean_d").alias("drawn_mean_d"), F.col("max_d").alias("drawn_max_d"))
    return far(varied_subset(rows, "matrix_id", "row_id", "elements", asked)).join(other, "request").withColumnRenamed("request", "request_id")


QUERIES = {"p3_subset": q_subset, "p3_coverage": q_coverage, "p3_spread": q_spread}
ORACLES = {
    "p3_coverage": """WITH rows AS (SELECT DISTINCT matrix_id, row_id FROM matrix_rows JOIN matrix_headers USING (matrix_id)
  WHERE len(elements) = n_columns AND len(list_filter(elements, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
n AS (SELECT matrix_id, count(*) AS n_rows FROM rows GROUP BY 1)
SELECT request_id, n_rows, least(n_rows, subset_size) AS n_chosen FROM subset_requests JOIN n USING (matrix_id)""",
}
