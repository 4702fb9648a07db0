"""Similarity clusters by power iteration on sparse affinities.

The affinity of two rows is 1 - d^2 / 2 r^2 up to the radius r, else 0.  It is kept factored, since a cluster with a third of
all rows would have n^2 pairs: leaders of each input chunk stand for the rows within the radius (nothing is shuffled), and
leaders are tied by their affinity to anchors, leaders picked in each cell of a grid over a few projections.  Besides its home
cell a leader visits the cells above it that lie within the radius, so any two leaders within the radius of each other meet in
one cell.  Z holds these sparse ties; D^-1 Z Z' with D its row sums is the normalised affinity, seen from the anchors.

As a cell knows only its own leaders, a cluster that lies across cells has several anchors, and which of them belong together
is what the power iteration finds: several random vectors over the anchors go through the normalised affinity by joins, until
no value changes.  They then agree on every set of rows tied together and differ (by independent random starts) between two.
k-means on these points has one centre for each distinct point: it is seeded on a grid, centres on both sides of a grid line
are merged on a shifted one, and a leader goes with the nearest of the centres that it is tied to.  Anchors without a leader
in common with another are at their fixed point from the start and need no steps.

Cells with too many leaders are first thinned by a further round of leaders in salted parts, then cut along further projections.
`spectral_clusters` (module p4_spectral) is the form for a wanted number of clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metricloom.llm.shared import cut, small, usable_rows

#: Rows of one group that are compared at once in an input chunk, and leaders in a grid cell.
CHUNK, AT_ONCE = 4_096, 1_024
#: Side of a grid cell in radii, and projections of a grid; leaders above which a cell is thinned and cut further.
SIDE, AXES, MOST = 6.0, 3, 20_000
#: Iterated vectors; largest change of a value (of size 1) at which they stop; steps after which they stop in any case.
VECTORS, TOL, ROUNDS = 4, 1e-11, 200
#: Grid of the seeds of k-means.
GRID = 1e-5
TYPICAL = 3


def near_mask(x: np.ndarray, y: np.ndarray, r: float) -> np.ndarray:
    """Whether |x_i - y_j| <= r; close calls of the fast formula are computed again from the differences."""
    c = x.mean(0)
    a, b = x - c, y - c
    na, nb = (a * a).sum(1), (b * b).sum(1)
    sq = na[:, None] + nb[None] - 2 * (a @ b.T)
    mask = sq <= r * r
    slack = 1e-13 * (na.max() + nb.max()) * (4 + x.shape[1])
    if slack > 1e-7 * r * r:  # only where coordinates dwarf the radius
        i, j = np.nonzero(np.abs(sq - r * r) <= slack)
        mask[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum(1)) <= r
    return mask


def leaders(ids: np.ndarray, x: np.ndarray, r: float) -> np.ndarray:
    """Position of each row's leader; rows are taken by ascending id, one without a leader within r becomes one."""
    order = np.argsort(ids, kind="stable")
    mask = near_mask(x[order], x[order], r)
    np.fill_diagonal(mask, True)
    lead = np.full(len(ids), -1)
    free = np.ones(len(ids), bool)
    at = 0
    while True:
        step = int(free[at:].argmax()) if at < len(free) else 0
        if at >= len(free) or not free[at + step]:
            break
        at += step
        mine = free & mask[at]
        lead[mine] = at
        free &= ~mine
    out = np.empty_like(lead)
    out[order] = order[lead]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _vectors(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _local(chunk: int):
    """(grp, id, r, vec) to (grp, id, r, leader, vec); only leaders keep their vector."""

    def out(g: int, held: list) -> pa.RecordBatch:
        ids, r, x = (np.concatenate([h[i] for h in held]) for i in range(3))
        lead = leaders(ids, x, r[0])
        own = lead == np.arange(len(ids))
        offsets = np.r_[0, np.cumsum(own)] * x.shape[1]
        vec = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x[own].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), g, np.int32)), pa.array(ids), pa.array(r), pa.array(ids[lead]), vec], ["grp", "id", "r", "leader", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n: dict[int, int] = {}
        for batch in batches:
            group = batch.column(0).to_numpy()
            for g in np.unique(group).tolist():
                part = batch.filter(pa.array(group == g))
                for a in range(0, part.num_rows, chunk):
                    p = part.slice(a, chunk)
                    if n.get(g, 0) + p.num_rows > chunk:
                        yield out(g, held.pop(g))
                        n[g] = 0
                    held.setdefault(g, []).append((p.column(1).to_numpy(), p.column(2).to_numpy(), _matrix(p.column(3))))
                    n[g] = n.get(g, 0) + p.num_rows
            if sum(n.values()) > 16 * chunk:  # many small groups
                for g in [*held]:
                    yield out(g, held.pop(g))
                n.clear()
        for g in held:
            yield out(g, held[g])

    return run


def _cells(side: float, axes: int, depth: int):
    """(grp, id, r, vec, cell) to the same: a row for the home cell, and one for each cell above that a row within r may have
    as its home. Cells of the depth before are cut along `axes` further projections, shorter once all dimensions had a turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(0).to_numpy()
            for g in np.unique(group).tolist():
                part = batch.filter(pa.array(group == g))
                x, r, before = _matrix(part.column(3)), part.column(2).to_numpy(), part.column(4).to_numpy()
                q = min(axes, x.shape[1])
                turn = np.linalg.qr(np.random.default_rng([x.shape[1], depth]).standard_normal((x.shape[1], q)))[0]
                p = (x @ turn) / r[:, None]  # in radii
                width = side / 2 ** (depth * q // x.shape[1])
                home = np.floor(p / width).astype(np.int64)
                above = np.floor((p + 1 + 1e-9 + 1e-12 * np.abs(p)) / width).astype(np.int64)
                steps = int((above - home).max()) + 1  # 2, unless cells got shorter than the radius
                for corner in np.ndindex(*[steps] * q):
                    cell = home + np.array(corner)
                    fresh = np.flatnonzero((cell <= above).all(1))
                    key = before[fresh] ^ np.int64(0x51ED270B + depth)
                    for j in range(q):
                        key = key * 0x5851F42D4C957F2D + cell[fresh, j] * 0x14057B7EF767814F + 1
                        key ^= key >> 29
                    take = part.take(pa.array(fresh))
                    yield pa.RecordBatch.from_arrays([*take.columns[:4], pa.array(key)], CELL_NAMES)

    return run


CELL_NAMES = ["grp", "id", "r", "vec", "cell"]
CELLS = "grp int, id bigint, r double, vec array<double>, cell bigint"


def _near(x: np.ndarray, y: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns within r, and their affinity."""
    i, j = np.nonzero(near_mask(x, y, r))
    return i, j, 1 - ((x[i] - y[j]) ** 2).sum(1) / (2 * r * r)


def _anchors(at_once: int):
    """Over rows sorted by group, cell and id: ties (grp, leader, anchor, w) of every leader to all anchors within its radius.
    A leader out of reach of the anchors so far becomes one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []

        def feed(ids: np.ndarray, r: float, x: np.ndarray) -> Iterator[tuple]:
            tied = np.zeros(len(ids), bool)
            for ki, kx in kept:
                i, j, w = _near(x, kx, r)
                tied[i] = True
                yield ids[i], ki[j], w
            left = np.flatnonzero(~tied)
            if len(left):
                lead = leaders(ids[left], x[left], r)
                own = left[lead == np.arange(len(left))]
                kept.append((ids[own], x[own]))
                i, j, w = _near(x, x[own], r)
                yield ids[i], ids[own][j], w

        for batch in batches:
            group, cell = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            edges = np.r_[0, np.flatnonzero((cell[1:] != cell[:-1]) | (group[1:] != group[:-1])) + 1, len(cell)]
            out: list[tuple] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (group[a], cell[a]) != now:
                    now = (group[a], cell[a])
                    kept.clear()
                for c in range(a, b, at_once):
                    p = batch.slice(c, min(at_once, b - c))
                    for leader, anchor, w in feed(p.column(1).to_numpy(), float(p.column(2)[0].as_py()), _matrix(p.column(3))):
                        out.append((np.full(len(leader), group[a], np.int32), leader, anchor, w))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["grp", "leader", "anchor", "w"])

    return run


LOCAL = "grp int, id bigint, r double, leader bigint, vec array<double>"


def _hot(cells: DataFrame, most: int) -> tuple[DataFrame, object, int]:
    """(grp, cell, parts) of the cells with more than `most` rows, the hint for joins with them, and their number of rows."""
    hot, hint = small(cells.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
    return hot.select("grp", "cell", F.ceil(F.col("n") / most).alias("parts")), hint, hot.agg(F.sum("n")).first()[0] or 0


def _thinned(leads: DataFrame, chunk: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Leaders after further rounds in the salted parts of hot cells, and (id, leader) of those that have one now."""
    moved = None
    while True:
        cells = leads.withColumn("cell", F.lit(0).cast("bigint")).mapInArrow(_cells(SIDE, AXES, 0), CELLS)
        hot, hint, n = _hot(cells, most)
        if not n:
            return leads, moved
        first = cells.groupBy("id").agg(F.min("cell").alias("cell"))  # one of a leader's cells
        split = leads.join(first, "id").join(hint(hot), ["grp", "cell"], "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")))
        part = split.where("parts is not null").repartition("grp", "cell", "salt").sortWithinPartitions("grp", "cell", "salt").select("grp", "id", "r", "vec")
        again = cut(part.mapInArrow(_local(chunk), LOCAL))
        left = again.where("size(vec) > 0")
        before, after = again.count(), left.count()
        step = again.where("leader <> id").groupBy("id").agg(F.min("leader").alias("leader"))
        if moved is None:
            moved = step
        else:
            up = step.withColumnsRenamed({"id": "leader", "leader": "_up"})
            moved = moved.join(up, "leader", "left").select("id", F.coalesce("_up", "leader").alias("leader")).unionByName(step)
        moved = cut(moved)
        leads = cut(split.where("parts is null").select("grp", "id", "r", "vec").unionByName(left.select("grp", "id", "r", "vec")))
        if after > 0.7 * before:
            return leads, moved


def _split_cells(leads: DataFrame, most: int) -> DataFrame:
    """Leaders in their cells, those with too many of them cut along further projections for as long as that helps."""
    cells = leads.withColumn("cell", F.lit(0).cast("bigint")).mapInArrow(_cells(SIDE, AXES, 0), CELLS)
    hot, hint, n = _hot(cells, most)
    depth = 0
    done = None
    while n:
        depth += 1
        marked = cut(cells).join(hint(hot), ["grp", "cell"], "left")
        calm = marked.where("parts is null").select(*CELL_NAMES)
        done = calm if done is None else done.unionByName(calm)
        cells = marked.where("parts is not null").select(*CELL_NAMES).mapInArrow(_cells(SIDE, AXES, depth), CELLS)
        hot, hint, now = _hot(cells, most)
        if now >= n:
            break
        n = now
    return cells if done is None else done.unionByName(cells)


def anchored(df: DataFrame, group_col: str, id_col: str, vec_col: str, radius_col: str, chunk: int = CHUNK, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Members (grp, id, leader), each id once, and ties (grp, leader, anchor, w). The radius is the same for all rows of a
    group."""
    rows = df.select(F.col(group_col).cast("int").alias("grp"), F.col(id_col).cast("bigint").alias("id"), F.col(radius_col).cast("double").alias("r"), F.col(vec_col).alias("vec"))
    rows = rows.where("grp is not null and id is not null and vec is not null and r > 0")
    local = cut(rows.mapInArrow(_local(chunk), LOCAL))
    leads, moved = _thinned(local.where("size(vec) > 0").select("grp", "id", "r", "vec"), chunk, most)
    members = local.groupBy("id").agg(F.min("grp").alias("grp"), F.min("leader").alias("leader"))
    if moved is not None:
        up = moved.select(F.col("id").alias("leader"), F.col("leader").alias("_up"))
        members = members.join(up, "leader", "left").select("grp", "id", F.coalesce("_up", "leader").alias("leader"))
    cells = _split_cells(leads, most)
    ties = cells.repartition("grp", "cell").sortWithinPartitions("grp", "cell", "id").mapInArrow(_anchors(AT_ONCE), "grp int, leader bigint, anchor bigint, w double")
    return members, cut(ties.groupBy("leader", "anchor").agg(F.min("grp").alias("grp"), F.max("w").alias("w")))


def _start(i: int) -> Column:
    return F.xxhash64("anchor", F.lit(i)).cast("double") / 2.0**63


def iterate(ties: DataFrame, bridges: DataFrame, vectors: int = VECTORS, tol: float = TOL, rounds: int = ROUNDS) -> DataFrame:
    """(anchor, grp, t, v0..) of the anchors that share a leader with another. bridges: (leader, links) of leaders with several
    ties. t: sum of an anchor's ties."""
    v = [f"v{i}" for i in range(vectors)]
    shared = bridges.select(F.explode("links").alias("x")).groupBy(F.col("x.anchor").alias("anchor")).agg(F.sum("x.w").alias("b"))
    sums = ties.groupBy("anchor").agg(F.min("grp").alias("grp"), F.sum("w").alias("t"))
    act, hint = small(sums.join(shared, "anchor").select("anchor", "grp", "t", "b", *[_start(i).alias(c) for i, c in enumerate(v)]))
    for _ in range(rounds):
        at = bridges.select("leader", F.explode("links").alias("x")).select("leader", F.col("x.anchor").alias("anchor"), F.col("x.w").alias("w")).join(hint(act.drop("grp", "b")), "anchor")
        mass = F.sum(F.col("w") * F.col("t"))
        u = at.groupBy("leader").agg(F.collect_list(F.struct("anchor", "w")).alias("links"), *[(F.sum(F.col("w") * F.col("t") * F.col(c)) / mass).alias(c) for c in v])  # a leader's few ties
        back = u.select(F.explode("links").alias("x"), *v).groupBy(F.col("x.anchor").alias("anchor")).agg(*[F.sum(F.col("x.w") * F.col(c)).alias(f"m{c}") for c in v])
        # leaders with this tie alone keep the anchor's own value
        new = [(((F.col("t") - F.col("b")) * F.col(c) + F.col(f"m{c}")) / F.col("t")).alias(c) for c in v]
        moved = F.greatest(*[F.abs(n - F.col(c)) for n, c in zip(new, v, strict=True)], F.lit(0.0))
        step = cut(hint(act).join(back, "anchor").select("anchor", "grp", "t", "b", *new, moved.alias("moved")))
        act = step.drop("moved")
        if (step.agg(F.max("moved")).first()[0] or 0.0) <= tol:
            break
    return act.drop("b")


def _key(columns: list[str], shift: float) -> Column:
    return F.xxhash64("grp", *[F.floor(F.col(c) / GRID + F.lit(shift)) for c in columns])


def embedded_clusters(act: DataFrame, vectors: int) -> DataFrame:
    """(anchor, t, v0.., c0.., first_id): k-means of the iterated points; c the centre, first_id its smallest anchor."""
    v, c = ([f"{x}{i}" for i in range(vectors)] for x in "vc")
    keyed = act.withColumn("k0", _key(v, 0.0))
    seeds = keyed.groupBy("k0").agg(F.min("grp").alias("grp"), F.min("anchor").alias("lo"), F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(b) for a, b in zip(v, c, strict=True)])
    seeds = cut(seeds.withColumn("k1", _key(c, 0.5)))
    centres = seeds.groupBy("k1").agg(F.min("lo").alias("first_id"), *[(F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias(x) for x in c])
    named = seeds.select("k0", "k1").join(centres, "k1").drop("k1")
    return keyed.join(named, "k0").drop("k0", "grp")


def similarity_clusters(
    df: DataFrame, group_col: str, id_col: str, vec_col: str, radius_col: str, vectors: int = VECTORS, chunk: int = CHUNK, most: int = MOST, rounds: int = ROUNDS, sizes: bool = True
) -> DataFrame:
    """(grp, id, first_id, size): the cluster of every row, named by its smallest id; a row on its own has size 1. sizes: with
    the last column.

    Exact where similarity (distance at most the radius) splits the rows into sets of mutually similar rows; elsewhere sets
    that are tied together by rows within the radius fall into one cluster if they mix within `rounds` steps. Rows with a null
    column or a radius of 0 or less are left out; an id counts once; equal vectors are similar; an empty table gives an empty
    result.
    """
    members, ties = anchored(df, group_col, id_col, vec_col, radius_col, chunk, most)
    linked = ties.groupBy("leader").agg(F.collect_list(F.struct("anchor", "w")).alias("links"))  # a leader's few ties
    bridges = cut(linked.where("size(links) > 1"))
    placed, hint = small(embedded_clusters(iterate(ties, bridges, vectors, rounds=rounds), vectors))
    alone = linked.where("size(links) = 1").select("leader", F.col("links")[0]["anchor"].alias("anchor"))
    alone = alone.join(hint(placed.select("anchor", "first_id")), "anchor", "left").select("leader", F.coalesce("first_id", "anchor").alias("first_id"))
    at = bridges.select("leader", F.explode("links").alias("x")).select("leader", F.col("x.anchor").alias("anchor"), F.col("x.w").alias("w")).join(hint(placed), "anchor")
    v, c = ([f"{x}{i}" for i in range(vectors)] for x in "vc")
    mass = F.col("w") * F.col("t")
    own = at.groupBy("leader").agg(
        F.collect_list(F.struct((F.col("anchor") != F.col("leader")).alias("other"), F.array(*c).alias("c"), "first_id")).alias("near"), F.array(*[F.sum(mass * F.col(a)) / F.sum(mass) for a in v]).alias("u")
    )
    gap = lambda x: F.aggregate(F.zip_with(x, "u", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    own = own.select("leader", F.array_min(F.transform("near", lambda x: F.struct(x["other"], gap(x["c"]).alias("gap"), x["first_id"])))["first_id"].alias("first_id"))
    out = members.join(alone.unionByName(own), "leader").select("grp", "id", "first_id")  # at most some CHUNK * MOST rows have one leader
    if not sizes:
        return out
    out = cut(out)
    counts, hint = small(out.groupBy("first_id").agg(F.count(F.lit(1)).alias("size")))
    return out.join(hint(counts), "first_id").select("grp", "id", "first_id", "size")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, first_id, vec) to the sums of a batch by cluster."""
    for batch in batches:
        group = batch.column(0).to_numpy()
        for g in np.unique(group).tolist():
            part = batch.filter(pa.array(group == g))
            names, at = np.unique(part.column(1).to_numpy(), return_inverse=True)
            o = np.argsort(at, kind="stable")
            start = np.searchsorted(at[o], np.arange(len(names)))
            total = np.add.reduceat(_matrix(part.column(2))[o], start, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at)), _vectors(total)], ["first_id", "n", "s"])


def typical_members(rows: DataFrame, clusters: DataFrame, id_col: str, vec_col: str, radius_col: str, top: int = TYPICAL) -> DataFrame:
    """(grp, first_id, size, rank, id, affinity): of each cluster the `top` rows of highest internal affinity, the mean of
    1 - d^2 / 2 r^2 over all members. Ties go to the smaller id.

    The mean of d^2 over all members is the squared distance to their mean plus their variance, so no pairs are needed."""
    x = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(radius_col).cast("double").alias("r")).dropDuplicates(["id"]).join(clusters, "id")
    x = cut(x)
    many = x.where("size > 1")
    parts = many.select("grp", "first_id", "vec").mapInArrow(_sums, "first_id bigint, n bigint, s array<double>")
    flat = parts.select("first_id", "n", F.posexplode("s").alias("i", "v")).groupBy("first_id", "i").agg((F.sum("v") / F.sum("n")).alias("m"))
    means = flat.groupBy("first_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))  # a vector for each cluster
    means, hint = small(means)
    off = F.aggregate(F.zip_with("vec", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    away = cut(many.join(hint(means), "first_id").select("grp", "first_id", "size", "id", "r", off.alias("off")))
    spread = away.groupBy("first_id").agg(F.avg("off").alias("spread"))
    near = F.round(F.col("off") / (F.col("r") * F.col("r")), 9)
    w = Window.partitionBy("first_id").orderBy("near", "id")
    ranked = away.withColumn("near", near).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).join(spread, "first_id")
    affinity = F.round(1 - (F.col("off") + F.col("spread")) / (2 * F.col("r") * F.col("r")), 6)
    single = x.where("size = 1").select("grp", "first_id", "size", F.lit(1).alias("rank"), "id", F.lit(1.0).alias("affinity"))
    return ranked.select("grp", "first_id", "size", "rank", "id", affinity.alias("affinity")).unionByName(single)


def q_found(spark: SparkSession, d: str) -> DataFrame:
    found = similarity_clusters(usable_rows(spark, d), "matrix_id", "row_id", "elements", "similar_within", sizes=False)
    return found.where("id <> first_id").select(F.col("first_id").alias("first_row_id"), F.col("id").alias("row_id"))


def q_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = usable_rows(spark, d)
    found = similarity_clusters(rows, "matrix_id", "row_id", "elements", "similar_within")
    top = typical_members(rows, found, "row_id", "elements", "similar_within")
    return top.select(F.col("grp").alias("matrix_id"), F.col("first_id").alias("first_row_id"), "size", "rank", F.col("id").alias("row_id"), "affinity")


QUERIES = {"p4_found": q_found, "p4_clusters": q_clusters}
_PAIRS = """rows AS (SELECT DISTINCT matrix_id, row_id, elements, similar_within FROM matrix_rows JOIN matrix_headers USING (matrix_id)
  WHERE len(elements) = n_columns AND len(list_filter(elements, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
first AS (SELECT b.matrix_id, b.row_id, min(a.row_id) AS first_row_id FROM rows a JOIN rows b ON a.matrix_id = b.matrix_id AND list_distance(a.elements, b.elements) <= a.similar_within GROUP BY ALL)"""
ORACLES = {
    "p4_found": f"WITH {_PAIRS} SELECT first_row_id, row_id FROM first WHERE first_row_id <> row_id",
    "p4_clusters": f"""WITH {_PAIRS},
x AS (SELECT first.*, elements, count(*) OVER (PARTITION BY first_row_id) AS size FROM first JOIN rows USING (row_id)),
near AS (SELECT b.matrix_id, b.first_row_id, b.size, b.row_id, avg(1 - list_distance(a.elements, b.elements) ** 2 / (2 * similar_within ** 2)) AS affinity
  FROM x a JOIN x b USING (first_row_id) JOIN matrix_headers h ON h.matrix_id = b.matrix_id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY first_row_id ORDER BY round(affinity, 9) DESC, row_id) AS rank FROM near)
SELECT matrix_id, first_row_id, size, rank, row_id, round(affinity, 6) AS affinity FROM ranked WHERE rank <= 3""",
}
