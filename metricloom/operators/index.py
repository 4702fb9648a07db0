"""Cell indexes: range partitions of pivot space, and exact searches over them.

Every index family is a list of levels.  A level maps pivot distances to features and cuts them, which gives each row a cell;
of each cell the bounds of all features are kept.  A query ball covers an interval of each feature, so a cell whose bounds it
misses holds no result: queries are joined to rows by equality of cells, with the pivot lower bound in the join condition and
the exact distance last.  No pairs of all queries and rows are formed, and the tree of the classical indexes is flattened to
one column.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metricloom.functions import transforms as X
from metricloom.functions.metrics import Metric
from metricloom.operators.durable import cut as cut_plan
from metricloom.operators.durable import stored
from metricloom.operators.pivots import Pivot, distances, embed, plain, select_pivots
from metricloom.operators.table import MetricTable

#: Cells of an index, at most: their bounds are kept on the driver and sent to the tasks.
MAX_CELLS = 65_536
#: Entries of a table of queries by cells that is made at once.
ENTRIES = 1 << 22
BIG = float(np.finfo(float).max)
#: Rows from which a search looks for copies, and rows of a value, on average, from which it compares each value only once.
COPIES_FROM, COPIES = 50_000, 2.0
#: Ids of a value in one row: about this many, and at most; and ids that are gathered at most (hashes may exceed it a little).
CHUNK, PIECE, MOST_IDS = 1_024, 2_048, 1 << 20
#: Entries of queries by cells, and ids in them, that are broadcast at most; more are joined by shuffles.
BROADCAST, BROADCAST_IDS = 1 << 18, 1 << 22

Bounds = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Level:
    """features: from pivot-distance columns; bounds: from query distances (n, k) and radii (n) the intervals (n, f) that
    results may have. Rows are cut at `fractions` of each feature within their parent cell, or at fixed `thresholds` (a list
    for each feature), or by `assign`, which gives a code below `fanout`. A value equal to a cut goes up, so equal rows share
    a cell."""

    name: str
    features: Callable[[list[Column]], list[Column]]
    bounds: Callable[[np.ndarray, np.ndarray], Bounds]
    fractions: Sequence[float] = ()
    thresholds: Sequence[Sequence[float]] = ()
    assign: Callable[[list[Column]], Column] | None = None
    fanout: int = 2
    n_features: int = 1

    def codes(self) -> int:
        if self.assign is not None:
            return self.fanout
        if self.thresholds:
            return int(np.prod([len(t) + 1 for t in self.thresholds]))
        return (len(self.fractions) + 1) ** self.n_features


def _pick(pivots: Sequence[int]) -> Callable[[list[Column]], list[Column]]:
    return lambda pd: [pd[i] for i in pivots]


def _ball(pivots: Sequence[int]) -> Callable[[np.ndarray, np.ndarray], Bounds]:
    return lambda q, r: X.ball(q[:, list(pivots)], r[:, None])


def _equal(m: int) -> tuple[float, ...]:
    return tuple(i / m for i in range(1, m))


def vp(pivots: Sequence[int] = (0,), parts: int = 2) -> Level:
    """Vantage points: equal-count rings about each pivot."""
    return Level("vp", _pick(pivots), _ball(pivots), _equal(parts), n_features=len(pivots))


def vp_cut(thresholds: Sequence[Sequence[float]], pivots: Sequence[int]) -> Level:
    """Vantage points with given rings (see `learn.kmeans_cuts`, `learn.pivot_wise`)."""
    return Level("vp_cut", _pick(pivots), _ball(pivots), thresholds=thresholds, n_features=len(pivots))


def gh(a: int = 0, b: int = 1) -> Level:
    """Generalised hyperplane: the nearer pivot, ties to the second."""
    return Level("gh", lambda pd: [pd[a] - pd[b]], lambda q, r: ((q[:, [a]] - q[:, [b]]) - 2 * r[:, None], (q[:, [a]] - q[:, [b]]) + 2 * r[:, None]), thresholds=((0.0,),))


def cght(a: int = 0, b: int = 1, parts: int = 2) -> Level:
    """Sum and difference of two pivot distances."""
    turn = lambda q: np.stack([q[:, a] + q[:, b], q[:, a] - q[:, b]], axis=1)
    return Level("cght", lambda pd: [pd[a] + pd[b], pd[a] - pd[b]], lambda q, r: (turn(q) - 2 * r[:, None], turn(q) + 2 * r[:, None]), _equal(parts), n_features=2)


def nearest_code(cols: list[Column]) -> Column:
    """Position of the smallest, ties to the first."""
    return F.array_min(F.array(*[F.struct(c.alias("d"), F.lit(i).alias("i")) for i, c in enumerate(cols)]))["i"]


def gnat(pivots: Sequence[int]) -> Level:
    """The nearest of several pivots, with the range of every pivot to every cell."""
    return Level("gnat", _pick(pivots), _ball(pivots), assign=lambda pd: nearest_code([pd[i] for i in pivots]), fanout=len(pivots), n_features=len(pivots))


def ratio(pd: list[Column], a: int, b: int) -> Column:
    return F.when(pd[b] == 0, F.lit(BIG)).otherwise(pd[a] / pd[b])


def _ratio_bounds(a: int, b: int) -> Callable[[np.ndarray, np.ndarray], Bounds]:
    def bounds(q: np.ndarray, r: np.ndarray) -> Bounds:
        with np.errstate(divide="ignore", invalid="ignore"):
            lo = np.where(q[:, b] + r > 0, np.maximum(q[:, a] - r, 0) / (q[:, b] + r), 0.0)
            hi = np.where(q[:, b] - r > 0, (q[:, a] + r) / (q[:, b] - r), np.inf)
        return lo[:, None], hi[:, None]

    return bounds


def rgh(a: int = 0, b: int = 1) -> Level:
    """Ratio of two pivot distances, cut at its median."""
    return Level("rgh", lambda pd: [ratio(pd, a, b)], _ratio_bounds(a, b), (0.5,))


def apollonian(a: int = 0, b: int = 1) -> Level:
    """Ratio of two pivot distances, cut at its thirds."""
    return Level("at", lambda pd: [ratio(pd, a, b)], _ratio_bounds(a, b), (1 / 3, 2 / 3))


def iat(thresholds: Sequence[float], a: int = 0, b: int = 1) -> Level:
    """Ratio cells with given cuts (see `learn.iat_cuts`) that keep their cover radii about the pivots as well."""

    def bounds(q: np.ndarray, r: np.ndarray) -> Bounds:
        (l0, h0), (l1, h1) = _ratio_bounds(a, b)(q, r), X.ball(q[:, [a, b]], r[:, None])
        return np.hstack([l0, l1]), np.hstack([h0, h1])

    return Level("iat", lambda pd: [ratio(pd, a, b), pd[a], pd[b]], bounds, thresholds=(tuple(thresholds), (), ()), n_features=3)


def linear(weights: Sequence[Sequence[float]], parts: int = 2, thresholds: Sequence[Sequence[float]] = (), name: str = "cp") -> Level:
    """Complete linear partition: weighted sums of pivot distances."""

    def bounds(q: np.ndarray, r: np.ndarray) -> Bounds:
        lo, hi = X.ball(q, r[:, None])
        each = [X.linear_interval(lo, hi, w) for w in weights]
        return np.stack([x[0] for x in each], 1), np.stack([x[1] for x in each], 1)

    return Level(name, lambda pd: [X.linear(pd[: len(w)], w) for w in weights], bounds, () if thresholds else _equal(parts), thresholds, n_features=len(weights))


def power(rho: float, weights: Sequence[float] = (1.0, -1.0), parts: int = 2, thresholds: Sequence[float] = ()) -> Level:
    """Weighted sum of d ** rho."""

    def bounds(q: np.ndarray, r: np.ndarray) -> Bounds:
        lo, hi = X.power_interval(*X.ball(q, r[:, None]), rho)
        a, b = X.linear_interval(lo, hi, weights)
        return a[:, None], b[:, None]

    return Level("power", lambda pd: [X.linear([X.power(c, rho) for c in pd[: len(weights)]], weights)], bounds, () if thresholds else _equal(parts), (tuple(thresholds),) if thresholds else ())


def log(weights: Sequence[float] = (1.0, -1.0), parts: int = 2, thresholds: Sequence[float] = ()) -> Level:
    """Weighted sum of ln d."""

    def bounds(q: np.ndarray, r: np.ndarray) -> Bounds:
        lo, hi = X.log_interval(*X.ball(q, r[:, None]))
        a, b = X.linear_interval(lo, hi, weights)
        return a[:, None], b[:, None]

    return Level("log", lambda pd: [X.linear([X.log(c) for c in pd[: len(weights)]], weights)], bounds, () if thresholds else _equal(parts), (tuple(thresholds),) if thresholds else ())


def pct(centres: np.ndarray) -> Level:
    """Pivot-space clustering tree: the nearest of given centres, with each cell's bounding box."""
    k = centres.shape[1]

    def assign(pd: list[Column]) -> Column:
        off = [sum(((pd[j] - float(c[j])) * (pd[j] - float(c[j])) for j in range(1, k)), (pd[0] - float(c[0])) * (pd[0] - float(c[0]))) for c in centres]
        return nearest_code(off)

    return Level("pct", _pick(range(k)), _ball(range(k)), assign=assign, fanout=len(centres), n_features=k)


def boxes(lo: np.ndarray, hi: np.ndarray) -> Level:
    """Density envelope: the first box that holds a row's coordinates, else the rest."""
    k = lo.shape[1]

    def assign(pd: list[Column]) -> Column:
        out = F.lit(len(lo))
        for i in reversed(range(len(lo))):
            inside = F.lit(True)
            for j in range(k):
                inside = inside & pd[j].between(float(lo[i, j]), float(hi[i, j]))
            out = F.when(inside, F.lit(i)).otherwise(out)
        return out

    return Level("envelope", _pick(range(k)), _ball(range(k)), assign=assign, fanout=len(lo) + 1, n_features=k)


#: Families by their names on the command line: pivots and levels for k pivots and m parts.
FAMILIES: dict[str, Callable[[int, int], list[Level]]] = {
    "vp": lambda k, m: [vp(range(k), m)],
    "gh": lambda k, m: [gh(2 * i, 2 * i + 1) for i in range(k // 2)],
    "cght": lambda k, m: [cght(0, 1, m)],
    "gnat": lambda k, m: [gnat(range(k))],
    "rgh": lambda k, m: [rgh(2 * i, 2 * i + 1) for i in range(k // 2)],
    "at": lambda k, m: [apollonian(2 * i, 2 * i + 1) for i in range(k // 2)],
    "cp": lambda k, m: [linear(np.eye(k).tolist() + [[1.0, -1.0] + [0.0] * (k - 2)], m)],
    "power": lambda k, m: [power(2.0, parts=m)],
    "log": lambda k, m: [log(parts=m)],
}


def bucket(value: Column, cuts: Column | Sequence[float]) -> Column:
    """Number of cuts that are not above the value. Given cuts are unrolled, which keeps the stage compiled."""
    if isinstance(cuts, Column):
        return F.aggregate(cuts, F.lit(0), lambda n, t: n + F.when(value >= t, 1).otherwise(0))
    out = F.lit(0)
    for t in cuts:
        out = out + F.when(value >= float(t), 1).otherwise(0)
    return out


def gathered(rows: DataFrame, keys: Sequence[str], rest: Sequence[str], ids: str, per_value: float, most: int, parts: int | None = None) -> DataFrame:
    """(ids, keys.., rest..): one row for the ids of equal keys, in chunks where they are many. per_value: rows of a value on
    average; most: of one value at most. parts: tasks that share the result, whatever its size."""
    chunks = max(1, -(-int(per_value) // CHUNK), -(-most // MOST_IDS))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(ids), F.lit(chunks)) if chunks > 1 else F.lit(0))
    rows = rows.repartition(parts, *keys, "_part") if parts else rows
    rows = rows.groupBy(*keys, "_part").agg(F.collect_list(ids).alias("ids"), *[F.first(c).alias(c) for c in rest])
    if most > PIECE:  # a value far above the average
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / PIECE).cast("int")), lambda i: F.slice("ids", i * PIECE + 1, F.lit(PIECE)))
        rows = rows.withColumn("ids", F.explode(pieces))
    return rows.select("ids", *keys, *rest)


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _values(rows: DataFrame, *columns: str) -> tuple[int, float]:
    """Rows, and about how many share a value."""
    n, different = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*columns))).first()
    return n, n / max(1, different)


def spread(pairs: DataFrame, *keep: str) -> DataFrame:
    """(query_id, id, keep..) of pairs of gathered rows (query_ids, ids, keep..). `coalesce` changes nothing but ends a compiled
    stage: together with the join above, the loops that write the rows would grow too long for the JVM to compile, and a stage
    holds all rows that come of one row before it passes on the first, which for both lists at once are a million."""
    pairs = pairs.coalesce(1 << 20).select(F.explode("query_ids").alias("query_id"), "ids", *keep)
    return pairs.coalesce(1 << 20).select("query_id", F.explode("ids").alias("id"), *keep)


@dataclass(frozen=True)
class CellIndex:
    """members: (id, v, pd0.., cell). low, high: bounds (cells, features) of `cells`; the features of all levels, then pd."""

    table: MetricTable
    pivots: list[Pivot]
    levels: list[Level]
    members: DataFrame
    cells: list[int]
    counts: list[int]
    low: np.ndarray = field(repr=False)
    high: np.ndarray = field(repr=False)
    recipe: dict | None = None  # how `build` made it, from which `open_index` has the levels again

    @property
    def pd(self) -> list[str]:
        return [f"pd{i}" for i in range(len(self.pivots))]

    def cell_rows(self) -> DataFrame:
        """(cell, n, lo, hi)."""
        rows = [(c, n, a.tolist(), b.tolist()) for c, n, a, b in zip(self.cells, self.counts, self.low, self.high, strict=True)]
        return self.members.sparkSession.createDataFrame(rows, "cell int, n bigint, lo array<double>, hi array<double>")

    def root_neighbourhood(self, r: float) -> int:
        """Rows that a query of radius r at their place could not settle within one cell."""
        near = self._placed(self.members.select(F.col("id").alias("query_id"), "v", F.lit(float(r)).alias("r"), *self.pd))
        return near.where(F.size("cells") > 1).count()

    def _placed(self, queries: DataFrame) -> DataFrame:
        """Queries (query_id, v, r, pd0..) with the cells that their balls may meet, and those of them that lie in it whole."""
        low, high, levels, cells = self.low, self.high, self.levels, np.array(self.cells, np.int32)
        k, n = len(self.pivots), len(queries.columns)

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            q = np.stack([batch.column(n - k + i).to_numpy(zero_copy_only=False) for i in range(k)], 1).astype(float)
            exact = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            r = exact * (1 + 1e-9) + 1e-12 * (1 + q.max(1, initial=0.0))
            each = [lv.bounds(q, r) for lv in levels] + [X.ball(q, r[:, None])]
            lo, hi = (np.concatenate([e[i] for e in each], 1) for i in range(2))
            slack = 1e-9 * np.where(np.isfinite(lo), np.abs(lo), 0), 1e-9 * np.where(np.isfinite(hi), np.abs(hi), 0)
            lo, hi = lo - slack[0], hi + slack[1]
            hit = np.ones((len(q), len(cells)), bool)
            for j in range(low.shape[1]):
                hit &= (low[None, :, j] <= hi[:, j, None]) & (high[None, :, j] >= lo[:, j, None])
            inside = np.zeros_like(hit)  # all rows of the cell within the radius, whatever their distance
            for j in range(k):
                inside |= (q[:, j, None] + high[None, :, low.shape[1] - k + j]) * (1 + 1e-9) <= exact[:, None]
            lists = []
            for found in (hit, hit & inside):
                offsets = np.r_[0, np.cumsum(found.sum(1))].astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells[np.nonzero(found)[1]])))
            return pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "cells", "whole"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, ENTRIES // max(1, len(cells)))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    yield part(batch.slice(a, step))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
        return queries.mapInArrow(run, f"{schema}, cells array<int>, whole array<int>")

    def _queries(self, queries: DataFrame, query_id: str, value: str, radius: float | Column) -> DataFrame:
        r = radius if isinstance(radius, Column) else F.lit(float(radius))
        rows = queries.select(F.col(query_id).alias("query_id"), F.col(value).alias("v"), r.cast("double").alias("r")).where("query_id is not null and v is not null and r >= 0")
        return rows.select("query_id", "v", "r", *[c.alias(f"pd{i}") for i, c in enumerate(distances(self.table, self.pivots))])

    @cached_property
    def copies(self) -> float:
        """Rows of a value, about; 1 if there are too few rows for it to matter."""
        return 1.0 if sum(self.counts) < COPIES_FROM else _values(self.members, "v")[1]

    def _by_value(self, queries: DataFrame) -> bool:
        return not queries.isStreaming and self.copies >= COPIES

    def _gathered_queries(self, queries: DataFrame) -> DataFrame:
        """(no, query_ids, v, r, pd0.., cells, whole): a row for each value and radius of the queries, kept in a table."""
        n, per_value = _values(queries, "v", "r")
        rows = gathered(queries, ["v", "r"], self.pd, "query_id", per_value, n)
        placed = self._placed(rows.select(F.col("ids").alias("query_ids"), "v", "r", *self.pd))
        return stored(placed.withColumn("no", F.monotonically_increasing_id()))

    def _pairs(self, asked: DataFrame, key: str, seen: bool = True) -> DataFrame:
        """(key, r, ids, distance) as `candidates`, but a pair of values once, however many rows have them: queries as
        `_gathered_queries` gives them, with `key` out of them (`no`, or `query_ids`). Without seen the distance is null where
        `accepted` needs none. Queries are broadcast if they are few, so that the rows of all cells are shared by all tasks;
        else rows are shared by a hash, and each share is joined to all queries of the cell."""
        spark, n = asked.sparkSession, F.size("cells").cast("bigint")
        entries, ids = asked.agg(F.sum(n), F.sum(n * F.size("query_ids"))).first()
        few = (entries or 0) <= BROADCAST and (key == "no" or (ids or 0) <= BROADCAST_IDS)
        tasks, shares = _tasks(spark), 1 if few else max(1, -(-_tasks(spark) // max(1, len(self.cells))))
        placed = asked.select(key, F.col("v").alias("qv"), "r", "whole", *[F.col(c).alias(f"q{c}") for c in self.pd], F.explode("cells").alias("cell"))
        placed = placed.withColumn("whole", F.array_contains("whole", F.col("cell")))
        rows = gathered(self.members, ["cell", "v"], self.pd, "id", self.copies, max(self.counts, default=0), tasks)
        rows = rows.select("ids", F.col("v").alias("mv"), *[F.col(c).alias(f"m{c}") for c in self.pd], F.col("cell").alias("mcell"))
        on = F.col("cell") == F.col("mcell")
        if few:
            placed = F.broadcast(placed)  # BROADCAST rows and BROADCAST_IDS ids at most
        else:
            placed = placed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
            rows = rows.withColumn("mshare", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int"))
            on = on & (F.col("share") == F.col("mshare"))
        bound, sure = F.lit(True), F.col("whole")
        for c in self.pd:
            bound = bound & (F.abs(F.col(f"q{c}") - F.col(f"m{c}")) <= F.col("r") * (1 + 1e-9) + 1e-12 * (1 + F.col(f"q{c}")))
            sure = sure | ((F.col(f"q{c}") + F.col(f"m{c}")) * (1 + 1e-9) <= F.col("r"))
        distance = self.table.metric.column(F.col("qv"), F.col("mv"))
        got = F.array(distance if seen else F.when(~sure, distance))
        return rows.join(placed, on & (bound if seen else F.col("whole") | bound)).select(key, "r", "ids", F.explode(got).alias("distance"))

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(query_id, r, id, distance): pairs that cells and pivots don't rule out; queries as `_queries` gives them.

        The distance comes out of a generator: a condition on a plain column would be moved into the join, ahead of those on
        the pivots, and the distance computed for every pair of the cell, and again for the result."""
        asked = self._placed(queries).select("query_id", F.col("v").alias("qv"), "r", *[F.col(c).alias(f"q{c}") for c in self.pd], F.explode("cells").alias("cell"))
        rows = self.members.select("id", F.col("v").alias("mv"), *[F.col(c).alias(f"m{c}") for c in self.pd], F.col("cell").alias("mcell"))
        bound = F.lit(True)
        for c in self.pd:
            bound = bound & (F.abs(F.col(f"q{c}") - F.col(f"m{c}")) <= F.col("r") * (1 + 1e-9) + 1e-12 * (1 + F.col(f"q{c}")))
        distance = F.array(self.table.metric.column(F.col("qv"), F.col("mv")))
        return asked.join(rows, (F.col("cell") == F.col("mcell")) & bound).select("query_id", "r", "id", F.explode(distance).alias("distance"))

    def range_join(
        self, queries: DataFrame, radius: float | Column, query_id: str = "query_id", value: str = "v", counted: Observation | None = None, digits: int | None = None
    ) -> DataFrame:
        """(query_id, id, distance) of all rows within the radius of each query, borders included. The radius is a number or
        a column of the queries; null and negative ones, null ids and null values give no results. counted: gets
        distance_count, the pairs of rows whose exact distance was needed, while the result itself is; pivots' distances are
        not in it. digits: distances are rounded to so many.

        Where values have copies, each pair of values is compared once and then spread over the rows that have them."""
        asked, kept = self._queries(queries, query_id, value, radius), F.col("distance") if digits is None else F.round("distance", digits).alias("distance")
        if self._by_value(queries):
            pairs = self._pairs(self._gathered_queries(asked), "query_ids")
            if counted is not None:
                pairs = pairs.observe(counted, F.coalesce(F.sum(F.size("query_ids").cast("bigint") * F.size("ids")), F.lit(0)).alias("distance_count"))
            return spread(pairs.where("distance <= r").select("query_ids", "ids", kept), "distance")
        pairs = self.candidates(asked)
        if counted is not None:
            pairs = pairs.observe(counted, F.count(F.lit(1)).alias("distance_count"))
        return pairs.where("distance <= r").select("query_id", "id", kept)

    def accepted(self, queries: DataFrame) -> DataFrame:
        """(query_id, r, id, distance) as `candidates`, but without the distance (null) where none is needed: the row's cell
        lies in the ball whole, or the query's and the row's distance to a pivot add up to the radius at most."""
        asked = self._placed(queries).select("query_id", F.col("v").alias("qv"), "r", "whole", *[F.col(c).alias(f"q{c}") for c in self.pd], F.explode("cells").alias("cell"))
        asked = asked.withColumn("whole", F.array_contains("whole", F.col("cell")))
        rows = self.members.select("id", F.col("v").alias("mv"), *[F.col(c).alias(f"m{c}") for c in self.pd], F.col("cell").alias("mcell"))
        bound, sure = F.lit(True), F.col("whole")
        for c in self.pd:
            bound = bound & (F.abs(F.col(f"q{c}") - F.col(f"m{c}")) <= F.col("r") * (1 + 1e-9) + 1e-12 * (1 + F.col(f"q{c}")))
            sure = sure | ((F.col(f"q{c}") + F.col(f"m{c}")) * (1 + 1e-9) <= F.col("r"))
        distance = F.array(F.when(~sure, self.table.metric.column(F.col("qv"), F.col("mv"))))
        return asked.join(rows, (F.col("cell") == F.col("mcell")) & (F.col("whole") | bound)).select("query_id", "r", "id", F.explode(distance).alias("distance"))

    def range_ids(self, queries: DataFrame, radius: float | Column, query_id: str = "query_id", value: str = "v") -> DataFrame:
        """(query_id, id): as `range_join` without the distances, which saves those of rows that are accepted unseen."""
        asked = self._queries(queries, query_id, value, radius)
        if self._by_value(queries):
            return spread(self._pairs(self._gathered_queries(asked), "query_ids", seen=False).where("distance is null or distance <= r").select("query_ids", "ids"))
        return self.accepted(asked).where("distance is null or distance <= r").select("query_id", "id")

    def unseen(self, queries: DataFrame, radius: float | Column, query_id: str = "query_id", value: str = "v") -> DataFrame:
        """(query_id, n): for each query the rows that `accepted` takes without an exact distance, if there are any."""
        asked = self._queries(queries, query_id, value, radius)
        if not self._by_value(queries):
            return self.accepted(asked).where("distance is null").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        asked = self._gathered_queries(asked)
        counted = self._pairs(asked, "no", seen=False).where("distance is null").groupBy("no").agg(F.sum(F.size("ids")).alias("n"))
        out = asked.select("no", F.explode("query_ids").alias("query_id")).join(counted, "no")
        return out.groupBy("query_id").agg(F.sum("n").alias("n"))

    def actions(self, queries: DataFrame, radius: float | Column, query_id: str = "query_id", value: str = "v") -> DataFrame:
        """(query_id, pruned, accepted, opened): for each query the cells without results, with nothing but results, and those
        in between."""
        placed = self._placed(self._queries(queries, query_id, value, radius))
        return placed.select("query_id", (F.lit(len(self.cells)) - F.size("cells")).alias("pruned"), F.size("whole").alias("accepted"), (F.size("cells") - F.size("whole")).alias("opened"))

    def stats(self, queries: DataFrame, radius: float | Column, query_id: str = "query_id", value: str = "v") -> DataFrame:
        """For each query: cells visited, exact distances computed (pivots included), results, prune rate (share of cells left
        out) and exclusion rate (share of rows that needed no exact distance)."""
        asked = self._queries(queries, query_id, value, radius)
        rows = max(1, sum(self.counts))
        if self._by_value(queries):
            asked = self._gathered_queries(asked)
            n = F.size("ids").cast("bigint")
            counted = self._pairs(asked, "no").groupBy("no").agg(F.sum(n).alias("_n"), F.sum(F.when(F.col("distance") <= F.col("r"), n)).alias("results"))
            visited = asked.select("no", "query_ids", F.size("cells").alias("cells_visited"))
            out = visited.join(counted, "no", "left").na.fill(0, ["_n", "results"]).withColumn("query_id", F.explode("query_ids"))
        else:
            visited = self._placed(asked).select("query_id", F.size("cells").alias("cells_visited"))
            pairs = self.candidates(asked).withColumn("hit", F.col("distance") <= F.col("r"))
            counted = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("hit").alias("results"))
            out = visited.join(counted, "query_id", "left").na.fill(0, ["_n", "results"])
        return out.select(
            "query_id", "cells_visited", (F.col("_n") + len(self.pivots)).alias("distance_count"), "results",
            (1 - F.col("cells_visited") / max(1, len(self.cells))).alias("prune_rate"), (1 - F.col("_n") / rows).alias("exclusion_rate"),
        )

    def knn_join(self, queries: DataFrame, k: int, query_id: str = "query_id", value: str = "v", within: float | None = None) -> DataFrame:
        """(query_id, id, distance, rank): the k nearest rows of each query (all, if there are fewer), ties to the smaller id;
        with `within` only rows up to that distance.

        Two rounds of equality joins: the k-th distance among the cells nearest to a query bounds a range search."""
        if k < 1:
            raise ValueError("k must be positive")
        asked = self._queries(queries, query_id, value, F.lit(0.0))
        near = self._nearest_cells(asked, k)
        first = near.join(self.members.select("id", F.col("v").alias("w"), "cell"), "cell").select("query_id", "id", self.table.metric.column(F.col("v"), F.col("w")).alias("distance"))
        w = Window.partitionBy("query_id").orderBy("distance", "id")
        reach = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("query_id").agg(F.max("distance").alias("_reach"))
        bound = F.coalesce(F.col("_reach"), F.lit(0.0))
        if within is not None:
            bound = F.least(bound, F.lit(float(within)))
        ready = asked.drop("r").join(reach, "query_id", "left").select("query_id", "v", bound.alias("r"), *self.pd)
        found = self.candidates(ready).where("distance <= r")
        return found.select("query_id", "id", "distance").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def _nearest_cells(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, v, cell): for each query the cells of least lower bound that hold k rows together."""
        low, high, cells, counts = self.low, self.high, np.array(self.cells, np.int32), np.array(self.counts)
        n_pd = len(self.pivots)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(n_pd)], 1).astype(float)
                lo, hi = low[:, -n_pd:], high[:, -n_pd:]
                gap = np.maximum(np.maximum(lo[None] - q[:, None], q[:, None] - hi[None]), 0).max(2)
                lists = []
                for g in gap:
                    o = np.argsort(g, kind="stable")
                    lists.append(cells[o[: int(np.searchsorted(np.cumsum(counts[o]), k)) + 1]].tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "v", "cells"])

        kinds = [f.dataType.simpleString() for f in asked.schema.fields]
        out = asked.mapInArrow(run, f"query_id {kinds[0]}, v {kinds[1]}, cells array<int>")
        return out.select("query_id", "v", F.explode("cells").alias("cell"))


def assign_cells(embedded: DataFrame, pd: list[str], levels: list[Level], leaf_size: int | None = None, copies: str | None = None) -> DataFrame:
    """Rows (.., pd0..) with their cell: level by level, cuts at fractions are taken within the parent cell. With leaf_size
    only cells of more rows are cut further, and cells are numbered anew after each level. copies: the column that says for how
    many rows each row stands, when no two have the same value; leaves count those, cuts do not."""
    cols = [F.col(c) for c in pd]
    out = embedded.withColumn("cell", F.lit(0))
    size, unchanged, before = 1, 0, 0
    for n, level in enumerate(levels):
        size *= level.codes()
        big = None
        if leaf_size is not None:
            out = cut_plan(out) if n else out  # else every level would repeat those above it
            different = F.count(F.lit(1))
            sizes = out.groupBy("cell").agg((F.sum(copies) if copies else different).alias("n"), different.alias("values")).collect()  # a row for each cell
            big = {r["cell"] for r in sizes if r["n"] > leaf_size and r["values"] > 1}
            unchanged, before = (unchanged + 1, before) if len(sizes) == before else (0, len(sizes))
            if not big or unchanged >= max(2, len(pd)) or len(sizes) + len(big) * (level.codes() - 1) > MAX_CELLS:
                return out
            start, numbers = 0, []
            for c in sorted(r["cell"] for r in sizes):
                numbers.append((c, start, c in big))
                start += level.codes() if c in big else 1
            # MAX_CELLS rows at most
            out = out.join(F.broadcast(out.sparkSession.createDataFrame(numbers, "cell int, _start int, _big boolean")), "cell")
        elif size > MAX_CELLS:
            raise ValueError(f"{size} cells; at most {MAX_CELLS}")
        code: Column = F.lit(0)
        fan = level.codes()
        if level.assign is not None:
            code = level.assign(cols)
        else:
            names = [f"_f{n}_{j}" for j in range(level.n_features)]
            out = out.withColumns(dict(zip(names, level.features(cols), strict=True)))
            if level.thresholds:
                for name, cuts in zip(names, level.thresholds, strict=True):
                    if len(cuts):
                        code = code * (len(cuts) + 1) + bucket(F.col(name), cuts)
            else:
                some = out if big is None else out.where("_big")
                many = [F.percentile_approx(name, list(level.fractions), 10_000) for name in names]
                if copies:  # of two values the lower is the median, and would go up with the other
                    many = [F.when(F.count(F.lit(1)) == 2, F.array_repeat(F.max(name), len(level.fractions))).otherwise(c) for name, c in zip(names, many, strict=True)]
                cut = some.groupBy("cell").agg(*[c.alias(f"_c{j}") for j, c in enumerate(many)])
                got = cut.collect()  # a row for each cell
                if len(got) <= 1 and big is None:  # one parent cell: its cuts are literals
                    cuts = [list(got[0][1 + j] or ()) if got else [] for j in range(len(names))]
                else:
                    given = out.sparkSession.createDataFrame([tuple(r) for r in got], "cell int, " + ", ".join(f"_c{j} array<double>" for j in range(len(names))))
                    out = out.join(F.broadcast(given), "cell", "left")  # MAX_CELLS rows at most
                    cuts = [F.col(f"_c{j}") for j in range(len(names))]
                for name, c in zip(names, cuts, strict=True):
                    code = code * (len(level.fractions) + 1) + bucket(F.col(name), c)
        if big is None:
            out = out.withColumn("cell", F.col("cell") * fan + code)
        else:
            out = out.withColumn("cell", F.col("_start") + F.when(F.col("_big"), code).otherwise(0)).drop("_start", "_big")
        out = out.drop(*[c for c in out.columns if c.startswith((f"_f{n}_", "_c"))])
    return out


def _leaves_by_value(rows: DataFrame, pd: list[str], levels: list[Level], leaf_size: int) -> DataFrame | None:
    """As `assign_cells` where values have copies: each value is placed once, and its rows follow it. None if there are few."""
    n, per_value = _values(rows, "v")
    if n < COPIES_FROM or per_value < COPIES:
        return None
    values = stored(rows.groupBy("v").agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in pd]))
    cells = stored(assign_cells(values, pd, levels, leaf_size, "_rows").select(F.col("v").alias("_v"), "cell"))
    return rows.join(cells, F.col("v") == F.col("_v")).drop("_v")


def _different(levels: list[Level]) -> list[Level]:
    """Without those that stand there again, whose features have the same bounds."""
    return list({id(level): level for level in levels}.values())


def build_index(table: MetricTable, pivots: list[Pivot], levels: list[Level], keep: bool = True, leaf_size: int | None = None, recipe: dict | None = None) -> CellIndex:
    """Places all rows in cells and takes the cells' bounds: one pass for each level with fractions and one for the bounds.
    keep: cache the members. The metric must obey the triangle inequality."""
    if not table.metric.triangle:
        raise ValueError(f"{table.metric.name} does not obey the triangle inequality; use a linear scan")
    pd = [f"pd{i}" for i in range(len(pivots))]
    rows = embed(table, pivots)
    members = _leaves_by_value(rows, pd, levels, leaf_size) if leaf_size is not None else None
    members = assign_cells(rows, pd, levels, leaf_size) if members is None else members
    levels = _different(levels)
    if keep:
        members = members.persist()
    cols = [F.col(c) for c in pd]
    feats = [f for level in levels for f in level.features(cols)] + cols
    rows = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(f) for f in feats]).alias("lo"), F.array(*[F.max(f) for f in feats]).alias("hi")).orderBy("cell").collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"{len(rows)} cells; at most {MAX_CELLS}")
    low, high = (np.array([r[c] for r in rows], float).reshape(len(rows), len(feats)) for c in ("lo", "hi"))
    return CellIndex(table, pivots, levels, members, [r["cell"] for r in rows], [r["n"] for r in rows], low, high, recipe)


def _levels(family: str, k: int, parts: int, depth: int, n_pivots: int) -> list[Level]:
    if k > n_pivots:
        return FAMILIES[family](k, parts)
    sets = [[shifted(level, i * k, n_pivots) for level in FAMILIES[family](k, parts)] for i in range(n_pivots // k)]
    return [level for i in range(depth) for level in sets[i % len(sets)]]


def build(table: MetricTable, family: str, k: int = 2, parts: int = 2, selection: str = "fft", depth: int = 1, leaf_size: int | None = None, **options: object) -> CellIndex:
    """By name. depth above 1 repeats the family's levels within the cells: with pivots of its own for each depth out of one
    pool (mixed mode), so that every depth adds directions. With leaf_size, cells are cut until they have no more rows than
    that: as deep as it takes, up to MAX_CELLS, `depth` sets of pivots in turn. Families with fixed cuts (gh, gnat) cut each
    cell once for each set."""
    pool = select_pivots(table, k * depth, selection, **options)
    deep = depth if leaf_size is None else max(depth, 24)
    recipe = {"family": family, "k": k, "parts": parts, "depth": deep, "metric": table.metric.name}
    return build_index(table, pool, _levels(family, k, parts, deep, len(pool)), leaf_size=leaf_size, recipe=recipe)


def save_index(index: CellIndex, path: str) -> None:
    """Members by cell, the cells with their bounds, and what is needed to search them again. For indexes made by `build`."""
    from metricloom.sources.sinks import write_index

    if index.recipe is None:
        raise ValueError("only indexes made by name can be saved")
    write_index(index.members, index.cell_rows(), path)
    about = index.recipe | {"pivots": [[str(p.id), p.value] for p in index.pivots]}
    index.members.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def open_index(spark: SparkSession, path: str, metric: Metric) -> CellIndex:
    """An index written by `save_index`: nothing is built, members are read when they are searched, and only those in cells
    that the queries meet if the cells have folders."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    if about["metric"] != metric.name:
        raise ValueError(f"the index was made for {about['metric']}, not {metric.name}")
    pool = [Pivot(i, v) for i, v in about["pivots"]]
    members = spark.read.parquet(f"{path}/members")
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MAX_CELLS rows at most
    low, high = (np.array([r[c] for r in cells], float).reshape(len(cells), -1) for c in ("lo", "hi"))
    recipe = {k: about[k] for k in ("family", "k", "parts", "depth", "metric")}
    levels = _different(_levels(about["family"], about["k"], about["parts"], about["depth"], len(pool)))
    return CellIndex(MetricTable(members.select("id", "v"), "id", "v", metric), pool, levels, members, [r["cell"] for r in cells], [r["n"] for r in cells], low, high, recipe)


def shifted(level: Level, by: int, total: int) -> Level:
    """The level over the pivots from `by` on."""
    if by == 0:
        return level
    assign = level.assign
    return Level(
        level.name, lambda pd: level.features(pd[by:]), lambda q, r: level.bounds(q[:, by:], r), level.fractions, level.thresholds,
        None if assign is None else lambda pd: assign(pd[by:]), level.fanout, level.n_features,
    )


def linear_scan(table: MetricTable, query: Pivot, radius: float) -> DataFrame:
    """(id, distance): one query against all rows; the ground truth of every index. One pass, no shuffle."""
    if radius < 0:
        raise ValueError("radius must not be negative")
    d = table.metric.column(F.col("v"), query.column())
    return table.rows().select("id", d.alias("distance")).where(F.col("distance") <= float(radius))


#: Queries of a block of `scan_join`, and queries up to which it takes such blocks: they are literals of its plan.
BLOCK, MOST_LITERAL = 64, 1_024


def scan_join(table: MetricTable, queries: DataFrame, radius: float, query_id: str = "query_id", value: str = "v", digits: int | None = None) -> DataFrame:
    """(query_id, id, distance): queries against all rows, without pruning. For metrics without the triangle inequality and as
    ground truth. Up to MOST_LITERAL queries stand in the plan, in blocks of literals: one pass for each block and no shuffle.
    More are joined to all rows, each pair of values once. digits: distances are rounded to so many."""
    kind = queries.schema[query_id].dataType.simpleString()
    kept = F.col("distance") if digits is None else F.round("distance", digits).alias("distance")
    out, all_asked = None, queries.select(F.col(query_id).alias("query_id"), F.col(value).alias("v")).where("query_id is not null and v is not null")
    asked = all_asked.limit(MOST_LITERAL + 1).collect()
    if len(asked) > MOST_LITERAL:
        return _scan_values(table, all_asked, radius, kept)
    for i in range(0, len(asked), BLOCK):
        block = F.array(*[F.struct(F.lit(r["query_id"]).cast(kind).alias("query_id"), Pivot(r["query_id"], plain(r["v"])).column().alias("qv")) for r in asked[i : i + BLOCK]])
        pairs = table.rows().select("id", "v", F.explode(block).alias("q"))
        part = pairs.select("q.query_id", "id", table.metric.column(F.col("q.qv"), F.col("v")).alias("distance")).where(F.col("distance") <= float(radius))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return table.rows().limit(0).select(F.lit(None).cast(kind).alias("query_id"), "id", F.lit(0.0).alias("distance"))
    return out.select("query_id", "id", kept)


def _scan_values(table: MetricTable, asked: DataFrame, radius: float, kept: Column) -> DataFrame:
    """`scan_join` of any number of queries: all pairs of different values, spread over the rows that have them."""
    spark, rows = asked.sparkSession, table.rows()
    (n, per_query), (m, per_row) = _values(asked, "v"), _values(rows, "v")
    left = stored(gathered(asked, ["v"], [], "query_id", per_query, n).select(F.col("ids").alias("query_ids"), F.col("v").alias("qv")))
    right = gathered(rows, ["v"], [], "id", per_row, m, _tasks(spark))
    if n <= BROADCAST:
        left = F.broadcast(left)  # BROADCAST ids at most
    distance = table.metric.column(F.col("qv"), F.col("v"))
    pairs = right.crossJoin(left)
    # out of a generator the distance is computed once; Arrow functions can't stand in one
    pairs = pairs.select("query_ids", "ids", F.explode(F.array(distance)).alias("distance") if table.metric.triangle else distance.alias("distance"))
    return spread(pairs.where(F.col("distance") <= float(radius)).select("query_ids", "ids", kept), "distance")


@dataclass(frozen=True)
class LocalIndex:
    """Pivots of their own in each cell: an index over each cell of a top index. Cells too small for one are searched by the
    bounds of the top index alone."""

    top: CellIndex
    parts: dict[int, CellIndex]

    def range_join(self, queries: DataFrame, radius: float, query_id: str = "query_id", value: str = "v") -> DataFrame:
        """As of CellIndex. A query goes on only to the parts that its ball may meet."""
        asked = self.top._placed(self.top._queries(queries, query_id, value, radius)).select("query_id", "v", "r", "cells")
        out = None
        for cell, part in self.parts.items():
            mine = asked.where(F.array_contains("cells", cell)).select("query_id", "v", "r")
            found = part.range_join(mine, F.col("r"))
            out = found if out is None else out.unionByName(found)
        return out if out is not None else self.top.range_join(queries, radius, query_id, value)


def build_local(table: MetricTable, family: str, k: int = 2, parts: int = 2, selection: str = "fft") -> LocalIndex:
    """Local mode: the cells of a first index each choose pivots among their own rows. A plan for each cell, so for a few."""
    top = build(table, family, k, parts, selection)
    if len(top.cells) > 32:
        raise ValueError(f"{len(top.cells)} cells; at most 32 in local mode")
    subs = {}
    for cell in top.cells:
        mine = MetricTable(top.members.where(F.col("cell") == cell).select("id", "v"), "id", "v", table.metric)
        pool = select_pivots(mine, k, selection)
        levels = FAMILIES[family](k, parts) if len(pool) == k else [vp(range(len(pool)), parts)]
        subs[cell] = build_index(mine, pool, levels)
    return LocalIndex(top, subs)


def diameter(table: MetricTable, parts: int = 6) -> float:
    """The largest distance between two rows, exactly; 0 for fewer than two. Needs the triangle inequality.

    A far pair gives a lower bound L; with R the largest distance to a pivot, both rows of a farther pair lie at least L - R
    from it. Only those rows are compared, cell by cell: two cells, and two rows, are left out if their distances to a pivot
    add up to less than L."""
    far = select_pivots(table, 3, "fft")
    if len(far) < 2:
        return 0.0
    low = max(table.metric.value(a.value, b.value) for i, a in enumerate(far) for b in far[i + 1 :])
    rows = embed(table, far)
    pd = [f"pd{i}" for i in range(len(far))]
    for c in pd:
        reach = rows.agg(F.max(c)).first()[0]
        low = max(low, reach)
        rows = rows.where(F.col(c) >= (low - reach) * (1 - 1e-9))
    rows = cut_plan(assign_cells(rows, pd, [vp(range(len(far)), parts)]))
    tops = rows.groupBy("cell").agg(F.array(*[F.max(c) for c in pd]).alias("hi")).collect()  # a row for each of parts ** 3 cells
    least = low * (1 - 1e-9)
    pairs = [(a["cell"], b["cell"]) for i, a in enumerate(tops) for b in tops[i:] if min(x + y for x, y in zip(a["hi"], b["hi"], strict=True)) >= least]
    if not pairs:
        return low
    met = F.broadcast(rows.sparkSession.createDataFrame(pairs, "cell int, other int"))  # at most all pairs of these cells
    left = rows.select("cell", F.col("v").alias("_a"), *[F.col(c).alias(f"a{c}") for c in pd]).join(met, "cell")
    right = rows.select(F.col("cell").alias("other"), F.col("v").alias("_b"), *[F.col(c).alias(f"b{c}") for c in pd])
    near = F.lit(True)
    for c in pd:
        near = near & (F.col(f"a{c}") + F.col(f"b{c}") >= least)
    found = left.join(right, (left["other"] == right["other"]) & near).select(F.explode(F.array(table.metric.column(F.col("_a"), F.col("_b")))).alias("d"))
    return max(low, found.agg(F.max("d")).first()[0] or 0.0)


def knn(table: MetricTable, query: Pivot, k: int) -> DataFrame:
    """(id, distance): the k nearest rows of one query, ties to the smaller id; each task sends k rows."""
    d = table.metric.column(F.col("v"), query.column())
    return table.rows().select("id", d.alias("distance")).where("distance is not null").orderBy("distance", "id").limit(k)


def with_hits(queries: DataFrame, found: DataFrame, query_id: str = "query_id", hit: bool = True) -> DataFrame:
    """Queries with at least one result, or without any."""
    return queries.join(found.select(F.col("query_id").alias(query_id)).distinct(), query_id, "left_semi" if hit else "left_anti")
