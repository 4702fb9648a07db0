"""The k most similar vectors of every vector: a hash-prefix forest.

The first part of a row's hash strings is common to all trees: the branches of random-projection cuts, each in the widest gap
between the middle rows of a sample, so that it seldom parts similar rows.  The rows behind each prefix are counted over the
whole table, and prefixes with too many rows get longer by further cuts, so one shuffle brings the rows of a prefix, a block,
together.  In a block every tree adds a long string of its own, one bit for each of BITS random projections, and sorts them.

A row descends in each tree to its longest prefix match, an interval of the sorted array, and ascends in all trees together,
bit by bit, until the intervals hold enough candidates; these give its first list.  A cut that lies nearer to the row than its
k-th distance may hide a neighbour, so a row ascends further, in the tree where that takes the fewest rows, to the prefix
whose cuts are all farther off, and its list is made anew from that interval.  Where even the cuts of the block are nearer,
the row visits the blocks beyond them.

No neighbour is missed: every row nearer than the k-th found shares the prefix that was searched or lies in a block that was
visited. `recall` compares with brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.shared import usable_rows
from metricloom.operators.durable import cut

K = 5
#: Trees, bits of a tree's own string, and candidates at which the common ascent ends.
TREES, BITS, CANDIDATES = 4, 48, 1_024
#: Rows that share a block's prefix; blocks a quarter above it are cut further. A task holds a block at once.
CAP = 16_384
#: Rows of a block that its cuts are fitted on. They are drawn and cut where they lie; only the cuts reach the driver.
SAMPLE = 4_096
#: Rows of a piece, the unit of pruning in a visited block, and entries of a distance matrix.
PIECE, ENTRIES = 512, 1 << 20
#: Block of the first group that needs no cuts, less its number.
WHOLE = 1 << 40


@dataclass
class Tree:
    """Cuts of one group. Node i sends x to `low[i]` if x @ axis[i] <= at[i], else to `high[i]`; a negative child -1 - b is
    block b. Without nodes there is block `first` alone."""

    first: int
    axis: list[np.ndarray] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    n_blocks: int = 0
    centre: np.ndarray | None = None


def fit_tree(x: np.ndarray, n: int, cap: int, first: int, rng: np.random.Generator, centre: np.ndarray | None = None) -> Tree:
    """A tree for n rows of which x is a sample."""
    tree = Tree(first)
    dim = x.shape[1]
    tree.centre = x.mean(0) if centre is None else centre
    z = x - tree.centre

    def leaf() -> int:
        tree.n_blocks += 1
        return -1 - (first + tree.n_blocks - 1)

    def grow(idx: np.ndarray) -> int:
        if n * len(idx) / len(x) <= cap or len(idx) < 32:
            return leaf()
        best = (0.0, None, 0.0)
        part = z[idx]
        axes = rng.standard_normal((8, dim)) * part.std(0)
        axes = np.concatenate([axes, np.eye(dim)[np.argsort(-part.var(0))[:4]]])
        for a in axes:
            size = np.linalg.norm(a)
            if size == 0:
                continue
            a = a / size
            p = np.sort(part @ a)
            lo, hi = max(1, int(len(p) * 0.2)), int(len(p) * 0.8)
            gap = p[lo + 1 : hi + 1] - p[lo:hi]
            share = (np.arange(lo, hi) + 1) / len(p)
            spread = p[-1] - p[0]
            if spread <= 0 or not len(gap):
                continue
            score = gap / spread * np.sqrt(share * (1 - share))
            i = int(score.argmax())
            if score[i] > best[0]:
                best = (float(score[i]), a, float((p[lo + i] + p[lo + i + 1]) / 2))
        if best[1] is None:
            return leaf()
        node = len(tree.axis)
        tree.axis.append(best[1])
        tree.at.append(best[2])
        tree.low.append(0)
        tree.high.append(0)
        below = part @ best[1] <= best[2]
        tree.low[node], tree.high[node] = grow(idx[below]), grow(idx[~below])
        return node

    grow(np.arange(len(x)))
    return tree


def graft(tree: Tree, block: int, cuts: Tree) -> None:
    """Puts the cuts, fitted about the tree's centre if it has one, in place of a block."""
    at = len(tree.axis)
    tree.low, tree.high = ([at if c == -1 - block else c for c in side] for side in (tree.low, tree.high))
    tree.axis += cuts.axis
    tree.at += cuts.at
    tree.low += [c + at if c >= 0 else c for c in cuts.low]
    tree.high += [c + at if c >= 0 else c for c in cuts.high]
    tree.n_blocks += cuts.n_blocks - 1
    tree.centre = cuts.centre


def reached(tree: Tree, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row's position and a block that may hold something within the row's reach, its own among them."""
    if not tree.axis:
        return np.arange(len(x)), np.full(len(x), tree.first, np.int64)
    z = x - tree.centre
    wide = reach * (1 + 1e-9) + 1e-9 * np.sqrt((z * z).sum(1))
    held, rows, blocks = {0: np.arange(len(x))}, [], []
    for i in range(len(tree.axis)):  # children follow their parents
        here = held.pop(i)
        p = z[here] @ tree.axis[i] - tree.at[i]
        for child, part in ((tree.low[i], here[p <= wide[here]]), (tree.high[i], here[p >= -wide[here]])):
            if child >= 0:
                held[child] = part
            else:
                rows.append(part)
                blocks.append(np.full(len(part), -1 - child, np.int64))
    return np.concatenate(rows), np.concatenate(blocks)


def prefixes(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Block of each row."""
    if not tree.axis:
        return np.full(len(x), tree.first, np.int64)
    z = x - tree.centre
    node = np.zeros(len(z), np.int64)
    for i in range(len(tree.axis)):  # children follow their parents
        here = np.flatnonzero(node == i)
        if len(here):
            node[here] = np.where(z[here] @ tree.axis[i] <= tree.at[i], tree.low[i], tree.high[i])
    return -1 - node


@dataclass
class Sorted:
    """One tree in a block. order: rows by ascending string. start, size (levels, rows): the interval of `order` that shares
    as many leading bits with the row; margin: how far the nearest cut of these bits is from it."""

    order: np.ndarray
    start: np.ndarray
    size: np.ndarray
    margin: np.ndarray


def sort_strings(z: np.ndarray, rng: np.random.Generator, bits: int = BITS) -> Sorted:
    """Strings of random projections, each cut at its median."""
    n, dim = z.shape
    axes = rng.standard_normal((dim, bits))
    p = z @ (axes / np.linalg.norm(axes, axis=0))
    p -= np.median(p, axis=0)
    packed = np.zeros((n, 8), np.uint8)
    packed[:, 8 - bits // 8 :] = np.packbits(p > 0, axis=1)
    code = packed.view(">u8").ravel().astype(np.uint64)
    order = np.argsort(code, kind="stable")
    common = bits - np.frexp((code[order][1:] ^ code[order][:-1]).astype(float))[1]  # leading bits shared with the next
    start, size = np.empty((2, bits + 1, n), np.int32)
    for level in range(bits + 1):
        edge = np.r_[0, np.flatnonzero(common < level) + 1, n]
        length = np.diff(edge)
        start[level, order] = np.repeat(edge[:-1], length)
        size[level, order] = np.repeat(length, length)
    margin = np.full((bits + 1, n), np.inf)
    np.minimum.accumulate(np.abs(p).T, axis=0, out=margin[1:])
    return Sorted(order, start, size, margin)


def _intervals(rows: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Rows by their interval: (rows, start, size)."""
    if not len(rows):
        return
    o = np.lexsort((size, start))
    rows, start, size = rows[o], start[o], size[o]
    edge = np.flatnonzero(np.r_[True, (start[1:] != start[:-1]) | (size[1:] != size[:-1]), True])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield rows[a:b], int(start[a]), int(size[a])


def _first_lists(ids: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of the candidates c of rows r, each pair once: ordered by row, distance and id."""
    pair = np.unique(r * len(ids) + c)
    r, c = pair // len(ids), pair % len(ids)
    r, c = r[r != c], c[r != c]
    d = np.sqrt(((x[r] - x[c]) ** 2).sum(1))
    o = np.lexsort((ids[c], d, r))
    r, c, d = r[o], c[o], d[o]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(ids)))[r] < k
    return r[keep], c[keep], d[keep]


def nearest_in_block(
    ids: np.ndarray, x: np.ndarray, k: int, trees: int = TREES, candidates: int = CANDIDATES, within: float = np.inf, seed: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, distance) as positions and distances: the k nearest other rows of each row, ties to the smaller id;
    ordered by row, distance and id. Fewer than k if there are no more rows. Beyond `within` some may be missing."""
    n = len(ids)
    z = x - x.mean(0)
    norm = (z * z).sum(1)
    slack = 1e-14 * (4 + x.shape[1]) * float(norm.max(initial=0.0))
    rng = np.random.default_rng([seed, n])
    forest = [sort_strings(z, rng) for _ in range(trees if n > candidates else 1)]

    # descend to the longest matches, then ascend together
    held = np.sum([t.size for t in forest], axis=0) if n > candidates else forest[0].size[:1]
    level = np.maximum((held >= candidates).sum(0) - 1, 0)
    every = np.arange(n)
    rows, near = [], []
    for t in forest:
        some = every if t is forest[0] else np.flatnonzero(level)
        for q, a, size in _intervals(some, t.start[level[some], some], t.size[level[some], some]):
            cols = t.order[a : a + size]
            y, m = z[cols].T, norm[cols]
            for lo in range(0, len(q), max(1, ENTRIES // size)):
                part = q[lo : lo + max(1, ENTRIES // size)]
                sq = m - 2 * z[part] @ y
                if size > k + 1:
                    r, c = np.nonzero(sq <= np.partition(sq, k, axis=1)[:, k : k + 1] + slack)
                else:
                    r, c = np.indices(sq.shape).reshape(2, -1)
                rows.append(part[r])
                near.append(cols[c])
    r, c, d = _first_lists(ids, x, np.concatenate(rows), np.concatenate(near), k)
    count = np.bincount(r, minlength=n)
    reach = np.full(n, np.inf)
    reach[count == k] = d[np.cumsum(count)[count == k] - 1]
    reach = np.minimum(reach, within)

    # ascend on, where a cut is nearer than the k-th distance
    wide = reach * (1 + 1e-9) + np.sqrt(slack)
    open_ = np.flatnonzero((level > 0) & np.all([t.margin[level, every] <= wide for t in forest], axis=0))
    if not len(open_):
        return r, c, d
    up = np.stack([(t.margin[1:, open_] > wide[open_]).sum(0) for t in forest])
    sizes = np.stack([t.size[u, open_] for t, u in zip(forest, up, strict=True)])
    best = sizes.argmin(0)
    rows, near = [], []
    single, small = z.astype(np.float32), norm.astype(np.float32)
    for i, t in enumerate(forest):
        mine = best == i
        some = open_[mine]
        for q, a, size in _intervals(some, t.start[up[i, mine], some], t.size[up[i, mine], some]):
            cols = t.order[a : a + size]
            step = max(1, ENTRIES // size)
            limit = np.minimum(wide[q] ** 2, 1e300)
            blur = 1e-6 * float(norm[cols].max() + norm[q].max())  # of single precision
            rough = blur <= 0.1 * float(np.median(limit))
            y, m = (single[cols].T, small[cols]) if rough else (z[cols].T, norm[cols])
            bound = np.minimum(limit - norm[q] + (blur if rough else slack), np.finfo(m.dtype).max)[:, None].astype(m.dtype)
            v = single if rough else z
            for lo in range(0, len(q), step):
                part = q[lo : lo + step]
                r2, c2 = np.nonzero(m - 2 * v[part] @ y <= bound[lo : lo + step])
                rows.append(part[r2])
                near.append(cols[c2])
    r2, c2, d2 = _first_lists(ids, x, np.concatenate(rows), np.concatenate(near), k)
    keep = np.isin(r, open_, invert=True)
    r, c, d = np.concatenate([r[keep], r2]), np.concatenate([c[keep], c2]), np.concatenate([d[keep], d2])
    o = np.lexsort((ids[c], d, r))
    return r[o], c[o], d[o]


def _pieces(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Halves along the widest coordinate until a piece has at most `most` rows."""
    todo, out = [np.arange(len(x))], []
    while todo:
        idx = todo.pop()
        if len(idx) <= most:
            out.append(idx)
            continue
        part = x[idx]
        p = part[:, int(part.var(0).argmax())]
        order = np.argpartition(p, len(p) // 2)
        todo += [idx[order[len(p) // 2 :]], idx[order[: len(p) // 2]]]
    return out


def visit(ids: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray, reach: np.ndarray, k: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, row of x, distance): for rows y of ids `own` the k nearest of the rows x that lie within each one's reach."""
    parts = _pieces(x, piece)
    centres = np.stack([x[p].mean(0) for p in parts])
    radius = np.array([np.sqrt(((x[p] - c) ** 2).sum(1).max()) for p, c in zip(parts, centres, strict=True)])
    rows, nbrs, dist = [], [], []
    for lo in range(0, len(y), piece):
        z, bound = y[lo : lo + piece], reach[lo : lo + piece].copy()
        far = np.stack([np.sqrt(((z - c) ** 2).sum(1)) for c in centres], axis=1)
        gap = far - radius - 1e-9 * (far + radius)
        cand_r, cand_c, cand_d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for j in np.argsort(gap.min(0), kind="stable"):
            some = np.flatnonzero(gap[:, j] <= bound)
            if not len(some):
                continue
            a, b = z[some] - centres[j], x[parts[j]] - centres[j]
            norms = (a * a).sum(1)[:, None] + (b * b).sum(1)
            r, c = np.nonzero(norms - 2 * a @ b.T <= (bound[some] ** 2 * (1 + 1e-9))[:, None] + 1e-9 * norms)
            r, c = some[r], parts[j][c]
            d = np.sqrt(((z[r] - x[c]) ** 2).sum(1))
            keep = (d <= bound[r]) & (ids[c] != own[lo + r])
            if not keep.any():
                continue
            cand_r, cand_c, cand_d = np.concatenate([cand_r, r[keep]]), np.concatenate([cand_c, c[keep]]), np.concatenate([cand_d, d[keep]])
            o = np.lexsort((ids[cand_c], cand_d, cand_r))
            cand_r, cand_c, cand_d = cand_r[o], cand_c[o], cand_d[o]
            keep = np.arange(len(cand_r)) - np.searchsorted(cand_r, np.arange(len(z)))[cand_r] < k
            cand_r, cand_c, cand_d = cand_r[keep], cand_c[keep], cand_d[keep]
            count = np.bincount(cand_r, minlength=len(z))
            full = count == k
            bound[full] = np.minimum(bound[full], cand_d[np.cumsum(count)[full] - 1])
        rows.append(lo + cand_r)
        nbrs.append(cand_c)
        dist.append(cand_d)
    return np.concatenate(rows), np.concatenate(nbrs), np.concatenate(dist)


class Held:
    """The rows of a block, which come in the order of their ids within equal vectors; of these only the first k + 1 are held,
    as they are all that can be neighbours. An id counts once."""

    def __init__(self, k: int, most: int) -> None:
        self.k, self.most, self.limit = k, most, most
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n, self.last = 0, None

    def add(self, h: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Takes rows; returns those that it lets go: hashes, ids and the ids of their k neighbours."""
        once = np.r_[self.last is None or ids[0] != self.last, ids[1:] != ids[:-1]]
        self.last = ids[-1]
        self.parts.append((h[once], ids[once], x[once]))
        self.n += int(once.sum())
        if self.n < self.limit:
            return None
        h, ids, x = self.rows()
        o = np.argsort(h, kind="stable")
        start = np.flatnonzero(np.r_[True, h[o][1:] != h[o][:-1]])
        begin = np.repeat(start, np.diff(np.r_[start, len(o)]))
        spare = np.arange(len(o)) - begin > self.k
        out = (h[o[spare]], ids[o[spare]], ids[o[begin[spare][:, None] + np.arange(self.k)]])
        keep = np.sort(o[~spare])
        self.parts, self.n = [(h[keep], ids[keep], x[keep])], len(keep)
        self.limit = max(self.most, 2 * self.n)
        return out if spare.any() else None

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, ids, x = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        return h, ids, x


def _matrix(column: pa.Array) -> np.ndarray:
    """List column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) + 0.0  # -0.0 becomes 0.0


def _placed_batches(forest: dict[int, Tree], batch: pa.RecordBatch, every: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of each group (grp, id, vec, h), their vectors and blocks. every: of groups without cuts, too."""
    group = batch.column(0).to_numpy()
    rest = np.ones(len(group), bool)
    for g in forest.keys() & {*np.unique(group).tolist()}:
        rest &= group != g
        part = batch.filter(pa.array(group == g))
        x = _matrix(part.column(2))
        yield part, x, prefixes(forest[g], x)
    if every and rest.any():
        part = batch.filter(pa.array(rest))
        yield part, None, group[rest].astype(np.int64) + WHOLE


def _assign(sent):
    """Rows with their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = cloudpickle.loads(sent.value)
        for batch in batches:
            for part, _, block in _placed_batches(forest, batch, True):
                yield pa.RecordBatch.from_arrays([pa.array(block), *part.columns], ["block", *part.schema.names])

    return run


def _blocks(sent):
    """(block, h) of the rows of groups with cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = cloudpickle.loads(sent.value)
        for batch in batches:
            for part, _, block in _placed_batches(forest, batch, False):
                yield pa.RecordBatch.from_arrays([pa.array(block), part.column(3)], ["block", "h"])

    return run


def _drawn(sent, shares, seed: int):
    """(block, h, vec) of a share of the rows of each block in `shares`, by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, share = cloudpickle.loads(sent.value), cloudpickle.loads(shares.value)
        for batch in batches:
            for part, _, block in _placed_batches(forest, batch, False):
                h = part.column(3).to_numpy().view(np.uint64)
                draw = ((h ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(34)) / 2.0**30
                kinds, at = np.unique(block, return_inverse=True)
                some = np.flatnonzero(draw < np.array([share.get(b, 0.0) for b in kinds.tolist()])[at])
                part = part.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([pa.array(block[some]), part.column(3), part.column(2)], ["block", "h", "vec"])

    return run


def _refit(sent, over, cap: int, seed: int):
    """Cuts of a block by its sample; its blocks are numbered from 0."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        b = int(part["block"].iloc[0])
        g, n = cloudpickle.loads(over.value)[b]
        x = np.stack(part.sort_values("h")["vec"].to_numpy()) + 0.0
        tree = fit_tree(x, n, cap, 0, np.random.default_rng([seed, abs(g), b]), cloudpickle.loads(sent.value)[g].centre)
        return pd.DataFrame({"block": [b], "cuts": [cloudpickle.dumps(tree)]})

    return run


def fit_forest(rows: DataFrame, cap: int, seed: int) -> tuple[dict[int, Tree], int]:
    """Trees of the groups above the cap, and the number of blocks. Blocks are counted over all rows (copies once, as only a
    few of them are held), those above the cap cut by samples of their own, and counted again, until none is left that can be
    cut. rows: grp, id, vec, h."""
    sc = rows.sparkSession.sparkContext
    most = cap * 5 // 4
    n_rows = F.approx_count_distinct("h", 0.02).alias("n")
    forest: dict[int, Tree] = {}
    over: dict[int, tuple[int, int]] = {}
    for r in rows.groupBy("grp").agg(n_rows).where(F.col("n") > most).orderBy("grp").collect():  # fewer than rows / cap
        forest[r["grp"]] = Tree(len(over), n_blocks=1)
        over[len(over)] = (r["grp"], r["n"])
    blocks, whole = len(over), set()
    while over:
        sent, told = sc.broadcast(cloudpickle.dumps(forest)), sc.broadcast(cloudpickle.dumps(over))  # a cut for each block of some cap rows
        shares = sc.broadcast(cloudpickle.dumps({b: min(1.0, SAMPLE / n) for b, (_, n) in over.items()}))
        part = rows.mapInArrow(_drawn(sent, shares, seed), "block bigint, h bigint, vec array<double>").groupBy("block", "h").agg(F.first("vec").alias("vec"))
        cuts = {r["block"]: cloudpickle.loads(bytes(r["cuts"])) for r in part.groupBy("block").applyInPandas(_refit(sent, told, cap, seed), "block bigint, cuts binary").collect()}
        owner = {}
        for b, (g, _) in over.items():
            sub = cuts.get(b)
            if sub is None or sub.n_blocks == 1:
                whole.add(b)
                continue
            sub.low, sub.high = ([c if c >= 0 else c - blocks for c in side] for side in (sub.low, sub.high))
            graft(forest[g], b, sub)
            owner |= dict.fromkeys(range(blocks, blocks + sub.n_blocks), g)
            blocks += sub.n_blocks
        if not owner:
            break
        sent = sc.broadcast(cloudpickle.dumps(forest))
        counted = rows.mapInArrow(_blocks(sent), "block bigint, h bigint").groupBy("block").agg(n_rows).where(F.col("n") > most).orderBy("block").collect()
        over = {r["block"]: (owner[r["block"]], r["n"]) for r in counted if r["block"] in owner}
    return forest, blocks


def _lists(g: int, h: np.ndarray, ids: np.ndarray, count: np.ndarray, d: np.ndarray, near: np.ndarray, visits: np.ndarray | None = None, **more: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    offsets = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(d), pa.array(near)], ["d", "id"]))
    empty = {"block": pa.nulls(n, pa.int64()), "vec": pa.nulls(n, pa.list_(pa.float64())), "reach": pa.nulls(n, pa.float64())}
    columns = {"grp": pa.array(np.full(n, g, np.int32)), "id": pa.array(ids), "h": pa.array(h), "near": lists, "visits": pa.array(np.zeros(n, bool) if visits is None else visits)} | empty | more
    return pa.RecordBatch.from_pydict(columns)


LISTS = "grp int, id bigint, h bigint, near array<struct<d:double,id:bigint>>, visits boolean, block bigint, vec array<double>, reach double"


def _vectors(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))


def _search(sent, k: int, trees: int, candidates: int, cap: int, within: dict[int, float] | None):
    """Lists over rows sorted by block and id, and after them the visits to other blocks: a row for each, with the block, the
    vector and its reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = cloudpickle.loads(sent.value)
        block, g, held = None, 0, Held(k, cap)

        def flush() -> Iterator[pa.RecordBatch]:
            h, ids, x = held.rows()
            most = np.inf if within is None else within.get(g, 0.0)
            r, c, d = nearest_in_block(ids, x, k, trees, candidates, most)
            count = np.bincount(r, minlength=len(ids))
            if g not in forest:
                yield _lists(g, h, ids, count, d, ids[c])
                return
            reach = np.full(len(ids), np.inf)
            reach[count == k] = d[np.cumsum(count)[count == k] - 1]
            reach = np.minimum(reach, most)
            visits = np.zeros(len(ids), bool)
            for lo in range(0, len(ids), 2048):
                at, other = reached(forest[g], x[lo : lo + 2048], reach[lo : lo + 2048])
                at, other = lo + at[other != block], other[other != block]
                visits[at] = True
                for i in range(0, len(at), 8192):
                    j = at[i : i + 8192]
                    none = np.zeros(len(j), np.int64)
                    yield _lists(g, h[j], ids[j], none, np.empty(0), none[:0], block=pa.array(other[i : i + 8192]), vec=_vectors(x[j]), reach=pa.array(reach[j]))
            yield _lists(g, h, ids, count, d, ids[c], visits)

        for batch in batches:
            b = batch.column(0).to_numpy()
            for lo, hi in zip(edges := np.r_[0, np.flatnonzero(b[1:] != b[:-1]) + 1], np.r_[edges[1:], len(b)], strict=True):
                if b[lo] != block:
                    if held.n:
                        yield from flush()
                    block, held = b[lo], Held(k, cap)
                part = batch.slice(lo, hi - lo)
                g = part.column(1)[0].as_py()
                if out := held.add(part.column(4).to_numpy(), part.column(2).to_numpy(), _matrix(part.column(3))):
                    h, ids, near = out
                    yield _lists(g, h, ids, np.full(len(ids), k), np.zeros(near.size), near.ravel())
        if held.n:
            yield from flush()

    return run


def _visited(sent, far: dict[int, float]):
    """The rows that a visit can reach, with their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = cloudpickle.loads(sent.value)
        for batch in batches:
            for part, x, block in _placed_batches({g: forest[g] for g in far}, batch, False):
                g = part.column(0)[0].as_py()
                at, _ = reached(forest[g], x, np.full(len(x), far[g]))
                some = np.flatnonzero(np.bincount(at, minlength=len(x)) > 1)
                part = part.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([pa.array(block[some]), *part.columns, pa.nulls(len(some), pa.float64())], ["block", *part.schema.names, "reach"])

    return run


def _visits(k: int, cap: int, piece: int):
    """Lists of the visits, over rows sorted by block, reach (members have none and come first) and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, Held(k, cap)
        for batch in batches:
            b, member = batch.column(0).to_numpy(), batch.column(5).is_null().to_numpy(zero_copy_only=False)
            for lo, hi in zip(edges := np.r_[0, np.flatnonzero((b[1:] != b[:-1]) | (member[1:] != member[:-1])) + 1], np.r_[edges[1:], len(b)], strict=True):
                if b[lo] != block:
                    block, held = b[lo], Held(k, cap)
                part = batch.slice(lo, hi - lo)
                h, ids, x = part.column(4).to_numpy(), part.column(2).to_numpy(), _matrix(part.column(3))
                if member[lo]:
                    held.add(h, ids, x)
                elif held.n:
                    _, others, y = held.parts[0] = held.rows()
                    del held.parts[1:]
                    r, c, d = visit(others, y, ids, x, part.column(5).to_numpy(), k, piece)
                    count = np.bincount(r, minlength=len(ids))
                    some = np.flatnonzero(count)
                    yield _lists(part.column(1)[0].as_py(), h[some], ids[some], count[some], d, others[c])

    return run


def nearest(
    df: DataFrame, group_col: str, id_col: str, vec_col: str, k: int = K, trees: int = TREES, candidates: int = CANDIDATES, cap: int = CAP, seed: int = 11, within: dict[int, float] | None = None
) -> DataFrame:
    """(grp, id, near): for every row the k nearest other rows of its group by Euclidean distance, near an array of (d, id)
    in ascending order; ties go to the smaller id. Groups and ids are integers.

    All vectors of a group have the same length and are finite (see `usable_rows`). An id counts once; its copies have the
    same vector. Equal vectors of different ids are neighbours at distance 0. A row of a group with fewer than k others has a
    shorter list. An empty table gives an empty result. cap: rows that are searched together; within: a radius for each group
    beyond which neighbours may be missing or others stand in their place (groups without one: 0), which saves visits.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group_col).cast("int").alias("grp"), F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).where("grp is not null and id is not null and vec is not null")
    rows = rows.withColumn("h", F.xxhash64(F.transform("vec", lambda x: x + 0.0)))
    forest, blocks = fit_forest(rows, cap, seed)
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(forest))  # a cut for each block
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * blocks, 4000))
    placed = rows.mapInArrow(_assign(sent), "block bigint, grp int, id bigint, vec array<double>, h bigint")
    found = placed.repartition(parts, "block").sortWithinPartitions("block", "id").mapInArrow(_search(sent, k, trees, candidates, cap, within), LISTS)
    if not forest:
        return found.select("grp", "id", "near")
    found = cut(found)
    lists = found.where("block is null").select("grp", "id", "near", "visits")
    far = {r["grp"]: r["far"] for r in found.where("block is not null").groupBy("grp").agg(F.max("reach").alias("far")).collect()}  # a row for each group with cuts
    if not far:
        return lists.drop("visits")
    visitors = found.where("block is not null").select("block", "grp", "id", "vec", "h", "reach")
    members = rows.mapInArrow(_visited(sent, far), "block bigint, grp int, id bigint, vec array<double>, h bigint, reach double")
    both = members.unionByName(visitors).repartition(parts, "block").sortWithinPartitions("block", F.col("reach").isNotNull(), "id")
    more = both.mapInArrow(_visits(k, cap, PIECE), LISTS).select("grp", "id", "near")
    every = F.array_distinct(F.flatten(F.collect_list("near")))  # a list of k from each visit
    joined = lists.where("visits").drop("visits").unionByName(more).groupBy("grp", "id").agg(F.slice(F.array_sort(every), 1, k).alias("near"))
    return lists.where("not visits").drop("visits").unionByName(joined)


def recall(df: DataFrame, group_col: str, id_col: str, vec_col: str, found: DataFrame, queries: float = 0.05, seed: int = 3) -> float:
    """Share of the true neighbours that `found` has, for a share of the ids against all rows by brute force. For tests and
    measurements; the queries are collected."""
    rows = df.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).dropDuplicates(["id"])
    asked = found.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) < 1000 * queries).collect()
    data = rows.toPandas()
    hit = total = 0
    by = {g: (p["id"].to_numpy(), np.stack(p["vec"].to_numpy())) for g, p in data.groupby("grp")}
    place = {g: dict(zip(i.tolist(), range(len(i)), strict=True)) for g, (i, _) in by.items()}
    for r in asked:
        ids, x = by[r["grp"]]
        d = np.sqrt(((x - x[place[r["grp"]][r["id"]]]) ** 2).sum(1))
        d[place[r["grp"]][r["id"]]] = np.inf
        best = np.lexsort((ids, d))[: len(r["near"])]
        hit += len({*ids[best].tolist()} & {n["id"] for n in r["near"]})
        total += len(best)
    return hit / max(1, total)


def q_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(usable_rows(spark, d), "matrix_id", "row_id", "elements")
    out = near.select(F.col("grp").alias("matrix_id"), F.col("id").alias("row_id"), F.posexplode("near").alias("rank", "n"))
    return out.select("matrix_id", "row_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("neighbour_id"), F.round("n.d", 6).alias("distance"))


def q_found(spark: SparkSession, d: str) -> DataFrame:
    heads = spark.read.parquet(f"{d}/matrix_headers.parquet").select(F.col("matrix_id").alias("grp"), "similar_within")
    within = {r["grp"]: r["similar_within"] for r in heads.where("grp is not null and similar_within is not null").collect()}  # a row for each matrix
    near = nearest(usable_rows(spark, d), "matrix_id", "row_id", "elements", within=within)
    pairs = near.select("grp", "id", F.explode("near").alias("n")).join(heads, "grp").where("n.d <= similar_within")
    return pairs.select(F.least("id", "n.id").alias("row_id_a"), F.greatest("id", "n.id").alias("row_id_b")).distinct()


QUERIES = {"p5_neighbours": q_neighbours, "p5_found": q_found}
_BEST = """rows AS (SELECT DISTINCT matrix_id, row_id, elements, similar_within FROM matrix_rows JOIN matrix_headers USING (matrix_id)
  WHERE len(elements) = n_columns AND len(list_filter(elements, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
near AS (SELECT a.matrix_id, a.row_id AS a, b.row_id AS b, a.similar_within AS r, list_distance(a.elements, b.elements) AS d FROM rows a JOIN rows b ON a.matrix_id = b.matrix_id AND a.row_id <> b.row_id),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM near)"""
ORACLES = {
    "p5_found": f"WITH {_BEST} SELECT DISTINCT least(a, b) AS row_id_a, greatest(a, b) AS row_id_b FROM best WHERE k <= 5 AND d <= r",
    "p5_neighbours": f"WITH {_BEST} SELECT matrix_id, a AS row_id, k::INT AS rank, b AS neighbour_id, round(d, 6) AS distance FROM best WHERE k <= 5",
}
