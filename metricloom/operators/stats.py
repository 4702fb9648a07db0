"""Statistics that the algorithms share: histograms, quantiles, gaps, covariance, curves. Null values never count."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metricloom.operators.durable import cut


def histogram(df: DataFrame, column: str, start: float, width: float) -> DataFrame:
    """(bin, n): bin is floor((x - start) / width); NaN does not count. Empty bins have no row."""
    if not width > 0:
        raise ValueError("width must be positive")
    x = F.col(column).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(F.floor((x - start) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_2d(df: DataFrame, columns: tuple[str, str], starts: tuple[float, float], widths: tuple[float, float]) -> DataFrame:
    """(bin_x, bin_y, n)."""
    x, y = (F.col(c).cast("double") for c in columns)
    keep = df.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    return keep.groupBy(F.floor((x - starts[0]) / widths[0]).alias("bin_x"), F.floor((y - starts[1]) / widths[1]).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))


def pivot_histogram(embedded: DataFrame, columns: Sequence[str], width: float, fixed: dict[str, int] | None = None) -> DataFrame:
    """(columns..., n): joint histogram of pivot distances; `fixed` keeps the rows in given bins of some dimensions."""
    bins = {c: F.floor(F.col(c) / width).alias(c) for c in columns}
    out = embedded
    for c, b in (fixed or {}).items():
        out = out.where(F.floor(F.col(c) / width) == b)
    return out.groupBy(*bins.values()).agg(F.count(F.lit(1)).alias("n"))


def histogram_summary(hist: DataFrame) -> DataFrame:
    """(bins, total, most, mean, std, entropy) of a histogram's column n; entropy is ln N - sum c ln c / N."""
    total = F.sum("n")
    return hist.agg(
        F.count(F.lit(1)).alias("bins"), total.alias("total"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"),
        (F.ln(total) - F.sum(F.col("n") * F.ln("n")) / total).alias("entropy"),
    )


def quantiles(df: DataFrame, groups: Sequence[str], column: str, probs: Sequence[float], exact: bool = True) -> DataFrame:
    """(groups..., p, value): nearest rank round(p (n - 1)) from 0, halves up. exact=False: by the mergeable sketch of
    `percentile_approx`, for columns whose groups don't fit a task."""
    rows = df.where(F.col(column).isNotNull())
    if not exact:
        at = rows.groupBy(*groups).agg(F.percentile_approx(column, list(probs), 10_000).alias("_v"))
        return at.select(*groups, F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"), F.col("_v").alias("value"))).alias("_x")).select(*groups, "_x.p", "_x.value")
    # counts of distinct values first: a hot group shrinks before it is ordered
    counted = rows.groupBy(*groups, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*groups)
    cum = counted.withColumn("_to", F.sum("_c").over(w.orderBy("value"))).withColumn("_n", F.sum("_c").over(w))
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.floor(F.lit(float(p)) * (F.col("_n") - 1) + 0.5).alias("rank")) for p in probs])
    return cum.withColumn("_q", F.explode(ranks)).where("_q.rank < _to and _q.rank >= _to - _c").select(*groups, F.col("_q.p").alias("p"), "value")


def _ordered(df: DataFrame, column: str) -> DataFrame:
    """(x, part) in global order: range-partitioned, each part sorted."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return cut(x.repartitionByRange("x").sortWithinPartitions("x").withColumn("part", F.spark_partition_id()))


def exclusion_curve(df: DataFrame, column: str, reach: float, steps: int = 19) -> DataFrame:
    """(cut, excluded) at each of evenly spaced quantiles of all rows: the expected share of rows that a query at a row's place
    leaves out, if its ball covers `reach` to both sides of the cut. Quantiles are of the nearest rank, halves up."""
    ordered = _ordered(df, column)
    before, at = {}, 0
    for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each part
        before[r["part"]], at = at, at + r["n"]
    if not at:
        return df.sparkSession.createDataFrame([], "cut double, excluded double")
    ranks = [(k * (at - 1) * 2 + steps + 1) // (2 * (steps + 1)) for k in range(1, steps + 1)]
    start = F.create_map(*[F.lit(v) for part, n in before.items() for v in (part, n)])[F.col("part")]
    upto = ordered.withColumn("to", start + F.sum("n").over(Window.partitionBy("part").orderBy("x")))
    cuts = sorted(r["x"] for r in upto.select("x", F.explode(F.array(*map(F.lit, ranks))).alias("rank"), "to", "n").where("rank < to and rank >= to - n").collect())  # `steps` rows
    x, n = F.col("x"), F.col("n")
    sums = [F.sum(F.when(c, n).otherwise(0)) for t in cuts for c in (x < t, x + reach < t, x - reach >= t)]
    got = [v / at for v in ordered.agg(*sums).first()]
    curve = [(t, left * (1 - low) + right * low) for t, low, left, right in zip(cuts, got[::3], got[1::3], got[2::3], strict=True)]
    return df.sparkSession.createDataFrame(curve, "cut double, excluded double")


def max_gap(df: DataFrame, column: str) -> tuple[float, float] | None:
    """(threshold, gap): the middle of the widest gap between neighbouring values, the first of equals; None without two
    distinct values. Parts are scanned apart, only their ends meet on the driver."""
    parts = _ordered(df, column)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        best, at = -1.0, 0.0
        for b in batches:
            x = b["x"].to_numpy()
            if not len(x):
                continue
            if last is not None:
                x = np.r_[last, x]
            else:
                first = x[0]
            gap = np.diff(x)
            if len(gap) and gap.max() > best:
                i = int(gap.argmax())
                best, at = float(gap[i]), float((x[i] + x[i + 1]) / 2)
            last = x[-1]
        if first is not None:
            yield pd.DataFrame({"first": [first], "last": [last], "gap": [best], "at": [at]})

    rows = sorted(parts.mapInPandas(ends, "first double, last double, gap double, at double").collect(), key=lambda r: r["first"])  # a row for each part
    found = [(r["at"], r["gap"]) for r in rows if r["gap"] >= 0] + [((a["last"] + b["first"]) / 2, b["first"] - a["last"]) for a, b in zip(rows, rows[1:], strict=False)]
    return min(found, key=lambda g: (-g[1], g[0])) if found else None


def otsu(df: DataFrame, column: str) -> float | None:
    """The cut between values that maximises the variance between the two sides (its middle); None without two distinct
    values. Running sums go over parts by their totals."""
    parts = _ordered(df, column)
    sums = {r["part"]: (r["n"], r["s"]) for r in parts.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("s"), F.min("x").alias("lo")).orderBy("lo").collect()}
    if not sums:
        return None
    before, n, s = {}, 0.0, 0.0
    for p, (a, b) in sums.items():
        before[p] = (n, s)
        n, s = n + a, s + b
    nexts = sorted(parts.groupBy("part").agg(F.min("x").alias("lo")).collect(), key=lambda r: r["lo"])
    after = {a["part"]: b["lo"] for a, b in zip(nexts, nexts[1:], strict=False)}

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            b = pd.concat(held)
            x, c, p = b["x"].to_numpy(), b["n"].to_numpy(), int(b["part"].iloc[0])
            n1 = before[p][0] + np.cumsum(c)
            s1 = before[p][1] + np.cumsum(c * x)
            follow = np.r_[x[1:], after.get(p, np.nan)]
            ok = ~np.isnan(follow)
            if ok.any():
                n1, s1, x, follow = n1[ok], s1[ok], x[ok], follow[ok]
                between = n1 * (n - n1) * (s1 / n1 - (s - s1) / (n - n1)) ** 2
                i = int(between.argmax())
                yield pd.DataFrame({"between": [float(between[i])], "at": [float((x[i] + follow[i]) / 2)]})

    got = parts.mapInPandas(best, "between double, at double").collect()  # a row for each part
    return min(got, key=lambda r: (-r["between"], r["at"]))["at"] if got else None


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, cov): population covariance of each pair of columns, i <= j, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.covar_pop(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def principal_axes(df: DataFrame, columns: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances and axes (columns), largest first; the sign makes each axis' largest entry positive."""
    m = np.zeros((len(columns), len(columns)))
    at = {c: i for i, c in enumerate(columns)}
    for r in covariance(df, columns).collect():
        m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r["cov"] or 0.0
    values, axes = np.linalg.eigh(m)
    axes = axes[:, ::-1][:, :k]
    return values[::-1][:k], axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)


def cluster_features(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(groups..., n, ls, ss, radius): count, linear sums and squared sum of a group's vectors, which add up, and the radius
    sqrt((n ss - |ls|^2) / n^2)."""
    out = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in columns]).alias("ls"), sum((F.sum(F.col(c) * F.col(c)) for c in columns[1:]), F.sum(F.col(columns[0]) * F.col(columns[0]))).alias("ss")
    )
    norm = F.aggregate("ls", F.lit(0.0), lambda s, x: s + x * x)
    return out.withColumn("radius", F.sqrt(F.greatest((F.col("n") * F.col("ss") - norm) / (F.col("n") * F.col("n")), F.lit(0.0))))


def running(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """df with, for each column, the sum over all rows of smaller `order` (`<column>_before`). `order` holds no ties.

    Rows are range-partitioned and summed within their part; the parts' totals, a row for each part, give the offsets."""
    parts = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    got = sorted(parts.groupBy("_part").agg(F.min(order).alias("_o"), *[F.sum(c).alias(c) for c in columns]).collect(), key=lambda r: r["_o"])
    rows, so_far = [], [0.0] * len(columns)
    for r in got:
        rows.append((r["_part"], *so_far))
        so_far = [a + float(r[c] or 0) for a, c in zip(so_far, columns, strict=True)]
    offsets = df.sparkSession.createDataFrame(rows, "_part int, " + ", ".join(f"_off_{c} double" for c in columns))
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(offsets), "_part")  # a row for each part
    return out.select(*df.columns, *[(F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"{c}_before") for c in columns])


def _by_score(df: DataFrame, score: str, positive: str) -> DataFrame:
    keep = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    return keep.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))


def roc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(score, tpr, fpr) with the cut at each distinct score, rows at the cut included; null rates for a missing class."""
    by = _by_score(df, score, positive)
    total = by.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    p, q = total["p"] or None, total["q"] or None
    cum = running(by, "score", ["p", "q"])
    return cum.select("score", ((F.lit(p) - F.col("p_before")) / F.lit(p)).alias("tpr"), ((F.lit(q) - F.col("q_before")) / F.lit(q)).alias("fpr"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(auc): chance that a positive row scores above a negative one, ties a half; null without both classes."""
    cum = running(_by_score(df, score, positive), "score", ["q"])
    won = F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2))
    return cum.agg((won / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))
