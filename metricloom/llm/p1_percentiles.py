"""Percentiles per group over very large numeric columns by radix selection.

A value is mapped to a signed 64-bit integer of the same order (its IEEE-754 bits, negated for negative values),
so that a percentile is a rank among integers.  Successive digits of that integer are histogrammed; only rows in a
digit that holds a target rank take part in the next pass.  Every pass is a partial aggregation, so a group with a
third of all rows shuffles no more than its histogram.

The histogram of the leading bits is also a summary that can be added up: days or partitions are summarised apart
(`sketch`), united (`merge_sketches`) and read (`sketch_percentiles`) with a relative error of at most
2 ** -(mantissa_bits + 1) for the estimate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metricloom.llm.shared import cut, small

METRICS = ("query_ns", "index_distance_count", "rho", "radius")
#: Columns in which a negative value is a measurement; elsewhere it stands for a missing one.
SIGNED = ("rho",)


def order_keys(df: DataFrame, keep: Sequence[str], values: Sequence[str], signed: Sequence[str] = ()) -> DataFrame:
    """`keep` and, under their names, the signed 64-bit order keys of the values. What does not count has a null key: null
    and NaN, and a negative value of a column outside `signed`. -0.0 and 0.0 have the same key.

    The bits of a double can't be read by built-in functions, and arithmetic on logarithms and powers costs ten times as
    much, so this one step runs on Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for i, v in enumerate(values, len(keep)):
                x = batch.column(i).cast(pa.float64(), safe=False)
                x = np.nan_to_num(x.to_numpy(zero_copy_only=False), nan=np.nan, posinf=np.inf, neginf=-np.inf)
                bits = np.abs(x).view(np.int64)
                skip = np.isnan(x) if v in signed else ~(x >= 0)
                keys.append(pa.array(np.where(x < 0, -bits, bits), pa.int64(), mask=skip))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *keys], [*keep, *values])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{v}` bigint" for v in values])
    return df.select(*keep, *values).mapInArrow(run, schema)


def key_value(key: Column) -> Column:
    """The double of an order key."""
    k = F.abs(key)
    e = F.shiftright(k, 52)
    m = k.bitwiseAND(F.lit((1 << 52) - 1))
    size = (
        F.when(e == 0, m.cast("double") * 2.0**-537 * 2.0**-537)
        .when(e == 2047, F.lit(float("inf")))
        .otherwise((m.cast("double") / float(1 << 52) + 1) * F.pow(F.lit(2.0), (e - 1023).cast("double")))
    )
    return F.when(key < 0, -size).otherwise(size)


def once(df: DataFrame, id_col: str) -> DataFrame:
    """One row for each id. Copies of an id agree; where they don't, the largest value of each column counts."""
    return df.groupBy(id_col).agg(*[F.max(c).alias(c) for c in df.columns if c != id_col])


def _long(keys: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(groups..., metric_name, _k): one row for each value that counts."""
    parts = F.array(*[F.struct(F.lit(v).alias("metric_name"), F.col(v).alias("k")) for v in values])
    return keys.select(*groups, F.explode(parts).alias("_v")).where("_v.k is not null").select(*groups, F.col("_v.metric_name").alias("metric_name"), F.col("_v.k").alias("_k"))


def radix_percentiles(
    keys: DataFrame, groups: Sequence[str], values: Sequence[str], probs: Sequence[float], digits: Sequence[int] = (16, 16, 16, 16)
) -> DataFrame:
    """(groups..., metric_name, p, n, value, rel_error): nearest-rank percentiles, the ceil(p * n)-th smallest value.

    keys: from `order_keys`. digits: widths of the radix digits, most significant first. Together 64 they give the exact
    value (rel_error 0); fewer give the edge nearest zero of the last bucket, at most rel_error off for normal numbers.
    Groups may be null (a group of its own); a group without a counting value has no row; an empty table gives none.
    Infinite values count at the ends of the order. p must lie in (0, 1].
    """
    if not probs or not all(0 < p <= 1 for p in probs):
        raise ValueError("probs must lie in (0, 1]")
    if sum(digits) > 64 or min(digits) < 1:
        raise ValueError("digits must be positive and sum to at most 64")
    keys = cut(keys.select(*groups, *values))
    long = _long(keys, groups, values)
    g = [*groups, "metric_name"]
    shift = 64 - digits[0]
    w = Window.partitionBy(*g).orderBy("_d")
    hist = long.groupBy(*g, F.shiftright("_k", shift).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    hist = hist.withColumn("_cum", F.sum("_c").over(w)).withColumn("n", F.sum("_c").over(Window.partitionBy(*g)))
    at = _at_ranks(hist, probs).select(*g, "n", F.col("_t.p").alias("p"), "_d", (F.col("_t.rank") - F.col("_cum") + F.col("_c")).alias("_r"))
    for width in digits[1:]:
        at, shift = _follow(long, *small(at), g, shift, width), shift - width
    rel = 0.0 if shift == 0 else 2.0 ** (shift - 52) if shift <= 52 else float("inf")
    low = F.shiftleft("_d", shift)
    near = F.when(F.col("_d") < 0, low + F.lit((1 << shift) - 1)).otherwise(low)
    return at.select(*g, "p", "n", key_value(near).alias("value"), F.lit(rel).alias("rel_error"))


def _rank(p: float) -> Column:
    """ceil(p * n) in whole numbers; p is taken as the nearest ratio with a denominator up to a million."""
    ratio = Fraction(p).limit_denominator(10**6)
    return F.expr(f"(n * {ratio.numerator}L + {ratio.denominator - 1}L) div {ratio.denominator}L")


def _at_ranks(hist: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The buckets that hold the ranks of probs: hist with _t (p, rank), once for each."""
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), _rank(p).alias("rank")) for p in probs])
    return hist.withColumn("_t", F.explode(ranks)).where("_t.rank <= _cum and _t.rank > _cum - _c")


def _follow(long: DataFrame, at: DataFrame, hint: Callable[[DataFrame], DataFrame], g: list[str], shift: int, width: int) -> DataFrame:
    """The next digit of each target: histogram of the rows whose leading digits hold a target."""
    held = at.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(g)], F.col("_d").alias("_hd")).distinct()
    same = lambda right: [F.col(c).eqNullSafe(F.col(f"{right}{i}")) for i, c in enumerate(g)]
    hist = (
        long.join(hint(held), [F.shiftright("_k", shift) == F.col("_hd"), *same("_h")], "left_semi")
        .groupBy(*g, F.shiftright("_k", shift).alias("_up"), F.shiftright("_k", shift - width).alias("_d"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    hist = hist.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*g, "_up").orderBy("_d")))
    t = at.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(g)], "n", "p", F.col("_d").alias("_td"), F.col("_r").alias("_tr"))
    within = (F.col("_tr") <= F.col("_cum")) & (F.col("_tr") > F.col("_cum") - F.col("_c"))
    joined = hist.join(hint(t), [F.col("_up") == F.col("_td"), *same("_t"), within])
    return joined.select(*g, "n", "p", "_d", (F.col("_tr") - F.col("_cum") + F.col("_c")).alias("_r"))


def sketch(keys: DataFrame, groups: Sequence[str], values: Sequence[str], mantissa_bits: int = 10) -> DataFrame:
    """(groups..., metric_name, digit, n): counts by the leading 12 + mantissa_bits bits. Sketches of disjoint rows add up."""
    if not 0 <= mantissa_bits <= 52:
        raise ValueError("mantissa_bits must lie in 0..52")
    return _long(keys, groups, values).groupBy(*groups, "metric_name", F.shiftright("_k", 52 - mantissa_bits).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One sketch for each of `groups` from those of any finer grouping (days, partitions; unite them first)."""
    return parts.groupBy(*groups, "metric_name", "digit").agg(F.sum("n").alias("n"))


def sketch_percentiles(sk: DataFrame, groups: Sequence[str], probs: Sequence[float], mantissa_bits: int = 10) -> DataFrame:
    """(groups..., metric_name, p, n, low, high, estimate, rel_error): the nearest-rank percentile lies in [low, high];
    |estimate - percentile| <= rel_error * |percentile| for normal numbers. mantissa_bits as in `sketch`."""
    g = [*groups, "metric_name"]
    shift = 52 - mantissa_bits
    hist = sk.withColumnRenamed("n", "_c")
    hist = hist.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*g).orderBy("digit"))).withColumn("n", F.sum("_c").over(Window.partitionBy(*g)))
    at = _at_ranks(hist, probs)
    low = key_value(F.shiftleft("digit", shift))
    high = key_value(F.shiftleft("digit", shift) + F.lit((1 << shift) - 1))
    at = at.select(*g, F.col("_t.p").alias("p"), "n", low.alias("low"), high.alias("high"))
    return at.withColumns({"estimate": F.expr("if(low = high, low, low + (high - low) / 2)"), "rel_error": F.lit(2.0 ** -(mantissa_bits + 1))})


def _runs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Order keys of the runs, each run once."""
    return once(order_keys(spark.read.parquet(f"{d}/query_runs.parquet"), ["run_id", "dataset_id", *more], METRICS, SIGNED), "run_id")


def q_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return radix_percentiles(_runs(spark, d), ["dataset_id"], METRICS, (0.05, 0.25, 0.5, 0.75, 0.9, 0.99)).drop("rel_error")


def q_daily(spark: SparkSession, d: str) -> DataFrame:
    """A summary for each day of run_ts."""
    return sketch(_runs(spark, d, "run_ts").withColumn("day", F.to_date("run_ts").cast("string")), ["dataset_id", "day"], METRICS)


def q_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles read from the united summaries of the days."""
    return sketch_percentiles(merge_sketches(q_daily(spark, d), ["dataset_id"]), ["dataset_id"], (0.25, 0.5, 0.75, 0.9, 0.99))


def q_found(spark: SparkSession, d: str) -> DataFrame:
    """Two digits of 16 bits: either percentile is at most 2**-20 of itself too small."""
    limits = spark.read.parquet(f"{d}/spread_limits.parquet").select("metric_name", "min_ratio")
    at = radix_percentiles(_runs(spark, d), ["dataset_id"], METRICS, (0.5, 0.9), (16, 16))
    wide = at.groupBy("dataset_id", "metric_name").agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("med"), F.max(F.when(F.col("p") == 0.9, F.col("value"))).alias("p90"))
    return wide.join(limits, "metric_name").where("p90 >= min_ratio * med").select("dataset_id", "metric_name").distinct()


_LONG = """runs AS (SELECT DISTINCT run_id, dataset_id, query_ns, index_distance_count, rho, radius FROM query_runs),
long AS (SELECT dataset_id, 'query_ns' AS metric_name, query_ns::DOUBLE AS x FROM runs WHERE query_ns >= 0
  UNION ALL SELECT dataset_id, 'index_distance_count', index_distance_count::DOUBLE FROM runs WHERE index_distance_count >= 0
  UNION ALL SELECT dataset_id, 'rho', rho FROM runs WHERE rho IS NOT NULL AND NOT isnan(rho)
  UNION ALL SELECT dataset_id, 'radius', radius FROM runs WHERE radius >= 0 AND NOT isnan(radius))"""

QUERIES = {"p1_percentiles": q_percentiles, "p1_daily": q_daily, "p1_merged": q_merged, "p1_found": q_found}
ORACLES = {
    "p1_percentiles": f"""WITH {_LONG},
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, metric_name ORDER BY x) AS rn, count(*) OVER (PARTITION BY dataset_id, metric_name) AS n FROM long),
ps AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.9, 0.99])::DOUBLE AS p)
SELECT dataset_id, metric_name, p, n, x AS value FROM ranked, ps WHERE rn = ceil(p * n - 1e-9)""",
    "p1_daily": """WITH runs AS (SELECT DISTINCT run_id, dataset_id, run_ts, query_ns, index_distance_count, rho, radius FROM query_runs),
long AS (SELECT dataset_id, run_ts, 'query_ns' AS metric_name, query_ns::DOUBLE AS x FROM runs WHERE query_ns >= 0
  UNION ALL SELECT dataset_id, run_ts, 'index_distance_count', index_distance_count::DOUBLE FROM runs WHERE index_distance_count >= 0
  UNION ALL SELECT dataset_id, run_ts, 'rho', rho FROM runs WHERE rho IS NOT NULL AND NOT isnan(rho)
  UNION ALL SELECT dataset_id, run_ts, 'radius', radius FROM runs WHERE radius >= 0 AND NOT isnan(radius)),
g AS (SELECT *, abs(x) AS a, CASE WHEN x = 0 THEN 0 ELSE floor(log2(abs(x))) END AS e0 FROM long),
e AS (SELECT *, e0 + CASE WHEN pow(2, e0) > a THEN -1 WHEN pow(2, e0 + 1) <= a THEN 1 ELSE 0 END AS e FROM g),
k AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE (e + 1023) * 1024 + (a / pow(2, e) - 1) * 1024 END AS k FROM e)
SELECT dataset_id, run_ts::DATE::VARCHAR AS day, metric_name, (CASE WHEN x < 0 THEN -ceil(k) ELSE floor(k) END)::BIGINT AS digit, count(*) AS n FROM k GROUP BY ALL""",
    "p1_merged": f"""WITH {_LONG},
g AS (SELECT *, abs(x) AS a, CASE WHEN x = 0 THEN 0 ELSE floor(log2(abs(x))) END AS e0 FROM long),
e AS (SELECT *, e0 + CASE WHEN pow(2, e0) > a THEN -1 WHEN pow(2, e0 + 1) <= a THEN 1 ELSE 0 END AS e FROM g),
k AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE (e + 1023) * 1024 + (a / pow(2, e) - 1) * 1024 END AS k FROM e),
digits AS (SELECT dataset_id, metric_name, (CASE WHEN x < 0 THEN -ceil(k) ELSE floor(k) END)::BIGINT AS digit FROM k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, metric_name ORDER BY digit) AS rn, count(*) OVER (PARTITION BY dataset_id, metric_name) AS n FROM digits),
ps AS (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.99])::DOUBLE AS p),
held AS (SELECT *, CASE WHEN digit < 0 THEN -digit ELSE digit END AS m, CASE WHEN digit < 0 THEN -digit - 1 ELSE digit END AS i FROM ranked, ps WHERE rn = ceil(p * n - 1e-9)),
edges AS (SELECT dataset_id, metric_name, p, n,
  CASE WHEN digit = 0 THEN 0 WHEN digit > 0 THEN pow(2, m // 1024 - 1023) * (1 + (m % 1024) / 1024) ELSE -pow(2, m // 1024 - 1023) * (1 + (m % 1024) / 1024) END AS low,
  CASE WHEN digit = 0 THEN (pow(2, 42) - 1) * pow(2, -537) * pow(2, -537) WHEN digit > 0 THEN pow(2, i // 1024 - 1023) * (1 + (i % 1024 + 1) / 1024 - pow(2, -52))
    ELSE -pow(2, i // 1024 - 1023) * (1 + (i % 1024) / 1024 + pow(2, -52)) END AS high FROM held)
SELECT *, low + (high - low) / 2 AS estimate, pow(2, -11)::DOUBLE AS rel_error FROM edges""",
    "p1_found": f"""WITH {_LONG},
q AS (SELECT dataset_id, metric_name, quantile_disc(x, 0.5) AS med, quantile_disc(x, 0.9) AS p90 FROM long GROUP BY ALL)
SELECT DISTINCT dataset_id, metric_name FROM q JOIN spread_limits USING (metric_name) WHERE p90 >= min_ratio * med""",
}
