"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.operators.durable import cut

#: Rows up to which the small side of a join may be broadcast; it is counted first.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows, written and counted, and the hint for joins with them: broadcast if there are at most `most`, else none, so
    that the join shuffles."""
    df = cut(df)
    return df, F.broadcast if df.limit(most + 1).count() <= most else lambda x: x


def usable_rows(spark: SparkSession, d: str) -> DataFrame:
    """(matrix_id, row_id, elements, similar_within): the usable rows; rows loaded twice still stand twice."""
    heads = spark.read.parquet(f"{d}/matrix_headers.parquet").select("matrix_id", "n_columns", "similar_within")
    rows = spark.read.parquet(f"{d}/matrix_rows.parquet").select("matrix_id", "row_id", "elements").where("row_id is not null and elements is not null")
    finite = F.forall("elements", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity in Spark's order
    return rows.join(heads, "matrix_id").where((F.size("elements") == F.col("n_columns")) & finite).select("matrix_id", "row_id", "elements", "similar_within")
