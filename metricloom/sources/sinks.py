"""Writers: indexes, clusterings, embeddings, pivots, statistics, experiments. All write folders of part files, in parallel."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells up to which an index gets a folder for each; beyond this, rows are sorted by cell in larger files.
FOLDERS = 500


def write_index(members: DataFrame, cells: DataFrame, path: str) -> None:
    """Members laid out by cell, so that a search reads the cells that it needs, and the table of cells."""
    n = cells.count()
    if n <= FOLDERS:
        members.repartition("cell").sortWithinPartitions("pd0").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/members")
    else:
        members.repartitionByRange("cell").sortWithinPartitions("cell", "pd0").write.mode("overwrite").parquet(f"{path}/members")
    cells.write.mode("overwrite").parquet(f"{path}/cells")


def write_bucketed(members: DataFrame, table: str, buckets: int) -> None:
    """Members as a table bucketed by cell: joins by cell need no shuffle."""
    members.write.mode("overwrite").bucketBy(buckets, "cell").sortBy("cell").saveAsTable(table)


def _joined(v: str) -> Column:
    return F.concat_ws("\t", F.transform(v, lambda x: x.cast("string")))


def write_clusters(clustered: DataFrame, path: str, value: str = "v") -> None:
    """Text rows of the values and the label; the header `dim n k` is a file of its own in the folder `header`."""
    head = clustered.agg(F.max(F.size(value)).alias("dim"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"))
    head.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("dim", "n", "k")])).coalesce(1).write.mode("overwrite").text(f"{path}/header")
    clustered.select(F.concat_ws("\t", _joined(value), F.col("cluster").cast("string"))).write.mode("overwrite").text(f"{path}/rows")


def write_coordinates(embedded: DataFrame, path: str, kind: str = "text") -> None:
    """Pivot-space coordinates (column pd) as text, as little-endian doubles or floats (a column of bytes), or as Parquet."""
    if kind == "text":
        embedded.select(_joined("pd")).write.mode("overwrite").text(path)
    elif kind == "parquet":
        embedded.write.mode("overwrite").parquet(path)
    elif kind in ("double", "float"):
        code = "d" if kind == "double" else "f"

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"id": b["id"], "bytes": [struct.pack(f"<{len(x)}{code}", *x) for x in b["pd"]]})

        embedded.select(F.col("id").cast("bigint"), "pd").mapInPandas(pack, "id bigint, bytes binary").write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def write_pivots(pivots: DataFrame, path: str) -> None:
    """(no, id, value as JSON), one line each."""
    pivots.coalesce(1).write.mode("overwrite").json(path)


def write_statistics(stats: DataFrame, path: str) -> None:
    """Search statistics, one JSON line for each query or batch."""
    stats.write.mode("overwrite").json(path)


def write_experiment(runs: DataFrame, path: str) -> None:
    """Runs of an experiment as CSV with a header."""
    runs.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_tree(members: DataFrame, cells: DataFrame, path: str) -> None:
    """Dump of an index: the cells with their bounds, and each cell's members with their values and coordinates."""
    cells.write.mode("overwrite").json(f"{path}/cells")
    members.repartition("cell").write.mode("overwrite").partitionBy("cell").json(f"{path}/members")
