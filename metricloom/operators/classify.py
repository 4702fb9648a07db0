"""Nearest-neighbour classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.metrics import LINF
from metricloom.operators.index import CellIndex, build
from metricloom.operators.pivots import Pivot, embed
from metricloom.operators.table import MetricTable


def vote(neighbours: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(query_id, prediction): the most frequent label among the neighbours (query_id, id), ties to the smallest; null labels
    don't vote."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("label is not null")
    votes = neighbours.join(known, "id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("prediction"))


def classify(train: CellIndex, labels: DataFrame, id_col: str, label_col: str, queries: DataFrame, k: int = 1, query_id: str = "query_id", value: str = "v") -> DataFrame:
    """(query_id, prediction) by the k nearest rows of an index; queries without a neighbour are left out."""
    return vote(train.knn_join(queries, k, query_id, value), labels, id_col, label_col)


def classify_in_pivot_space(train: MetricTable, labels: DataFrame, id_col: str, label_col: str, queries: DataFrame, pivots: list[Pivot], k: int = 1, query_id: str = "query_id", value: str = "v") -> DataFrame:
    """(query_id, prediction) by the k nearest rows in pivot space: the Chebyshev distance of pivot distances, a lower bound of
    the metric itself."""
    near = build(MetricTable(embed(train, pivots, scalar=False), "id", "pd", LINF), "vp", 2, 3)
    asked = embed(MetricTable(queries, query_id, value, train.metric), pivots, scalar=False)
    return classify(near, labels, id_col, label_col, asked, k, "id", "pd")


def split(table: MetricTable, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the id: the same for any partitioning and on any retry."""
    h = F.pmod(F.xxhash64(F.col(table.id_col), F.lit(seed)), F.lit(1_000_000))
    return table.df.where(h < int(share * 1_000_000)), table.df.where(h >= int(share * 1_000_000))


def accuracy(table: MetricTable, label_col: str, k: int = 1, share: float = 0.7, runs: int = 3, seed: int = 0, family: str = "vp", pivots: int = 2, parts: int = 4) -> float:
    """Mean share of test rows that are classified right over several seeded splits."""
    got = []
    for run in range(runs):
        train, test = split(table, share, seed + run)
        index = build(MetricTable(train, table.id_col, table.value_col, table.metric), family, pivots, parts)
        asked = test.select(F.col(table.id_col).alias("query_id"), F.col(table.value_col).alias("v"))
        guess = classify(index, train, table.id_col, label_col, asked, k)
        right = guess.join(test.select(F.col(table.id_col).alias("query_id"), F.col(label_col).alias("_y")), "query_id").agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0]
        index.members.unpersist()
        got.append(right or 0.0)
    return sum(got) / max(1, len(got))
