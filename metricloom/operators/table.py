"""A table of objects with a distance, and the catalog of such tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.metrics import METRICS, Metric


@dataclass(frozen=True)
class MetricTable:
    """Rows with an id, a value and the metric of the values. Further columns may have any names; operators use these two."""

    df: DataFrame
    id_col: str
    value_col: str
    metric: Metric

    def rows(self) -> DataFrame:
        """(id, v) of the rows with neither null."""
        return self.df.select(F.col(self.id_col).alias("id"), F.col(self.value_col).alias("v")).where("id is not null and v is not null")


def collapse(rows: DataFrame) -> DataFrame:
    """(id, n, ids, v): one row for each distinct value, under its smallest id. ids holds the other ids of equal values."""
    return rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).select("id", "n", "ids", "v")


def expand(found: DataFrame) -> DataFrame:
    """Rows of a search over collapsed values, one for each original id."""
    return found.drop("id").withColumn("id", F.explode("ids")).drop("ids", "n")


class Catalog:
    """Named metric tables, kept as tables of the session's catalog; the metric's name is a table property."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def put(self, name: str, table: MetricTable) -> None:
        table.df.write.mode("overwrite").saveAsTable(name)
        props = {"metricloom.id": table.id_col, "metricloom.value": table.value_col, "metricloom.metric": table.metric.name}
        self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({', '.join(f"'{k}'='{v}'" for k, v in props.items())})")

    def get(self, name: str) -> MetricTable:
        if not self.spark.catalog.tableExists(name):
            raise KeyError(name)
        props = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        return MetricTable(self.spark.table(name), props["metricloom.id"], props["metricloom.value"], METRICS[props["metricloom.metric"]])

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if not t.isTemporary)
