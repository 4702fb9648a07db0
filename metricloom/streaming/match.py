"""Streams of queries against a static index, and windowed counts of event streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.operators.durable import cut
from metricloom.operators.index import CellIndex


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over the Parquet table `name` of a folder: one file, or a folder of files to which more may come."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if os.path.isdir(path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def range_match_stream(index: CellIndex, queries: DataFrame, radius: float, query_id: str = "query_id", value: str = "v") -> DataFrame:
    """(query_id, id, distance) for a stream of queries: a stream-static join, stateless, with the pruning of the index."""
    return index.range_join(queries, radius, query_id, value)


def windowed_counts(events: DataFrame, ts: str, keys: list[str], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, keys..., n): events by tumbling window; state is dropped once a window is `late` behind."""
    kind = events.schema[ts].dataType.simpleString()
    by = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("w.start").cast(kind).alias("window_start"), *keys, "n")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes what is there now and returns the rows. append: all rows, written exactly once by the file sink; complete:
    the last state. Files and progress go to the shared checkpoint folder."""
    spark = stream.sparkSession
    cut(spark.range(1))  # sees to a checkpoint folder
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/progress")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
