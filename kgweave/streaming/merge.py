"""Incremental forms of the merge operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import merge_edges


def deduplicated(stream: DataFrame, *, id: str, time: str, delay: str) -> DataFrame:
    """Rows of a stream, each id once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([id])


def windowed_counts(stream: DataFrame, *, time: str, kind: str, value: str, width: str, delay: str) -> DataFrame:
    """(start, kind, n, total) by tumbling window; late rows count until the watermark passes."""
    w = stream.withWatermark(time, delay).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), kind, "n", "total")


def merge_edge_stream(stream: DataFrame, target: str, checkpoint: str, *, order: str) -> StreamingQuery:
    """Append every batch to ``target`` as one merged part; :func:`merged_edges` reads all parts merged again.

    Merging is associative in scores and sources, and properties carry their order, so a batch that is written
    a second time after a failure changes nothing: its folder is named by the batch and overwritten."""

    def put(batch: DataFrame, number: int) -> None:
        merged = merge_edges(batch, F.col(order)).withColumn(order, F.lit(number).cast("long"))
        merged.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_edges(spark, target: str, *, order: str) -> DataFrame:
    return merge_edges(spark.read.parquet(target).drop("batch"), F.col(order))
