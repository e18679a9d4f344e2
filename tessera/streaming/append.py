"""Bounded-memory appends: a stream of Parquet files written in row groups, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.sink import Layout, write


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_stream(stream: DataFrame, path: str, checkpoint: str, layout: Layout = Layout()) -> StreamingQuery:  # noqa: B008
    """Writes each batch to its own folder, so that a repeated batch replaces itself; stops once all files are through."""

    def one(batch: DataFrame, number: int) -> None:
        write(batch, f"{path}/batch={number}", layout, mode="overwrite")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
