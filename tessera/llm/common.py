"""Shared helpers: durable cut points in the plan, Arrow batch access and bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ArrowMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Rows of one or two numbers each up to which a set of ids is broadcast; beyond it the join shuffles. Spark holds some 32
#: bytes for each (id, row pointer and half-empty table), 32 MB together.
BROADCAST_IDS = 1_000_000

#: Rows of a key beyond which its rows aren't brought together in one task.
HOT_ROWS = 20_000

#: Text bytes that a Python operator works on at a time, whatever the size of the Arrow batch.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. Where it is unset, a local session gets a temporary one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a shared path once nothing reads it any more."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def cut(df: DataFrame, name: str, *, codec: str = "zstd") -> DataFrame:
    """Writes a result to the shared folder and reads it back, so that a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with, now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy_worker() -> None:
    """Gives memory that a Python worker no longer needs back to the machine, as idle workers live on beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def tidied(run: ArrowMap) -> ArrowMap:
    """A function for mapInArrow() whose worker holds nothing once a task ends."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy_worker()

    return tidy


def few(df: DataFrame) -> DataFrame:
    """A set of ids or nodes, broadcast if its count is bounded."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def join_one(rows: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """Joins rows to a table with one row a key at most (inner or left), whatever share of the rows a key has.

    Keys of more than HOT_ROWS rows can't be many; their side of `one` is broadcast while its count is bounded, so that
    their rows stay where they are, and so do rows with a null key if these are many. The other keys meet in a shuffle.
    Both tables are read more than once, so they should be stored ones; where `rows` isn't, `counted` is a stored table
    that has about as many rows of each key, and `rows` is stored if there are hot keys.
    """
    often = (rows if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > HOT_ROWS).select(*keys)
    if not often.take(1):
        return rows.join(one, keys, how)
    often, rows = cut(often, "hot-keys"), rows if counted is None else cut(rows, "rows")
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    hot, rest = few(often.where(known)), None
    if often.where(~known).take(1):
        rest, rows = rows.where(~known), rows.where(known)
    cold = rows.join(hot, keys, "left_anti").join(one, keys, how)
    out = cold.unionByName(rows.join(hot, keys, "left_semi").join(few(cut(one.join(hot, keys, "left_semi"), "hot")), keys, how))
    return out.unionByName(rest, allowMissingColumns=True) if rest is not None and how == "left" else out


def with_ids(docs: DataFrame, one: DataFrame) -> DataFrame:
    """Documents with the row of their doc_id in a stored table, or nulls; broadcast if its count is bounded, which spares the texts a shuffle."""
    return docs.join(F.broadcast(one), "doc_id", "left") if one.count() <= BROADCAST_IDS else join_one(docs, one, ["doc_id"], "left")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id isn't in a stored table of distinct ids; null doc_ids stay."""
    return with_ids(docs, ids.select("doc_id", F.lit(True).alias("_gone"))).where(F.col("_gone").isNull()).drop("_gone")


def slices(sizes, limit: int = SLICE_BYTES):
    """(start, stop) row ranges whose sizes add up to about `limit`; one long row is a range of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Zero-copy slices of a batch, each of bounded text size."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for start, stop in slices(sizes, limit):
        yield batch.slice(start, stop - start)


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def file_name(path: str) -> str:
    return os.path.basename(path)
