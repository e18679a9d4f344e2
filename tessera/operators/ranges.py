"""Row ranges: sets of half-open [first, last) ranges as DataFrames, optionally within groups (file, row group).

Ranges are worked on in buckets of positions, so that no task gets all of them: what lies inside a bucket is final, and only
ranges that touch a bucket's edge, two a bucket at most, are stitched together in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of positions, and ranges up to which a set is broadcast (three numbers each).
BUCKETS, BROADCAST = 1024, 500_000


def width(ranges: DataFrame, buckets: int = BUCKETS) -> int:
    """Positions of a bucket, from the smallest and the largest position of a set."""
    low, high = ranges.agg(F.min("first"), F.max("last")).first()
    return max(1, -(-((high or 0) - (low or 0)) // buckets))


def floor_div(x: Column, n: int) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def pieces(ranges: DataFrame, size: int, *by: str) -> DataFrame:
    """The parts of ranges in each bucket, with the bucket's number."""
    numbers = F.sequence(floor_div(F.col("first"), size), floor_div(F.col("last") - 1, size))
    parts = ranges.where("last > first").select(*by, "first", "last", F.explode(numbers).alias("_bucket"))
    return parts.select(*by, "_bucket", F.greatest("first", F.col("_bucket") * size).alias("first"), F.least("last", (F.col("_bucket") + 1) * size).alias("last"))


def islands(ranges: DataFrame, *by: str) -> DataFrame:
    """Overlapping and adjacent ranges of each group as one."""
    order = Window.partitionBy(*by).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.select(*by, "first", "last", F.when(F.col("first") <= before, 0).otherwise(1).alias("_new"))
    return marked.withColumn("_island", F.sum("_new").over(order)).groupBy(*by, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_island")


def stitched(parts: DataFrame, size: int, *by: str) -> DataFrame:
    """Islands of buckets as islands of the whole: only those that touch an edge are brought together."""
    edge = (F.pmod("first", F.lit(size)) == 0) | (F.pmod("last", F.lit(size)) == 0)
    return parts.where(~edge).select(*by, "first", "last").unionByName(islands(parts.where(edge), *by))


def normalize(ranges: DataFrame, *by: str) -> DataFrame:
    """Sorted, disjoint ranges: empty ones go, overlapping and adjacent ones become one."""
    size = width(ranges)
    return stitched(islands(pieces(ranges, size, *by), *by, "_bucket"), size, *by)


def union(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    return normalize(a.unionByName(b), *by)


def intersect(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Ranges common to two normalised sets, by one ordered pass over the ends in each bucket: no pairs of ranges are formed."""
    size = width(a.unionByName(b))
    both = pieces(a, size, *by).unionByName(pieces(b, size, *by))
    ends = both.select(*by, "_bucket", F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("step")), F.struct(F.col("last").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    points = ends.groupBy(*by, "_bucket", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    order = Window.partitionBy(*by, "_bucket").orderBy("at")
    depth = points.select(*by, "_bucket", "at", F.sum("step").over(order).alias("depth"), F.lead("at").over(order).alias("next"))
    return stitched(islands(depth.where("depth = 2").select(*by, "_bucket", F.col("at").alias("first"), F.col("next").alias("last")), *by, "_bucket"), size, *by)


def contains(rows: DataFrame, row: str, ranges: DataFrame, *by: str) -> DataFrame:
    """Rows whose number is in a normalised set: a row meets the few ranges of its own bucket. A bounded set is broadcast, and rows stay where they are."""
    n = ranges.count()
    size = width(ranges, max(1, n))
    parts = pieces(ranges, size, *by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("first").alias("_first"), F.col("last").alias("_last"), "_bucket")
    parts = F.broadcast(parts) if 2 * n <= BROADCAST else parts  # pieces are fewer than twice the ranges and the buckets
    own = (F.col("_bucket") == floor_div(rows[row], size)) & (rows[row] >= F.col("_first")) & (rows[row] < F.col("_last"))
    for c in by:
        own = own & (rows[c] == F.col(f"_{c}"))
    return rows.join(parts, own, "left_semi")


def full(spark, n: int) -> DataFrame:
    return spark.createDataFrame([(0, n)] if n else [], "first bigint, last bigint")


def empty(spark) -> DataFrame:
    return full(spark, 0)


def single(spark, first: int, last: int) -> DataFrame:
    return spark.createDataFrame([(first, last)] if last > first else [], "first bigint, last bigint")


def row_count(ranges: DataFrame) -> DataFrame:
    return ranges.agg(F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0)).alias("n_rows"))


def is_empty(ranges: DataFrame) -> DataFrame:
    return ranges.agg((F.count_if(F.col("last") > F.col("first")) == 0).alias("is_empty"))


def is_full(ranges: DataFrame, n: int) -> DataFrame:
    return ranges.agg(((F.count("*") == 1) & (F.min("first") == 0) & (F.max("last") == n)).alias("is_full"))
