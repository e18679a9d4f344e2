"""Statistics: per column, per page and per chunk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def _value(df: DataFrame, c: str) -> Column:
    """The column as statistics see it: NaN counts as a value and has no part in min and max."""
    return F.when(~F.isnan(c), F.col(c)) if isinstance(df.schema[c].dataType, (FloatType, DoubleType)) else F.col(c)


def column_stats(df: DataFrame, *columns: str) -> DataFrame:
    """(column, n_values, null_count, min, max) as text, from one pass; min and max are null without comparable values."""
    aggs = []
    for c in columns:
        v = _value(df, c)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n_values"), F.count_if(F.col(c).isNull()).alias("null_count"), F.min(v).cast("string").alias("min"), F.max(v).cast("string").alias("max")).alias(c))
    return df.agg(F.array(*aggs).alias("all")).select(F.inline("all"))


def paged(df: DataFrame, row: str, size: int) -> DataFrame:
    """Adds `page`, rows being numbered from 0 by the unique dense column `row`."""
    return df.withColumn("page", F.floor(F.col(row) / size))


def page_stats(df: DataFrame, row: str, column: str, size: int) -> DataFrame:
    """(page, first_row, n_rows, null_count, null_page, min, max) of pages of `size` rows."""
    v = _value(df, column)
    return paged(df, row, size).groupBy("page").agg(
        F.min(row).alias("first_row"), F.count("*").alias("n_rows"), F.count_if(F.col(column).isNull()).alias("null_count"),
        (F.count(column) == 0).alias("null_page"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def page_boundaries(pages: DataFrame, total: int, *by: str) -> DataFrame:
    """Adds end_row: where the next page of a chunk starts, or the row group's rows. Page numbers are dense, so the next one is looked up by number."""
    following = pages.select(*by, (F.col("page") - 1).alias("page"), F.col("first_row").alias("end_row"))
    return pages.join(following, [*by, "page"], "left").withColumn("end_row", F.coalesce("end_row", F.lit(total)))


def boundary_order(pages: DataFrame, *by: str) -> DataFrame:
    """(boundary_order): ascending, descending or unordered over the pages that have values."""
    order = Window.partitionBy(*by).orderBy("page")
    steps = pages.where("not null_page").select(*by, "min", "max", F.lag("min").over(order).alias("_min"), F.lag("max").over(order).alias("_max"))
    up = F.bool_and(F.coalesce((F.col("min") >= F.col("_min")) & (F.col("max") >= F.col("_max")), F.lit(True)))
    down = F.bool_and(F.coalesce((F.col("min") <= F.col("_min")) & (F.col("max") <= F.col("_max")), F.lit(True)))
    return steps.groupBy(*by).agg(F.when(up, "ascending").when(down, "descending").otherwise("unordered").alias("boundary_order"))


def page_filter(df: DataFrame, row: str, size: int, *filters) -> DataFrame:
    """Rows of the pages that may match all filters, a superset of the exact rows, for tables that have no page indexes.

    Statistics are worked out from the rows; pages.page_scan() reads those that files have. Page statistics and rows meet on the page number: pages are as many as rows / size, and Spark picks the join by size.
    """
    kept = [page_stats(df, row, f.column, size).where(f.keeps()).select("page") for f in filters]
    pages = reduce(lambda a, b: a.join(b, "page", "left_semi"), kept)
    return paged(df, row, size).join(pages, "page", "left_semi").drop("page")


def size_share(df: DataFrame, by: str, size: str) -> DataFrame:
    """(by, total, pct): sums and their share of all in percent, 0 if there is nothing."""
    sums = df.groupBy(by).agg(F.sum(size).alias("total"))
    whole = df.agg(F.sum(size).alias("_whole"))
    pct = F.when(F.col("_whole") > 0, 100.0 * F.col("total") / F.col("_whole")).otherwise(F.lit(0.0))
    return sums.join(F.broadcast(whole)).select(by, "total", pct.alias("pct"))  # one row


def dictionary_cutoff(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """(column, n_distinct, n_values, use_dictionary): dictionaries pay while distinct / values is at most the threshold."""
    aggs = [F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("n_distinct"), F.count(c).alias("n_values")) for c in columns]
    rows = df.agg(F.array(*aggs).alias("all")).select(F.inline("all"))
    return rows.withColumn("use_dictionary", F.col("n_distinct") <= threshold * F.col("n_values"))
