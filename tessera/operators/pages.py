"""Filtered scans by the page indexes of Parquet files: page bounds decide on row ranges, and only these rows are returned.

Rows come from Spark's reader. The bounds of the kept pages go to it as a condition that all their rows meet, so that it skips
other pages and row groups by the same indexes; row ranges then take exactly the rows of the kept pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.metadata import files, page_index
from . import ranges
from .filters import ColumnFilter

#: Columns of a page index that hold bounds of each kind of column.
BOUNDS = {"INT32": ("min_long", "max_long"), "INT64": ("min_long", "max_long"), "FLOAT": ("min_double", "max_double"), "DOUBLE": ("min_double", "max_double"), "BYTE_ARRAY": ("min", "max")}


def page_keeps(f: ColumnFilter, text: bool = False) -> Column:
    """The condition of a filter on rows of page_index(); pages without bounds of the filter's kind are kept, all-null ones are not.

    `text` tells that a raw filter is on a column of text or bytes; other filters show it by their value.
    """
    text = text if f.op == "raw" else isinstance(f.value, (str, bytes))
    own = ColumnFilter(f.column, f.op, raw_bytes(f.value), raw_bytes(f.high)) if text and f.op != "raw" else f
    out = F.coalesce(~F.col("null_page"), F.lit(True)) if f.op != "raw" else F.lit(True)
    return reduce(lambda other, k: F.when(F.col("physical_type") == k, own.keeps(*BOUNDS[k])).otherwise(other), [k for k in BOUNDS if text == (k == "BYTE_ARRAY")], out)


def raw_bytes(x):
    return x.encode() if isinstance(x, str) else x


def page_ranges(index: DataFrame, *filters: ColumnFilter, text: tuple[str, ...] = ()) -> DataFrame:
    """(file, first, last): rows, numbered within their file, of the pages that may match all filters; `text` names columns of text."""
    place = [(F.col("group_first") + F.col(c)).alias(n) for c, n in (("first_row", "first"), ("end_row", "last"))]
    kept = [ranges.normalize(index.where((F.col("path") == f.column) & page_keeps(f, f.column in text)).select("file", *place), "file") for f in filters]
    return reduce(lambda a, b: ranges.intersect(a, b, "file"), kept)


def hull(index: DataFrame, f: ColumnFilter, kind: str) -> Column | None:
    """A condition on rows that all rows of the kept pages meet, for the reader to skip others by; one row comes to the driver."""
    kept = index.where((F.col("path") == f.column) & page_keeps(f, kind in ("string", "binary")))
    types = {"tinyint": "long", "smallint": "long", "int": "long", "bigint": "long", "float": "double", "double": "double", "string": ""}
    if kind not in types:
        return None
    low, high = (f"{e}_{types[kind]}".rstrip("_") for e in ("min", "max"))
    found = kept.agg(F.min(low), F.max(high), F.count_if(~F.coalesce("null_page", F.lit(False)) & F.col(low).isNull())).first()
    if found[0] is None or found[2]:
        return None
    try:
        a, b = (bytes(x).decode() if kind == "string" else x for x in found[:2])
    except UnicodeDecodeError:
        return None
    return F.col(f"`{f.column}`").between(F.lit(a), F.lit(b)) | F.col(f"`{f.column}`").isNull()


def page_scan(spark: SparkSession, path: str, *filters: ColumnFilter, columns: list[str] | None = None) -> DataFrame:
    """Rows of the pages that may match all filters, a superset of the matching rows; every file needs a page index of the filtered columns.

    Filters name leaf columns of flat files. Without filters all rows are returned.
    """
    df = spark.read.parquet(path)
    if bad := [f.column for f in filters if f.column not in df.columns]:
        raise ValueError(f"no column {bad[0]!r}")
    wanted = columns or df.columns
    if not filters:
        return df.select(*[f"`{c}`" for c in wanted])
    index = page_index(spark, path).where(F.col("path").isin([f.column for f in filters])).cache()
    held = index.groupBy("file").agg(F.count_distinct("path").alias("n"))
    missing = files(spark, path).join(held.where(F.col("n") == len({f.column for f in filters})), "file", "left_anti").take(1)
    if missing and df.where(F.col("_metadata.file_path") == missing[0]["file"]).take(1):
        raise ValueError(f"PageIndexMissing: {missing[0]['file']}")
    known = dict(df.dtypes)
    limits = [c for f in filters if (c := hull(index, f, known[f.column])) is not None]
    rows = reduce(DataFrame.where, limits, df).select(*[f"`{c}`" for c in wanted], F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    found = page_ranges(index, *filters, text=tuple(c for c, k in known.items() if k in ("string", "binary"))).withColumnRenamed("file", "_path")
    return ranges.contains(rows, "_row", found, "_path").drop("_path", "_row")


def page_summary(index: DataFrame) -> DataFrame:
    """(file, path, indexed_chunks, pages, null_pages): each column of a page_index() result over all row groups."""
    return index.groupBy("file", "path").agg(F.count_distinct("row_group").alias("indexed_chunks"), F.count("*").alias("pages"), F.count_if("null_page").alias("null_pages"))
