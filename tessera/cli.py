"""Inspection commands: python -m tessera.cli COMMAND FILE [N]."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import cell, ndjson
from .operators import pages
from .sources import metadata, scan, schema

COMMANDS = ("schema", "tree", "count", "head", "table", "cat", "stats", "rowgroups", "column", "size", "page-index", "validate")


def report(spark: SparkSession, command: str, path: str, arg: str | None = None) -> DataFrame:
    """The result of a command as a DataFrame."""
    if command == "schema":
        return metadata.chunks(spark, path).where("row_group = 0").select("file", "leaf", "path", "physical_type", "logical_type").orderBy("file", "leaf")
    if command == "tree":
        lines = schema.tree(spark.read.parquet(path).schema)
        return spark.createDataFrame([(x,) for x in lines], "line string")
    if command == "count":
        return metadata.footers(spark, path).agg(F.sum("num_rows").alias("rows"))
    if command == "head":
        return scan.head(spark.read.parquet(path), int(arg or 5))
    if command == "table":
        df = spark.read.parquet(path)
        return scan.head(df.select(*[cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]), int(arg or 5))
    if command == "cat":
        df = scan.scan(spark, path)
        return df.select(ndjson(df).alias("value"))
    if command == "stats":
        return metadata.footers(spark, path)
    if command == "rowgroups":
        return metadata.group_summary(metadata.chunks(spark, path)).orderBy("file", "row_group")
    if command == "column":
        found = metadata.chunks(spark, path)
        return found.where(F.col("path") == arg).orderBy("file", "row_group") if arg else metadata.column_summary(found).orderBy("file", "path")
    if command == "size":
        return metadata.column_summary(metadata.chunks(spark, path)).select("file", "path", "compressed", "pct").orderBy(F.desc("compressed"))
    if command == "page-index":
        found = metadata.page_index(spark, path)
        return found.where(F.col("path") == arg).orderBy("file", "row_group", "page") if arg else pages.page_summary(found)
    if command == "validate":
        return metadata.validate(spark, path)
    raise ValueError(f"unknown command {command!r}; there are {', '.join(COMMANDS)}")


def main(args: list[str]) -> int:
    from .session import session

    if len(args) < 2:
        print(__doc__)
        return 2
    found = report(session(), args[0], args[1], args[2] if len(args) > 2 else None)
    if args[0] == "cat":
        for row in found.toLocalIterator():
            print(row["value"])
    else:
        found.show(10_000, truncate=60)
    return int(args[0] == "validate" and bool(found.where("status <> 'ok'").take(1)))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
