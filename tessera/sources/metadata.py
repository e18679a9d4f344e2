"""Footers, column chunks and page indexes as DataFrames, read in tasks from a list of files."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import stat_text
from .thrift import PHYSICAL, parse

FOOTER = "file string, size bigint, num_rows bigint, num_row_groups int, num_leaves int, created_by string, metadata map<string,string>, error string"
CHUNK = (
    "file string, row_group int, group_rows bigint, leaf int, path string, physical_type string, logical_type string, codec string, encodings array<string>, "
    "num_values bigint, compressed bigint, uncompressed bigint, null_count bigint, min string, max string, has_column_index boolean, has_offset_index boolean"
)
PAGE = (
    "file string, row_group int, group_first bigint, path string, physical_type string, page int, first_row bigint, end_row bigint, offset bigint, size int, null_count bigint, null_page boolean, "
    "min binary, max binary, min_long bigint, max_long bigint, min_double double, max_double double, min_text string, max_text string"
)


def open_file(path: str):
    """(file system, path inside) of a local path or a URI."""
    from pyarrow import fs

    found, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (fs.LocalFileSystem(), path)
    return found, inside


def footer_of(path: str) -> dict:
    system, inside = open_file(path)
    with system.open_input_file(inside) as f:
        return pq.read_metadata(f).to_dict()


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, size) of all files below the paths, without their contents."""
    return spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("file"), F.col("length").alias("size"))


FOOTER_KINDS = pa.schema([("file", pa.string()), ("size", pa.int64()), ("num_rows", pa.int64()), ("num_row_groups", pa.int32()), ("num_leaves", pa.int32()), ("created_by", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
CHUNK_KINDS = pa.schema(
    [
        ("file", pa.string()), ("row_group", pa.int32()), ("group_rows", pa.int64()), ("leaf", pa.int32()), ("path", pa.string()), ("physical_type", pa.string()), ("logical_type", pa.string()), ("codec", pa.string()),
        ("encodings", pa.list_(pa.string())), ("num_values", pa.int64()), ("compressed", pa.int64()), ("uncompressed", pa.int64()), ("null_count", pa.int64()), ("min", pa.string()), ("max", pa.string()), ("has_column_index", pa.bool_()), ("has_offset_index", pa.bool_()),
    ]
)
PAGE_KINDS = pa.schema(
    [
        ("file", pa.string()), ("row_group", pa.int32()), ("group_first", pa.int64()), ("path", pa.string()), ("physical_type", pa.string()), ("page", pa.int32()), ("first_row", pa.int64()), ("end_row", pa.int64()), ("offset", pa.int64()), ("size", pa.int32()), ("null_count", pa.int64()), ("null_page", pa.bool_()),
        ("min", pa.binary()), ("max", pa.binary()), ("min_long", pa.int64()), ("max_long", pa.int64()), ("min_double", pa.float64()), ("max_double", pa.float64()), ("min_text", pa.string()), ("max_text", pa.string()),
    ]
)

UNREADABLE = (pa.ArrowException, OSError, ValueError, KeyError, IndexError, TypeError, struct.error)


def per_file(spark: SparkSession, paths: tuple[str, ...], rows_of: Callable[[object, str], Iterator[dict]], kinds: pa.Schema, ddl: str, on_error: Callable[[str, str], dict] | None = None) -> DataFrame:
    """Rows that a function of (open file, name) gives for every file below the paths, in tasks; a file that can't be read gives `on_error`'s row or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size in zip(batch.column("file").to_pylist(), batch.column("size").to_pylist(), strict=True):
                try:
                    system, inside = open_file(file)
                    with system.open_input_file(inside) as f:
                        rows = [{"file": file, "size": size} | r for r in rows_of(f, file)]
                except UNREADABLE as e:
                    rows = [{"file": file, "size": size} | on_error(file, str(e) or type(e).__name__)] if on_error else []
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], kinds)

    return files(spark, *paths).mapInArrow(run, ddl)


def footers(spark: SparkSession, *paths: str) -> DataFrame:
    """One row a file; a file that is no Parquet has its error."""

    def rows(f, file: str) -> Iterator[dict]:
        m = pq.read_metadata(f)
        kv = [(k.decode(), v.decode("utf-8", "replace")) for k, v in (m.metadata or {}).items()]
        yield {"num_rows": m.num_rows, "num_row_groups": m.num_row_groups, "num_leaves": m.num_columns, "created_by": m.created_by, "metadata": kv}

    return per_file(spark, paths, rows, FOOTER_KINDS, FOOTER, lambda file, error: {"error": error})


def chunks(spark: SparkSession, *paths: str) -> DataFrame:
    """One row for each column chunk of each row group; files that can't be read give none, footers() has their errors."""

    def rows(f, file: str) -> Iterator[dict]:
        shown = lambda x: None if x is None else x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x)
        m = pq.read_metadata(f)
        logical = [logical_type_text(m.schema.column(k)) for k in range(m.num_columns)]
        for g in range(m.num_row_groups):
            for k in range(m.num_columns):
                c, s = m.row_group(g).column(k), m.row_group(g).column(k).statistics
                yield {
                    "row_group": g, "group_rows": m.row_group(g).num_rows, "leaf": k, "path": c.path_in_schema, "physical_type": c.physical_type,
                    "logical_type": logical[k], "codec": c.compression, "encodings": list(c.encodings), "num_values": c.num_values,
                    "compressed": c.total_compressed_size, "uncompressed": c.total_uncompressed_size, "null_count": s.null_count if s is not None and s.has_null_count else None,
                    "min": shown(s.min) if s is not None and s.has_min_max else None, "max": shown(s.max) if s is not None and s.has_min_max else None,
                    "has_column_index": c.has_column_index, "has_offset_index": c.has_offset_index,
                }

    return per_file(spark, paths, rows, CHUNK_KINDS, CHUNK)


def logical_type_text(column) -> str | None:
    """Such as DECIMAL(9,2), TIMESTAMP(UTC, MICROS), INT(8,signed); null for a column without a logical type."""
    own = json.loads(column.logical_type.to_json())
    kind = own["Type"].upper()
    place = "UTC" if own.get("isAdjustedToUTC") else "LOCAL"
    unit = {"milliseconds": "MILLIS", "microseconds": "MICROS", "nanoseconds": "NANOS"}.get(own.get("timeUnit"), "")
    # The forms of types that have parameters.
    if kind in ("TIME", "TIMESTAMP"):
        return f"{kind}({place}, {unit})"
    if kind == "DECIMAL":
        return f"DECIMAL({own['precision']},{own['scale']})"
    if kind == "INT":
        return f"INT({own['bitWidth']},{'signed' if own['isSigned'] else 'unsigned'})"
    if kind == "GEOMETRY":
        return f"GEOMETRY({own['crs']})" if own.get("crs") else "GEOMETRY"
    if kind == "GEOGRAPHY":
        return f"GEOGRAPHY({', '.join(x for x in (own.get('crs'), own.get('algorithm') or 'spherical') if x)})"
    return None if kind in ("NONE", "UNKNOWN", "UNDEFINED") else kind


def is_logical(column, text: str) -> bool:
    """Whether a leaf's logical type is the one named, with or without parameters."""
    own = logical_type_text(column) or ""
    return text in (own, own.split("(")[0])


def sort_order_valid(column) -> bool:
    """Geometries and intervals have no order, so their min and max mean nothing."""
    return (logical_type_text(column) or "").split("(")[0] not in ("GEOMETRY", "GEOGRAPHY") and str(getattr(column, "converted_type", "")) != "INTERVAL"


def leaves(spark: SparkSession, path: str) -> list[dict]:
    """The leaf columns of one file in order: path, physical and logical type, maximum levels, whether they have an order."""
    m = pq.ParquetFile(open_file(path)[0].open_input_file(open_file(path)[1])).schema
    return [{"path": c.path, "physical_type": c.physical_type, "logical_type": logical_type_text(c), "max_definition": c.max_definition_level, "max_repetition": c.max_repetition_level, "ordered": sort_order_valid(c)} for c in (m.column(k) for k in range(len(m)))]


def typed(raw: bytes | None, physical: str) -> tuple[int | None, float | None]:
    """A page's bound as a whole number or a float, as the physical type says."""
    form = {"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}.get(physical)
    if raw is None or form is None or len(raw) != struct.calcsize(form):
        return None, None
    (v,) = struct.unpack(form, raw)
    return (v, None) if isinstance(v, int) else (None, None if math.isnan(v) else v)


def compare_encoded(a: bytes, b: bytes, physical: str) -> int:
    """-1, 0 or 1 of two encoded values by physical type; what isn't a number of full size goes byte by byte."""
    x, y = (next((v for v in typed(r, physical) if v is not None), None) for r in (a, b))
    x, y = (a, b) if x is None or y is None else (x, y)
    return (x > y) - (x < y)


def footer_fields(f) -> dict[int, object]:
    """The whole footer as nested dicts by field number."""
    size = f.size()
    tail = f.read_at(8, size - 8) if size >= 12 else b""
    if tail[4:] != b"PAR1":
        raise ValueError("InvalidMagic")
    n = int.from_bytes(tail[:4], "little")
    return parse(f.read_at(n, size - 8 - n))


def page_index(spark: SparkSession, *paths: str) -> DataFrame:
    """One row for each page that an offset index lists, with its bounds if there is a column index; in tasks, file by file.

    Files without page indexes, and such as can't be read, give no rows.
    """

    def rows(f, file: str) -> Iterator[dict]:
        group_first = 0
        for g, group in enumerate(footer_fields(f).get(4, [])):
            for chunk in group.get(1, []):
                meta = chunk.get(3, {})
                if 4 not in chunk:
                    continue
                pages = parse(f.read_at(chunk[5], chunk[4]))[1]
                bounds = parse(f.read_at(chunk[7], chunk[6])) if 6 in chunk else {}
                physical, path = PHYSICAL[meta[1]], ".".join(x.decode() for x in meta[3])
                for k, page in enumerate(pages):
                    of = lambda n, k=k, bounds=bounds: bounds[n][k] if n in bounds else None
                    empty = of(1)
                    low, high = (None, None) if empty else (of(2), of(3))
                    (a, x), (b, y) = typed(low, physical), typed(high, physical)
                    yield {
                        "row_group": g, "group_first": group_first, "path": path, "physical_type": physical, "page": k, "first_row": page[3],
                        "end_row": pages[k + 1][3] if k + 1 < len(pages) else group[3], "offset": page[1], "size": page[2], "null_count": of(5), "null_page": empty, "min": low, "max": high,
                        "min_long": a, "max_long": b, "min_double": x, "max_double": y, "min_text": stat_text(low, physical), "max_text": stat_text(high, physical),
                    }
            group_first += group[3]

    return per_file(spark, paths, rows, PAGE_KINDS, PAGE)


def column_summary(found: DataFrame) -> DataFrame:
    """Values, nulls and sizes of each leaf over all row groups of a chunks() result, with its share of the file."""
    sums = found.groupBy("file", "path").agg(F.sum("num_values").alias("num_values"), F.sum("null_count").alias("null_count"), F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"), F.sort_array(F.collect_set("codec")).alias("codecs"))
    total = found.groupBy("file").agg(F.sum("compressed").alias("_total"))
    pct = F.when(F.col("_total") > 0, F.round(100 * F.col("compressed") / F.col("_total"), 1)).otherwise(0.0)
    return sums.join(total, "file").withColumn("pct", pct).drop("_total")


def group_summary(found: DataFrame) -> DataFrame:
    """Rows, sizes and compression ratio of each row group of a chunks() result."""
    sums = found.groupBy("file", "row_group").agg(F.max("group_rows").alias("num_rows"), F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"))
    return sums.withColumn("ratio", F.when(F.col("compressed") > 0, F.col("uncompressed") / F.col("compressed")))


def validate(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, status, error, rows_read): magic bytes, footer, every row group decoded with page checksums, row counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file in batch.column("file").to_pylist():
                n, error = 0, None
                try:
                    system, inside = open_file(file)
                    with system.open_input_file(inside) as f:
                        if f.size() < 12 or f.read_at(4, 0) != b"PAR1" or f.read_at(4, f.size() - 4) != b"PAR1":
                            raise ValueError("InvalidMagic")
                        reader = pq.ParquetFile(f, page_checksum_verification=True)
                        for b in reader.iter_batches():
                            n += b.num_rows
                        if n != reader.metadata.num_rows or n != sum(reader.metadata.row_group(g).num_rows for g in range(reader.num_row_groups)):
                            raise ValueError("RowCountMismatch")
                except (pa.ArrowException, OSError, ValueError) as e:
                    error = str(e)
                out.append({"file": file, "status": "ok" if error is None else "failed", "error": error, "rows_read": n})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("status", pa.string()), ("error", pa.string()), ("rows_read", pa.int64())]))

    return files(spark, *paths).select("file").mapInArrow(run, "file string, status string, error string, rows_read bigint")
