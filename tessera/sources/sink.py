"""Writing Parquet: Spark's writer with layout options, and an Arrow sink for what that writer lacks.

Spark's writer covers codecs but brotli, rows per group, page sizes, dictionaries per column, checksums and delta encodings.
The Arrow sink adds brotli, codecs and encodings per leaf column, byte stream split, key/value metadata and sorting columns;
each attempt of a task writes a hidden file of its own, and the driver gives the files of tasks that ended well their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions import geo
from ..operators.nested import leaf_levels

# Encodings that each physical type allows besides PLAIN.
ENCODINGS = {
    "PLAIN": {"bool", "int32", "int64", "float", "double", "bytes", "fixed"},
    "RLE": {"bool"},
    "DELTA_BINARY_PACKED": {"int32", "int64"},
    "DELTA_LENGTH_BYTE_ARRAY": {"bytes"},
    "DELTA_BYTE_ARRAY": {"bytes", "fixed"},
    "BYTE_STREAM_SPLIT": {"int32", "int64", "float", "double", "fixed"},
}


# Physical types of Spark's types.
PHYSICAL = {
    "boolean": "bool", "tinyint": "int32", "smallint": "int32", "int": "int32", "date": "int32", "bigint": "int64", "timestamp": "int64", "timestamp_ntz": "int64",
    "float": "float", "double": "double", "string": "bytes", "binary": "bytes", "decimal": "fixed",
}

CODECS = ("none", "uncompressed", "snappy", "gzip", "lz4", "zstd", "brotli")
KEYS = {"codec", "dictionary", "encoding"}


@dataclass(frozen=True)
class Layout:
    """Write options; `by_path` overrides them for a top-level column or a leaf's dotted path (`s.a`, `v.list.element`), keys being codec, dictionary and encoding.

    `int_encoding` and `float_encoding` hold for all columns of these types. `sort` has column names, or tuples of
    (name, descending, nulls first). `geo` names columns of well-known binary, whose types and bounds go into the metadata.
    """

    codec: str = "zstd"
    rows_per_group: int | None = None
    page_bytes: int | None = None
    rows_per_page: int | None = None
    dictionary: bool = True
    dictionary_bytes: int | None = None
    delta: bool = False
    int_encoding: str | None = None
    float_encoding: str | None = None
    checksum: bool = True
    by_path: dict[str, dict] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)
    sort: tuple = ()
    geo: tuple[str, ...] = ()

    def resolve(self, path: str, key: str, physical: str | None = None):
        """The option for a leaf: its own, its column's, its type's, or the general one."""
        for p in (path, path.split(".")[0]):
            if key in self.by_path.get(p, {}):
                return self.by_path[p][key]
        if key == "encoding":
            delta = {"int32": "DELTA_BINARY_PACKED", "int64": "DELTA_BINARY_PACKED", "bytes": "DELTA_BYTE_ARRAY"}.get(physical) if self.delta else None
            return {"int32": self.int_encoding, "int64": self.int_encoding, "float": self.float_encoding, "double": self.float_encoding}.get(physical) or delta
        return {"codec": self.codec, "dictionary": self.dictionary}[key]

    def order(self) -> list[tuple[str, bool, bool]]:
        return [(s, False, True) if isinstance(s, str) else tuple(s) for s in self.sort]


def leaf_types(kind: DataType, name: str = "") -> list[DataType]:
    """The types of all leaves, in the order of leaf_levels()."""
    if isinstance(kind, StructType):
        return [x for f in kind for x in leaf_types(f.dataType)]
    if isinstance(kind, ArrayType):
        return leaf_types(kind.elementType)
    return leaf_types(kind.keyType) + leaf_types(kind.valueType) if isinstance(kind, MapType) else [kind]


def physical_types(schema: StructType) -> dict[str, str]:
    """Physical type of each leaf path."""
    return {path: PHYSICAL.get(kind.simpleString().split("(")[0], "fixed") for (path, _, _), kind in zip(leaf_levels(schema), leaf_types(schema), strict=True)}


def check_encoding(encoding: str, physical: str) -> None:
    if physical not in ENCODINGS.get(encoding, ()):
        raise ValueError(f"UnsupportedEncoding: {encoding} doesn't encode {physical}")


def check(schema: StructType, layout: Layout) -> dict[str, str]:
    """Raises an error for a layout that the schema doesn't allow; returns the leaves' physical types. Both writers call this first."""
    names = [f.name for f in schema]
    if len(set(names)) < len(names):
        raise ValueError("DuplicateColumnName")
    leaves = physical_types(schema)
    for path, own in layout.by_path.items():
        if path not in leaves and path not in names:
            raise ValueError(f"no column {path!r}")
        if more := set(own) - KEYS:
            raise ValueError(f"unknown option {sorted(more)[0]!r}")
    for codec in (layout.codec, *(o["codec"] for o in layout.by_path.values() if "codec" in o)):
        if codec not in CODECS:
            raise ValueError(f"UnsupportedCompression: {codec}")
    if layout.int_encoding:
        check_encoding(layout.int_encoding, "int32")
    if layout.float_encoding:
        check_encoding(layout.float_encoding, "float")
    for path, physical in leaves.items():
        if encoding := layout.resolve(path, "encoding", physical):
            check_encoding(encoding, physical)
    if missing := [c for c, _, _ in layout.order() if c not in leaves]:
        raise ValueError(f"no column {missing[0]!r} to sort by")
    for number in (layout.rows_per_group, layout.page_bytes, layout.rows_per_page, layout.dictionary_bytes):
        if number is not None and number < 1:
            raise ValueError("sizes are 1 or more")
    return leaves


def ordered(df: DataFrame, layout: Layout) -> DataFrame:
    way = {(False, True): "asc_nulls_first", (False, False): "asc_nulls_last", (True, True): "desc_nulls_first", (True, False): "desc_nulls_last"}
    return df.sortWithinPartitions(*[getattr(F.col(c), way[down, first])() for c, down, first in layout.order()]) if layout.sort else df


def write(df: DataFrame, path: str, layout: Layout = Layout(), mode: str = "errorifexists") -> None:  # noqa: B008
    """Spark's own writer; a layout that it can't follow is an error."""
    check(df.schema, layout)
    own = any({"codec", "encoding"} & set(o) for o in layout.by_path.values())
    if layout.codec == "brotli" or layout.metadata or layout.geo or layout.int_encoding or layout.float_encoding or own:
        raise ValueError("this layout needs write_arrow()")
    options = {"compression": layout.codec, "parquet.enable.dictionary": layout.dictionary, "parquet.page.write-checksum.enabled": layout.checksum}
    options |= {f"parquet.enable.dictionary#{p}": o["dictionary"] for p, o in layout.by_path.items() if "dictionary" in o}
    more = {"parquet.block.row.count.limit": layout.rows_per_group, "parquet.page.size": layout.page_bytes, "parquet.page.row.count.limit": layout.rows_per_page, "parquet.dictionary.page.size": layout.dictionary_bytes, "parquet.writer.version": "v2" if layout.delta else None}
    if layout.rows_per_page:
        more["parquet.page.size.row.check.min"] = min(100, layout.rows_per_page)  # else no page ends before 100 rows
    options |= {k: v for k, v in more.items() if v is not None}
    ordered(df, layout).write.mode(mode).options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).parquet(path)


def arrow_options(schema: StructType, layout: Layout) -> dict:
    """Options of the Arrow writer, one for each leaf where they differ."""
    leaves = check(schema, layout)
    encodings = {p: e for p, k in leaves.items() if (e := layout.resolve(p, "encoding", k))}
    codec = lambda p: {"uncompressed": "none"}.get(c := layout.resolve(p, "codec"), c)
    if layout.rows_per_page:
        raise ValueError("the Arrow writer bounds pages by bytes only; use write() for rows_per_page")
    out = {
        "compression": {p: codec(p) for p in leaves}, "use_dictionary": [p for p in leaves if layout.resolve(p, "dictionary") and p not in encodings],
        "column_encoding": encodings or None, "write_page_index": True, "write_page_checksum": layout.checksum, "data_page_size": layout.page_bytes,
    }
    if layout.dictionary_bytes:
        out["dictionary_pagesize_limit"] = layout.dictionary_bytes
    if layout.sort:
        places = list(leaves)
        out["sorting_columns"] = [pq.SortingColumn(places.index(c), down, first) for c, down, first in layout.order()]
    return out


def row_groups(batches: Iterator[pa.RecordBatch], layout: Layout, write_group: Callable[[pa.Table], None]) -> None:
    """Gathers batches to tables of rows_per_group rows."""
    limit, held, n = layout.rows_per_group or 1_000_000, [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(batch.num_rows - at, limit - n)
            held.append(batch.slice(at, take))
            at, n = at + take, n + take
            if n == limit:
                write_group(pa.Table.from_batches(held))
                held, n = [], 0
    if held:
        write_group(pa.Table.from_batches(held))


class TableWriter:
    """The Arrow writer with a layout, opened with the first row group; `target` is a path in `system` or a file-like object."""

    def __init__(self, target, options: dict, metadata: dict[str, str], system=None):
        self.target, self.options, self.metadata, self.system, self.writer, self.rows = target, options, metadata, system, None, 0

    def add(self, table: pa.Table) -> None:
        meta = {**(table.schema.metadata or {}), **{k.encode(): v.encode() for k, v in self.metadata.items()}}
        table = table.replace_schema_metadata(meta)
        if self.writer is None:
            where = {"filesystem": self.system} if self.system is not None else {}
            self.writer = pq.ParquetWriter(self.target, table.schema, **where, **self.options)
        self.writer.write_table(table, row_group_size=max(1, table.num_rows))
        self.rows += table.num_rows

    def close(self) -> None:
        if self.writer is not None:
            self.writer.close()


def geo_layout(df: DataFrame, layout: Layout) -> Layout:
    """The layout with GeoParquet metadata of its `geo` columns, whose bounds one pass over them gives."""
    if not layout.geo:
        return layout
    found = {}
    for c in layout.geo:
        box = geo.bounding_box(df, c).first()
        found[c] = (box["geometry_types"] or [], [box[k] for k in ("xmin", "ymin", "xmax", "ymax")] if box["xmin"] is not None else None)
    return replace(layout, metadata=layout.metadata | {"geo": geo.geo_metadata(found, layout.geo[0])}, geo=())


def write_arrow(df: DataFrame, path: str, layout: Layout = Layout()) -> list[str]:  # noqa: B008
    """One file for each partition that has rows, by the Arrow writer; returns their names."""
    from .metadata import open_file

    layout = geo_layout(df, layout)
    options = arrow_options(df.schema, layout)
    system, root = open_file(path)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_file(path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        out = TableWriter(f"{root}/.{name}", options, layout.metadata, system)
        row_groups(batches, layout, out.add)
        out.close()
        if out.rows:
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    names = sorted(r["name"] for r in ordered(df, layout).mapInArrow(run, "name string").collect())
    for name in names:  # one small call a file
        system.move(f"{root}/.{name}", f"{root}/{name}")
    return names


def write_to(df: DataFrame, open_target: Callable[[int], object], layout: Layout = Layout()) -> int:  # noqa: B008
    """Parquet through callbacks: `open_target` gives, for a partition's number, an object with write(bytes) and close(). Returns the rows written.

    Each partition with rows is a file; bytes come in order, no seeks. A partition that is tried again opens its target anew.
    """
    options = arrow_options(df.schema, layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = None

        def add(table: pa.Table) -> None:
            nonlocal sink
            if sink is None:
                target = open_target(TaskContext.get().partitionId())
                sink = target, TableWriter(pa.PythonFile(Target(target), "w"), options, layout.metadata)
            sink[1].add(table)

        row_groups(batches, layout, add)
        if sink is not None:
            sink[1].close()
            sink[0].close()
            yield pa.RecordBatch.from_arrays([pa.array([sink[1].rows], pa.int64())], ["rows"])

    return sum(r["rows"] for r in ordered(df, layout).mapInArrow(run, "rows bigint").collect())


class Target:
    """A file-like object over a write callback; it counts what went through and leaves closing to its owner."""

    def __init__(self, inner):
        self.inner, self.at, self.closed = inner, 0, False

    def write(self, data) -> int:
        self.inner.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def writable(self) -> bool:
        return True

    def readable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return False

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.closed = True


def choose_dictionary(df: DataFrame, columns: list[str], threshold: float = 0.67) -> dict[str, dict]:
    """by_path options that turn dictionaries off for columns with too many distinct values, by approximate counts."""
    counts = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: {"dictionary": counts[f"d{i}"] <= threshold * counts[f"n{i}"]} for i, c in enumerate(columns)}
