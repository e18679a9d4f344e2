"""Parquet from any random-access source: an object that tells its size and reads bytes at an offset, such as callbacks of a host."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    """`read_at(offset, size)` gives bytes, `size()` the length. Both are sent to the tasks, so they must be picklable."""

    read_at: Callable[[int, int], bytes]
    size: Callable[[], int]

    def open(self) -> pa.NativeFile:
        return pa.PythonFile(SourceFile(self), "r")


class SourceFile:
    """A file-like object over a source."""

    def __init__(self, source: Source):
        self.source, self.at, self.end, self.closed = source, 0, source.size(), False

    def read(self, n: int = -1) -> bytes:
        n = self.end - self.at if n is None or n < 0 else min(n, self.end - self.at)
        data = self.source.read_at(self.at, n) if n > 0 else b""
        if len(data) != max(0, n):
            raise OSError(f"the source gave {len(data)} bytes of {n}")
        self.at += len(data)
        return data

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.end)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def writable(self) -> bool:
        return False

    def close(self) -> None:
        self.closed = True


def buffer_source(data: bytes) -> Source:
    return Source(lambda at, n: data[at : at + n], lambda: len(data))


def path_source(path: str) -> Source:
    """Positional reads of a file that pyarrow's file systems reach."""

    def opened():
        from .metadata import open_file

        system, inside = open_file(path)
        return system.open_input_file(inside)

    def read_at(at: int, n: int) -> bytes:
        with opened() as f:
            return f.read_at(n, at)

    def size() -> int:
        with opened() as f:
            return f.size()

    return Source(read_at, size)


def scan_source(spark: SparkSession, source: Source, columns: list[str] | None = None) -> DataFrame:
    """Rows of a source, one task for each row group; only the wanted columns are read."""
    from pyspark.sql.pandas.types import from_arrow_schema

    file = pq.ParquetFile(source.open())
    groups, schema = file.metadata.num_row_groups, file.schema_arrow
    names = columns or schema.names
    if bad := [c for c in names if c not in schema.names]:
        raise ValueError(f"no column {bad[0]!r}")
    wanted = pa.schema([schema.field(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for g in batch.column("id").to_pylist():
                own = own or pq.ParquetFile(source.open())
                for b in own.iter_batches(row_groups=[g], columns=names):
                    yield b.select(names)

    return spark.range(0, groups, 1, max(1, groups)).mapInArrow(run, from_arrow_schema(wanted))
