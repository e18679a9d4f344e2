"""Scans: whole files, projections, filters, row groups, batches and heads."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.filters import ColumnFilter, where_all


# What Spark's vectorized reader or its codecs refuse.
REFUSED_CODECS, REFUSED_ENCODINGS = {"BROTLI", "LZO"}, {"BYTE_STREAM_SPLIT"}


def needs_arrow(df: DataFrame) -> bool:
    """Whether Spark's reader refuses a scan's files, by the first file's first row group; codecs and encodings are the same throughout a folder as a rule."""
    names = df._jdf.inputFiles()  # stays in the JVM but for one name
    if not len(names):
        return False
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(names[0]), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        blocks = reader.getFooter().getBlocks()
        for chunk in blocks[0].getColumns() if len(blocks) else ():
            if chunk.getCodec().name() in REFUSED_CODECS or REFUSED_ENCODINGS & {e.name() for e in chunk.getEncodings()}:
                return True
        return False
    finally:
        reader.close()


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, filters: tuple[ColumnFilter, ...] = (), schema=None, reader: str = "auto") -> DataFrame:
    """Rows of a file or folder; columns in the order asked for. Both columns and filters reach the Parquet reader.

    `schema` gives types that Spark doesn't infer, such as binary for UUID and half-precision columns. `reader` is `spark`,
    `arrow` for files that Spark's reader refuses (brotli, byte stream split), or `auto`, which looks at one footer first.
    """
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if reader == "arrow" or reader == "auto" and needs_arrow(df):
        columns = columns if columns is None else project(df, columns).columns
        wanted = columns if columns is None else [*dict.fromkeys([*columns, *[f.column.split(".")[0] for f in filters]])]
        df = scan_arrow(spark, path, wanted, schema)
    df = where_all(df, *filters)
    return project(df, columns) if columns is not None else df


def scan_arrow(spark: SparkSession, path: str, columns: list[str] | None = None, schema=None) -> DataFrame:
    """Rows through the Arrow reader, a row group at a time in tasks; only the wanted columns are read."""
    from .metadata import files, open_file

    kind = (spark.read.schema(schema) if schema else spark.read).parquet(path).schema
    names = columns if columns is not None else kind.names
    if bad := [c for c in names if c not in kind.names]:
        raise ValueError(f"no column {bad[0]!r}")
    own = StructType([kind[c] for c in names])
    target = to_arrow_schema(own)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, inside = open_file(file)
                with system.open_input_file(inside) as f:
                    n = pq.read_metadata(f).num_row_groups
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(range(n), pa.int32())], ["file", "row_group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, g in zip(batch.column("file").to_pylist(), batch.column("row_group").to_pylist(), strict=True):
                system, inside = open_file(file)
                with system.open_input_file(inside) as f:
                    for b in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(row_groups=[g], columns=names):
                        yield from pa.Table.from_batches([b]).select(names).cast(target).to_batches()

    listed = files(spark, path).where("size > 0").select("file").mapInArrow(groups, "file string, row_group int")
    # A row group is a task's unit; they are dealt out, as a task would else get all of a file.
    return listed.repartition(max(1, spark.sparkContext.defaultParallelism * 4)).mapInArrow(run, own)


def project(df: DataFrame, columns: list[str | int]) -> DataFrame:
    """Top-level columns by name or place, in list order; an unknown one is an error."""
    names = [df.columns[c] if isinstance(c, int) and 0 <= c < len(df.columns) else c for c in columns]
    if bad := [c for c in names if c not in df.columns]:
        raise ValueError(f"no column {bad[0]!r}")
    return df.select(*[f"`{c}`" for c in names])


def numbered(df: DataFrame) -> DataFrame:
    """A scan's rows with `row_index`, their number in the file."""
    return df.withColumn("row_index", F.col("_metadata.row_index"))


def row_group(spark: SparkSession, path: str, number: int) -> DataFrame:
    """Rows of one row group of a file; a number out of range gives none."""
    from .metadata import footer_of

    sizes = [g["num_rows"] for g in footer_of(path)["row_groups"]]
    df = spark.read.parquet(path)
    if not 0 <= number < len(sizes):
        return df.limit(0)
    first = sum(sizes[:number])
    index = F.col("_metadata.row_index")
    return df.where((index >= first) & (index < first + sizes[number]))


def head(df: DataFrame, n: int = 5, order: str | None = None) -> DataFrame:
    """The first n rows, by `order` if given; without it, whichever come first."""
    return (df.orderBy(order) if order else df).limit(n)


def rows(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time."""
    return df.toLocalIterator()


def visit(row: Row, function: Callable[[int, object], bool]) -> None:
    """Calls a function with the place and value of each column until it answers False."""
    for place, value in enumerate(row):
        if function(place, value) is False:
            return


def batches(df: DataFrame) -> pa.RecordBatchReader:
    """Arrow batches of a result as a stream: the driver holds one partition at a time, whatever the size of the whole."""
    schema = to_arrow_schema(df.schema)

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = io.BytesIO()
            with pa.ipc.new_stream(out, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["ipc"])

    def stream() -> Iterator[pa.RecordBatch]:
        for row in df.mapInArrow(packed, "ipc binary").toLocalIterator():
            yield from pa.Table.from_batches(pa.ipc.open_stream(bytes(row["ipc"]))).cast(schema).to_batches()

    return pa.RecordBatchReader.from_batches(schema, stream())


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """Runs a function over an iterator of Arrow batches in each task."""
    return df.mapInArrow(function, schema)


def open_buffer(spark: SparkSession, data: bytes) -> DataFrame:
    """Rows of a Parquet file held in memory."""
    return spark.createDataFrame(pq.read_table(io.BytesIO(data)))


def write_buffer(df: DataFrame, **options) -> bytes:
    """A Parquet file in memory, of a result that fits the driver."""
    out = io.BytesIO()
    pq.write_table(df.toArrow(), out, **options)
    return out.getvalue()
