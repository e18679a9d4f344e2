import datetime
import decimal
import math
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera import functions as fn
from tessera.operators import filters as flt
from tessera.operators import pages
from tessera.sources import custom, metadata, scan, schema, sink, thrift, writer


def scanned_rows(df):
    """Rows that the file scans of an executed plan put out."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if hasattr(node, "executedPlan") and "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.fixture(scope="module")
def paged(spark, tmp_path_factory):
    """20 row groups of 10 pages of 50 rows; v is null in every page of the first group."""
    path = str(tmp_path_factory.mktemp("paged") / "p")
    df = spark.range(0, 10_000, 1, 1).select("id", F.when(F.col("id") >= 500, F.col("id") % 1000).alias("v"), (F.col("id") / 4).alias("x"), F.format_string("k%05d", "id").alias("s"))
    sink.write(df, path, sink.Layout(rows_per_group=500, rows_per_page=50, dictionary=False))
    return path


@pytest.mark.parametrize(
    "wanted",
    [
        [flt.cmp_i64("id", "lt", 120)], [flt.cmp_i64("v", "eq", 3)], [flt.cmp_i64("v", "ne", 3)], [flt.between_f64("x", 100.0, 101.0)], [flt.cmp_bytes("s", "ge", "k09990")],
        [flt.cmp_bytes("s", "eq", "k00777"), flt.cmp_i64("id", "gt", 700)], [flt.cmp_i64("id", "gt", 99_999)], [flt.cmp_f64("x", "le", 5)],
        [flt.raw("id", lambda c: c % 500 == 7, lambda low, high, null: (low % 500 <= 7) & ~null)], [flt.raw("id", lambda c: c > 5)],
    ],
)
def test_page_scan(spark, paged, wanted):
    """All rows of the pages whose bounds match, by brute force over pages of 50 rows."""
    rows = spark.read.parquet(paged).collect()
    names = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}

    def keeps(page, f):
        own = [r[f.column] for r in page if r[f.column] is not None]
        if not own and f.op != "raw":
            return False
        low, high = (min(own), max(own)) if own else (None, None)
        if f.op == "raw":
            return f.high is None or low % 500 <= 7
        if f.op == "between":
            return low <= f.high and high >= f.value
        if f.op == "eq":
            return low <= f.value <= high
        if f.op == "ne":
            return not low == high == f.value
        return names[f.op](low if f.op in ("lt", "le") else high, f.value)

    want = {r["id"] for k in range(0, 10_000, 50) if all(keeps(rows[k : k + 50], f) for f in wanted) for r in rows[k : k + 50]}
    assert {r["id"] for r in pages.page_scan(spark, paged, *wanted, columns=["id"]).collect()} == want


def test_page_scan_reads_less(spark, paged):
    found = pages.page_scan(spark, paged, flt.between_i64("id", 4_010, 4_020), columns=["id", "s"])
    assert found.count() == 50
    assert scanned_rows(found) < 500 < scanned_rows(spark.read.parquet(paged))


def test_page_scan_errors(spark, paged, tmp_path):
    with pytest.raises(ValueError, match="no column"):
        pages.page_scan(spark, paged, flt.cmp_i64("nope", "eq", 1))
    pq.write_table(pa.table({"id": [1, 2]}), tmp_path / "plain.parquet", write_page_index=False)
    with pytest.raises(ValueError, match="PageIndexMissing"):
        pages.page_scan(spark, str(tmp_path / "plain.parquet"), flt.cmp_i64("id", "eq", 1))
    assert pages.page_scan(spark, str(tmp_path / "plain.parquet")).count() == 2


def test_page_index(spark, paged, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 no file at all PAR1")
    index = metadata.page_index(spark, paged, str(tmp_path))
    rows = index.where("path = 'v'").orderBy("row_group", "page").collect()
    assert len(rows) == 200 and rows[0].null_page and rows[0].min_text == "null" and (rows[10].min_long, rows[10].max_long, rows[10].null_count) == (500, 549, 0)
    assert [(r.first_row, r.end_row) for r in rows[:10]] == [(k, k + 50) for k in range(0, 500, 50)] and rows[15].group_first == 500
    assert index.where("path = 's'").orderBy("row_group", "page").first().max_text == '"k00049"'
    summary = {r.path: r for r in cli.report(spark, "page-index", paged).collect()}
    assert (summary["v"].indexed_chunks, summary["v"].pages, summary["v"].null_pages) == (20, 200, 10)
    assert cli.report(spark, "page-index", paged, "x").count() == 200
    assert metadata.chunks(spark, paged, str(tmp_path)).where("row_group = 0").count() == 4  # the bad file gives none
    assert metadata.footers(spark, str(tmp_path)).first().error


def test_thrift():
    nested = bytes([0x15, 0x05, 0x18, 2, 65, 66, 0x11, 0x19, 0x25, 2, 4, 0x0C, 0x20, 0x15, 2, 0, 0])
    assert thrift.parse(nested) == {1: -3, 2: b"AB", 3: True, 4: [1, 2], 16: {1: 1}}
    for bad in (b"", b"\x18\x7f", b"\x1c" * 100, b"\x1d\x00"):
        with pytest.raises(ValueError):
            thrift.parse(bad)


def test_statistic_text():
    one = [(struct.pack("<i", -5), "INT32", "-5"), (struct.pack("<q", 7), "INT64", "7"), (struct.pack("<d", 1.5), "DOUBLE", "1.5000"), (struct.pack("<f", 0.0), "FLOAT", "0.0000"), (struct.pack("<d", 2e11), "DOUBLE", "2.0000e11"), (struct.pack("<d", -2e-5), "DOUBLE", "-2.0000e-5")]
    one += [(struct.pack("<d", math.nan), "DOUBLE", "NaN"), (struct.pack("<d", -math.inf), "DOUBLE", "-inf"), (b"\x01", "BOOLEAN", "true"), (b"", "BOOLEAN", "?"), (b"abc", "BYTE_ARRAY", '"abc"'), (b"\x00a", "BYTE_ARRAY", "0x0061"), (b"\x00" * 17, "FIXED_LEN_BYTE_ARRAY", "(17 bytes)"), (b"\x00" * 12, "INT96", "(12 bytes)"), (None, "INT32", "null"), (b"\x01", "INT32", "0x01"), (b"\x01", None, "0x01")]
    assert [fn.stat_text(raw, kind) for raw, kind, _ in one] == [t for _, _, t in one]
    assert metadata.compare_encoded(struct.pack("<i", -1), struct.pack("<i", 1), "INT32") == -1 and metadata.compare_encoded(b"\xff", b"\x01", "BYTE_ARRAY") == 1 and metadata.compare_encoded(b"a", b"a", "BYTE_ARRAY") == 0


def test_logical_types(spark, tmp_path):
    table = pa.table(
        {
            "ts": pa.array([1], pa.timestamp("us", "UTC")), "local": pa.array([1], pa.timestamp("ms")), "t": pa.array([1], pa.time64("ns")), "d": pa.array([decimal.Decimal("1.50")], pa.decimal128(9, 2)),
            "i": pa.array([1], pa.int8()), "u": pa.array([1], pa.uint16()), "s": pa.array(["x"]), "b": pa.array([b"x"]), "day": pa.array([1], pa.date32()),
        }
    )
    pq.write_table(table, tmp_path / "x.parquet")
    found = {r.path: r.logical_type for r in metadata.chunks(spark, str(tmp_path / "x.parquet")).collect()}
    assert found == {"ts": "TIMESTAMP(UTC, MICROS)", "local": "TIMESTAMP(LOCAL, MILLIS)", "t": "TIME(UTC, NANOS)" if "UTC" in found["t"] else "TIME(LOCAL, NANOS)", "d": "DECIMAL(9,2)", "i": "INT(8,signed)", "u": "INT(16,unsigned)", "s": "STRING", "b": None, "day": "DATE"}
    own = pq.ParquetFile(tmp_path / "x.parquet").schema
    assert metadata.is_logical(own.column(0), "TIMESTAMP") and metadata.is_logical(own.column(3), "DECIMAL(9,2)") and not metadata.is_logical(own.column(7), "STRING") and metadata.sort_order_valid(own.column(0))
    assert [x["path"] for x in metadata.leaves(spark, str(tmp_path / "x.parquet"))][:2] == ["ts", "local"]


NEGATIVE = [
    ({"float_encoding": "DELTA_BINARY_PACKED"}, "UnsupportedEncoding"), ({"int_encoding": "RLE"}, "UnsupportedEncoding"), ({"float_encoding": "RLE"}, "UnsupportedEncoding"), ({"by_path": {"s": {"encoding": "BYTE_STREAM_SPLIT"}}}, "UnsupportedEncoding"),
    ({"by_path": {"b": {"encoding": "BYTE_STREAM_SPLIT"}}}, "UnsupportedEncoding"), ({"by_path": {"i": {"encoding": "RLE"}}}, "UnsupportedEncoding"), ({"by_path": {"i": {"encoding": "BIT_PACKED"}}}, "UnsupportedEncoding"), ({"by_path": {"nope": {"codec": "gzip"}}}, "no column"),
    ({"by_path": {"i": {"level": 3}}}, "unknown option"), ({"codec": "rar"}, "UnsupportedCompression"), ({"sort": ("nope",)}, "to sort by"), ({"rows_per_group": 0}, "1 or more"), ({"rows_per_page": 5}, "write\\(\\)"),
]


@pytest.mark.parametrize("options, error", NEGATIVE)
def test_layouts_that_are_refused(spark, options, error):
    df = spark.range(1).select(F.col("id").cast("int").alias("i"), F.lit("x").alias("s"), F.lit(True).alias("b"), F.lit(1.0).alias("d"))
    with pytest.raises(ValueError, match=error):
        sink.write_arrow(df, "/nowhere", sink.Layout(**options))


def test_refused_before_writing(spark, tmp_path):
    df = spark.range(1)
    for layout in (sink.Layout("brotli"), sink.Layout(int_encoding="DELTA_BINARY_PACKED"), sink.Layout(by_path={"id": {"encoding": "RLE"}})):
        with pytest.raises(ValueError):
            sink.write(df, str(tmp_path / "out"), layout)
    with pytest.raises(ValueError, match="Duplicate"):
        sink.write_arrow(df.select("id", "id"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_nested_leaves_have_their_options(spark, tmp_path):
    df = spark.range(500).select("id", F.struct(F.col("id").alias("a"), F.lit("x").alias("b")).alias("s"), F.array(F.col("id"), F.lit(1)).alias("v"), F.create_map(F.lit("k"), F.col("id")).alias("m")).coalesce(1)
    layout = sink.Layout("zstd", by_path={"s.a": {"codec": "snappy"}, "v": {"codec": "gzip", "dictionary": False}, "m.key_value.value": {"encoding": "DELTA_BINARY_PACKED"}}, sort=(("id", True, False),), metadata={"k": "v"})
    (name,) = sink.write_arrow(df, str(tmp_path), layout)
    group = pq.ParquetFile(tmp_path / name).metadata.row_group(0)
    own = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert {p: c.compression for p, c in own.items()} == {"id": "ZSTD", "s.a": "SNAPPY", "s.b": "ZSTD", "v.list.element": "GZIP", "m.key_value.key": "ZSTD", "m.key_value.value": "ZSTD"}
    assert "DELTA_BINARY_PACKED" in own["m.key_value.value"].encodings and "RLE_DICTIONARY" not in own["v.list.element"].encodings
    assert group.sorting_columns == (pq.SortingColumn(0, True, False),)
    back = spark.read.parquet(str(tmp_path))
    assert back.count() == 500 and back.first().id == 499 and {p.name[0] for p in tmp_path.iterdir()} <= {"p", "."}
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".part") and p.suffix == ".parquet"]


def test_files_that_spark_refuses(spark, tmp_path):
    df = spark.range(3000).select("id", (F.col("id") / 8).alias("x"), F.when(F.col("id") % 3 > 0, F.array(F.col("id").cast("int"))).alias("v"), F.timestamp_seconds("id").alias("t"))
    for name, layout in (("brotli", sink.Layout("brotli", rows_per_group=700)), ("split", sink.Layout(float_encoding="BYTE_STREAM_SPLIT"))):
        path = str(tmp_path / name)
        sink.write_arrow(df, path, layout)
        assert scan.needs_arrow(spark.read.parquet(path))
        back = scan.scan(spark, path)
        assert back.schema.simpleString() == df.schema.simpleString() and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
        some = scan.scan(spark, path, ["x", "id"], (flt.cmp_i64("id", "lt", 10),))
        assert some.columns == ["x", "id"] and some.count() == 10
    plain = str(tmp_path / "plain")
    sink.write(df, plain)
    assert not scan.needs_arrow(spark.read.parquet(plain))
    with pytest.raises(ValueError):
        scan.scan_arrow(spark, plain, ["nope"])


def test_batches_stream(spark):
    df = spark.range(0, 10_000, 1, 5).select("id", F.array("id").alias("v"))
    reader = scan.batches(df)
    assert reader.schema.names == ["id", "v"] and sum(b.num_rows for b in reader) == 10_000
    assert scan.batches(df.limit(0)).read_all().num_rows == 0


def test_callbacks(spark, tmp_path):
    folder = str(tmp_path)

    class Kept:
        """A target that keeps what it got in a file, as tasks run in processes of their own."""

        def __init__(self, path):
            self.file = open(path, "wb")

        def write(self, data):
            self.file.write(data)

        def close(self):
            self.file.close()

    n = sink.write_to(spark.range(0, 1000, 1, 3), lambda k: Kept(f"{folder}/out{k}.parquet"), sink.Layout("gzip", rows_per_group=100))
    assert n == 1000 and spark.read.parquet(folder).count() == 1000
    source = custom.path_source(f"{folder}/out0.parquet")
    df = custom.scan_source(spark, source)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 333
    with pytest.raises(ValueError):
        custom.scan_source(spark, source, ["nope"])
    with pytest.raises(OSError):
        custom.scan_source(spark, custom.Source(lambda at, size: b"", lambda: 100))


def test_row_writer(tmp_path):
    columns = [schema.column("k", "int64").required(), schema.decimal("d", 9, 2), schema.timestamp("t", "millis"), schema.column("u", "uuid"), schema.struct_of("s", schema.column("a", "int32")), schema.map_of("m", schema.column("key", "string"), schema.column("value", "double"))]
    out = writer.RowWriter(layout=sink.Layout("snappy", rows_per_group=2))
    with pytest.raises(RuntimeError):
        out.begin()
    for c in columns:
        out.add_column(c)
    with pytest.raises(ValueError, match="Duplicate"):
        out.add_column(columns[0])
    with pytest.raises(RuntimeError):
        out.set("k", 1)
    out.begin()
    with pytest.raises(RuntimeError):
        out.add_column(schema.column("late", "string"))
    when = datetime.datetime(2020, 1, 2, tzinfo=datetime.UTC)
    for k in range(5):
        out.set("k", k)
        out.set(1, decimal.Decimal(f"-{k}.25"))
        out.set("t", when)
        out.set("u", bytes([k] * 16))
        out.set("s", {"a": k})
        out.set("m", [("x", k / 2)])
        if k == 4:
            out.set_null("m")
        out.add_row()
    with pytest.raises(ValueError, match="required"):
        out.add_row()
    with pytest.raises(IndexError):
        out.set(99, 1)
    data = out.close()
    with pytest.raises(RuntimeError):
        out.add_row()
    file = pq.ParquetFile(pa.BufferReader(data))
    assert file.metadata.num_row_groups == 3 and file.metadata.row_group(0).column(0).compression == "SNAPPY"
    assert file.read().to_pylist()[3] == {"k": 3, "d": decimal.Decimal("-3.25"), "t": when, "u": bytes([3] * 16), "s": {"a": 3}, "m": [("x", 1.5)]}
    empty = writer.RowWriter(str(tmp_path / "e.parquet"))
    empty.add_column(columns[0])
    empty.begin()
    assert empty.close() is None and pq.read_table(tmp_path / "e.parquet").num_rows == 0


def test_schemas(spark):
    columns = [schema.column("i", "uint8"), schema.time("t", "millis"), schema.list_of("v", schema.column("e", "int32").required()), schema.geometry("g", "EPSG:4326"), schema.geography("h"), schema.fixed("f", 5), schema.column("e", "enum")]
    kind = schema.to_spark(columns)
    assert [f.dataType.simpleString() for f in kind] == ["smallint", "binary", "array<int>", "binary", "binary", "binary", "string"]
    assert schema.to_arrow(kind).names == [c.name for c in columns]
    back = schema.from_arrow(pa.schema([c.arrow() for c in columns]))
    assert back == columns and back[3].meaning == "geometry(EPSG:4326)"
    assert schema.leaf_count(kind) == 7
    assert schema.tree(kind)[0] == "message schema {" and "    repeated group list {" in schema.tree(kind) and "      required int element" in schema.tree(kind)
    for bad in (lambda: schema.column("x", "nope"), lambda: schema.decimal("x", 39, 0), lambda: schema.decimal("x", 5, 6), lambda: schema.geography("x", edges="flat")):
        with pytest.raises(ValueError):
            bad()


def test_geo_metadata(spark, tmp_path):
    points = spark.createDataFrame([(struct.pack("<BIdd", 1, 1, 10, 20),), (struct.pack("<BIdd", 1, 1, -3, 5),)], "g binary").coalesce(1)
    (name,) = sink.write_arrow(points, str(tmp_path), sink.Layout(geo=("g",)))
    found = pq.ParquetFile(tmp_path / name).metadata.metadata[b"geo"].decode()
    assert '"primary_column": "g"' in found and '"bbox": [-3.0, 5.0, 10.0, 20.0]' in found and '"Point"' in found
