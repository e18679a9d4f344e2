import datetime
import decimal
import json
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType

from tessera import cli
from tessera import functions as fn
from tessera.operators import filters as flt
from tessera.operators import nested, ranges, stats
from tessera.sources import metadata, scan, sink

SPANS = st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=8)


def frame(spark, rows):
    return spark.createDataFrame(rows, "first bigint, last bigint")


def members(rows):
    return {x for a, b in rows for x in range(a, b)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(SPANS, SPANS, st.sampled_from([3, 1024]))
def test_range_algebra(spark, a, b, buckets):
    kept = ranges.BUCKETS
    ranges.BUCKETS = buckets
    try:
        na, nb = ranges.normalize(frame(spark, a)), ranges.normalize(frame(spark, b))
        got = sorted(tuple(r) for r in na.collect())
        assert members(got) == members(a) and all(x[1] < y[0] for x, y in zip(got, got[1:]))
        for found, want in ((ranges.union(na, nb), members(a) | members(b)), (ranges.intersect(na, nb), members(a) & members(b))):
            rows = sorted(tuple(r) for r in found.collect())
            assert members(rows) == want and all(x[1] < y[0] for x, y in zip(rows, rows[1:]))
        assert {r.row for r in ranges.contains(spark.range(31).withColumnRenamed("id", "row"), "row", na).collect()} == members(a)
    finally:
        ranges.BUCKETS = kept


def test_ranges_of_groups(spark, monkeypatch):
    df = spark.createDataFrame([("a", -5, 3), ("a", 3, 9), ("b", 0, 2), ("b", 1, 1), ("b", 100, 2000)], "f string, first bigint, last bigint")
    got = sorted(tuple(r) for r in ranges.normalize(df, "f").collect())
    assert got == [("a", -5, 9), ("b", 0, 2), ("b", 100, 2000)]
    other = spark.createDataFrame([("a", 0, 1), ("b", 1, 150), ("c", 0, 9)], "f string, first bigint, last bigint")
    assert sorted(tuple(r) for r in ranges.intersect(ranges.normalize(df, "f"), other, "f").collect()) == [("a", 0, 1), ("b", 1, 2), ("b", 100, 150)]
    rows = spark.createDataFrame([("a", -5), ("a", 9), ("b", 1999), ("b", 50), ("c", 0)], "f string, n bigint")
    for limit in (500_000, 0):
        monkeypatch.setattr(ranges, "BROADCAST", limit)
        assert sorted(tuple(r) for r in ranges.contains(rows, "n", ranges.normalize(df, "f"), "f").collect()) == [("a", -5), ("b", 1999)]
    assert ranges.is_empty(ranges.empty(spark)).first().is_empty and not ranges.is_empty(ranges.single(spark, 1, 2)).first().is_empty
    assert ranges.is_full(ranges.full(spark, 9), 9).first().is_full and ranges.normalize(ranges.empty(spark)).count() == 0


@pytest.mark.parametrize("op", [*flt.OPERATORS, "between"])
def test_pages_hold_exact_rows(spark, op):
    df = spark.range(400).select("id", F.when(F.col("id") % 3 != 0, (F.col("id") * 7919) % 101).alias("v"))
    f = flt.between_i64("v", 90, 95) if op == "between" else flt.cmp_i64("v", op, 50)
    exact, paged = ({r.id for r in x.collect()} for x in (flt.where_all(df, f), stats.page_filter(df, "id", 10, f)))
    assert exact <= paged


def test_filter_errors(spark):
    with pytest.raises(ValueError):
        flt.where_all(spark.range(1), flt.cmp_i64("nope", "eq", 1))
    with pytest.raises(ValueError):
        flt.cmp_i64("id", "like", 1)
    with pytest.raises(ValueError):
        scan.project(spark.range(1), ["nope"])


def test_nan_and_all_null_statistics(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None)], "x double, y int")
    rows = {r.column: r for r in stats.column_stats(df, "x", "y").collect()}
    assert (rows["x"].min, rows["x"].max, rows["x"].null_count) == ("1.0", "1.0", 0)
    assert (rows["y"].min, rows["y"].null_count) == (None, 2)
    empty = stats.column_stats(df.limit(0), "x").first()
    assert (empty.n_values, empty.min) == (0, None)


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(fn.saturating_mul(F.lit(1 << 62), F.lit(4))) == (1 << 63) - 1
    assert get(fn.saturating_mul(F.lit(-(1 << 62)), F.lit(4))) == -(1 << 63)
    assert get(fn.convert_time(F.lit(-1500), "millis", "seconds")) == -1
    assert get(fn.convert_time(F.lit(1 << 60), "seconds", "nanos")) == (1 << 63) - 1
    assert get(fn.int96_days(F.lit(-1))) == 2440587 and get(fn.int96_nanos_of_day(F.lit(-1))) == 86_399_999_999_999
    assert get(fn.interval_text(F.lit(1), F.lit(15), F.lit(3_600_000))) == "P1M15DT1H"
    assert get(fn.interval_text(F.lit(0), F.lit(0), F.lit(0))) == "P0D"
    assert get(fn.decimal_from_bytes(F.unhex(F.lit("FF85")), 9, 2)) == decimal.Decimal("-1.23")
    assert get(fn.uuid_parse(F.lit("not-a-uuid"))) is None
    assert get(fn.float16(F.unhex(F.lit("003C")))) == 1.0 and get(fn.float16(F.unhex(F.lit("00FC")))) == float("-inf")
    assert get(fn.size_text(F.lit(1536))) == "1.5 KB"
    assert fn.type_name(1001) == "Point Z" and fn.type_name(99) == "Unknown"
    assert [fn.decimal_byte_length(p) for p in (1, 9, 18, 38)] == [1, 4, 8, 16]


def test_interval_bytes(spark):
    """One interval is 12 bytes or null, never other numbers; what needs more is a list of two."""
    most = (1 << 32) - 1
    rows = [(0, 0, 0), (1, 15, 3_600_000), (most, most, most), (0, 0, most + 1), (0, most + 1, 0), (most + 5, 0, 7), (-1, 0, 0), (0, -(1 << 63), (1 << 63) - 1), (1, None, 2)]
    df = spark.createDataFrame(rows, "m bigint, d bigint, s bigint")
    parts = [F.col(c) for c in df.columns]
    got = df.select("m", "d", "s", fn.interval_bytes(*parts).alias("raw"), fn.interval_words(*parts).alias("words")).select("*", fn.interval_parts(F.col("raw")).alias("p"), fn.interval_whole(F.col("words")).alias("w"))
    for r in got.collect():
        want = (r.m, r.d, r.s)
        fits = None not in want and all(0 <= x <= most for x in want)
        assert (bytes(r.raw) if r.raw is not None else None) == (struct.pack("<3I", *want) if fits else None)
        assert tuple(r.p) == (want if fits else (None,) * 3) and tuple(r.w) == ((None,) * 3 if None in want else want)
        assert None in want or [bytes(x) for x in r.words] == [struct.pack("<3I", *[x >> shift & most for x in want]) for shift in ([0] if fits else [0, 32])]


def test_decimal_bytes(spark):
    """All widths, signs and the largest sizes, byte for byte."""
    values = [0, 1, -1, 127, -128, -385, 2**63 - 1, -(2**63), 2**64, -(2**64), 10**38 - 1, 1 - 10**38, 12345678901234567890123, -12345678901234567890123]
    rows = [(str(v), n, v.to_bytes(n, "big", signed=True)) for v in values for n in range(1, 17) if -(1 << 8 * n - 1) <= v < 1 << 8 * n - 1]
    df = spark.createDataFrame(rows, "v string, n int, b binary")
    got = df.select("v", fn.decimal_from_bytes(F.col("b"), 38, 0).alias("x"), fn.decimal_from_bytes(F.col("b"), 38, 5).alias("y")).collect()
    with decimal.localcontext(prec=60):
        assert all(r.x == decimal.Decimal(r.v) and (r.y == decimal.Decimal(r.v).scaleb(-5)) for r in got)
    whole = spark.createDataFrame([(str(v),) for v in values], "v string").select("v", F.col("v").cast("decimal(38,0)").alias("d"))
    for n in (1, 8, 9, 12, 15, 16):
        for r in whole.select("v", fn.decimal_to_bytes(F.col("d"), 0, n).alias("b")).collect():
            fits = -(1 << 8 * n - 1) <= int(r.v) < 1 << 8 * n - 1
            assert (bytes(r.b) if r.b is not None else None) == (int(r.v).to_bytes(n, "big", signed=True) if fits else None)
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert get(fn.decimal_from_bytes(F.unhex(F.lit("00" * 17)), 38, 0)) is None and get(fn.decimal_from_bytes(F.unhex(F.lit("")), 9, 2)) == 0
    assert get(fn.decimal_from_bytes(F.unhex(F.lit("7F" + "FF" * 15)), 38, 0)) is None and get(fn.decimal_from_bytes(F.unhex(F.lit("0400")), 3, 1)) is None
    assert get(fn.reverse_bytes(F.unhex(F.lit("0102FF")))) == b"\xff\x02\x01"
    assert get(fn.decimal_unscaled(F.lit(123.455), 2)) == 12346 and get(fn.decimal_unscaled(F.lit(float("nan")), 2)) == 10**38 - 1 and get(fn.decimal_unscaled(F.lit(-1e300), 2)) == 1 - 10**38
    assert get(fn.decimal_to_double(F.lit(-12345), 2)) == -123.45


def test_value_text(spark):
    kind = "a array<double>, m map<string,double>, n map<int,binary>, s struct<x:int,`y z`:string>, b binary, d double, e decimal(9,2), t string"
    df = spark.createDataFrame([([1.5, float("nan"), None, 2.0, 1e20, -1e-7, float("-inf")], {"a": 2.0}, {3: b"\x00\xff"}, (1, 'q"\\\n\x01\x1f\x7f'), b"plain\t", 1e-300, decimal.Decimal("1.50"), None)], kind)
    text = df.select(fn.ndjson(df).alias("j")).first().j
    assert json.loads(text) == {"a": [1.5, "nan", None, 2, 10**20, -1e-7, "-inf"], "m": {"a": 2}, "n": {"3": "00ff"}, "s": {"x": 1, "y z": 'q"\\\n\x01\x1f\x7f'}, "b": "plain\t", "d": 1e-300, "e": 1.5, "t": None}
    assert "\\u001f" in text and "100000000000000000000" in text
    row = df.select(*[fn.nested_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert row.a == "[1.5, nan, null, 2, 100000000000000000000, -0.0000001, -inf]" and row.m == '{"a": 2}' and row.s == '{x: 1, y z: "q"\\\n\x01\x1f\x7f"}' and row.t == "null"
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert get(fn.printable_cell(F.lit("a\x7f\t"))) and not get(fn.printable_cell(F.lit("\x1f")))
    assert get(fn.cell_text(F.lit("x" * 51))) == "x" * 47 + "..." and get(fn.cell_text(F.lit("é" * 30))) == "é" * 23 + "\ufffd..." and get(fn.cell_text(F.lit("a\x01b"))) == "610162"
    assert get(fn.cell(F.lit(b"\x00" * 20), BinaryType())) == "00" * 16 + "..." and get(fn.cell(F.lit(None).cast("int"), IntegerType())) == "null"
    assert [get(fn.plain_number(F.lit(x))) for x in (0.0, -0.0, 100.0, 1.25e-3, 123456789.125, 1.7976931348623157e308)] == ["0", "-0", "100", "0.00125", "123456789.125", str(17976931348623157 * 10**292)]


SHREDDED = [
    ("array<array<int>>", [[[1, 2], [], None, [None, 3]], [], None, [[]]]),
    ("array<struct<a:int,b:array<string>>>", [[(1, ["x", None]), None, (None, None), (2, [])], [], None]),
    ("map<string,array<int>>", [{"a": [1, None], "b": None, "c": []}, {}, None]),
    ("struct<x:struct<y:array<int>>,z:double>", [(([1],), 2.0), ((None,), None), (None, 1.0), None]),
    ("int", [1, None]),
]


@pytest.mark.parametrize("kind, values", SHREDDED)
def test_shred_and_assemble(spark, kind, values):
    df = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")
    own = df.schema["v"].dataType
    leaves = [p[2:] for p, _, _ in nested.leaf_levels(own, "v")]
    parts = {p: nested.shred(df, "k", "v", p) for p in leaves}
    back = nested.assemble(parts, "k", "v", own)
    assert dict(map(tuple, back.collect())) == dict(map(tuple, df.collect()))
    if kind.startswith("array<array"):
        got = [tuple(r)[2:] for r in parts[leaves[0]].orderBy("k", "pos").collect()]
        assert got == [(0, 5, 1), (2, 5, 2), (1, 3, None), (1, 2, None), (1, 4, None), (2, 5, 3), (0, 1, None), (0, 0, None), (0, 3, None)]


def test_geometry(spark):
    point, line = struct.pack("<BIdd", 1, 1, 10, 20), struct.pack("<BII4d", 1, 2, 2, 0, 1, 30, -5)
    good = spark.createDataFrame([(point,), (line,), (None,)], "g binary")
    box = fn.bounding_box(good, "g").first()
    assert (box.xmin, box.ymin, box.xmax, box.ymax, box.geometry_types, box.zmin) == (0, -5, 30, 20, [1, 2], None)
    odd = spark.createDataFrame([(struct.pack("<BIdd", 1, 1, float("nan"), 9.0),), (struct.pack(">BIdd", 0, 1, -8, 4),), (struct.pack("<BIddd", 1, 1001, 1, 2, 3),)], "g binary")
    more = fn.bounding_box(good.union(odd), "g").first()
    assert (more.xmin, more.ymin, more.xmax, more.ymax, more.zmin, more.geometry_types) == (-8, -5, 30, 20, 3, [1, 2, 1001])
    seen = []
    scan.visit(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").first(), lambda k, v: seen.append((k, v)) or k < 1)
    assert seen == [(0, 1), (1, 2)]
    bad = good.union(spark.createDataFrame([(b"\x01\x01",)], "g binary"))
    assert fn.bounding_box(bad, "g").first().xmin is None


def test_nested(spark):
    df = spark.createDataFrame([(1, [1, None]), (2, []), (3, None)], "k int, v array<int>")
    got = sorted((r.k, r.pos if r.pos is not None else -1, r.def_level) for r in nested.flatten_list(df, "k", "v").collect())
    assert got == [(1, 0, 3), (1, 1, 2), (2, -1, 1), (3, -1, 0)]
    assert nested.leaf_levels(df.schema) == [("k", 1, 0), ("v.list.element", 3, 1)]
    assert [nested.bit_width(x) for x in (0, 1, 3, 4)] == [0, 1, 2, 3]


def test_files(spark, tmp_path):
    df = spark.range(5000).select("id", (F.col("id") % 7).cast("double").alias("x"), F.lit("s").alias("s")).coalesce(1)
    own, arrow = str(tmp_path / "own"), str(tmp_path / "arrow")
    sink.write(df, own, sink.Layout(rows_per_group=1000, rows_per_page=100, dictionary=False, sort=("id",)))
    groups = metadata.group_summary(metadata.chunks(spark, own)).collect()
    assert sorted(r.num_rows for r in groups) == [1000] * 5
    file = next(r.file for r in metadata.footers(spark, own).collect())
    pages = metadata.page_index(spark, file)
    assert pages.where("path = 'id' and row_group = 0").count() == 10
    assert scan.row_group(spark, file, 1).count() == 1000 and scan.row_group(spark, file, 9).count() == 0
    layout = sink.Layout("brotli", rows_per_group=2000, by_path={"x": {"encoding": "BYTE_STREAM_SPLIT", "codec": "snappy"}}, metadata={"k": "v"})
    names = sink.write_arrow(df, arrow, layout)
    kept = pq.ParquetFile(f"{arrow}/{names[0]}")
    assert kept.metadata.row_group(0).column(1).compression == "SNAPPY" and kept.metadata.num_row_groups == 3 and kept.metadata.metadata[b"k"] == b"v"
    assert kept.read().num_rows == 5000
    assert {r.status for r in metadata.validate(spark, own, arrow).collect()} == {"ok"}
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 no file at all")
    assert cli.report(spark, "validate", str(tmp_path / "bad.parquet")).first().status == "failed"
    assert cli.report(spark, "count", own).first().rows == 5000
    assert [cli.report(spark, c, own).count() for c in ("head", "size", "rowgroups")] == [5, 3, 5]
    data = scan.write_buffer(df.limit(3))
    assert scan.open_buffer(spark, data).count() == 3
    assert sum(b.num_rows for b in scan.batches(df)) == 5000


def test_rejected_types(spark, tmp_path):
    path = str(tmp_path / "odd.parquet")
    pq.write_table(pa.table({"h": pa.array([1.5], pa.float16()), "t": pa.array([datetime.time(1)], pa.time32("ms"))}), path)
    row = scan.scan(spark, path, schema="h binary, t int").select(fn.float16(F.col("h")).alias("h"), "t").first()
    assert (row.h, row.t) == (1.5, 3_600_000)
    with pytest.raises(ValueError):
        sink.check_encoding("BYTE_STREAM_SPLIT", "bytes")


def test_append_stream(spark, tmp_path):
    from tessera.streaming import append

    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = append.read_stream(spark, str(tmp_path / "in"), "id bigint")
    append.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
