"""Well-known binary geometries: type, bounds and validity, by an Arrow UDF, and column-wide bounding boxes."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

# Geometry types and dimensions of well-known binary.
TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
DIMENSIONS = {0: ("", "xy"), 1: (" Z", "xyz"), 2: (" M", "xym"), 3: (" ZM", "xyzm")}
EDGES = ("spherical", "vincenty", "thomas", "andoyer", "karney")


def type_name(code: int) -> str:
    if code % 1000 not in TYPES or code // 1000 not in DIMENSIONS:
        return "Unknown"
    return TYPES[code % 1000] + DIMENSIONS[code // 1000][0]


def bounds(raw: bytes) -> tuple[int, dict[str, list[float]]]:
    """(type code, {axis: [min, max]}) of a whole geometry; ValueError if it is malformed or bytes are left over."""
    box: dict[str, list[float]] = {}

    def read(form: str, at: int):
        size = struct.calcsize(form)
        if at + size > len(raw):
            raise ValueError("too short")
        return struct.unpack_from(form, raw, at), at + size

    def geometry(at: int, depth: int) -> tuple[int, int]:
        if depth > 32:
            raise ValueError("nested too deeply")
        (order,), at = read("<B", at)
        if order > 1:
            raise ValueError("byte order")
        end = "<>"[order == 0]
        (code,), at = read(end + "I", at)
        if type_name(code) == "Unknown":
            raise ValueError("type")
        axes = DIMENSIONS[code // 1000][1]

        def points(n: int, at: int) -> int:
            for _ in range(n):
                values, at = read(f"{end}{len(axes)}d", at)
                for axis, v in zip(axes, values, strict=True):
                    if not math.isnan(v):
                        b = box.setdefault(axis, [v, v])
                        b[0], b[1] = min(b[0], v), max(b[1], v)
            return at

        kind = code % 1000
        if kind == 1:
            return code, points(1, at)
        (n,), at = read(end + "I", at)
        for _ in range(n if kind > 2 else 1):
            if kind > 3:
                _, at = geometry(at, depth + 1)
            else:
                (m,), at = read(end + "I", at) if kind == 3 else ((n,), at)
                at = points(m, at)
        return code, at

    code, at = geometry(0, 0)
    if at != len(raw):
        raise ValueError("trailing bytes")
    return code, box


AXES = [f"{a}{k}" for k in ("min", "max") for a in "xyzm"]
BOUNDS = StructType([StructField("ok", BooleanType()), StructField("type", IntegerType()), *[StructField(a, DoubleType()) for a in AXES]])


PLAIN_POINT = np.dtype([("order", "u1"), ("type", "<u4"), ("x", "<f8"), ("y", "<f8")])


def one_bounds(x) -> tuple:
    try:
        code, box = bounds(bytes(x)) if x is not None else (None, {})
    except ValueError:
        return (False, None, *[None] * 8)
    return (True, code, *[box.get(a, [None, None])[k] for k in (0, 1) for a in "xyzm"])


@F.pandas_udf(BOUNDS)
def wkb_bounds(raw: pd.Series) -> pd.DataFrame:
    """Bounds of each geometry; plain little-endian points, the most common form, are read as columns, others one by one."""
    plain = np.array([x is not None and len(x) == PLAIN_POINT.itemsize and bytes(x[:5]) == b"\x01\x01\x00\x00\x00" for x in raw], bool)
    out = pd.DataFrame(index=range(len(raw)), columns=["ok", "type", *AXES], dtype=object)
    points = np.frombuffer(b"".join(bytes(x) for x, p in zip(raw, plain, strict=True) if p), PLAIN_POINT)
    out.loc[plain, "ok"], out.loc[plain, "type"] = True, 1
    for axis in "xy":  # NaN coordinates count for nothing
        out.loc[plain, f"{axis}min"] = out.loc[plain, f"{axis}max"] = points[axis]
    rest = np.flatnonzero(~plain)
    if len(rest):
        out.loc[rest] = pd.DataFrame([one_bounds(raw.iloc[i]) for i in rest], columns=out.columns, index=rest)
    return out.astype({a: "float64" for a in AXES} | {"ok": "bool", "type": "Int32"})


def bounding_box(df: DataFrame, column: str) -> DataFrame:
    """(xmin ... mmax, geometry_types): one row; all null if any geometry is invalid. NaN coordinates and null geometries count for nothing."""
    parts = df.select(wkb_bounds(column).alias("b")).select("b.*")
    low = [F.min(f"{a}min").alias(f"{a}min") for a in "xyzm"]
    high = [F.max(f"{a}max").alias(f"{a}max") for a in "xyzm"]
    found = parts.agg(F.bool_and("ok").alias("ok"), F.sort_array(F.collect_set("type")).alias("geometry_types"), *low, *high)
    return found.select(*[F.when(F.col("ok"), F.col(c)).alias(c) for c in found.columns if c != "ok"])


def geo_metadata(columns: dict[str, tuple[list[int], list[float] | None]], primary: str) -> str:
    """GeoParquet file metadata: columns with their geometry types and bounding box."""
    own = {c: {"encoding": "WKB", "geometry_types": [type_name(t) for t in types]} | ({"bbox": box} if box else {}) for c, (types, box) in columns.items()}
    return json.dumps({"version": "1.1.0", "primary_column": primary, "columns": own})
