"""Column definitions for all logical types, trees of schemas, and schemas of Spark and Arrow as each other."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..operators.nested import leaf_levels


WIDER = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}


@dataclass(frozen=True)
class ColumnDef:
    """A column's name, Arrow type, whether it may be null, and what its type means beyond Arrow (`enum`, `bson`, `interval`, `geometry` ...)."""

    name: str
    type: pa.DataType
    nullable: bool = True
    meaning: str | None = None

    def arrow(self) -> pa.Field:
        return pa.field(self.name, self.type, self.nullable, {"meaning": self.meaning} if self.meaning else None)

    def plain(self) -> pa.Field:
        """The field in types that Spark has: half floats, times and fixed sizes as binary, unsigned integers in wider ones."""
        if self.type in WIDER:
            return pa.field(self.name, WIDER[self.type], self.nullable)
        odd = pa.types.is_float16(self.type) or pa.types.is_time(self.type) or pa.types.is_fixed_size_binary(self.type) or isinstance(self.type, pa.BaseExtensionType)
        return pa.field(self.name, pa.binary() if odd else self.type, self.nullable)

    def required(self) -> ColumnDef:
        return ColumnDef(self.name, self.type, False, self.meaning)


UNITS = {"seconds": "s", "millis": "ms", "micros": "us", "nanos": "ns"}

# Types without parameters.
PLAIN = {
    "boolean": pa.bool_(), "int8": pa.int8(), "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(), "uint8": pa.uint8(), "uint16": pa.uint16(), "uint32": pa.uint32(), "uint64": pa.uint64(),
    "float16": pa.float16(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "date": pa.date32(), "uuid": pa.binary(16), "json": pa.string(), "bson": pa.binary(), "enum": pa.string(), "interval": pa.binary(12),
}


def column(name: str, kind: str) -> ColumnDef:
    """A column of a type without parameters; uuid, json, bson, enum and interval keep their meaning in the field's metadata."""
    if kind not in PLAIN:
        raise ValueError(f"unknown type {kind!r}")
    return ColumnDef(name, PLAIN[kind], True, kind if kind in ("uuid", "json", "bson", "enum", "interval") else None)


def decimal(name: str, precision: int, scale: int) -> ColumnDef:
    if not (1 <= precision <= 38 and 0 <= scale <= precision):
        raise ValueError("precision is 1 to 38, scale 0 to the precision")
    return ColumnDef(name, pa.decimal128(precision, scale))


def timestamp(name: str, unit: str = "micros", utc: bool = True) -> ColumnDef:
    return ColumnDef(name, pa.timestamp(UNITS[unit], "UTC" if utc else None))


def time(name: str, unit: str = "micros") -> ColumnDef:
    return ColumnDef(name, (pa.time64 if unit in ("micros", "nanos") else pa.time32)(UNITS[unit]))


def fixed(name: str, size: int) -> ColumnDef:
    return ColumnDef(name, pa.binary(size))


def geometry(name: str, crs: str | None = None) -> ColumnDef:
    return ColumnDef(name, pa.binary(), True, f"geometry({crs})" if crs else "geometry")


def geography(name: str, crs: str | None = None, edges: str = "spherical") -> ColumnDef:
    from ..functions.geo import EDGES

    if edges not in EDGES:
        raise ValueError(f"edges are {', '.join(EDGES)}")
    return ColumnDef(name, pa.binary(), True, f"geography({', '.join(x for x in (crs, edges) if x)})")


def list_of(name: str, element: ColumnDef) -> ColumnDef:
    return ColumnDef(name, pa.list_(pa.field("element", element.type, element.nullable)))


def struct_of(name: str, *fields: ColumnDef) -> ColumnDef:
    return ColumnDef(name, pa.struct([f.arrow() for f in fields]))


def map_of(name: str, key: ColumnDef, value: ColumnDef) -> ColumnDef:
    return ColumnDef(name, pa.map_(key.type, pa.field("value", value.type, value.nullable)))


def to_spark(columns: list[ColumnDef]) -> StructType:
    return from_arrow_schema(pa.schema([c.plain() for c in columns]))


def to_arrow(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def from_arrow(schema: pa.Schema) -> list[ColumnDef]:
    """Definitions of an Arrow schema's columns."""
    return [ColumnDef(f.name, f.type, f.nullable, (f.metadata or {}).get(b"meaning", b"").decode() or None) for f in schema]


def leaf_count(kind: DataType) -> int:
    return len(leaf_levels(kind, "x"))


def tree(kind: DataType, name: str = "schema", nullable: bool = True, depth: int = 0) -> list[str]:
    """The lines of a schema as a tree: repetition, type and name of each node."""
    own = "required" if not nullable else "optional"
    pad = "  " * depth
    if isinstance(kind, StructType):
        return [f"{pad}{own} group {name} {{" if depth else f"message {name} {{", *[x for f in kind for x in tree(f.dataType, f.name, f.nullable, depth + 1)], pad + "}"]
    if isinstance(kind, ArrayType):
        return [f"{pad}{own} group {name} (LIST) {{", f"{pad}  repeated group list {{", *tree(kind.elementType, "element", kind.containsNull, depth + 2), f"{pad}  }}", pad + "}"]
    if isinstance(kind, MapType):
        inner = [*tree(kind.keyType, "key", False, depth + 2), *tree(kind.valueType, "value", kind.valueContainsNull, depth + 2)]
        return [f"{pad}{own} group {name} (MAP) {{", f"{pad}  repeated group key_value {{", *inner, f"{pad}  }}", pad + "}"]
    return [f"{pad}{own} {kind.simpleString()} {name}"]
