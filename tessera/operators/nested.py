"""Nested values: flattening lists, maps and structs to rows with their levels, and assembling them again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def flatten_list(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, value, def_level): null lists have level 0, empty ones 1, null elements 2, others 3; pos is null without an element."""
    rows = df.select(key, F.col(column).alias("_list"), F.posexplode_outer(column).alias("pos", "value"))
    level = F.when(F.col("_list").isNull(), 0).when(F.col("pos").isNull(), 1).when(F.col("value").isNull(), 2).otherwise(3)
    return rows.select(key, "pos", "value", level.alias("def_level"))


def assemble_list(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): the values of a key in order; null elements stay."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(pairs, lambda p: p["v"]).alias("values"))


def flatten_map(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, entry_key, entry_value): the entries of a map; a null or empty map gives one row of nulls."""
    return df.select(key, F.explode_outer(F.map_entries(column)).alias("_e")).select(key, F.col("_e.key").alias("entry_key"), F.col("_e.value").alias("entry_value"))


def flatten_map_levels(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, entry_key, entry_value, rep_level, def_level): a map's entries with their levels; null and empty maps give one row."""
    shown = F.posexplode_outer(F.map_entries(column))
    rows = df.select(key, F.col(column).alias("_m"), shown.alias("pos", "_e"))
    level = F.when(F.col("_m").isNull(), 0).when(F.col("pos").isNull(), 1).when(F.col("_e.value").isNull(), 2).otherwise(3)
    return rows.select(key, "pos", F.col("_e.key").alias("entry_key"), F.col("_e.value").alias("entry_value"), F.when(F.col("pos") > 0, 1).otherwise(0).alias("rep_level"), level.alias("def_level"))


def leaf_entries(x: Column, kind: DataType, steps: list[str], nullable: bool, first: Column, d: int = 0, r: int = 0) -> Column:
    """array<struct<rep, def, value>> of one leaf of a nested value; `first` is the repetition level of what comes first."""
    one = lambda rep, level, v: F.array(F.struct(rep.alias("rep"), F.lit(level).alias("def"), v.alias("value")))
    leaf = leaf_type(kind, steps)
    none = F.lit(None).cast(leaf)
    d += nullable
    if isinstance(kind, StructType):
        f = kind[steps[0]]
        out = leaf_entries(x[f.name], f.dataType, steps[1:], f.nullable, first, d, r)
    elif isinstance(kind, (ArrayType, MapType)):
        items = x if isinstance(kind, ArrayType) else F.map_entries(x)
        part = {"element": ("elementType", "containsNull"), "key": ("keyType", None), "value": ("valueType", "valueContainsNull")}[steps[1]]
        own, null = getattr(kind, part[0]), getattr(kind, part[1]) if part[1] else False
        pick = lambda e: e if isinstance(kind, ArrayType) else e[steps[1]]
        each = F.transform(items, lambda e, i: leaf_entries(pick(e), own, steps[2:], null, F.when(i == 0, first).otherwise(F.lit(r + 1)), d + 1, r + 1))
        out = F.when(F.size(items) == 0, one(first, d, none)).otherwise(F.flatten(each))
    else:
        out = one(first, d, x.cast(leaf))
    return F.when(x.isNull(), one(first, d - 1, none)).otherwise(out) if nullable else out


def leaf_type(kind: DataType, steps: list[str]) -> DataType:
    if isinstance(kind, StructType):
        return leaf_type(kind[steps[0]].dataType, steps[1:])
    if isinstance(kind, ArrayType):
        return leaf_type(kind.elementType, steps[2:])
    if isinstance(kind, MapType):
        return leaf_type(kind.keyType if steps[1] == "key" else kind.valueType, steps[2:])
    return kind


def shred(df: DataFrame, key: str, column: str, leaf: str) -> DataFrame:
    """(key, pos, rep_level, def_level, value): one leaf of a nested column of any depth as Parquet holds it.

    `leaf` is the path below the column, such as `list.element.name` or `key_value.key`; an empty one for a plain column.
    """
    f = df.schema[column]
    entries = leaf_entries(F.col(f"`{column}`"), f.dataType, [s for s in leaf.split(".") if s], f.nullable, F.lit(0))
    return df.select(key, F.posexplode(entries).alias("pos", "_e")).select(key, "pos", F.col("_e.rep").alias("rep_level"), F.col("_e.def").alias("def_level"), F.col("_e.value").alias("value"))


def assembled(kind: DataType, nullable: bool, leaves: list[tuple[list, DataType]], d: int = 0, r: int = 0):
    """One nested value from the (rep, def, value) entries of its leaves, which are in the order of the type's leaves."""
    d += nullable
    if nullable and leaves[0][0][1] < d:
        return None
    if isinstance(kind, StructType):
        out, at = {}, 0
        for f in kind:
            n = count_leaves(f.dataType)
            out[f.name] = assembled(f.dataType, f.nullable, leaves[at : at + n], d, r)
            at += n
        return out
    if isinstance(kind, (ArrayType, MapType)):
        if leaves[0][0][1] <= d:
            return [] if isinstance(kind, ArrayType) else {}
        cut = [split(entries, r + 1) for entries in leaves]
        items = [[c[i] for c in cut] for i in range(len(cut[0]))]
        if isinstance(kind, ArrayType):
            return [assembled(kind.elementType, kind.containsNull, own, d + 1, r + 1) for own in items]
        n = count_leaves(kind.keyType)
        return {assembled(kind.keyType, False, own[:n], d + 1, r + 1): assembled(kind.valueType, kind.valueContainsNull, own[n:], d + 1, r + 1) for own in items}
    return leaves[0][0][2]


def split(entries: list, level: int) -> list[list]:
    """Entries of the items of one list: an item begins where the repetition level isn't above the list's."""
    out: list[list] = []
    for e in entries:
        if not out or e[0] <= level:
            out.append([])
        out[-1].append(e)
    return out


def count_leaves(kind: DataType) -> int:
    return len(leaf_levels(kind, "x"))


def assemble(shredded: dict[str, DataFrame], key: str, column: str, kind: DataType, nullable: bool = True) -> DataFrame:
    """(key, column): values of a nested type from the shredded form of each of its leaves, by path below the column in any order.

    Entries of one key come together; a value is as large as it was before it was shredded.
    """
    paths = [p[len("x") :].lstrip(".") for p, _, _ in leaf_levels(kind, "x")]
    if set(paths) != set(shredded):
        raise ValueError(f"leaves are {', '.join(paths)}")
    entry = F.struct("pos", "rep_level", "def_level", "value")
    parts = [shredded[p].groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias(f"_l{i}")) for i, p in enumerate(paths)]
    joined = reduce(lambda a, b: a.join(b, key), parts)

    @F.udf(returnType=kind, useArrow=True)
    def build(*leaves):
        return assembled(kind, nullable, [[(e["rep_level"], e["def_level"], e["value"]) for e in own] for own in leaves])

    return joined.select(key, build(*[f"_l{i}" for i in range(len(paths))]).alias(column))


def by_name(column: Column, have: StructType, want: StructType) -> Column:
    """A struct with the wanted fields, matched by name: missing ones are null, others are left out."""
    names = set(have.names)
    return F.when(column.isNotNull(), F.struct(*[(column[f.name] if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]))


def leaf_levels(kind: DataType, name: str = "", nullable: bool = True, levels: tuple[int, int] = (0, 0), depth: int = 0) -> list[tuple[str, int, int]]:
    """(path, max definition level, max repetition level) of each leaf."""
    if depth > 64:
        raise ValueError("nested too deeply")
    d, r = levels[0] + nullable, levels[1]
    if isinstance(kind, StructType):
        own = (d, r) if name else levels
        return [x for f in kind for x in leaf_levels(f.dataType, f"{name}.{f.name}".lstrip("."), f.nullable, own, depth + 1)]
    if isinstance(kind, ArrayType):
        return leaf_levels(kind.elementType, f"{name}.list.element", kind.containsNull, (d + 1, r + 1), depth + 1)
    if isinstance(kind, MapType):
        return leaf_levels(kind.keyType, f"{name}.key_value.key", False, (d + 1, r + 1), depth + 1) + leaf_levels(kind.valueType, f"{name}.key_value.value", kind.valueContainsNull, (d + 1, r + 1), depth + 1)
    return [(name, d, r)]


def bit_width(level: int) -> int:
    return level.bit_length()
