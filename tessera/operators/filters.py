"""Column filters: comparisons, inclusive ranges and raw predicates, joined by AND.

A filter has two forms: `exact()` is a condition on rows, which Spark pushes into the Parquet scan; `keeps()` is a condition
on a page's statistics (min, max, null_page) that holds whenever a row of the page may match. All-null pages match no typed
filter; missing statistics keep a page.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


@dataclass(frozen=True)
class ColumnFilter:
    """`op` is one of OPERATORS, `between` (inclusive) or `raw`.

    A raw filter's value is a function from a column to a condition on rows; `high`, if given, one from (min, max, null_page) to a
    condition on pages, without which every page is kept.
    """

    column: str
    op: str
    value: Any = None
    high: Any = None
    kind: str | None = None

    def literal(self, x: Any) -> Column:
        return F.lit(x).cast(self.kind) if self.kind else F.lit(x)

    def exact(self) -> Column:
        c = F.col(self.column)
        if self.op == "raw":
            return self.value(c)
        if self.op == "between":
            return c.between(self.literal(self.value), self.literal(self.high))
        return OPERATORS[self.op](c, self.literal(self.value))

    def keeps(self, low: str = "min", high: str = "max", null_page: str = "null_page") -> Column:
        lo, hi = F.col(low), F.col(high)
        if self.op == "raw":
            return F.coalesce(self.high(lo, hi, F.col(null_page)), F.lit(True)) if self.high else F.lit(True)
        v = self.literal(self.value)
        may = {
            "eq": lambda: (lo <= v) & (hi >= v),
            "ne": lambda: ~((lo == v) & (hi == v)),
            "lt": lambda: lo < v,
            "le": lambda: lo <= v,
            "gt": lambda: hi > v,
            "ge": lambda: hi >= v,
            "between": lambda: (lo <= self.literal(self.high)) & (hi >= v),
        }[self.op]()
        return F.coalesce(~F.col(null_page), F.lit(True)) & F.coalesce(may, F.lit(True))


def compare(kind: str | None) -> Callable[[str, str, Any], ColumnFilter]:
    def make(column: str, op: str, value: Any) -> ColumnFilter:
        if op not in OPERATORS:
            raise ValueError(f"unknown comparison {op!r}")
        return ColumnFilter(column, op, value, kind=kind)

    return make


def between(kind: str | None) -> Callable[[str, Any, Any], ColumnFilter]:
    return lambda column, low, high: ColumnFilter(column, "between", low, high, kind)


cmp_i32, cmp_i64, cmp_f32, cmp_f64, cmp_bytes = map(compare, ("int", "bigint", "float", "double", None))
between_i32, between_i64, between_f32, between_f64, between_bytes = map(between, ("int", "bigint", "float", "double", None))


def raw(column: str, condition: Callable[[Column], Column], pages: Callable[[Column, Column, Column], Column] | None = None) -> ColumnFilter:
    return ColumnFilter(column, "raw", condition, pages)


def where_all(df: DataFrame, *filters: ColumnFilter) -> DataFrame:
    """Rows that match every filter; an unknown column is an error, no filter keeps all rows."""
    for f in filters:
        if f.column.split(".")[0] not in df.columns:
            raise ValueError(f"no column {f.column!r}")
    return df.where(reduce(operator.and_, [f.exact() for f in filters])) if filters else df
