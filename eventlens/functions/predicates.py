"""Filter conditions compiled to Columns.

Two dialects exist on purpose: step filters (``step_condition``) and viewer
filters (``viewer_condition``), which differ in ``contains`` and in typing.
Every condition returns a non-null boolean, so conditions compose freely.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_list(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def settled(cond: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(cond, F.lit(False))


def is_nullish(col: Column) -> Column:
    """NULL, blank text, NaN or an infinity."""
    text = col.cast("string")
    return text.isNull() | (F.trim(text) == "") | text.isin("NaN", "Infinity", "-Infinity")


def contains_ci(col: Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search."""
    return settled(col.cast("string").rlike(f"(?i){pattern}"))


def matches_start(col: Column, pattern: str) -> Column:
    return settled(col.cast("string").rlike(f"^(?:{pattern})"))


def compared(col: Column, value: Any, test: Callable[[Column, Column], Column]) -> Column:
    """``test`` of a column of any type and a value, NULL where the two have no common type.

    Numbers, also as text, compare with numeric columns; a number compares with text that is one. Boolean words and times in text do
    alike with booleans and times; in a number column true is 1. Everything else compares as text.
    """
    if isinstance(value, Column) or value is None:
        return test(col, F.lit(None) if value is None else value)
    kind, text, never = F.typeof(col), col.cast("string"), F.lit(None).cast("boolean")
    number = kind.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    timed = kind.rlike("^(timestamp|date)")
    if isinstance(value, bool):
        return (
            F.when(kind.isin("boolean", "string"), test(text.try_cast("boolean"), F.lit(value)))
            .when(number, test(text.try_cast("double"), F.lit(float(value)))).otherwise(never)
        )
    if isinstance(value, (int, float)):
        exact = F.when(kind.isin("tinyint", "smallint", "int", "bigint"), test(text.try_cast("bigint"), F.lit(value))) if isinstance(value, int) and abs(value) < 1 << 63 else F
        return exact.when(number | (kind == "string"), test(text.try_cast("double"), F.lit(float(value)))).when(
            kind == "boolean", test(text.try_cast("boolean").cast("double"), F.lit(float(value)))).otherwise(never)
    if isinstance(value, (datetime, date)):
        return F.when(timed | (kind == "string"), test(text.try_cast("timestamp"), F.lit(value).cast("timestamp"))).otherwise(never)
    if not isinstance(value, str):
        return test(col, F.lit(value))
    return (
        F.when(number, test(text.try_cast("double"), F.lit(value).try_cast("double")))
        .when(timed, test(text.try_cast("timestamp"), F.lit(value).try_cast("timestamp")))
        .when(kind == "boolean", test(text.try_cast("boolean"), F.lit(value).try_cast("boolean")))
        .otherwise(test(text, F.lit(value)))
    )


def equals(col: Column, value: Any) -> Column:
    return compared(col, value, lambda a, b: a == b)


def in_list(col: Column, values: Any) -> Column:
    return settled(reduce(lambda a, b: a | b, [settled(equals(col, v)) for v in as_list(values)], F.lit(False)))


def not_in_list(col: Column, values: Any) -> Column:
    """NULL is in no list, so it stays."""
    return ~in_list(col, values)


def step_condition(col: Column, op: str, value: Any = None) -> Column:
    if op == "eq":
        return settled(equals(col, value))
    if op == "ne":
        return col.isNotNull() if value is None else ~settled(equals(col, value))
    if op == "gt":
        return settled(compared(col, value, lambda a, b: a > b))
    if op == "gte":
        return settled(compared(col, value, lambda a, b: a >= b))
    if op == "lt":
        return settled(compared(col, value, lambda a, b: a < b))
    if op == "lte":
        return settled(compared(col, value, lambda a, b: a <= b))
    if op == "in":
        return in_list(col, value)
    if op == "nin":
        return not_in_list(col, value)
    if op == "contains":
        return contains_ci(col, str(value))
    if op == "startswith":
        return settled(col.cast("string").startswith(str(value)))
    if op == "endswith":
        return settled(col.cast("string").endswith(str(value)))
    if op == "isnull":
        return col.isNull()
    if op == "notnull":
        return col.isNotNull()
    if op == "regex":
        return matches_start(col, str(value))
    if op == "between":
        low, high = value
        return settled(compared(col, low, lambda a, b: a >= b) & compared(col, high, lambda a, b: a <= b))
    raise ValueError(f"unknown filter operator {op!r}")


STEP_OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "contains", "startswith", "endswith", "isnull", "notnull", "regex", "between")


def viewer_condition(col: Column, op: str, value: Any = None) -> Column:
    """Viewer dialect: ``contains`` is a case-sensitive search, ``icontains`` is not."""
    if op == "contains":
        return settled(col.cast("string").rlike(str(value)))
    if op == "icontains":
        return contains_ci(col, str(value))
    return step_condition(col, op, value)


def field_column(df: DataFrame, name: str, meta: str = "meta") -> Column | None:
    """A column, or a key of the JSON column as ``meta.key``; None when absent."""
    if name in df.columns:
        return F.col(name)
    if name.startswith(f"{meta}.") and meta in df.columns:
        return F.get_json_object(meta, f"$.{name.split('.', 1)[1]}")
    return None


_TIME_OPS = ("eq", "ne", "gt", "gte", "lt", "lte")


def conditions_of(spec: Mapping | Iterable[Mapping]) -> list[Mapping]:
    """A single condition, a ``{"conditions": [...]}`` wrapper, or a list."""
    if isinstance(spec, Mapping):
        return list(spec["conditions"]) if "conditions" in spec else [spec]
    return list(spec)


def filter_rows(df: DataFrame, spec: Mapping | Iterable[Mapping]) -> DataFrame:
    """AND of all conditions; blank and unknown fields are ignored."""
    parts = [
        step_condition(F.col(c["field"]), c.get("op", "eq"), c.get("value"))
        for c in conditions_of(spec)
        if c.get("field") in df.columns
    ]
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df


def filter_view(df: DataFrame, conds: Iterable[Mapping]) -> DataFrame:
    """Viewer filters: ``meta.key`` fields, text compared with ``ts`` read as time; unknown fields and operators are ignored."""
    parts = []
    for c in conds:
        col = field_column(df, c.get("field", ""))
        if col is None:
            continue
        op, value = c.get("op", "eq"), c.get("value")
        if op not in (*STEP_OPS, "icontains"):
            continue
        if c["field"] == "ts" and op in _TIME_OPS:
            parts.append(step_condition(col, op, F.try_to_timestamp(F.lit(str(value)))))
        else:
            parts.append(viewer_condition(col, op, value))
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df
