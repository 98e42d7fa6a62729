"""Projection, aggregation, ordering and set steps over DataFrames.

A column missing from the input is skipped, as the step language asks; the
check reads metadata only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.expressions import arithmetic, step_function
from eventlens.operators.quantiles import grouped_quantiles


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


# --- projection ---------------------------------------------------------------

def select_columns(df: DataFrame, columns: Sequence[str | Mapping[str, str]]) -> DataFrame:
    """Names, or ``{"field": ..., "alias": ...}``."""
    picked = []
    for item in columns:
        field, alias = (item, item) if isinstance(item, str) else (item["field"], item.get("alias") or item["field"])
        if field in df.columns:
            picked.append(F.col(field).alias(alias))
    return df.select(*picked) if picked else df


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*present(df, names))


def _operand(df: DataFrame, item) -> tuple[Column, str]:
    """A column name, a quoted text, or a number."""
    if isinstance(item, str) and item in df.columns:
        return F.col(item), dict(df.dtypes)[item]
    if isinstance(item, (int, float)):
        return F.lit(float(item)), "double"
    return F.lit(str(item).strip("'\"")), "string"


def transform(df: DataFrame, columns: Sequence[Mapping]) -> DataFrame:
    """Computed columns in order; later ones see earlier ones.

    Each is ``{"name", "fn", "args"}``, ``{"name", "op", "args": [l, r]}`` or
    ``{"name", "expr"}`` with a Spark SQL expression.
    """
    for spec in columns:
        if "expr" in spec:
            value = F.expr(spec["expr"])
        elif "op" in spec:
            (left, _), (right, _) = (_operand(df, a) for a in spec["args"])
            value = arithmetic(left, spec["op"], right)
        else:
            args = list(spec.get("args", []))
            extra = args[1:] if spec["fn"] == "round" else []
            operands = [_operand(df, a) for a in (args[:1] if spec["fn"] == "round" else args)]
            value = step_function(spec["fn"], [c for c, _ in operands], [t for _, t in operands], extra)
        df = df.withColumn(spec["name"], value)
    return df


# --- aggregation --------------------------------------------------------------

ROW_ORDER = ("ts", "event_id")


def aggregate_column(func: str, field: str, order: Sequence[str] = ROW_ORDER) -> Column:
    """One aggregate that combines map-side; quantiles are handled apart."""
    col = F.col(field)
    position = F.struct(*order)
    table = {
        "count": lambda: F.count(col),
        "sum": lambda: F.coalesce(F.sum(col), F.lit(0).cast("double")),
        "avg": lambda: F.avg(col),
        "mean": lambda: F.avg(col),
        "min": lambda: F.min(col),
        "max": lambda: F.max(col),
        "first": lambda: F.min_by(col, F.when(col.isNotNull(), position)),
        "last": lambda: F.max_by(col, F.when(col.isNotNull(), position)),
        "std": lambda: F.stddev_samp(col),
        "var": lambda: F.var_samp(col),
        "count_distinct": lambda: F.count_distinct(col),
        "nunique": lambda: F.count_distinct(col),
        "approx_count_distinct": lambda: F.approx_count_distinct(col),
    }
    return table[func]()


def aggregate(
    df: DataFrame,
    group_by: Sequence[str] = (),
    aggs: Sequence[Mapping[str, str]] = (),
    order: Sequence[str] = ROW_ORDER,
) -> DataFrame:
    """Grouped or global aggregation.

    Rows with a NULL group key are dropped. Each entry of ``aggs`` is
    ``{"func", "field", "alias"}``; ``*`` counts rows, and so does a global
    ``count`` of any field.
    """
    keys = present(df, group_by)
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    if not aggs:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")) if keys else df
    order = present(df, order) or df.columns
    columns, medians = [], []
    for spec in aggs:
        func, field = spec["func"].lower(), spec.get("field", "*")
        alias = spec.get("alias") or f"{func}_{field}"
        if func == "count" and (field == "*" or not keys):
            columns.append(F.count(F.lit(1)).alias(alias))
        elif func == "median":
            medians.append((field, alias))
        elif field in df.columns:
            columns.append(aggregate_column(func, field, order).alias(alias))
    if not medians:
        return df.groupBy(*keys).agg(*columns)
    columns = columns or [F.count(F.lit(1)).alias("__n")]
    out = df.groupBy(*keys).agg(*columns)
    for field, alias in medians:
        part = grouped_quantiles(df, keys, field, {alias: 0.5})
        out = out.join(part, keys, "left") if keys else out.withColumn(alias, part.select(alias).scalar())
    return out.drop("__n")


# --- ordering, paging, sets ---------------------------------------------------

def ordering(df: DataFrame, keys: Sequence[Mapping], ties: Sequence[str] = ROW_ORDER) -> list[Column]:
    """NULLs last in both directions; ``ci`` orders text without case."""
    out = []
    for key in keys:
        if key["field"] not in df.columns:
            continue
        col = F.lower(F.col(key["field"])) if key.get("ci") else F.col(key["field"])
        out.append(col.desc_nulls_last() if key.get("direction") == "desc" else col.asc_nulls_last())
    return out + [F.col(t).asc_nulls_last() for t in present(df, ties)]


def sort_rows(df: DataFrame, keys: Sequence[Mapping], ties: Sequence[str] = ROW_ORDER) -> DataFrame:
    return df.orderBy(*ordering(df, keys, ties))


def limit_rows(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(count)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame, subset: Sequence[str] = (), order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """All columns, or the first row per ``subset`` in (ts, event_id) order.

    The subset form is a ``min_by`` aggregate, so each task sends one row per
    key it has seen, however hot the key is.
    """
    keys = present(df, subset)
    if not keys:
        return df.distinct()
    row = F.struct(*df.columns)
    # Ties, and tables without the order columns, go by all columns.
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate([*present(df, order), *df.columns])])).alias("__row"))
    return first.select("__row.*")


def page_with_total(df: DataFrame, keys: Sequence[Mapping], count: int, offset: int = 0) -> DataFrame:
    """One page plus the number of rows before paging."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return limit_rows(sort_rows(df, keys), count, offset).withColumn("total_rows", total.scalar())
