"""Saved step lists folded into one lazy DataFrame.

There is no plan object: every step is a DataFrame function, Catalyst sees the
whole chain, and nothing runs before the caller's action.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from eventlens.functions.predicates import filter_rows
from eventlens.operators import steps
from eventlens.operators.joins import equi_join, window_join

Sources = Mapping[str, DataFrame]


def _join(df: DataFrame, config: Mapping, sources: Sources) -> DataFrame:
    name = config.get("table")
    right = sources.get(name) if name else None
    if right is None:
        return df
    keys = [k if isinstance(k, str) else (k["left"], k["right"]) for k in config.get("keys", [])]
    window = config.get("time_window")
    if window:
        return window_join(
            df, right, [k if isinstance(k, str) else k[0] for k in keys], window["direction"], window["value"],
            window.get("unit", "hours"), config.get("how", "left"), right_name=name,
            post_filter=window.get("post_filter", False),
        )
    return equi_join(df, right, keys, config.get("how", "left"), name)


STEPS: dict[str, Callable[[DataFrame, Mapping, Sources], DataFrame]] = {
    "filter": lambda df, c, s: filter_rows(df, c),
    "select": lambda df, c, s: steps.select_columns(df, c["columns"]),
    "rename": lambda df, c, s: steps.rename_columns(df, c["mapping"]),
    "drop": lambda df, c, s: steps.drop_columns(df, c["columns"]),
    "transform": lambda df, c, s: steps.transform(df, c["columns"]),
    "join": _join,
    "aggregate": lambda df, c, s: steps.aggregate(df, c.get("group_by", []), c.get("aggregations", [])),
    "sort": lambda df, c, s: steps.sort_rows(df, c["keys"]),
    "limit": lambda df, c, s: steps.limit_rows(df, c["count"], c.get("offset", 0)),
    "union": lambda df, c, s: steps.union_all([df, *[s[t] for t in c["tables"] if t in s]]),
    "distinct": lambda df, c, s: steps.distinct_rows(df, c.get("columns", [])),
}


def run_steps(plan: Sequence[Mapping], sources: Sources) -> DataFrame:
    """``[{"type": ..., "config": {...}}, ...]``; the first step names the source."""
    if not plan or plan[0]["type"] != "source":
        raise ValueError("the first step must be a source")
    df = sources[plan[0]["config"]["table"]]
    for step in plan[1:]:
        df = STEPS[step["type"]](df, step.get("config", {}), sources)
    return df
