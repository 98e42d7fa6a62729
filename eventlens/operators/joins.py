"""Equi-joins with NULL-safe keys, time-window joins by bins, skew-safe lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.session import materialize

MICROS = {"seconds": 1_000_000, "minutes": 60_000_000, "hours": 3_600_000_000, "days": 86_400_000_000}

# A key with more rows than this is hot: its rows are spread over HOT_SALTS tasks.
HOT_ROWS = 5_000_000
HOT_SALTS = 256


def prefixed_right(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], name: str) -> DataFrame:
    """Give colliding right columns the prefix ``<name>_``; keys become ``__rk<i>``."""
    shared = [l for l, r in keys if l == r]
    columns = [F.col(r).alias(f"__rk{i}") for i, (_, r) in enumerate(keys)]
    for col in right.columns:
        if col in shared:
            continue
        columns.append(F.col(col).alias(f"{name}_{col}" if col in left.columns else col))
    return right.select(*columns)


def equi_join(
    left: DataFrame,
    right: DataFrame | None,
    keys: Sequence[str | tuple[str, str]],
    how: str = "left",
    right_name: str = "right",
) -> DataFrame:
    """inner / left / right / full on several keys; NULL keys match each other.

    A missing right side or no keys leaves the left side as it is. A full join
    is built as left join plus the right rows without a partner: adaptive
    execution can split a hot key of a left join, but not of a full join.
    """
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in keys]
    if right is None or not pairs:
        return left
    other = prefixed_right(left, right, pairs, right_name)
    on = reduce(lambda a, b: a & b, [left[l].eqNullSafe(other[f"__rk{i}"]) for i, (l, _) in enumerate(pairs)])
    helper = [f"__rk{i}" for i in range(len(pairs))]
    shared = [(l, f"__rk{i}") for i, (l, r) in enumerate(pairs) if l == r]
    if how in ("inner", "left"):
        return left.join(other, on, how).drop(*helper)
    if how == "right":
        joined = left.join(other, on, "right")
        return joined.withColumns({l: F.col(rk) for l, rk in shared}).drop(*helper)
    if how in ("outer", "full"):
        both = left.join(other, on, "left").drop(*helper)
        left_keys = left.select(*[F.col(l).alias(f"__lk{i}") for i, (l, _) in enumerate(pairs)]).distinct()
        unmatched = reduce(
            lambda a, b: a & b,
            [other[f"__rk{i}"].eqNullSafe(left_keys[f"__lk{i}"]) for i in range(len(pairs))],
        )
        alone = other.join(left_keys, unmatched, "left_anti")
        alone = alone.withColumns({l: F.col(rk) for l, rk in shared}).drop(*helper)
        return both.unionByName(alone, allowMissingColumns=True)
    raise ValueError(f"unknown join type {how!r}")


def window_bounds(direction: str, width: int) -> tuple[int, int]:
    """Offsets of the right event relative to the left one, in microseconds."""
    return {"after": (0, width), "before": (-width, 0), "around": (-width, width)}[direction]


def window_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    direction: str,
    value: float,
    unit: str = "hours",
    how: str = "inner",
    left_ts: str = "ts",
    right_ts: str = "ts",
    right_name: str = "right",
    post_filter: bool = False,
) -> DataFrame:
    """Equality on ``keys`` (may be empty) and a time window, both ends inclusive.

    The time line is cut into bins of the window's width and the bin joins the
    key, so a hot key is split over time and no pair outside two or three
    neighbouring bins is ever formed. ``post_filter`` keeps the variant in
    which a left row whose key matches only outside the window disappears.
    ``right`` and ``full`` also keep right rows without partner; their key is
    that of the right side. Without keys every kind is an inner join.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown join type {how!r}")
    width = int(value * MICROS[unit])
    low, high = window_bounds(direction, width)
    size = max(width, 1)
    pairs = [(k, k) for k in keys]
    other = prefixed_right(left, right, pairs, right_name)
    ts_name = f"{right_name}_{right_ts}" if right_ts in left.columns else right_ts
    left_us = F.unix_micros(left_ts)
    # The right side is repeated into each bin whose left rows may reach it.
    first = F.floor((F.unix_micros(ts_name) - F.lit(high)) / F.lit(size))
    last = F.floor((F.unix_micros(ts_name) - F.lit(low)) / F.lit(size))
    other = other.withColumn("__us", F.unix_micros(ts_name)).withColumn("__bin", F.explode(F.sequence(first, last)))
    probe = left.withColumn("__lus", left_us).withColumn("__lbin", F.floor(left_us / F.lit(size)))
    on = (probe["__lbin"] == other["__bin"]) & other["__us"].between(
        probe["__lus"] + F.lit(low), probe["__lus"] + F.lit(high)
    )
    for i, (l, _) in enumerate(pairs):
        on = on & probe[l].eqNullSafe(other[f"__rk{i}"])
    helper = ["__lus", "__lbin", "__us", "__bin", *[f"__rk{i}" for i in range(len(pairs))]]
    kind = "inner" if not pairs or how in ("inner", "right") else "left"
    out = probe.join(other, on, kind)
    lonely = None
    if pairs and how in ("right", "full"):
        # Now the left side is repeated, so that each right row is tested once.
        reach = [F.floor((F.unix_micros(left_ts) + F.lit(d)) / F.lit(size)) for d in (low, high)]
        near = left.select(
            F.unix_micros(left_ts).alias("__lus"), F.explode(F.sequence(*reach)).alias("__lbin"), *[F.col(k).alias(f"__lk{i}") for i, k in enumerate(keys)])
        single = prefixed_right(left, right, pairs, right_name).withColumn("__us", F.unix_micros(ts_name))
        meets = (F.floor(single["__us"] / F.lit(size)) == near["__lbin"]) & single["__us"].between(near["__lus"] + F.lit(low), near["__lus"] + F.lit(high))
        for i in range(len(pairs)):
            meets = meets & single[f"__rk{i}"].eqNullSafe(near[f"__lk{i}"])
        lonely = single.join(near, meets, "left_anti").withColumns({k: F.col(f"__rk{i}") for i, k in enumerate(keys)})
    if post_filter and kind == "left":
        # A left row stays without partner only when its key is absent on the right.
        known = right.select(*[F.col(k).alias(f"__pk{i}") for i, k in enumerate(keys)]).distinct()
        has_key = reduce(lambda a, b: a & b, [out[k].eqNullSafe(known[f"__pk{i}"]) for i, k in enumerate(keys)])
        partner = F.col("__us").isNotNull()
        out = out.where(partner).unionByName(out.where(~partner).join(known, has_key, "left_anti"))
    out = out.drop(*helper)
    return out if lonely is None else out.unionByName(lonely.drop(*helper), allowMissingColumns=True)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join on columns of one name in which NULL equals NULL; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"__safe_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__safe_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__safe_{k}" for k in keys])


def attach_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], spread: Column, rows: str) -> DataFrame:
    """Left-join per-key statistics back to their rows, hot keys salted.

    ``stats`` holds one row per key and names its row count in ``rows``. It is
    written first, so its true size decides whether the join broadcasts it, and
    its largest count whether salting is needed at all. Rows of hot keys are
    spread by ``spread``; only the statistics of hot keys are repeated. A NULL
    key is a key like any other.
    """
    keys = list(keys)
    stats = materialize(stats, "stats")
    if (stats.agg(F.max(rows)).first()[0] or 0) <= HOT_ROWS:
        return null_safe_join(df, stats, keys, "left")
    absent = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    unnamed, df, without = df.where(absent), df.where(~absent), stats.where(absent)
    stats = stats.where(~absent)
    # At most rows / HOT_ROWS keys.
    hot = stats.where(F.col(rows) > HOT_ROWS).select(*keys, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(HOT_SALTS))).otherwise(F.lit(0).cast("bigint"))
    salted = df.join(hot, keys, "left").withColumn("__salt", salt).drop("__hot")
    top = F.when(F.col(rows) > HOT_ROWS, HOT_SALTS - 1).otherwise(0).cast("bigint")
    repeated = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), top)))
    named = salted.join(repeated, [*keys, "__salt"], "left").drop("__salt")
    # Rows without a key have few statistics rows; adaptive execution splits them if they are many.
    return named.unionByName(null_safe_join(unnamed, without, keys, "left").select(named.columns))
