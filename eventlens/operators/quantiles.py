"""Exact quantiles that never gather a hot group in one task.

``percentile`` keeps every distinct value of a group in one hash map. It is used
where the largest group has been counted and is small. Beyond that, a sketch
*cuts* each group into zones, narrow around the wanted rank; exact counts per
zone say which zone holds the rank; only that zone is ordered. The sketch
affects speed, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.joins import null_safe_join

# Sketch accuracy and half-width of the middle zone, in rank share. The width is
# four times the sketch's error bound; about 0.1 % of a group lies in the zone.
ACCURACY = 10_000
HALF_WIDTH = 4.0 / ACCURACY
# Largest group, in rows, that one aggregation buffer may hold.
SMALL_GROUP = 100_000
# Evenly spaced borders besides: with heavy ties the rank may fall anywhere, and
# then still only this share of a group's distinct values is ordered.
GRID = 16


def counted_values(df: DataFrame, keys: Sequence[str], value: Column, weight: Column | None = None) -> DataFrame:
    """(keys, value, weight): combined map-side, spread over keys and values."""
    number = value.cast("double")
    rows = df.select(*keys, number.alias("__x"), (F.lit(1) if weight is None else weight).cast("bigint").alias("__w"))
    rows = rows.where(F.col("__x").isNotNull() & ~F.isnan("__x") & (F.col("__w") > 0))
    return rows.groupBy(*keys, "__x").agg(F.sum("__w").alias("__w"))


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    quantiles: Mapping[str, float],
    weight: Column | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key, one column per ``alias: q``.

    ``weight`` repeats a value that many times. Groups without a value are
    absent, as there is nothing to rank. Without keys the result is one row.
    """
    keys = list(keys)
    column = F.col(value) if isinstance(value, str) else value
    if largest_group(df, keys) <= SMALL_GROUP:
        return _buffered_quantiles(df, keys, column, quantiles, weight)
    return zoned_quantiles(df, keys, column, quantiles, weight)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; reads the key columns only."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _buffered_quantiles(
    df: DataFrame, keys: list[str], column: Column, quantiles: Mapping[str, float], weight: Column | None,
) -> DataFrame:
    number = column.cast("double")
    times = F.lit(1) if weight is None else weight
    rows = df.select(*keys, number.alias("__x"), times.cast("bigint").alias("__w"))
    rows = rows.where(F.col("__x").isNotNull() & ~F.isnan("__x") & (F.col("__w") > 0))
    return rows.groupBy(*keys).agg(*[F.percentile("__x", F.lit(float(q)), F.col("__w")).alias(a) for a, q in quantiles.items()])


def zoned_quantiles(
    df: DataFrame, keys: list[str], column: Column, quantiles: Mapping[str, float], weight: Column | None = None,
) -> DataFrame:
    """The way for groups of any size."""
    values = counted_values(df, keys, column, weight)
    if not keys:
        values = values.withColumn("__all", F.lit(1))
    on = keys or ["__all"]
    near = {min(max(q + d, 0.0), 1.0) for q in quantiles.values() for d in (-HALF_WIDTH, HALF_WIDTH)}
    probes = sorted(near | {i / GRID for i in range(1, GRID)})

    # Zone borders from a sketch over distinct values: any border is correct.
    borders = values.groupBy(*on).agg(
        F.percentile_approx("__x", F.array(*[F.lit(p) for p in probes]), F.lit(ACCURACY)).alias("__borders")
    )
    zoned = null_safe_join(values, borders, on).withColumn(
        "__zone", F.size(F.filter("__borders", lambda b: b < F.col("__x")))
    ).drop("__borders")
    per_zone = zoned.groupBy(*on, "__zone").agg(F.sum("__w").alias("__zw"))
    # At most len(probes) + 1 rows per group.
    up_to = Window.partitionBy(*on).orderBy("__zone").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*on)
    per_zone = per_zone.withColumn("__before", F.coalesce(F.sum("__zw").over(up_to), F.lit(0))).withColumn(
        "__n", F.sum("__zw").over(whole)
    )
    targets = F.array(*[
        F.struct(F.lit(alias).alias("alias"), (F.lit(float(q)) * (F.col("__n") - 1)).alias("rank"))
        for alias, q in quantiles.items()
    ])
    # A zone matters when it holds the rank below or the rank above a target.
    wanted = per_zone.withColumn("__targets", targets).where(
        F.exists("__targets", lambda t: (F.floor(t["rank"]) < F.col("__before") + F.col("__zw"))
                 & (F.ceil(t["rank"]) >= F.col("__before")))
    )
    inside = null_safe_join(zoned, wanted.select(*on, "__zone", "__before", "__n"), [*on, "__zone"])
    running = Window.partitionBy(*on, "__zone").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("__end", F.col("__before") + F.sum("__w").over(running)).withColumn(
        "__start", F.col("__end") - F.col("__w")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__start")) & (rank < F.col("__end")), F.col("__x")))

    picked = []
    for alias, q in quantiles.items():
        rank = F.lit(float(q)) * (F.col("__n") - 1)
        picked += [at(F.floor(rank)).alias(f"__lo_{alias}"), at(F.ceil(rank)).alias(f"__hi_{alias}")]
    result = placed.groupBy(*on, "__n").agg(*picked)
    columns = []
    for alias, q in quantiles.items():
        rank = F.lit(float(q)) * (F.col("__n") - 1)
        low, high = F.col(f"__lo_{alias}"), F.col(f"__hi_{alias}")
        # The formula of ``percentile``, so that both ways agree to the last bit.
        between = (F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high
        columns.append(F.when((F.floor(rank) == F.ceil(rank)) | (low == high), low).otherwise(between).alias(alias))
    return result.select(*keys, *columns)


def quantile_scalar(df: DataFrame, value: str | Column, q: float, weight: Column | None = None) -> Column:
    """One global quantile as an uncorrelated scalar subquery."""
    return grouped_quantiles(df, [], value, {"q": q}, weight).scalar()


# Sketch size and half-width of the zone around the middle, in rank share; the width is some four times the sketch's error.
KLL_SIZE = 4096
KLL_WIDTH = 0.004


def column_medians(df: DataFrame, names: Sequence[str], zone_rows: int = 1_000_000) -> dict[str, float | None]:
    """Exact medians of many numeric columns, None for a column without a value; NULLs don't count, NaN isn't expected.

    Every round is one scan that aggregates all columns side by side: counts below and inside each column's zone and a mergeable
    sketch of the zone, from which the next, narrower one is cut. Once no zone holds more than ``zone_rows`` rows, only the cells inside
    a zone are laid out and ordered. A round narrows by about 1 / (2 x KLL_WIDTH); a sketch that misses the middle widens the next zone.
    """
    zone: dict[str, tuple[float, float]] = {}
    state: dict[str, tuple[int, int, int]] = {}
    width = KLL_WIDTH

    def inside(name: str) -> Column:
        c = F.col(name).cast("double")
        return F.when(c.between(*[F.lit(v) for v in zone[name]]), c) if name in zone else c

    todo, found = list(names), dict.fromkeys(names)
    held: dict[str, int] = {}
    while todo:
        row = df.agg(*[a for n in todo for a in (
            F.count(n).alias(f"n_{n}"), F.count(inside(n)).alias(f"in_{n}"),
            (F.count_if(F.col(n).cast("double") < F.lit(zone[n][0])) if n in zone else F.lit(0)).alias(f"below_{n}"))]).first()
        state = {n: (row[f"n_{n}"], row[f"in_{n}"], row[f"below_{n}"]) for n in todo}
        todo = [n for n in todo if state[n][0]]
        missed = [n for n in todo if not (state[n][2] <= (state[n][0] - 1) // 2 and state[n][0] // 2 < state[n][2] + state[n][1])]
        for n in missed:  # start over with a wider zone
            del zone[n]
            state[n] = (state[n][0], state[n][0], 0)
        width = width * 2 if missed else width
        for n in [n for n in todo if n in zone and zone[n][0] == zone[n][1]]:
            found[n] = zone[n][0]
            todo.remove(n)
        # A zone that keeps over half of its rows is made of equal values at its ends, which the cells count as one: no sketch narrows it.
        narrow = [n for n in todo if n not in zone or 2 * state[n][1] <= held[n]]
        if not narrow or max(state[n][1] for n in narrow) <= zone_rows:
            break
        held.update({n: state[n][1] for n in narrow})
        sketched = df.agg(*[F.kll_sketch_agg_double(inside(n), KLL_SIZE).alias(n) for n in narrow])
        probes = {n: [min(max(((state[n][0] - 1) / 2 - state[n][2]) / state[n][1] + d, 0.0), 1.0) for d in (-width, width)] for n in narrow}
        cut = sketched.select(*[F.array(*[F.kll_sketch_get_quantile_double(F.col(n), F.lit(p)) for p in probes[n]]).alias(n) for n in narrow]).first()
        zone.update({n: tuple(cut[n]) for n in narrow})
    if todo:
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), inside(n).alias("x")) for i, n in enumerate(todo)])).alias("c")).where("c.x IS NOT NULL")
        values = cells.groupBy("c.i", "c.x").agg(F.count(F.lit(1)).alias("w"))
        end = F.sum("w").over(Window.partitionBy("i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        ranks = [F.array(*[F.lit(r) for n in todo for r in ((state[n][0] - 1) // 2 - state[n][2], state[n][0] // 2 - state[n][2])])]
        low, high = (F.get(ranks[0], 2 * F.col("i") + F.lit(k)) for k in (0, 1))
        placed = values.withColumn("end", end)
        hit = [F.max(F.when((r >= F.col("end") - F.col("w")) & (r < F.col("end")), F.col("x"))) for r in (low, high)]
        for row in placed.groupBy("i").agg(((hit[0] + hit[1]) / 2).alias("m")).collect():
            found[todo[row["i"]]] = row["m"]
    return found
