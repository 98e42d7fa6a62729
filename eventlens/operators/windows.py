"""Ordered per-key computations that hold for keys of any size.

Keys are counted first, reading the key column only. For ordinary keys a plain
window is best: all of them share one shuffle. A key with more than
``HEAVY_ROWS`` rows would keep one task busy with a huge sort, so heavy keys are
cut into time or row-number chunks instead, and the few rows that matter at a
border are handed over to the next chunk. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.joins import null_safe_join
from eventlens.session import materialize

HEAVY_ROWS = 5_000_000
CHUNK_SECONDS = 3600


class Heavy:
    """The heavy values of one key column; empty for most inputs."""

    def __init__(self, df: DataFrame, key: str, limit: int | None = None):
        self.key = key
        sizes = df.groupBy(F.col(key).alias("__heavy")).agg(F.count(F.lit(1)).alias("n"))
        found = sizes.where(F.col("n") > (HEAVY_ROWS if limit is None else limit)).select("__heavy")
        # At most rows / HEAVY_ROWS values.
        self.values = materialize(found, "heavy") if found.limit(1).count() else None

    def split(self, df: DataFrame, plain: Callable[[DataFrame], DataFrame], chunked: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if self.values is None:
            return plain(df)
        same = df[self.key].eqNullSafe(self.values["__heavy"])
        light = df.join(self.values, same, "left_anti")
        return plain(light).unionByName(chunked(df.join(self.values, same, "left_semi")))


# Chunk of rows without a time; they come before all others, as in an ordered window.
NO_TIME = -(1 << 62)


def time_chunk(ts: Column, seconds: int = CHUNK_SECONDS) -> Column:
    return F.coalesce(F.floor(F.unix_seconds(ts) / F.lit(seconds)), F.lit(NO_TIME))


def with_previous(
    df: DataFrame, key: str, columns: dict[str, str], heavy: Heavy | None = None, order: Sequence[str] = ("ts", "event_id"),
) -> DataFrame:
    """``columns`` maps a new name to the column whose previous value it takes."""
    heavy = heavy or Heavy(df, key)

    def plain(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*order)
        return rows.withColumns({name: F.lag(src).over(w) for name, src in columns.items()})

    return heavy.split(df, plain, lambda rows: _previous_in_chunks(rows, key, columns, order))


def _previous_in_chunks(df: DataFrame, key: str, columns: dict[str, str], order: Sequence[str]) -> DataFrame:
    chunked = df.withColumn("__chunk", time_chunk(F.col(order[0])))
    taken = [F.col(src).alias(f"__v{i}") for i, src in enumerate(columns.values())]
    # Last row of every chunk, passed on to the key's next chunk that has rows.
    last = chunked.groupBy(key, "__chunk").agg(F.max_by(F.struct(*taken), F.struct(*order)).alias("__last"))
    by_key = Window.partitionBy(key).orderBy("__chunk")
    carried = last.select(
        F.col(key).alias("__key"), F.col("__chunk").alias("__at"), F.lag("__last").over(by_key).alias("__carry")
    )
    inside = Window.partitionBy(key, "__chunk").orderBy(*order)
    rows = chunked.withColumn("__lag", F.lag(F.struct(*taken)).over(inside))
    rows = rows.withColumn("__head", F.row_number().over(inside) == 1)
    joined = rows.join(carried, rows[key].eqNullSafe(carried["__key"]) & (rows["__chunk"] == carried["__at"]), "left")
    previous = F.when(F.col("__head"), F.col("__carry")).otherwise(F.col("__lag"))
    for i, name in enumerate(columns):
        joined = joined.withColumn(name, previous[f"__v{i}"])
    return joined.drop("__chunk", "__lag", "__head", "__carry", "__key", "__at")


def with_row_number(
    df: DataFrame, key: str, name: str = "rn", heavy: Heavy | None = None, order: Sequence[str] = ("ts", "event_id"),
) -> DataFrame:
    """1-based position within the key."""
    heavy = heavy or Heavy(df, key)
    w = Window.partitionBy(key).orderBy(*order)
    return heavy.split(
        df, lambda rows: rows.withColumn(name, F.row_number().over(w).cast("bigint")),
        lambda rows: _row_number_in_chunks(rows, key, name, order),
    )


def _row_number_in_chunks(df: DataFrame, key: str, name: str, order: Sequence[str]) -> DataFrame:
    """Position in the chunk plus the rows of earlier chunks."""
    chunked = df.withColumn("__chunk", time_chunk(F.col(order[0])))
    sizes = chunked.groupBy(key, "__chunk").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(key).alias("__key"), F.col("__chunk").alias("__at"),
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
    )
    inside = Window.partitionBy(key, "__chunk").orderBy(*order)
    numbered = chunked.withColumn("__pos", F.row_number().over(inside))
    on = numbered[key].eqNullSafe(offsets["__key"]) & (numbered["__chunk"] == offsets["__at"])
    return (
        numbered.join(offsets, on, "left").withColumn(name, F.col("__pos") + F.col("__offset"))
        .drop("__chunk", "__pos", "__offset", "__key", "__at")
    )


def with_rolling_count(
    df: DataFrame, key: str, seconds: int, name: str, heavy: Heavy | None = None, order: Sequence[str] = ("ts", "event_id"),
) -> DataFrame:
    """Rows of the key in ``(t - seconds, t]``; rows with equal time count together."""
    heavy = heavy or Heavy(df, key)
    span = seconds * 1_000_000

    def counted(rows: DataFrame, *keys: str) -> DataFrame:
        # By the time itself, so that rows that come ordered by it need no other sort.
        by = ", ".join(f"`{k}`" for k in keys)
        return rows.withColumn(name, F.expr(
            f"count(1) OVER (PARTITION BY {by} ORDER BY `{order[0]}` RANGE BETWEEN INTERVAL '{(span - 1) / 1e6:.6f}' SECOND PRECEDING AND CURRENT ROW)"))

    def chunked(rows: DataFrame) -> DataFrame:
        # Rows near the end of a chunk are copied into the next one as context.
        size = max(CHUNK_SECONDS, seconds)
        own = time_chunk(F.col(order[0]), size)
        reach = F.coalesce(F.floor((F.unix_micros(order[0]) + F.lit(span - 1)) / F.lit(size * 1_000_000)), own)
        spread = rows.withColumn("__own", own).withColumn("__chunk", F.explode(F.sequence(own, reach)))
        return counted(spread, key, "__chunk").where(F.col("__own") == F.col("__chunk")).drop("__own", "__chunk")

    return heavy.split(df, lambda rows: counted(rows, key), chunked)


def with_recent_repeat(
    df: DataFrame, key: str, position: str, values: dict[str, Column], window: int, heavy: Heavy | None = None, block: int = 4096,
) -> DataFrame:
    """For each ``name: value``: 1 unless the value occurs in the key's last ``window`` rows.

    ``position`` numbers the key's rows; the value's previous position tells.
    """
    heavy = heavy or Heavy(df, key)

    def flagged(rows: DataFrame, *keys: str) -> DataFrame:
        for name, value in values.items():
            same = Window.partitionBy(*keys, value).orderBy(position)
            gap = F.col(position) - F.lag(position).over(same)
            rows = rows.withColumn(name, F.when(gap <= window, 0).otherwise(1))
        return rows

    def chunked(rows: DataFrame) -> DataFrame:
        # Blocks of row numbers, each with the last rows of the one before.
        own = F.coalesce(F.floor(F.col(position) / F.lit(block)), F.lit(-1))
        reach = F.coalesce(F.floor((F.col(position) + F.lit(window)) / F.lit(block)), F.lit(-1))
        spread = rows.withColumn("__own", own).withColumn("__block", F.explode(F.sequence(own, reach)))
        return flagged(spread, key, "__block").where(F.col("__own") == F.col("__block")).drop("__own", "__block")

    return heavy.split(df, lambda rows: flagged(rows, key), chunked)


def with_first_seen(
    df: DataFrame, key: str, values: dict[str, Column], heavy: Heavy | None = None, order: Sequence[str] = ("ts", "event_id"),
) -> DataFrame:
    """For each ``name: value``: 1 on the key's first row with that value, else 0."""
    heavy = heavy or Heavy(df, key)

    def plain(rows: DataFrame) -> DataFrame:
        for name, value in values.items():
            w = Window.partitionBy(key, value).orderBy(*order)
            rows = rows.withColumn(name, (F.row_number().over(w) == 1).cast("int"))
        return rows

    def chunked(rows: DataFrame) -> DataFrame:
        # The first row per (key, value) is a map-side combined minimum; it joins
        # back on the row's own identity, which no heavy key can skew.
        for name, value in values.items():
            first = (
                rows.select(key, value.alias("__val"), *order)
                .groupBy(key, "__val").agg(F.min(F.struct(*order)).alias("__first"))
                .select(*[F.col(f"__first.{c}").alias(c) for c in order], F.lit(1).alias(name))
            )
            rows = null_safe_join(rows, first, order, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
        return rows

    return heavy.split(df, plain, chunked)


def range_numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with a number from 0 in the given order, without a task that holds all rows.

    Rows are dealt by ranges and numbered within each range, from the number of rows in the ranges before it.
    """
    ranges = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")
    # One row for each range.
    counts, before, offsets = sorted(map(tuple, ranges.groupBy("__part").count().collect())), 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    offset = df.sparkSession.createDataFrame(offsets, "__part int, __before long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranges.join(offset, "__part").withColumn(name, F.col("__before") + place - 1).drop("__part", "__before")
