"""Exponential means and rolling medians of per-user bucket series, as runs of equal values.

A series has a value for every position between its first and last one; positions that are not listed hold zero. Rows
are listed positions only, and the result has a row for each of them and for each position where the rolling median
changes in between, so it grows with the events and not with the time range.

A series is cut into chunks of positions. Each chunk gets the rows before it that still lie in its first window, so
a user is spread over tasks however many rows there are, and no row carries its window: a task walks a chunk once with the sorted
deviations of the window, to which rows are added and from which they are removed.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from eventlens.operators.joins import null_safe_join

#: A chunk is this many times as long as the context that it needs.
CHUNK_FACTOR = 32

Run = tuple[int, float | None, int | None, float, float | None, int]


def ewma_reach(alpha: float) -> int:
    """Rows after which a value's weight is below double precision."""
    return math.ceil(36 / -math.log(1 - alpha))


def runs(rows: Sequence[tuple[int, float, int]], center: float, lo: int, start: int, stop: int, window: int, least: int, alpha: float) -> Iterator[Run]:
    """Runs (position, x, rows, mean, median, length) from ``start`` to ``stop`` (exclusive) of one series that begins at ``lo``.

    ``rows`` are (position, x, rows) in order, with those before ``start`` that the first window holds. The median is that of
    |x - center| over the last ``window`` positions, None while there are fewer than ``least``. A run without a row of its own has x None.
    """
    zero, keep = abs(center), 1 - alpha
    held: list[float] = []
    add = drop = 0
    mean, last = 0.0, lo
    out: Run | None = None
    p = start
    while add < len(rows) and rows[add][0] < start:
        at, x, _ = rows[add]
        mean = x if at == lo else mean * keep ** (at - last) + alpha * x
        last = at
        insort(held, abs(x - center))
        add += 1
    while p < stop:
        x = n = None
        if add < len(rows) and rows[add][0] == p:
            _, x, n = rows[add]
            mean = x if p == lo else mean * keep ** (p - last) + alpha * x
            last = p
            insort(held, abs(x - center))
            add += 1
        while drop < add and rows[drop][0] <= p - window:
            del held[bisect_left(held, abs(rows[drop][1] - center))]
            drop += 1
        size = min(window, p - lo + 1)
        blanks = size - len(held)
        below = bisect_left(held, zero)
        low, high = (size - 1) // 2, size // 2
        ends = below + blanks
        if below <= low and high < ends:
            median = zero
        else:
            a, b = (held[r] if r < below else zero if r < ends else held[r - blanks] for r in (low, high))
            median = (a + b) / 2
        after = stop
        if add < len(rows):
            after = min(after, rows[add][0])
        if drop < add:
            after = min(after, rows[drop][0] + window)
        if size < window and not (below <= low and high < ends):
            after = min(after, p + 1)
        if size < least:
            median, after = None, min(after, max(p + 1, lo + least - 1))
        if x is None and out is not None and out[4] == median:
            out = (*out[:5], out[5] + after - p)
        else:
            if out is not None:
                yield out
            out = (p, x, n, mean * keep ** (p - last), median, after - p)
        p = after
    if out is not None:
        yield out


_FIELDS = ["user_id", "p", "x", "rows", "mu", "mad_raw", "run"]


def _walk(size: int, window: int, least: int, alpha: float, kind: pa.DataType):
    types = [kind, pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def packed(users: list, found: list[Run]) -> pa.RecordBatch:
        columns = [users, *zip(*found, strict=True)] if found else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_FIELDS)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        users, found, held, now = [], [], [], None

        def ended() -> None:
            user, chunk, center, lo, stop = now
            for run in runs(held, center, lo, max(lo, chunk * size), stop, window, least, alpha):
                users.append(user)
                found.append(run)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("user_id", "chunk", "center", "lo", "stop", "b", "x", "rows")]
            for *key, b, x, n in zip(*columns, strict=True):
                if key != now:
                    if held:
                        ended()
                        if len(found) > 20_000:
                            yield packed(users, found)
                            users.clear()
                            found.clear()
                    held, now = [], key
                held.append((b, x, n))
        if held:
            ended()
        yield packed(users, found)

    return work


def rolling_series(sparse: DataFrame, window: int, least: int, alpha: float) -> DataFrame:
    """Rows (user_id, p, x, rows, mu, mad_raw, run) of series given as (user_id, b, x, rows), one row for each position ``b`` with a value.

    ``mad_raw`` is the rolling median of |x - the user's median|; both count the zeros of the positions that are not listed.
    """
    spans = sparse.groupBy("user_id").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count(F.lit(1)).alias("k"))
    zeros = spans.select("user_id", F.lit(0.0).alias("x"), (F.col("hi") - F.col("lo") + 1 - F.col("k")).alias("w"))
    values = sparse.select("user_id", "x", F.lit(1).cast("bigint").alias("w")).unionByName(zeros).where("w > 0")
    # One buffer entry for each distinct value of a user, combined map-side.
    centers = values.groupBy("user_id").agg(F.percentile("x", F.lit(0.5), F.col("w")).alias("center"))
    user = null_safe_join(spans.drop("k"), centers, ["user_id"])

    context = max(window - 1, ewma_reach(alpha))
    size = CHUNK_FACTOR * context
    own = F.floor(F.col("b") / F.lit(size))
    reach = F.floor((F.col("b") + F.lit(context)) / F.lit(size))
    dealt = sparse.withColumn("chunk", F.explode(F.sequence(own, reach)))
    # A chunk without rows belongs to the one before it; few rows for each user.
    chunks = dealt.groupBy("user_id", "chunk").agg(F.lit(1).alias("one"))
    following = F.lead("chunk").over(Window.partitionBy("user_id").orderBy("chunk"))
    chunks = null_safe_join(chunks.select("user_id", "chunk", following.alias("following")), user, ["user_id"])
    stop = F.least(F.col("hi") + 1, F.coalesce(F.col("following") * size, F.col("hi") + 1))
    chunks = chunks.select("user_id", "chunk", "center", "lo", stop.alias("stop")).where(F.col("stop") > F.col("chunk") * size)
    rows = null_safe_join(dealt, chunks, ["user_id", "chunk"])
    rows = rows.repartition("user_id", "chunk").sortWithinPartitions("user_id", "chunk", "b")
    user_type = sparse.schema["user_id"].dataType
    kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[user_type.simpleString()]
    return rows.select("user_id", "chunk", "center", "lo", "stop", "b", "x", "rows").mapInArrow(
        _walk(size, window, least, alpha, kind), f"user_id {user_type.simpleString()}, p bigint, x double, rows bigint, mu double, mad_raw double, run bigint")


def row_runs(values: Sequence[float], window: int, least: int, alpha: float) -> tuple[list[float], list[float | None]]:
    """Means and medians of ``runs`` for a whole series without gaps, whose center is its own median."""
    order, k = sorted(values), len(values)
    center = 0.5 * order[(k - 1) // 2] + 0.5 * order[k // 2]
    keep, mean, held = 1 - alpha, 0.0, []
    means, medians = [], []
    for i, x in enumerate(values):
        mean = mean * keep + alpha * x if i else x
        insort(held, abs(x - center))
        if i >= window:
            del held[bisect_left(held, abs(values[i - window] - center))]
        size = len(held)
        means.append(mean)
        medians.append((held[(size - 1) // 2] + held[size // 2]) / 2 if size >= least else None)
    return means, medians


def row_series(sparse: DataFrame, order: str, window: int, least: int, alpha: float) -> DataFrame:
    """``sparse`` (user_id, x, ...) with ``mu`` and ``mad_raw``, the positions of a series being its rows by ``order``.

    As ``rolling_series`` over row numbers, in one shuffle: a task holds the rows of a user at a time.
    """

    def walked(rows: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        x, means, medians = rows.column("x").to_pylist(), [], []
        for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            found = row_runs(x[a:b], window, least, alpha)
            means += found[0]
            medians += found[1]
        out = rows.append_column("mu", pa.array(means, pa.float64())).append_column("mad_raw", pa.array(medians, pa.float64()))
        yield from out.combine_chunks().to_batches()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            users = rows.column("user_id").to_pylist()
            starts = [0, *[i for i in range(1, len(users)) if users[i] != users[i - 1]]]
            if starts[-1]:
                yield from walked(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1]).to_batches()
        if held:
            yield from walked(pa.Table.from_batches(held), [0])

    rows = sparse.repartition("user_id").sortWithinPartitions("user_id", order)
    return rows.mapInArrow(work, StructType([*sparse.schema.fields, StructField("mu", DoubleType()), StructField("mad_raw", DoubleType())]))


def every_position(series: DataFrame, alpha: float) -> DataFrame:
    """The runs spelt out: one row for each position, zero where nothing is listed, the mean decaying."""
    offset = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("run") - 1))
    out = series.withColumn("__i", offset)
    return out.select(
        "user_id", (F.col("p") + F.col("__i")).alias("p"), F.when(F.col("__i") == 0, F.coalesce("x", F.lit(0.0))).otherwise(0.0).alias("x"),
        (F.col("mu") * F.pow(F.lit(1 - alpha), F.col("__i"))).alias("mu"), "mad_raw")
