"""Structured Streaming twins of the batch operators.

Stateless parts reuse the batch Column compilers. Every job writes through
``foreachBatch`` into one folder per batch id, which a retried batch overwrites,
so results are exactly-once.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructType

from eventlens.operators.features import EPSILON, MAD_SCALE
from eventlens.session import scratch_path


def open_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A file stream over ``<folder>/<name>``, a directory or a single file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    is_dir = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if is_dir:
        return reader.load(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).load(folder)


def run_to_table(
    stream: DataFrame, label: str, mode: str = "append", also: Callable[[DataFrame], DataFrame] | None = None, listener: _Progress | None = None,
) -> DataFrame:
    """Drain the stream; returns the written rows with ``batch_id``."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    shape = stream if also is None else also(stream)
    schema = shape.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if also is None else also(batch)
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    if listener is not None:
        listener.run_id = str(query.runId)
    query.awaitTermination()
    return spark.read.schema(StructType([*schema.fields]).add("batch_id", LongType())).parquet(out)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update-mode output: the newest row per key."""
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return best.select(*keys, "v.*")


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window start, user, rows), late rows beyond ``delay`` dropped."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "user_id").agg(
        F.count(F.lit(1)).alias("rows")
    )
    return counted.select(F.unix_seconds("window.start").alias("bucket"), "user_id", "rows")


def sliding_velocity(events: DataFrame, width: str = "5 minutes", step: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", width, step), "user_id").agg(
        F.count(F.lit(1)).alias("rows")
    )
    return counted.select(
        F.unix_seconds("window.end").alias("window_end"), "user_id", (F.col("rows") / F.lit(5.0)).alias("velocity")
    )


FIRST_OUT = "user_id string, value string, event_id bigint, ts timestamp"
FIRST_STATE = "first bigint, event_id bigint, last bigint"


def _firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each (user, value) of a batch of rows: its first event and its last time, in microseconds."""
    for rows in batches:
        rows = rows.sort_values(["us", "event_id"]).groupby(["user_id", "value"], dropna=False, sort=False)
        yield rows.agg(us=("us", "first"), event_id=("event_id", "first"), last=("us", "last")).reset_index()[["user_id", "value", "event_id", "us", "last"]]


def first_seen_updater(keep_days: float) -> Callable:
    """State per (user, value): first event and last time; it goes when the watermark is ``keep_days`` past the last time."""
    span = int(keep_days * 86_400_000_000)

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            first, event, last = state.get if state.exists else (None, None, None)
            for rows in frames:
                for us, event_id, until in zip(rows["us"], rows["event_id"], rows["last"], strict=True):
                    last = int(until) if last is None else max(last, int(until))
                    if first is None or (int(us), int(event_id)) < (first, event):
                        first, event = int(us), int(event_id)
                        out = [(key[0], key[1], event, pd.Timestamp(first, unit="us"))]
            state.update((first, event, last))
            state.setTimeoutTimestamp(max((last + span) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "value", "event_id", "ts"])

    return update


def first_seen(events: DataFrame, value: str, keep_days: float = 90, delay: str = "10 minutes") -> DataFrame:
    """First event per (user, value) by event time, in update mode.

    A pair that hasn't been seen for ``keep_days`` of event time is forgotten and would be new again, so the state holds the pairs of that
    span only. Rows of a pair are combined before the shuffle.
    """
    known = events.where("ts IS NOT NULL").select(
        "user_id", F.coalesce(F.col(value).cast("string"), F.lit("unknown")).alias("value"), "event_id", F.unix_micros("ts").alias("us"))
    firsts = known.mapInPandas(_firsts, "user_id string, value string, event_id bigint, us bigint, last bigint")
    timed = firsts.withColumn("at", F.timestamp_micros("last")).withWatermark("at", delay)
    return timed.groupBy("user_id", "value").applyInPandasWithState(
        first_seen_updater(keep_days), FIRST_OUT, FIRST_STATE, "update", GroupStateTimeout.EventTimeTimeout)


EWMA_OUT = "user_id string, bucket bigint, rows bigint, mu double, spread double, z double, closed boolean"
EWMA_STATE = "mu double, spread double, last bigint, open string"


class RunningSpread:
    """Exponential mean of a series of buckets, and of the distance from it; buckets in between hold zero."""

    def __init__(self, alpha: float, seconds: int, mu: float | None = None, spread: float = 0.0, last: int | None = None):
        self.alpha, self.seconds, self.mu, self.spread, self.last = alpha, seconds, mu, spread, last

    def copy(self) -> RunningSpread:
        return RunningSpread(self.alpha, self.seconds, self.mu, self.spread, self.last)

    def add(self, bucket: int, count: int) -> tuple[float, float, float]:
        """Mean, spread and z after a bucket that follows all others."""
        if self.mu is None:
            self.mu = float(count)
        else:
            idle, keep = (bucket - self.last) // self.seconds - 1, 1 - self.alpha
            self.spread = keep**idle * (self.spread + self.alpha * idle * self.mu)
            self.mu = keep * keep**idle * self.mu + self.alpha * count
            self.spread = keep * self.spread + self.alpha * abs(count - self.mu)
        self.last = bucket
        return self.mu, self.spread, (count - self.mu) / (MAD_SCALE * (self.spread + EPSILON))


def ewma_updater(alpha: float, seconds: int) -> Callable:
    """State per user: mean, spread and last bucket of closed buckets, and the counts of open ones.

    Every call emits the buckets that the watermark has passed, as closed, and the open ones with what they have so far. A timer at the end
    of the oldest open bucket closes it when the user sends nothing more.
    """

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mu, spread, last, text = state.get if state.exists else (None, 0.0, None, "{}")
        series = RunningSpread(alpha, seconds, mu, spread, last)
        counts = {int(b): n for b, n in json.loads(text).items()}
        for rows in frames:
            for bucket, n in zip(rows["bucket"], rows["rows"], strict=True):
                counts[int(bucket)] = counts.get(int(bucket), 0) + int(n)
        passed = state.getCurrentWatermarkMs()
        out = []
        for bucket in sorted(b for b in counts if (b + seconds) * 1000 <= passed):
            n = counts.pop(bucket)
            if series.last is None or bucket > series.last:
                out.append((key[0], bucket, n, *series.add(bucket, n), True))
        state.update((series.mu, series.spread, series.last, json.dumps(counts)))
        if counts:
            state.setTimeoutTimestamp(max((min(counts) + seconds) * 1000, passed + 1))
        ahead = series.copy()
        for bucket in sorted(counts):
            out.append((key[0], bucket, counts[bucket], *ahead.add(bucket, counts[bucket]), False))
        yield pd.DataFrame(out, columns=["user_id", "bucket", "rows", "mu", "spread", "z", "closed"])

    return update


def online_ewma(events: DataFrame, alpha: float = 0.2, seconds: int = 3600, delay: int = 600) -> DataFrame:
    """Buckets with rows, the user's running mean and spread, and z = (rows - mu) / (1.4826 (spread + 1e-6)), in update mode.

    A bucket comes out as soon as it has rows and again whenever it changes, at last with ``closed`` once a bucket that starts ``delay`` seconds
    after its end has rows; the newest row of a bucket counts. Rows are counted by (user, bucket) before the shuffle, rows of closed buckets
    are dropped.
    """
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.groupby(["user_id", "bucket"], dropna=False, sort=False).size().rename("rows").reset_index()

    bucket = F.unix_seconds("ts") - F.pmod(F.unix_seconds("ts"), F.lit(seconds))
    parts = events.where("ts IS NOT NULL").select("user_id", bucket.alias("bucket"))
    sums = parts.mapInPandas(counted, "user_id string, bucket bigint, rows bigint")
    timed = sums.withColumn("until", F.timestamp_seconds(F.col("bucket") + seconds)).withWatermark("until", f"{seconds + delay} seconds")
    return timed.groupBy("user_id").applyInPandasWithState(
        ewma_updater(alpha, seconds), EWMA_OUT, EWMA_STATE, "update", GroupStateTimeout.EventTimeTimeout)


class _Progress(StreamingQueryListener):
    """Rows read in each batch of the queries of one session, as reported after the batch."""

    def __init__(self):
        self.read: dict[int, int] = {}
        self.ended = threading.Event()
        self.run_id = None

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        if str(event.progress.runId) == self.run_id and event.progress.numInputRows:
            self.read[event.progress.batchId] = event.progress.numInputRows

    def onQueryTerminated(self, event):
        if str(event.runId) == self.run_id:
            self.ended.set()


def late_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows (batch_id, input_rows, late_rows) of the tumbling counts: late ones came after the watermark had passed their window.

    A batch goes by the watermark that the one before it started with.

    The batch's input comes from the query's progress. What it added to the counts is the difference of a window's rows to those of the batch before.
    """
    spark = events.sparkSession
    listener = _Progress()
    spark.streams.addListener(listener)
    try:
        counts = run_to_table(tumbling_counts(events, width, delay), "late", "update", listener=listener)
        if not listener.ended.wait(60):
            raise RuntimeError("the query's progress has not been reported")
    finally:
        spark.streams.removeListener(listener)
    earlier = F.lag("rows").over(Window.partitionBy("bucket", "user_id").orderBy("batch_id"))
    added = counts.withColumn("added", F.col("rows") - F.coalesce(earlier, F.lit(0))).groupBy("batch_id").agg(F.sum("added").alias("added"))
    read = spark.createDataFrame(sorted(listener.read.items()), "batch_id bigint, input_rows bigint")  # one row for each batch
    late = F.col("input_rows") - F.coalesce(F.col("added"), F.lit(0))
    return read.join(added, "batch_id", "left").select("batch_id", "input_rows", late.alias("late_rows"))


def correlated(left: DataFrame, right: DataFrame, key: str, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Right events up to ``minutes`` after a left event of the same key."""
    a = left.select(F.col(key).alias("key"), F.col("ts").alias("l_ts"), F.col("event_id").alias("l_id")).withWatermark("l_ts", delay)
    b = right.select(F.col(key).alias("r_key"), F.col("ts").alias("r_ts"), F.col("event_id").alias("r_id")).withWatermark("r_ts", delay)
    near = F.expr(f"r_ts >= l_ts AND r_ts <= l_ts + INTERVAL {int(minutes)} MINUTES")
    return a.join(b, (F.col("key") == F.col("r_key")) & near).select("key", "l_id", "r_id")
