"""Shared by the operators of this subpackage: their query registry, table reader and Arrow slicing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.words import buffers
from eventlens.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Bytes of text that a task works on at a time (a single longer text is worked on alone).
SLICE = 2 << 20
#: Slots (a power of two) of the bitmap that ``among`` sends to tasks.
SLOT_BITS = 24
#: Bytes of an Arrow batch between Spark and Python; a single larger row is a batch of its own.
BATCH = 8 << 20


def configure(spark: SparkSession, batch: int = BATCH) -> SparkSession:
    """Session settings of the operators; their jobs run under them, so they are set before any."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch))
    return spark


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn`` under ``name``; ``sql`` is its DuckDB equivalent."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, of: int) -> Column:
    """crc32 of the decimal text of ``column``, modulo ``of``; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in the column of that name of ``keys``, and by chance a few others.

    Tasks drop rows by a bitmap of hash slots, so that a join that follows does not shuffle them. The bitmap has a fixed size; at most
    ``2 ** (SLOT_BITS - 6)`` rows of it reach the driver.
    """
    slot = F.pmod(F.xxhash64(column), F.lit(1 << SLOT_BITS))
    cells = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (SLOT_BITS - 6), np.uint64)
    bitmap[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)

    def passing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            hit = (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(hit))
        release()

    return df.select("*", slot.alias("__slot")).mapInArrow(passing, df.schema)


def release() -> None:
    """Give memory that is free again back to the system, so that a worker waiting for its next task holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    release()


def cut_up(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that come sorted by ``keys``, in tables that never cut a key in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, dtype=bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            same &= values == values[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        first = {key: batch.column(key)[0] for key in keys}
        if held and any(held[-1].column(key)[-1] != first[key] for key in keys):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
