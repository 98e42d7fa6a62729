"""Nearest neighbours by cosine as a block matrix join (operator 7).

Vectors are scaled to length one and rounded to int8; the rounding error's length is kept. Candidates and queries come
in blocks, and each candidate block meets each query block as one tile: the int8 product gives all cosines of the tile
with an error bound. Pairs whose upper bound reaches the k-th best lower bound of their query are computed again in
double precision from the original vectors. A task merges its tiles by a heap for each query; a window over the few
rows left of each query picks the last ones. The result is exact, so nothing is fitted.

Vectors that are NULL, zero, or hold a NULL or a value that is not finite, and rows with a NULL id take no part; vectors of
another length than the query's are no candidates. Ties go to the smaller id. Of rows that repeat an id the nearest counts,
and none is a candidate for its own id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import query, table
from eventlens.session import materialize

#: Vectors of a block.
BLOCK = 1024

_BLOCKS = "dim int, n int, ids binary, vectors binary, codes binary, steps binary, errors binary"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, the step of each, and the length of the rounding error."""
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    step = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / step)
    return codes.astype(np.int8), step[:, 0], np.sqrt(((unit - codes * step) ** 2).sum(axis=1))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_length: dict[int, list] = {}
        for key, vector in zip(batch.column("id").to_pylist(), batch.column("vector"), strict=True):
            values = vector.values
            if key is None or values is None or not len(values) or values.null_count:
                continue
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            scale = np.abs(x).max()
            if np.isfinite(scale) and scale > 0:
                by_length.setdefault(len(x), []).append((key, x))
        out = []
        for dim, some in by_length.items():
            for a in range(0, len(some), BLOCK):
                part = some[a : a + BLOCK]
                x = np.array([v for _, v in part])
                codes, step, error = quantised(x / np.abs(x).max(axis=1, keepdims=True))
                out.append((dim, len(part), np.array([k for k, _ in part], np.int64).tobytes(), x.tobytes(), codes.tobytes(), step.tobytes(), error.tobytes()))
        if out:
            names = ["dim", "n", "ids", "vectors", "codes", "steps", "errors"]
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _read(row: dict, side: str) -> tuple[np.ndarray, ...]:
    n, dim = row[f"{side}_n"], row["dim"]
    return (
        np.frombuffer(row[f"{side}_ids"], np.int64), np.frombuffer(row[f"{side}_vectors"], np.float64).reshape(n, dim),
        np.frombuffer(row[f"{side}_codes"], np.int8).reshape(n, dim), np.frombuffer(row[f"{side}_steps"], np.float64),
        np.frombuffer(row[f"{side}_errors"], np.float64),
    )


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(x * x, axis=-1)[..., -1])


def nearest_in_tile(q: tuple, c: tuple, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query of a tile its k nearest candidates as (-cosine, id), best first."""
    (q_ids, q_x, q_codes, q_step, q_error), (c_ids, c_x, c_codes, c_step, c_error) = q, c
    exact = np.float32 if q_x.shape[1] <= 1000 else np.float64  # sums of int8 products below 2^24 are exact in float32
    near = (q_codes.astype(exact) @ c_codes.astype(exact).T) * q_step[:, None] * c_step
    bound = q_error[:, None] * (1 + c_error) + c_error + 1e-9
    near[q_ids[:, None] == c_ids] = -np.inf
    unique, first = np.unique(c_ids, return_index=True)
    repeats = len(c_ids) - len(unique)
    want = min(k + repeats, len(c_ids))
    low = near - bound
    reach = np.partition(low, len(c_ids) - want, axis=1)[:, len(c_ids) - want]
    q_length, c_length = _length(q_x), _length(c_x)
    for i, own in enumerate(q_ids.tolist()):
        at = np.flatnonzero((near[i] + bound[i] >= reach[i]) & np.isfinite(near[i]))
        if not len(at):
            continue
        cosine = np.cumsum(q_x[i] * c_x[at], axis=1)[:, -1] / (q_length[i] * c_length[at])
        best: dict[int, float] = {}
        for key, value in zip(c_ids[at].tolist(), cosine.tolist(), strict=True):
            best[key] = max(value, best.get(key, -np.inf))
        yield own, heapq.nsmallest(k, ((-value, key) for key, value in best.items()))


def _tiles(k: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}

        def drained() -> pa.RecordBatch:
            rows = [(own, key, -value) for own, some in heaps.items() for value, key in some]
            heaps.clear()
            ids, keys, scores = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_pydict({
                "query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(keys, pa.int64()), "score": pa.array(scores, pa.float64())})

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                for own, some in nearest_in_tile(_read(row, "q"), _read(row, "c"), k):
                    merged, seen = [], set()
                    for value, key in heapq.merge(heaps.get(own, ()), some):
                        if key not in seen and len(merged) < k:
                            seen.add(key)
                            merged.append((value, key))
                    heaps[own] = merged
            if len(heaps) > 100_000:
                yield drained()
        yield drained()

    return work


def nearest(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows of ``df`` to each of its rows for which ``queries`` holds."""
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), queries.alias("asks"))
    candidates = materialize(vectors.select("id", "vector").mapInArrow(_blocks, _BLOCKS), "blocks")
    asked = vectors.where("asks").select("id", "vector")
    asked = asked.coalesce(max(1, asked.count() // BLOCK)).mapInArrow(_blocks, _BLOCKS)
    asked = materialize(asked.withColumn("block", F.monotonically_increasing_id()), "asked")
    names = asked.select("dim", "block")
    sides = [
        side.select("dim", *extra, *[F.col(c).alias(f"{name}_{c}") for c in ("n", "ids", "vectors", "codes", "steps", "errors")])
        for side, name, extra in ((candidates, "c", []), (asked, "q", ["block"]))
    ]
    tiles = sides[0].join(names, "dim").repartition("block", F.xxhash64("c_ids")).join(sides[1], ["dim", "block"])
    found = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
n AS (SELECT vec_id, x, sqrt(list_reduce(list_transform(x, lambda a: a * a), lambda a, b: a + b)) AS l FROM v
  WHERE vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
  list_reduce(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.l * c.l) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0 AND q.l > 0 AND c.l > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op7_block_matrix_neighbours", SQL)
def op7_block_matrix_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
