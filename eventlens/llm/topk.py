"""Exact top-k search by inner product in three phases with a uniform threshold (operator 11).

Vectors are turned into integers and cut into ``SLICES`` parts. For each query every part of a block of candidates is a list of local
scores; a pair's score is the sum of its local scores.

1. Each block gathers its k best entries of each list and adds up the scores of those candidates. The k-th best total of a query over all
   blocks is a safe cutoff: k candidates reach it.
2. The cutoff travels back with the queries. A candidate whose total reaches the cutoff has a local score of at least cutoff / SLICES, the
   same threshold for all lists. All such entries are collected; lists where a candidate has no entry give it less than the threshold, and
   candidates whose largest possible total is below the cutoff go.
3. The missing local scores of the candidates left are looked up. A block passes on its k best totals that reach the cutoff, and a window
   picks the k best of each query.

The lists of a block stay in one task, so that entries are added up before the shuffle. A block sends at most k rows for each query, also where
candidates repeat or tie; codes travel in the narrowest integer type that holds them. The result is exact at every size. Each block of
candidates meets each block of queries, since every query is set against all rows.

Vectors that are NULL or hold a NULL or a value that is not finite, and rows with a NULL id take no part; an empty vector has the score 0 with
other empty ones; vectors of another length than the query's are no candidates. Ties go to the smaller id. Of rows that repeat an id, as
queries or as candidates, the best pair counts, and none is a candidate for its own id. Fewer than k candidates give all of them, empty
tables no rows. Totals beyond 64 bits count as the border of the type. Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import query, table
from eventlens.session import materialize

#: Vectors of a block of candidates and of queries; queries of a tile that are scored at a time.
CANDIDATES, QUERIES, ROWS = 2048, 8192, 256
#: Lists of local scores.
SLICES = 2

_BLOCKS = "dim int, n int, type string, peak double, ids binary, codes binary"
_TYPES = [np.int8, np.int16, np.int32, np.int64]
_LEAST, _MOST = -(2**63), 2**63 - 1


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(64 * x) as whole doubles (which hold it exactly)."""
    return np.floor(64 * x.astype(np.float64))


def _packed(codes: np.ndarray) -> tuple[str, bytes]:
    top = np.abs(codes).max(initial=0)
    fits = [t for t in _TYPES if top < 2.0 ** (8 * np.dtype(t).itemsize - 1)]
    kind = np.dtype(fits[0] if fits else np.float64)
    return kind.name, codes.astype(kind).tobytes()


def _blocks(size: int, transform: Callable[[np.ndarray], np.ndarray]):
    """Rows (dim, n, type, peak, ids, codes): up to ``size`` vectors of one length."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        names = ["dim", "n", "type", "peak", "ids", "codes"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.binary(), pa.binary()]

        def packed(dim: int) -> pa.RecordBatch:
            some = waiting.pop(dim)
            codes = np.array([v for _, v in some]).reshape(len(some), dim)
            kind, data = _packed(codes)
            row = (dim, len(some), kind, float(np.abs(codes).max(initial=0)), np.array([k for k, _ in some], np.int64).tobytes(), data)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for key, vector in zip(batch.column("id").to_pylist(), batch.column("vector"), strict=True):
                values = vector.values
                if key is None or values is None or values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = values.to_numpy(zero_copy_only=False)
                    codes = transform(x)
                if not np.isfinite(x).all() or not np.isfinite(codes).all():
                    continue
                waiting.setdefault(len(codes), []).append((key, codes))
                if len(waiting[len(codes)]) >= size:
                    yield packed(len(codes))
        for dim in list(waiting):
            yield packed(dim)

    return work


def _slices(dim: int) -> list[slice]:
    at = [dim * i // SLICES for i in range(SLICES + 1)]
    return [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]


def local_scores(q: np.ndarray, c: np.ndarray, peak: float) -> list[np.ndarray]:
    """Matrix of local scores of each list; ``peak`` bounds the size of any product. Exact for every size of the codes."""
    bound = peak * max(q.shape[1], 1)
    if bound < 2**24:
        kind = np.float32
    elif bound < 2**53:
        kind = np.float64
    else:
        kind = object
    if kind is object:
        q, c = (np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) for x in (q, c))
    else:
        q, c = q.astype(kind), c.astype(kind)
    return [q[:, s] @ c[:, s].T if s.stop > s.start else np.zeros((len(q), len(c)), kind) for s in _slices(q.shape[1])]


def _best(ids: np.ndarray, totals: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of (ids, totals) without ``own``: of equal ids the best one, ties to the smaller id."""
    keep = ids != own
    ids, totals = ids[keep], totals[keep]
    totals = np.array([min(max(int(v), _LEAST), _MOST) for v in totals], np.int64)
    order = np.lexsort((ids, ~totals))  # ~x falls as x rises, and has no overflow
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], totals[order]


def gathered(lists: list[np.ndarray], own: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phase 1: for each query the totals of the candidates that stand among the first of any list.

    Repeated ids and the query itself take places in a list, so each list gives as many entries more.
    """
    want = min(k + 1 + len(ids) - len(np.unique(ids)), len(ids))
    for i, key in enumerate(own.tolist()):
        at = np.unique(np.concatenate([np.argsort(-x[i], kind="stable")[:want] if x.dtype == object or want == len(ids)
                                       else np.argpartition(-x[i], want - 1)[:want] for x in lists]))
        yield key, *_best(ids[at], sum(x[i][at] for x in lists), key, k)


def collected(lists: list[np.ndarray], own: np.ndarray, cutoffs: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phases 2 and 3: for each query the k best candidates whose total reaches its cutoff."""
    m = len(lists)
    for i, (key, cutoff) in enumerate(zip(own.tolist(), cutoffs.tolist(), strict=True)):
        entry = [m * x[i] >= cutoff for x in lists]
        at = np.flatnonzero(np.logical_or.reduce(entry))
        most = sum(m * np.where(e[at], x[i][at], cutoff / m) for e, x in zip(entry, lists, strict=True))
        at = at[most >= cutoff * m - 1e-6 * abs(cutoff)]
        totals = sum(x[i][at] for x in lists)
        enough = totals >= cutoff
        if enough.any():
            yield key, *_best(ids[at[enough]], totals[enough], key, k)


def _matrix(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}_ids"].as_buffer(), np.int64)
    return ids, np.frombuffer(row[f"{side}_codes"].as_buffer(), row[f"{side}_type"].as_py()).reshape(len(ids), row["dim"].as_py())


def _tiles(k: int, phase: int):
    """Rows (query_id, vec_ids, scores) of each query of each tile."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                (own, q), (ids, c) = _matrix(row, "q"), _matrix(row, "c")
                peak = row["q_peak"].as_py() * row["c_peak"].as_py()
                cutoffs = np.frombuffer(row["cutoffs"].as_buffer(), np.float64) if phase > 1 else None
                for a in range(0, len(own), ROWS):
                    lists = local_scores(q[a : a + ROWS], c, peak)
                    part = own[a : a + ROWS]
                    found = list(gathered(lists, part, ids, k) if phase == 1 else collected(lists, part, cutoffs[a : a + ROWS], ids, k))
                    yield pa.RecordBatch.from_pydict({
                        "query_id": pa.array([x for x, _, _ in found], pa.int64()), "vec_ids": pa.array([x for _, x, _ in found], pa.list_(pa.int64())),
                        "scores": pa.array([x for _, _, x in found], pa.list_(pa.int64())),
                    })

    return work


def _ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column("block").to_pylist(), batch.column("ids"), strict=True):
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            yield pa.RecordBatch.from_pydict({"block": np.full(len(ids), block), "query_id": ids})


def _with_cutoffs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks with the cutoff of each query, -inf where no k candidates are known."""
    for batch in batches:
        packed = []
        for ids, keys, values in zip(*(batch.column(c) for c in ("ids", "keys", "values")), strict=True):
            known = dict(zip(keys.as_py() or [], values.as_py() or [], strict=True))
            # A double may lie above a large score: the next one below is a cutoff as safe.
            packed.append(np.array([np.nextafter(known[x], -np.inf) if abs(known.get(x, 0)) >= 2**53 else known.get(x, -np.inf)
                                    for x in np.frombuffer(ids.as_buffer(), np.int64).tolist()], np.float64).tobytes())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("dim", "block", "n", "type", "peak", "ids", "codes")], pa.array(packed, pa.binary())],
                                         names=["dim", "block", "n", "type", "peak", "ids", "codes", "cutoffs"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    pairs = found.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("p")).select("query_id", F.col("p.vec_ids").alias("vec_id"), F.col("p.scores").alias("score"))
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def top_inner_products(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
                       transform: Callable[[np.ndarray], np.ndarray] = scaled) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of ``df`` for which ``queries`` holds the k other rows of largest inner product.

    ``transform`` makes a vector's whole numbers (as doubles) from its components.
    """
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), queries.alias("asks"))
    candidates = materialize(vectors.select("id", "vector").mapInArrow(_blocks(CANDIDATES, transform), _BLOCKS), "candidates")
    asked = vectors.where("asks").select("id", "vector")
    asked = asked.coalesce(max(1, asked.count() // QUERIES)).mapInArrow(_blocks(QUERIES, transform), _BLOCKS)
    asked = materialize(asked.withColumn("block", F.monotonically_increasing_id()), "asked")

    # A grid of tasks: each takes the blocks of one of ``rows`` groups of queries and one of ``columns`` groups of candidates.
    rows, columns = (-(-max(side.count(), 1) // size) for side, size in ((asked, 64), (candidates, 8)))

    def tiles(questions: DataFrame, phase: int) -> DataFrame:
        sides = []
        for side, name, own, other, of in ((candidates, "c", "column", "row", (columns, rows)), (questions, "q", "row", "column", (rows, columns))):
            cells = [F.pmod(F.xxhash64("ids"), F.lit(of[0])).alias(own), F.explode(F.expr(f"sequence(0L, {of[1] - 1}L)")).alias(other)]
            more = ["cutoffs"] if name == "q" and phase > 1 else []
            sides.append(side.select("dim", *cells, *more, *[F.col(x).alias(f"{name}_{x}") for x in ("type", "peak", "ids", "codes")]))
        both = sides[0].join(sides[1], ["dim", "row", "column"])
        return both.mapInArrow(_tiles(k, phase), "query_id long, vec_ids array<long>, scores array<long>")

    sure = _ranked(tiles(asked, 1), k).where(F.col("rank") == k).select("query_id", "score")
    of = asked.select("block", "ids").mapInArrow(_ids, "block long, query_id long")
    cutoffs = of.join(sure, "query_id").groupBy("block").agg(F.collect_list("query_id").alias("keys"), F.collect_list("score").alias("values"))
    questions = asked.join(cutoffs, "block", "left").select("dim", "block", "n", "type", "peak", "ids", "codes", "keys", "values")
    questions = materialize(questions.mapInArrow(_with_cutoffs, "dim int, block long, n int, type string, peak double, ids binary, codes binary, cutoffs binary"), "questions")
    return _ranked(tiles(questions, 2), k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda a: floor(64 * a::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op11_uniform_threshold_topk", SQL)
def op11_uniform_threshold_topk(spark, sf_dir):
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
