"""Quality classifier by Bradley-Terry pairwise ranking (operator 3).

A document's score is linear in features of its whole text. Weights come from preference pairs (a document marked 1
over one marked 0) by logistic loss on feature differences, over all such pairs of all labelled documents. A quantile of
the training scores, at the share of documents marked 0, becomes the threshold; the score of a document is the logistic
of its distance from there.

Training writes the features of the labelled documents once. Each Newton step reads them twice and adds up numbers, sums
and weighted squares by bins of ``BIN`` of the score, since how often a document loses depends on its score and on how
many documents of the other mark have which score. So nothing is drawn, and what reaches the driver has a fixed size.
A document meets its opponents at the mean score of their bin, an error of about ``BIN ** 2 / 24`` of a pair's weight; the
threshold is exact.
Scoring is one pass without a shuffle. Labels, lang, source and doc_id are never inputs of a score.

NULL and empty texts have zero counts and are scored like any text. NULL labels are ignored; a document labelled more
than once takes part with its lowest mark. Without documents of both marks every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from eventlens.llm.common import query, remainder, sliced, table
from eventlens.llm.words import BLOCK, buffers, shingles_of, words_of
from eventlens.operators.quantiles import grouped_quantiles
from eventlens.session import materialize

#: Newton steps at most and the change of a weight that ends them; weight of the squared weights in the loss.
STEPS, SETTLED, RIDGE = 40, 1e-3, 1e-3
#: Width of a bin of scores, and number of bins for each mark; scores beyond them fall into the first or last.
BIN, BINS = 1 / 32, 2048
BORDERS = (np.arange(BINS + 1) - BINS // 2) * BIN

#: Byte classes: 0 letters a-z, 1 A-Z, 2 digits, 3 blanks, 4 line ends, 5 sentence ends, 6 other ASCII marks, 7 above
#: ASCII, 8 continuation bytes of UTF-8, 9 brackets and quotes.
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[128:192] = 8
_CLASS[[9, 32]], _CLASS[[10, 13]] = 3, 4
_CLASS[[ord(c) for c in ".,;:?"]] = 5
_CLASS[[ord(c) for c in "()[]{}<>\"'"]] = 9
CLASSES = 10


def features(column: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    data, at = buffers(column)
    rows = len(at) - 1
    size = np.diff(at)
    counts = np.zeros((rows, CLASSES))
    a = 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + BLOCK, "right")) - 1)
        doc = np.repeat(np.arange(b - a) * CLASSES, size[a:b])
        counts[a:b] = np.bincount(doc + _CLASS[data[at[a] : at[b]]], minlength=(b - a) * CLASSES).reshape(b - a, CLASSES)
        a = b
    words = words_of(column)
    n = np.diff(words.first)
    total = np.maximum(size, 1)[:, None]
    per_word = np.maximum(n, 1)
    owner = np.repeat(np.arange(rows), n)
    length = words.end - words.begin
    again = np.zeros(len(owner), dtype=bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    marked = _CLASS[words.data[words.end - 1]] == 6 if len(owner) else again
    alone = marked & (length == 1)
    upper = ((_CLASS[words.data[words.begin]] == 1) & (length > 1) & (_CLASS[words.data[np.minimum(words.begin + 1, words.end - 1)]] == 1)
             if len(owner) else again)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=flag, minlength=rows) / per_word

    def variety(hashes: np.ndarray, borders: np.ndarray) -> np.ndarray:
        return np.array([len(np.unique(hashes[a:b])) / (b - a) if b > a else 1.0 for a, b in zip(borders[:-1], borders[1:], strict=True)])

    pairs, borders = shingles_of(words, 2, short=False)
    shares = counts / total
    columns = [
        *shares.T, *np.sqrt(shares[:, [1, 2, 6, 9]]).T, np.log1p(size), np.log1p(n), share(length), np.sqrt(share(length.astype(float) ** 2)),
        share(again), share(marked), share(alone), share(upper), np.sqrt(share(again)), np.sqrt(share(marked)), np.sqrt(share(upper)),
        variety(words.hash, words.first), variety(pairs, borders), counts[:, 5] / per_word, (n == 0).astype(float),
    ]
    return np.column_stack(columns) if rows else np.zeros((0, len(columns)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def linear(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums of rows, to the last bit the same for equal rows in whatever batch."""
    return (z * weights).sum(axis=1)


class Model(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(linear((x - self.mean) / self.spread, self.weights) - self.threshold)


def _rows(batches: Iterable[pa.RecordBatch], mean: np.ndarray, spread: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Marks and standardised features of each batch."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield batch.column("mark").to_numpy().astype(np.int64), (x - mean) / spread


def _cell(mark: np.ndarray, z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return mark * BINS + np.clip(np.floor(linear(z, weights) / BIN).astype(np.int64) + BINS // 2, 0, BINS - 1)


def _bin_sums(mean: np.ndarray, spread: np.ndarray, weights: np.ndarray):
    """Rows (cell, n, z): numbers and summed features of a task's documents by mark and bin of the score."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(2 * BINS, np.int64), np.zeros((2 * BINS, len(mean)))
        for mark, z in _rows(batches, mean, spread):
            cell = _cell(mark, z, weights)
            order = np.argsort(cell, kind="stable")
            own, start, times = np.unique(cell[order], return_index=True, return_counts=True)
            n[own] += times
            total[own] += np.add.reduceat(z[order], start)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cell": own, "n": n[own], "z": _lists(total[own])})

    return work


def _slopes(mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, lost: np.ndarray, curved: np.ndarray):
    """Rows (place, value): a task's sums of the outer products of features times ``curved``, then of features times ``lost``, less for mark 0.

    Both are given for each mark at the borders of the bins and interpolated at the document's score.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean) + 1, len(mean)))
        for mark, z in _rows(batches, mean, spread):
            at = linear(z, weights)
            here = [np.where(mark == 1, np.interp(at, BORDERS, some[1]), np.interp(at, BORDERS, some[0])) for some in (curved, lost)]
            total[:-1] += (z * here[0][:, None]).T @ z
            total[-1] += (2 * mark - 1) * here[1] @ z
        yield pa.RecordBatch.from_pydict({"place": np.arange(total.size), "value": total.ravel()})

    return work


class _Pairs:
    """Loss, gradient and curvature at ``weights`` over all pairs of a document of either mark."""

    def __init__(self, marked: DataFrame, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray):
        self.marked, self.given, d = marked, (mean, spread, weights), len(mean)
        cells = marked.mapInArrow(_bin_sums(*self.given), "cell long, n long, z array<double>").groupBy("cell").agg(
            F.sum("n").alias("n"), *[F.sum(F.get("z", F.lit(i))).alias(f"z{i}") for i in range(d)]).toPandas().sort_values("cell")
        mark, n = cells["cell"].to_numpy() >= BINS, cells["n"].to_numpy(float)
        self.z = [cells.iloc[:, 2:].to_numpy(float)[mark == m] / n[mark == m][:, None] for m in (0, 1)]
        self.share = [n[mark == m] / n[mark == m].sum() for m in (0, 1)]
        self.at = [z @ weights for z in self.z]
        self.count = n[~mark].sum(), n[mark].sum()
        gap = self.at[1][:, None] - self.at[0]
        self.loss = float(self.share[1] @ np.logaddexp(0, -gap) @ self.share[0] + RIDGE / 2 * weights @ weights)

    def step(self) -> np.ndarray:
        """Newton's step towards a smaller loss."""
        # How often a document loses its pairs (mark 0: wins them) by its score.
        lose = [_sigmoid(BORDERS[:, None] - self.at[1]), _sigmoid(self.at[0] - BORDERS[:, None])]
        lost, curved = (np.array([f(x) @ self.share[1 - m] / self.count[m] for m, x in enumerate(lose)]) for f in (np.array, lambda x: x * (1 - x)))
        sums = self.marked.mapInArrow(_slopes(*self.given, lost, curved), "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
        sums = sums.toPandas().sort_values("place")["value"].to_numpy().reshape(-1, len(self.given[0]))
        p = _sigmoid(self.at[0] - self.at[1][:, None])
        both = (self.z[1] * self.share[1][:, None]).T @ (p * (1 - p)) @ (self.z[0] * self.share[0][:, None])
        return np.linalg.solve(sums[:-1] - both - both.T + RIDGE * np.eye(len(both)), sums[-1] - RIDGE * self.given[2])


def fit(marked: DataFrame) -> Model | None:
    """Bradley-Terry weights from rows (mark, x); the share of mark 0 is cut off. None if a mark has no row."""
    width = features(pa.array([""])).shape[1]
    found = marked.agg(
        F.count("*").alias("n"), F.count_if(F.col("mark") == 0).alias("low"),
        *[f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(width)]).first()
    n, low = found["n"], found["low"]
    if not 0 < low < n:
        return None
    # Sums of doubles hang on the order of tasks in their last digits; what is kept does not.
    mean, spread = (np.array([float(f"{v:.9e}") for v in found[a : a + width]]) for a in (2, 2 + width))
    spread[spread < 1e-9] = 1.0
    weights = np.zeros(width)
    now = _Pairs(marked, mean, spread, weights)
    for _ in range(STEPS):
        step = now.step()
        while np.abs(step).max() > SETTLED and (new := _Pairs(marked, mean, spread, weights + step)).loss > now.loss + 1e-6:
            step = step / 2
        weights = weights + step
        if np.abs(step).max() <= SETTLED:
            break
        now = new
    weights = np.round(weights, 6)

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, z in _rows(batches, mean, spread):
            yield pa.RecordBatch.from_pydict({"score": linear(z, weights)})

    between = grouped_quantiles(marked.mapInArrow(scores, "score double"), [], "score", {"score": (low - 0.5) / (n - 1)})
    return Model(mean, spread, weights, between.first()["score"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark_col: str = "quality") -> Model | None:
    """Fit on all labelled documents; None if a mark has none."""
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col(mark_col).alias("mark")).where("id IS NOT NULL AND mark IN (0, 1)")
        .groupBy("id").agg(F.min("mark").cast("int").alias("mark"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    # Features are smaller than texts, so they are joined.
    rows = texts.mapInArrow(_feature_rows, StructType([texts.schema["id"], StructField("x", ArrayType(DoubleType()))]))
    return fit(materialize(rows.join(marks, "id").select("mark", "x"), "features"))


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "x": _lists(features(batch.column("text")))})


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score), one for each input row."""
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([StructField("id", picked.schema["id"].dataType), StructField("score", DoubleType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            values = np.full(batch.num_rows, 0.5) if model is None else model.score(features(batch.column("text")))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(values)})

    return picked.mapInArrow(work, schema)


def keep_good(df: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score ``least`` or more, with all their columns."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            if model is None:
                yield batch
            else:
                yield batch.filter(pa.array(model.score(features(batch.column(text_col))) >= least))

    return df.mapInArrow(work, df.schema)


def split_training(docs: DataFrame) -> DataFrame:
    """Documents whose labels may be learned: crc32 of doc_id modulo 3 is not 1."""
    return docs.where(remainder("doc_id", 3) != 1)


@query("op3_bradley_terry_quality")
def op3_bradley_terry_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(split_training(docs), labels))
    return scored.select(
        F.col("id").alias("doc_id"), (remainder("id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
