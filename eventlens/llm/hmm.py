"""Hidden Markov language model (operator 5).

Latent states emit word classes (hashes of a word's last bytes, a fixed number of them); a word is drawn within its class by its
training count. With c, N, V of the training tokens, P(word | state) = P(class | state) * (c + 0.5) / sum of
(c + 0.5) in the class; a word without training count has 0.5 / (N + 0.5 (V + 1)) in every state, as in the unigram base. So the
probabilities of all known words and one unknown word sum to one in each state.

Baum-Welch: each task gathers expected counts of its training texts, Spark sums them across tasks, and the next round starts from the sums, over
all training texts each time, until a round gains less than ``GAIN`` bits a token (at most ``ROUNDS`` times). Tasks work on windows of ``WINDOW``
tokens; each is read with ``CONTEXT`` tokens of its text on either side, over which the forward and backward messages settle, so that every
transition counts once and only beginnings of texts count as such. The first parameters are the classes' shares of all training tokens, blurred
for each state. Word counts are summed over all training texts. The score of a text is its exact log likelihood: one scaled forward recursion over
the whole text.

Texts are packed once into chunks of about ``CHUNK`` tokens with a vocabulary of their own, written as Parquet; later passes read those, and
only distinct words of chunks are shuffled, never tokens. Broadcast are the parameters, whose size is fixed.

NULL and empty texts are one end token. Repeated rows count each time. NULL ids count as the empty text in the split. Without any training
text every word is unknown with probability 1 and all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import query, release, remainder, sliced, table
from eventlens.llm.words import LOWER, Words, mix, words_of
from eventlens.session import materialize

STATES, CLASSES, WINDOW, CONTEXT = 8, 1 << 15, 128, 12
#: Most rounds, and the gain in bits a token below which there is no further one.
ROUNDS, GAIN = 12, 0.01
CHUNK, BLOCK = 1_500_000, 2048
#: Class of the end token.
END = 0


def word_classes(words: Words) -> np.ndarray:
    """Class 1 .. CLASSES - 1 of each word by its last four bytes."""
    code = np.zeros(len(words.end), np.uint64)
    for j in range(4):
        at = words.end - 1 - j
        inside = at >= words.begin
        code = code * np.uint64(257) + np.where(inside, LOWER[words.data[np.maximum(at, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(code) % np.uint64(CLASSES - 1)).astype(np.uint16) + np.uint16(1)


_CHUNKS = "chunk long, ids array<{id}>, learn binary, lengths binary, tokens binary, hashes binary, classes binary, counts binary"


def _chunks():
    """Packed texts: token numbers, and the hash, class and training count of each number."""

    def packed(held: list, part: int, number: int) -> pa.RecordBatch:
        ids = pa.concat_arrays([x[0] for x in held])
        learn, lengths, hashes, classes = (np.concatenate([x[i] for x in held]) for i in range(1, 5))
        tokens, vocabulary = pd.factorize(hashes)
        kind = np.zeros(len(vocabulary), np.uint16)
        kind[tokens] = classes
        counts = np.bincount(tokens, weights=np.repeat(learn, lengths), minlength=len(vocabulary)).astype(np.int32)
        blobs = (learn, lengths.astype(np.int32), tokens.astype(np.int32), vocabulary.astype(np.uint64), kind, counts)
        names = ("learn", "lengths", "tokens", "hashes", "classes", "counts")
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([(part << 24) | number], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            **{name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(names, blobs, strict=True)},
        })

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in sliced(batches, "text"):
            words = words_of(batch.column("text"))
            held.append((batch.column("id"), batch.column("learn").to_numpy(zero_copy_only=False).astype(bool), np.diff(words.first), words.hash, word_classes(words)))
            size += len(words.hash)
            if size >= CHUNK:
                yield packed(held, part, number)
                number, held, size = number + 1, [], 0
        if held:
            yield packed(held, part, number)

    return work


def _vocabulary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, number, word, class, n) of a chunk's vocabulary."""
    for batch in batches:
        for i in range(batch.num_rows):
            hashes, classes, counts = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (
                ("hashes", np.int64), ("classes", np.uint16), ("counts", np.int32)))
            yield pa.RecordBatch.from_pydict({
                "chunk": np.full(len(hashes), batch.column("chunk")[i].as_py()), "number": np.arange(len(hashes), dtype=np.int32),
                "word": hashes, "class": classes.astype(np.int32), "n": counts.astype(np.int64)})


def sequences(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token classes with an end token after each text, and the lengths with it."""
    at = np.cumsum(lengths)
    return np.insert(classes, at, END), lengths + 1


class Model(NamedTuple):
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # CLASSES x STATES


class Windows(NamedTuple):
    """Windows of texts with their context, longest first: begin and length, the part that counts (from, to), and whether a text begins there."""

    begin: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray


def windows_of(lengths: np.ndarray) -> Windows:
    pieces = -(-lengths // WINDOW)
    ends = np.repeat(np.cumsum(lengths), pieces)
    starts = np.repeat(np.cumsum(lengths) - lengths, pieces)
    core = starts + WINDOW * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    until = np.minimum(core + WINDOW, ends)
    begin, end = np.maximum(core - CONTEXT, starts), np.minimum(until + CONTEXT, ends)
    order = np.argsort(begin - end, kind="stable")
    return Windows(*(x[order] for x in (begin, end - begin, core - begin, until - begin, core == starts)))


def lasting(step: np.ndarray) -> np.ndarray:
    """Distribution of states that a chain settles at."""
    out = np.full(len(step), 1 / len(step))
    for _ in range(200):
        out = out @ step
    return out / out.sum()


def expected(model: Model, seq: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (start, step, emit) of texts and their log likelihood, by forward and backward recursion over their windows."""
    k = len(model.start)
    start, step, emit, gained = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k)), 0.0
    a_, b_, p_, l_ = (x.astype(np.float32) for x in (model.step, model.emit, model.start, lasting(model.step)))
    every = windows_of(lengths)
    for lo in range(0, len(every.begin), BLOCK):
        begin, size, low, high, first = (x[lo : lo + BLOCK] for x in every)
        top = int(size[0])
        active = [int(np.searchsorted(-size, -t, "left")) for t in range(top)]
        token = [seq[begin[:n] + t] for t, n in enumerate(active)]
        counts = [((low[:n] <= t) & (t < high[:n])).astype(np.float32) for t, n in enumerate(active)]
        likely = [b_[x] for x in token]
        alpha, scale = [], []
        for t in range(top):
            now = (np.where(first[:, None], p_, l_) if t == 0 else alpha[-1][: active[t]] @ a_) * likely[t]
            total = np.maximum(now.sum(axis=1, keepdims=True), np.float32(1e-30))
            gained += float(np.log(total[:, 0]) @ counts[t])
            alpha.append(now / total)
            scale.append(total)
        beta = np.ones((active[-1], k), np.float32)
        gamma = [None] * top
        for t in range(top - 1, -1, -1):
            if t < top - 1:
                ahead = likely[t + 1] * beta / scale[t + 1]
                n = active[t + 1]
                step += alpha[t][:n].T @ (ahead * counts[t + 1][:, None])
                beta = np.concatenate([ahead @ a_.T, np.ones((active[t] - n, k), np.float32)])
            gamma[t] = alpha[t] * beta
        start += gamma[0][first].sum(axis=0)
        tokens, shares = np.concatenate(token), np.concatenate(gamma) * np.concatenate(counts)[:, None]
        for j in range(k):
            emit[:, j] += np.bincount(tokens, weights=shares[:, j], minlength=CLASSES)
    return start, step * model.step, emit, gained


def improved(start: np.ndarray, step: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
    """Parameters from expected counts, smoothed; ``share`` is the classes' share of training tokens."""
    emit = emit + 20.0 * share[:, None]
    return Model((start + 0.1) / (start + 0.1).sum(), (step + 0.1) / (step + 0.1).sum(axis=1, keepdims=True), emit / np.maximum(emit.sum(axis=0), 1e-300))


def log_likelihood(model: Model, unknown: float, seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural logarithm of the likelihood of each whole sequence by scaled forward recursion.

    Class -1 is an unknown word of probability ``unknown`` in every state.
    """
    table_ = np.vstack([model.emit * (1 - unknown), np.full((1, len(model.start)), unknown)])
    order = np.argsort(-lengths, kind="stable")
    begin, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    total = np.zeros(len(lengths))
    alpha = None
    ends = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    for t, n in enumerate(ends.tolist()):
        alpha = (model.start if t == 0 else alpha[:n] @ model.step) * table_[seq[begin[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(lengths))
    out[order] = total
    return out


def _partial(model: Model):
    """Expected counts of a task: rows (place, values); classes, then transitions, starts, and the log likelihood."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES)), np.zeros(1)]
        for seq, full in _training(batches):
            for total, more in zip(sums, expected(model, seq, full), strict=True):
                total += more
        start, step, emit, gained = sums
        used = np.flatnonzero(emit.any(axis=1))
        place = np.concatenate([used, CLASSES + np.arange(STATES + 2)])
        values = np.concatenate([emit[used], step, start[None], np.broadcast_to(gained / STATES, (1, STATES))])
        yield pa.RecordBatch.from_pydict({"place": place.astype(np.int32), **{f"s{j}": values[:, j] for j in range(STATES)}})

    return work


def _training(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sequences of the training texts of each chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            learn, lengths, tokens, classes = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (
                ("learn", bool), ("lengths", np.int32), ("tokens", np.int32), ("classes", np.uint16)))
            if learn.any():
                yield sequences(classes[tokens][np.repeat(learn, lengths)], lengths[learn].astype(np.int64))
            release()


def first_model(share: np.ndarray) -> Model:
    """States that last, each with the classes' shares of all training tokens under noise of its own."""
    sticky = np.full((STATES, STATES), 0.1 / max(STATES - 1, 1))
    np.fill_diagonal(sticky, 0.9)
    noisy = share[:, None] * np.random.default_rng(5).gamma(1.0, 1.0, (CLASSES, STATES))
    return Model(np.full(STATES, 1 / STATES), sticky, noisy / noisy.sum(axis=0))


def fit(chunks: DataFrame, share: np.ndarray, tokens: int, rounds: int = ROUNDS, gain: float = GAIN) -> Model:
    """Baum-Welch over all training texts of ``chunks``, which hold ``tokens`` tokens."""
    parts = chunks.select("learn", "lengths", "tokens", "classes")
    model, before = first_model(share), -np.inf
    for _ in range(rounds):
        columns = ", ".join(f"s{j} double" for j in range(STATES))
        partial = parts.mapInArrow(_partial(model), f"place int, {columns}")
        sums = partial.groupBy("place").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(STATES)]).toPandas()
        total = np.zeros((CLASSES + STATES + 2, STATES))
        total[sums["place"].to_numpy()] = sums[[f"s{j}" for j in range(STATES)]].to_numpy()
        model = improved(total[-2], total[CLASSES:-2], total[:CLASSES], share)
        now = total[-1].sum() / np.log(2) / max(tokens, 1)
        if now - before < gain:
            break
        before = now
    return model


class Totals(NamedTuple):
    """Training tokens, distinct ones, ends, and for each class the sum of c + 0.5."""

    tokens: int
    distinct: int
    ends: int
    mass: np.ndarray


def _scored(model: Model, totals: Totals):
    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts = right.sort_values("number")["c"].to_numpy(dtype=np.float64)
        out = []
        below = totals.tokens + 0.5 * (totals.distinct + 1)
        unknown = 0.5 / below
        for row in left.itertuples(index=False):
            learn, lengths, tokens, classes = (np.frombuffer(x, t) for x, t in (
                (row.learn, bool), (row.lengths, np.int32), (row.tokens, np.int32), (row.classes, np.uint16)))
            lengths = lengths.astype(np.int64)
            known = counts > 0
            mass = totals.mass[classes]
            base = np.log10((counts + 0.5) / below)
            inner = np.where(known, np.log10((counts + 0.5) / np.where(known, mass, 1.0)), 0.0)
            kind = np.where(known, classes.astype(np.int64), -1)
            owner = np.repeat(np.arange(len(lengths)), lengths)

            def per_text(values, end, tokens=tokens, owner=owner, n=len(lengths)):
                return np.bincount(owner, weights=values[tokens], minlength=n) + end

            has_end = totals.ends > 0
            seq, full = sequences(kind[tokens], lengths)
            if not has_end:
                seq[np.cumsum(full) - 1] = -1
            if totals.tokens:
                score = log_likelihood(model, unknown, seq, full) / np.log(10)
                score += per_text(inner, np.log10((totals.ends + 0.5) / totals.mass[END]) if has_end else 0.0)
            else:
                score = np.zeros(len(lengths))
            out.append(pd.DataFrame({
                "id": list(row.ids), "held_out": ~learn, "n_tokens": full, "n_known": per_text(known.astype(float), int(has_end)).astype(np.int64),
                "train_tokens": totals.tokens, "base_score": per_text(base, np.log10((totals.ends + 0.5) / below)), "score": score}))
        release()
        return pd.concat(out)

    return work


def score(df: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each input row; rows where ``learn`` holds train the model."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    id_type = texts.schema["id"].dataType.simpleString()
    packed = texts.mapInArrow(_chunks(), _CHUNKS.format(id=id_type))
    chunks = materialize(packed, "chunks")
    words = chunks.select("chunk", "hashes", "classes", "counts").mapInArrow(_vocabulary, "chunk long, number int, word long, class int, n long")
    # One row for each word, combined before the shuffle; a frequent word has a row in every chunk, which joins may split.
    totals_ = materialize(words.groupBy("word").agg(F.sum("n").alias("c"), F.first("class").alias("class")), "totals")
    counted = words.select("chunk", "number", "word").join(totals_.select("word", "c"), "word")
    by_class = totals_.where("c > 0").groupBy("class").agg(F.count("*").alias("words"), F.sum("c").alias("c")).toPandas()
    ends = texts.where("learn").count()
    mass = np.zeros(CLASSES)
    mass[by_class["class"].to_numpy()] = (by_class["c"] + 0.5 * by_class["words"]).to_numpy(dtype=float)
    mass[END] = ends + 0.5 * (ends > 0)
    totals = Totals(int(by_class["c"].sum()) + ends, int(by_class["words"].sum()) + (ends > 0), ends, mass)
    share = mass / mass.sum() if ends else np.full(CLASSES, 1 / CLASSES)
    model = fit(chunks, share, totals.tokens, rounds if ends else 0)
    out = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    left = chunks.select("chunk", "ids", "learn", "lengths", "tokens", "classes").groupBy("chunk")
    return left.cogroup(counted.select("chunk", "number", "c").groupBy("chunk")).applyInPandas(_scored(model, totals), out)


@query("op5_hidden_markov_score")
def op5_hidden_markov_score(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1).withColumnRenamed("id", "doc_id")
