"""Benchmark decontamination by greedy string tiling (operator 10).

Documents and test items are sequences of lower-cased words. A seed is a window of ``SEED`` words; seeds of a document
that some test item has are joined with the items' seeds. For each pair so found, tiling repeatedly takes the longest
common run of at least ``SEED`` words that no tile has yet, found by Karp-Rabin windows and checked word by word. A document
holds a test item if tiles cover ``COVERAGE`` of the item's words, in whatever order its passages stand.

A bitmap of fixed size lets most seeds of documents go before the join. Only words inside seeds that pass it travel;
tiles can't lie anywhere else, so the tiling equals that of whole texts. Nothing is collected but the bitmap.

An item of fewer than ``SEED`` words is its own seed: documents that hold its words in a row hold the item. Repetitive texts, where windows
match in very many pairs, are tiled by searching for the greatest length at which free windows still agree, in memory linear in both texts.

NULL texts count as empty; items without a word can't match, rows with a NULL id are not looked at. Repeated documents and items give equal results; several rows of one id count as separate texts of that id,
of which the best counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import query, sliced, table
from eventlens.llm.words import Words, shingles_of, short_runs, words_of
from eventlens.session import materialize

SEED, COVERAGE = 5, 0.5
#: Bits of the seed bitmap, a power of two.
BITS = 24
#: Matching pairs of windows above which tiles are searched for by length.
PAIRS = 1_000_000


def _slot(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> np.uint64(64 - BITS)).astype(np.int64)


def _items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, size, words, seeds, times) of the benchmark: each distinct seed and its number of places."""
    for batch in sliced(batches, "text"):
        words = words_of(batch.column("text"))
        seeds, at = shingles_of(words, SEED)
        spans = list(zip(words.first[:-1], words.first[1:], strict=True))
        counted = [np.unique(seeds[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({
            "item": batch.column("id"), "size": np.diff(words.first).astype(np.int32),
            "words": pa.array([words.hash[a:b].tobytes() for a, b in spans], pa.binary()),
            "seeds": pa.array([x.view(np.int64) for x, _ in counted], pa.list_(pa.int64())),
            "times": pa.array([n.astype(np.int32) for _, n in counted], pa.list_(pa.int32())),
        })


def _hits(bitmap: bytes, sizes: list[int]):
    """Rows (id, copy, places, words, seeds) of documents with seeds in the bitmap: the covered words and their places."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)
        for batch in sliced(batches, "text"):
            words = words_of(batch.column("text"))
            found = []
            for size in (*sizes, SEED):
                seeds, at = _runs_of(words, size)
                hit = np.flatnonzero(known[_slot(seeds)])
                row = np.searchsorted(at, hit, "right") - 1
                found.append((row, hit - at[row], np.full(len(hit), size), seeds[hit]))
            row, place, size, seeds = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(row):
                continue
            order = np.lexsort((place, row))
            row, place, size, seeds = row[order], place[order], size[order], seeds[order]
            ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1
            out, a = ([], [], [], []), 0
            for b in ends.tolist():
                i = int(row[a])
                inside = np.arange(SEED) < size[a:b, None]
                covered = np.unique((place[a:b, None] + np.arange(SEED))[inside])
                out[0].append(i)
                out[1].append(covered.astype(np.int32).tobytes())
                out[2].append(words.hash[words.first[i] + covered].tobytes())
                out[3].append(np.unique(seeds[a:b]).view(np.int64))
                a = b
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").take(pa.array(out[0])), "places": pa.array(out[1], pa.binary()),
                "words": pa.array(out[2], pa.binary()), "seeds": pa.array(out[3], pa.list_(pa.int64())),
            })

    return work


def _runs_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, those of under ``SEED`` words as ``shingles_of`` makes them for a text that is no longer."""
    if size == SEED:
        return shingles_of(words, SEED, short=False)
    return short_runs(words, size)


def _rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows."""
    out = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for j in range(size):
        out = out * base + words[j : j + len(out)]
    return out


def tiles(places: np.ndarray, words: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, place in the item, length), longest first.

    Ties go to the earlier place in the item, then in the document. ``places`` are those of ``words`` in the document.
    """
    least = min(least, len(item))
    if not least:
        return []
    ours, theirs = _rolling(words, least), _rolling(item, least)
    if not len(ours) or not len(theirs):
        return []
    whole = places[least - 1 :] - places[: len(ours)] == least - 1
    order = np.argsort(theirs, kind="stable")
    low, high = (np.searchsorted(theirs[order], ours, side) for side in ("left", "right"))
    count = np.where(whole, high - low, 0)
    if count.sum() > PAIRS:
        return _tiles_by_length(places, words, item, least)
    i = np.repeat(np.arange(len(ours)), count)
    j = order[np.repeat(low, count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)]
    same = np.ones(len(i), bool)
    for k in range(least):
        same &= words[i + k] == item[j + k]
    i, j = i[same], j[same]
    out = []
    while len(i):
        order = np.lexsort((i, j - i))
        i, j = i[order], j[order]
        start = np.flatnonzero(np.append(True, (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1) | (places[i[1:]] != places[i[:-1]] + 1)))
        length = np.diff(np.append(start, len(i))) + least - 1
        best = min(np.flatnonzero(length == length.max()).tolist(), key=lambda x: (j[start[x]], i[start[x]]))
        a, b, n = int(i[start[best]]), int(j[start[best]]), int(length[best])
        out.append((int(places[a]), b, n))
        free = ((i + least <= a) | (i >= a + n)) & ((j + least <= b) | (j >= b + n))
        i, j = i[free], j[free]
    return out


def _free(taken: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """From each place the number of free places in a row; ``joined`` tells where a place follows the one before."""
    stops = np.flatnonzero(np.append(~joined[1:], True) | taken)
    after = stops[np.searchsorted(stops, np.arange(len(taken)))]
    return np.where(taken, 0, after - np.arange(len(taken)) + ~taken[after])


def _tiles_by_length(places: np.ndarray, words: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """As ``tiles``, by binary search for the greatest length at which free windows of both agree."""
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(len(words), len(item)), base, np.uint64)))
    sums = []
    for text in (words, item):
        total = np.zeros(len(text) + 1, np.uint64)
        # Prefix hashes divided by the powers of the base, so that they add up.
        np.cumsum(text * power[: len(text)], out=total[1:], dtype=np.uint64)
        sums.append(total)

    def windows(side: int, starts: np.ndarray, size: int) -> np.ndarray:
        raw = sums[side][starts + size] - sums[side][starts]
        return raw * power[len(power) - 1 - starts]

    taken = [np.zeros(len(words), bool), np.zeros(len(item), bool)]
    joined = [np.append(True, places[1:] == places[:-1] + 1), np.ones(len(item), bool)]
    out, top = [], min(len(words), len(item))
    while True:
        free = [_free(t, j) for t, j in zip(taken, joined, strict=True)]

        def agreeing(size: int, free=free) -> tuple[list[np.ndarray], list[np.ndarray]]:
            """Free windows of a length whose hash both texts have, and the hashes."""
            at = [np.flatnonzero(f >= size) for f in free]
            hashes = [windows(side, x, size) for side, x in enumerate(at)]
            keep = [np.isin(hashes[side], hashes[1 - side]) for side in (0, 1)]
            return [x[k] for x, k in zip(at, keep, strict=True)], [x[k] for x, k in zip(hashes, keep, strict=True)]

        low, high, size = least, min(top, int(free[0].max(initial=0)), int(free[1].max(initial=0))), 0
        while low <= high:
            middle = (low + high) // 2
            if len(agreeing(middle)[0][0]):
                low, size = middle + 1, middle
            else:
                high = middle - 1
        if not size:
            return out
        # All tiles of this length in one go: from the first place in the item on, each with the first free place in the document.
        (ours, theirs), (own, other) = agreeing(size)
        order = np.argsort(own, kind="stable")
        ours, first = ours[order], np.searchsorted(own[order], other, "left")
        ends, next_ = np.searchsorted(own[order], other, "right"), {}
        for j, a, b in zip(theirs.tolist(), first.tolist(), ends.tolist(), strict=True):
            if taken[1][j] or taken[1][j + size - 1]:  # tiles are at least as long, so they cover an end
                continue
            k = next_.get(a, a)
            while k < b and (taken[0][ours[k]] or taken[0][ours[k] + size - 1]):
                k += 1
            next_[a] = k
            if k < b and (words[ours[k] : ours[k] + size] == item[j : j + size]).all():
                i = int(ours[k])
                out.append((int(places[i]), j, size))
                taken[0][i : i + size] = True
                taken[1][j : j + size] = True
        top = size - 1
        if top < least:
            return out


def _tiled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for places, words, item in zip(*(batch.column(c) for c in ("places", "words", "item_words")), strict=True):
            item = np.frombuffer(item.as_buffer(), np.uint64)
            some = tiles(np.frombuffer(places.as_buffer(), np.int32).astype(np.int64), np.frombuffer(words.as_buffer(), np.uint64), item)
            found.append((len(some), sum(x[2] for x in some), max((x[2] for x in some), default=0)))
        n, covered, longest = (np.array(x, dtype=np.int32) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int32)] * 3
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "item": batch.column("item"), "size": batch.column("size"), "tiles": n, "covered": covered, "longest": longest,
        })


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Rows (id, item, size, tiles, covered, longest, coverage) of documents that hold a test item."""
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).where("id IS NOT NULL")
    item_type = items.schema["id"].dataType.simpleString()
    items = materialize(items.mapInArrow(_items, f"item {item_type}, size int, words binary, seeds array<long>, times array<int>"), "items")
    slots = items.select(F.explode("seeds").alias("seed")).select(F.shiftrightunsigned("seed", 64 - BITS).alias("slot")).distinct()
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[slots.toPandas()["slot"].to_numpy(dtype=np.int64)] = True
    sizes = sorted(r["size"] for r in items.where(f"size BETWEEN 1 AND {SEED - 1}").select("size").distinct().collect())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    id_type = texts.schema["id"].dataType.simpleString()
    hits = texts.mapInArrow(_hits(np.packbits(bitmap).tobytes(), sizes), f"id {id_type}, places binary, words binary, seeds array<long>")
    hits = materialize(hits.withColumn("copy", F.xxhash64("places", "words")), "hits")
    seeds = items.select("item", "size", F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("item", "size", "s.times", F.col("s.seeds").alias("seed"))
    shared = hits.select("id", "copy", F.explode("seeds").alias("seed")).join(seeds, "seed")
    # Each word that tiles can cover stands in a place of a shared seed; the item may repeat a seed.
    pairs = shared.groupBy("id", "copy", "item").agg(F.sum("times").alias("n"), F.max("size").alias("size"))
    pairs = pairs.where(F.col("n") * SEED >= coverage * F.col("size")).select("id", "copy", "item")
    both = pairs.join(hits.select("id", "copy", "places", "words").dropDuplicates(["id", "copy"]), ["id", "copy"]).join(
        items.select("item", "size", F.col("words").alias("item_words")), "item")
    tiled = both.select("id", "item", "size", "places", "words", "item_words").mapInArrow(
        _tiled, f"id {id_type}, item {item_type}, size int, tiles int, covered int, longest int")
    held = tiled.withColumn("coverage", F.col("covered") / F.col("size")).where(F.col("coverage") >= coverage)
    best = held.groupBy("id", "item").agg(F.max(F.struct("coverage", "longest", "tiles", "covered", "size")).alias("best"))
    return best.select("id", "item", "best.size", "best.tiles", "best.covered", "best.longest", "best.coverage")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, with all columns, whose id holds no test item."""
    gone = matches(docs, benchmark, id_col, text_col, **how).select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


@query("op10_benchmark_tiling")
def op10_benchmark_tiling(spark, sf_dir):
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("size").alias("item_words"), F.col("covered").alias("covered_words"),
        "tiles", F.col("longest").alias("longest_tile"), "coverage")
