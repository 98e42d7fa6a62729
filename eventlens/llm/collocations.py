"""Phrase collocations from depth-truncated suffix subtrees (operator 12).

A text is cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words. The suffixes of all pieces, cut after ``DEPTH`` words or before
the first word, pair or triple of words that is too rare for any phrase, are partitioned vertically in the manner of ERA: the suffixes below a word prefix
form a subtree, a prefix with more suffixes than ``BUDGET`` is split by its next word, and prefixes are packed into groups that
fit the budget. Each group is built by itself in one task: its sorted suffixes are its leaves, runs of equal words at each depth are
its nodes, and a phrase occurs as often as the leaves below its node in total. The few nodes above a split prefix have leaves in several groups;
their totals are added up. A task counts equal suffixes before the shuffle for as long as its distinct ones fit, so that a prefix of full depth
is one row for each such part however frequent it is.

Words are counted straight from the texts. The token table, which all later passes read, is written after that: a word too rare for any phrase stands
as the end of a piece does, and a row holds its distinct words once and 32-bit places in them, by count and compressed.

Prefixes are counted and packed by hash slots (``2 ** SLOT_BITS`` for each depth), so what reaches the driver and the tasks has a fixed size: a
slot stands for all prefixes that fall into it, which are split together. Suffixes are cut by bitmaps: of the slots of frequent words, and of
the slots where pairs, then triples of what passed before, add up to the least count. A rare one that they let through costs work and changes nothing, since nodes below
the least count are dropped.

NULL texts count as empty, a NULL language as ``und``; empty texts and tables give no rows, texts of any length are taken whole (in
rows that overlap by ``DEPTH - 1`` words). Repeated rows count each time; ids and other columns are not looked at. Of cuts with the
same floored score the smallest counts; phrases with equal score and count are ordered by their UTF-8 bytes. Words are 64-bit hashes until the
last step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import configure, cut_up, query, release, sliced, table, whole_groups
from eventlens.llm.words import LOWER, mix, words_of
from eventlens.session import materialize

#: Longest phrase in words, fewest occurrences of a phrase, phrases of a language.
DEPTH, LEAST, TOP = 5, 100, 2000
#: Suffixes of a group; words of a row of the token table; suffixes or words that a task holds before it counts equal ones.
BUDGET, STREAM, CHUNK = 1 << 20, 1 << 15, 1 << 18
#: Words of a row of the packed token table (under twice as many); words or distinct suffixes of all languages that a task holds at once.
ROW, HELD = 1 << 17, 1 << 19
#: Bytes of an Arrow batch into Python; rows of numbers of one out of it, and suffixes of a row. They bound what workers and the JVM hold at once.
PASSED, ROWS, PIECE = 1 << 20, 1 << 14, 1 << 14
#: Slots (powers of two) of the prefix histogram of each depth, of the bitmap of frequent words, and of the counters of pairs and triples in how many cells.
SLOT_BITS, WORD_BITS, GRAM_BITS, CELL_BITS = 16, 24, 23, 8
#: Lengths of the runs of words that are counted in slots before suffixes are cut.
GRAMS = (2, 3)

IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[[0x20, 0x09]] = True

_TOKENS = "lang string, own int, stream binary"
_PACKED = "lang string, own int, size int, words binary, places binary"
_PLACE = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """The words of each language in a slice of the texts in order, with a 0 before each piece."""
    for batch in sliced(batches, "text"):
        words = words_of(batch.column("text"), IS_GAP)
        if not len(words.hash):
            continue
        names, code = np.unique(np.array(batch.column("lang").to_pylist(), dtype=str), return_inverse=True)
        lang = np.repeat(code, np.diff(words.first))
        hashes = np.maximum(words.hash, np.uint64(1))
        breaks = np.concatenate([[0], np.cumsum(IS_BREAK[words.data])])
        opens = np.append(True, breaks[words.begin[1:]] > breaks[words.end[:-1]])
        opens[words.first[:-1][np.diff(words.first) > 0]] = True
        for i, name in enumerate(names.tolist()):
            mine = np.flatnonzero(lang == i)
            if len(mine):
                yield name, np.insert(hashes[mine], np.flatnonzero(opens[mine]), 0)


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all words of a language in order with a 0 between pieces; the last of the next row are repeated."""
    for lang, stream in _read(batches):
        for a in range(0, len(stream), STREAM):
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang], pa.string()), "own": pa.array([min(STREAM, len(stream) - a)], pa.int32()),
                "stream": pa.array([stream[a : a + STREAM + DEPTH - 1].tobytes()], pa.binary())})


class _Held:
    """Arrays by language; a language is given back once it has ``most`` entries, the largest once all have ``total``."""

    def __init__(self, most: int, total: int) -> None:
        self.most, self.total, self.parts, self.size = most, total, {}, {}

    def add(self, lang: str, some: np.ndarray) -> Iterator[tuple[str, list[np.ndarray]]]:
        self.parts.setdefault(lang, []).append(some)
        self.size[lang] = self.size.get(lang, 0) + len(some)
        while self.size and (max(self.size.values()) >= self.most or sum(self.size.values()) >= self.total):
            largest = max(self.size, key=self.size.get)
            del self.size[largest]
            yield largest, self.parts.pop(largest)

    def all(self) -> Iterator[tuple[str, list[np.ndarray]]]:
        yield from self.parts.items()


def _packed(bitmap: bytes):
    """Rows of the packed token table: as ``_tokens``, but words that are not in the bitmap stand as a 0, and a run of those is one."""

    def packed(lang: str, some: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        stream = np.concatenate(some)
        step = -(-len(stream) // max(1, len(stream) // ROW))
        for a in range(0, len(stream), step):
            words, at, n = np.unique(stream[a : a + step + DEPTH - 1], return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            planes = np.ascontiguousarray(place[at].view(np.uint8).reshape(-1, 4).T)  # the upper bytes of most places are 0
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang], pa.string()), "own": pa.array([min(step, len(stream) - a)], pa.int32()), "size": pa.array([len(at)], pa.int32()),
                "words": pa.array([words[order].tobytes()], pa.binary()), "places": pa.array([pa.compress(planes, "zstd", asbytes=True)], pa.binary())})

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = np.frombuffer(bitmap, np.uint8), _Held(ROW, HELD)
        for lang, words in _read(batches):
            words = np.where(_in_bitmap(words, _salt(lang), known), words, np.uint64(0))
            for full in held.add(lang, words[np.append(True, words[:-1] != 0) | (words != 0)]):
                yield from packed(*full)
        for rest in held.all():
            yield from packed(*rest)
        release()

    return work


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(lang, own, words) of the rows of a token table, packed or not."""
    for batch in batches:
        lang, own = batch.column("lang").to_pylist(), batch.column("own").to_pylist()
        if "stream" in batch.schema.names:
            yield from zip(lang, own, (np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("stream")), strict=True)
            continue
        for name, n, size, words, places in zip(lang, own, batch.column("size").to_pylist(), batch.column("words"), batch.column("places"), strict=True):
            planes = np.frombuffer(pa.decompress(places.as_buffer(), 4 * size, "zstd"), np.uint8).reshape(4, -1)
            yield name, n, np.frombuffer(words.as_buffer(), np.uint64)[np.ascontiguousarray(planes.T).view(np.uint32).ravel()]


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, n) of a task's words; a word may come more than once."""
    held: dict[str, list] = {}

    def drained(lang: str) -> Iterator[pa.RecordBatch]:
        some = held.pop(lang)
        words, at = np.unique(np.concatenate([w for w, _ in some]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n for _, n in some])).astype(np.int64)
        yield from cut_up(pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()), "word": words.view(np.int64), "n": n}), ROWS)

    for lang, own, words in _rows(batches):
        words = words[:own]
        held.setdefault(lang, []).append(np.unique(words[words != 0], return_counts=True))
        if sum(len(w) for w, _ in held[lang]) > CHUNK:
            yield from drained(lang)
    for lang in list(held):
        yield from drained(lang)
    release()


def _spelt(bitmap: bytes):
    """Rows (lang, word, spelt) of words whose slot is in the bitmap; a word may come more than once."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = np.frombuffer(bitmap, np.uint8), set()
        for batch in sliced(batches, "text"):
            words = words_of(batch.column("text"), IS_GAP)
            hashes = np.maximum(words.hash, np.uint64(1))
            names, code = np.unique(np.array(batch.column("lang").to_pylist(), dtype=str), return_inverse=True)
            lang = np.repeat(code, np.diff(words.first))
            for i, name in enumerate(names.tolist()):
                mine = np.flatnonzero(lang == i)
                word, at = np.unique(hashes[mine], return_index=True)
                hit = _in_bitmap(word, _salt(name), known)
                new = [(w, x) for w, x in zip(word[hit].tolist(), mine[at[hit]].tolist(), strict=True) if (i, w) not in seen]
                if len(seen) < CHUNK:
                    seen.update((i, w) for w, _ in new)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([name] * len(new), pa.string()), "word": np.array([w for w, _ in new], np.uint64).view(np.int64),
                    "spelt": pa.array([bytes(LOWER[words.data[words.begin[x] : words.end[x]]]).decode() for _, x in new], pa.string())})

    return work


def _salt(lang: str) -> np.uint64:
    return mix(np.frombuffer(lang.encode().ljust(-(-len(lang.encode()) // 8) * 8 + 8, b"\0"), np.uint64)).sum(dtype=np.uint64)


def _top_bits(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _prefix(suffixes: np.ndarray, depth: int, salt: np.uint64) -> np.ndarray:
    """Hashes of the first ``depth`` words."""
    total = np.full(len(suffixes), salt, np.uint64)
    for d in range(depth):
        total += suffixes[:, d] * _PLACE[d]
    return mix(total)


def _in_bitmap(words: np.ndarray, salt: np.uint64, bitmap: np.ndarray) -> np.ndarray:
    slot = _top_bits(mix(words + salt), WORD_BITS)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 != 0


def _passing(words: np.ndarray, salt: np.uint64, bitmaps: list[np.ndarray], overlap: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length in ``GRAMS`` with a bitmap whether the run of words at each place passes, 0 standing between pieces.

    Then the slots of the runs of the first length without a bitmap whose shorter runs pass, but for those that start in the last ``overlap`` words.
    """
    padded = np.append(words, np.zeros(DEPTH, np.uint64))
    whole, passing = padded != 0, []
    before = whole
    for k, bitmap in zip(GRAMS, [*bitmaps, None], strict=False):
        alive = np.append(before[1:], False) & before
        at = np.flatnonzero(alive)
        total = np.full(len(at), salt, np.uint64)
        for d in range(k):
            total += padded[at + d] * _PLACE[d]
        slot = _top_bits(mix(total), GRAM_BITS)
        if bitmap is None:
            return passing, slot[at < len(words) - overlap]
        alive[at] = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 != 0
        passing.append(alive)
        before = alive
    return passing, np.zeros(0, np.int64)


def _suffixes(words: np.ndarray, own: int, salt: np.uint64, bitmap: np.ndarray, *grams: np.ndarray) -> np.ndarray:
    """Truncated suffixes that start with a frequent word, 0 behind their end."""
    words = np.where(_in_bitmap(words, salt, bitmap), words, np.uint64(0))
    passing, _ = _passing(words, salt, list(grams))
    padded = np.append(words, np.zeros(DEPTH, np.uint64))
    start = np.flatnonzero(words[:own])
    out = np.zeros((len(start), DEPTH), np.uint64)
    out[:, 0] = padded[start]
    alive = np.ones(len(start), bool)
    for d in range(1, DEPTH):
        for k, passes in zip(GRAMS, passing, strict=True):
            if d >= k - 1:
                alive &= passes[start + d - k + 1]
        out[:, d] = padded[start + d] * alive
    return out


def _gram_counts(known: tuple[bytes, ...]):
    """Rows (cell, counts) of a task: how many runs of words of the next length fall into each slot."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, total, held = [np.frombuffer(x, np.uint8) for x in known], np.zeros(1 << GRAM_BITS, np.uint8), []

        def add() -> None:
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            total[slot] = np.minimum(total[slot] + n, 255)
            held.clear()

        for lang, own, words in _rows(batches):
            salt = _salt(lang)
            words = np.where(_in_bitmap(words, salt, bitmaps[0]), words, np.uint64(0))
            held.append(_passing(words, salt, bitmaps[1:], len(words) - own)[1])
            if sum(map(len, held)) > CHUNK:
                add()
        if held:
            add()
        yield from _cells(total)
        release()

    return work


def _cells(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counters as rows (cell, counts); nothing where all are zero."""
    parts = [(i, x) for i, x in enumerate(total.reshape(1 << CELL_BITS, -1)) if x.any()]
    if parts:
        cells = pa.RecordBatch.from_pydict({"cell": pa.array([i for i, _ in parts], pa.int64()), "counts": pa.array([x.tobytes() for _, x in parts], pa.binary())})
        yield from cut_up(cells, max(1, PASSED // parts[0][1].nbytes))


def _added(kind: type, finish):
    """Rows (cell, counts): the counters of each cell added up and passed through ``finish``."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, counts in zip(batch.column("cell").to_pylist(), batch.column("counts"), strict=True):
                totals[cell] = totals.get(cell, 0) + np.frombuffer(counts.as_buffer(), kind).astype(np.int64)
        yield pa.RecordBatch.from_pydict({
            "cell": pa.array(list(totals), pa.int64()), "counts": pa.array([finish(x).tobytes() for x in totals.values()], pa.binary())})

    return work


def frequent_runs(tokens: DataFrame, bitmap: bytes, least: int) -> tuple[bytes, ...]:
    """``bitmap`` and for each length in ``GRAMS`` one of ``2 ** GRAM_BITS`` slots: where runs that occur ``least`` times fall, and others by chance.

    A task counts up to 255 in a slot, so no more than that is asked for.
    """
    known, enough = (bitmap,), min(least, 255)
    for _ in GRAMS:
        counts = tokens.mapInArrow(_gram_counts(known), "cell long, counts binary").repartition("cell")
        bits = np.zeros((1 << CELL_BITS, 1 << (GRAM_BITS - CELL_BITS - 3)), np.uint8)
        for row in counts.mapInArrow(_added(np.uint8, lambda x: np.packbits(x >= enough, bitorder="little")), "cell long, counts binary").collect():
            bits[row["cell"]] = np.frombuffer(row["counts"], np.uint8)
        known += (bits.tobytes(),)
    return known


def _counted(suffixes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes in sorted order and their numbers."""
    if not len(suffixes):
        return suffixes, np.zeros(0, np.int64)
    order = np.lexsort(suffixes.T[::-1])
    rows = suffixes[order]
    start = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    total = np.diff(np.append(start, len(rows))) if times is None else np.add.reduceat(times[order], start)
    return rows[start], total


def _streams(batches: Iterable[pa.RecordBatch], known: tuple[bytes, ...]) -> Iterator[tuple[str, np.uint64, np.ndarray]]:
    bitmaps = [np.frombuffer(x, np.uint8) for x in known]
    for lang, own, words in _rows(batches):
        salt = _salt(lang)
        yield lang, salt, _suffixes(words, own, salt, *bitmaps)


def _split(suffixes: np.ndarray, salt: np.uint64, plan: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Group of each suffix, and the slot of the first depth without a plan; -1 where there is none."""
    group, slot = np.full(len(suffixes), -1), np.full(len(suffixes), -1)
    left = np.arange(len(suffixes))
    for depth in range(1, DEPTH + 1):
        found = _top_bits(_prefix(suffixes[left], depth, salt), SLOT_BITS)
        if depth > len(plan):
            slot[left] = found
            break
        group[left] = plan[depth - 1][found]
        left = left[group[left] < 0]
    return group, slot


def _histogram(known: tuple[bytes, ...], plan: list[np.ndarray]):
    """Rows (cell, counts): suffixes of this task by the slot of their next undecided prefix."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for _, salt, suffixes in _streams(batches, known):
            _, slot = _split(suffixes, salt, plan)
            total += np.bincount(slot[slot >= 0], minlength=len(total))
        yield from _cells(total)
        release()

    return work


def vertical_partition(tokens: DataFrame, known: tuple[bytes, ...], budget: int = BUDGET) -> list[np.ndarray]:
    """Plan of the groups, which are numbered by the depth of their prefixes: for each depth the group of every prefix slot, -1 where its suffixes are above ``budget`` and the next word decides.

    Slots of the last depth are never split: equal suffixes are counted before they travel.
    """
    plan, groups = [], 0
    for depth in range(1, DEPTH + 1):
        counts = tokens.mapInArrow(_histogram(known, plan), "cell long, counts binary").repartition("cell")
        size = np.zeros((1 << CELL_BITS, 1 << (SLOT_BITS - CELL_BITS)), np.int64)
        for row in counts.mapInArrow(_added(np.int64, lambda x: x), "cell long, counts binary").collect():
            size[row["cell"]] = np.frombuffer(row["counts"], np.int64)
        size = size.ravel()
        fits = (size <= budget) if depth < DEPTH else np.ones(len(size), bool)
        packed = np.cumsum(np.where(fits, np.minimum(size, budget), 0)) // budget + groups
        plan.append(np.where(fits, packed, -1))
        groups = int(packed[-1]) + 1
        if fits.all():
            break
    return plan


def _parts(known: tuple[bytes, ...], plan: list[np.ndarray]):
    """Rows (grp, lang, suffixes, times): distinct suffixes of a part of a task's text that belong to a group."""

    def cut(lang: str, rows: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        group, _ = _split(rows, _salt(lang), plan)
        order = np.argsort(group, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else []
        parts = [p[a : a + PIECE] for p in (np.split(order, start[1:]) if len(order) else []) for a in range(0, len(p), PIECE)]
        while parts:
            size = np.cumsum([len(p) for p in parts])
            now, parts = parts[: (n := max(1, int(np.searchsorted(size, PIECE, "right"))))], parts[n:]
            yield pa.RecordBatch.from_pydict({
                "grp": pa.array([int(group[p[0]]) for p in now], pa.int64()), "lang": pa.array([lang] * len(now), pa.string()),
                "suffixes": pa.array([rows[p].tobytes() for p in now], pa.binary()), "times": pa.array([times[p].tobytes() for p in now], pa.binary())})

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held = _Held(CHUNK, HELD)

        def count(lang: str, some: list[np.ndarray]) -> None:
            rows, times = _counted(np.concatenate(some))
            if lang in counted:
                rows, times = _counted(np.concatenate([counted[lang][0], rows]), np.concatenate([counted[lang][1], times]))
            counted[lang] = rows, times

        for lang, _, suffixes in _streams(batches, known):
            for full in held.add(lang, suffixes):
                count(*full)
            while sum(len(rows) for rows, _ in counted.values()) > HELD:
                largest = max(counted, key=lambda x: len(counted[x][0]))
                yield from cut(largest, *counted.pop(largest))
        for rest in held.all():
            count(*rest)
        for lang, some in counted.items():
            yield from cut(lang, *some)
        release()

    return work


def subtree(suffixes: np.ndarray, times: np.ndarray, least: int, split: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of the subtree of sorted distinct suffixes, by depth: (depth, words, count, counts of the nodes above).

    Nodes of fewer than ``least`` leaves are left out below the first ``split`` depths.
    """
    above = np.zeros((len(suffixes), 0), np.int64)
    opens = np.zeros(len(suffixes), bool)
    opens[:1] = True
    for d in range(suffixes.shape[1]):
        opens[1:] |= suffixes[1:, d] != suffixes[:-1, d]
        start = np.flatnonzero(opens)
        if not len(start):
            return
        total = np.add.reduceat(times, start)
        above = np.column_stack([above, np.repeat(total, np.diff(np.append(start, len(suffixes))))])
        kept = start[((total >= least) | (d < split)) & (suffixes[start, d] != 0)]
        yield d + 1, np.ascontiguousarray(suffixes[kept, : d + 1]), above[kept, d], np.ascontiguousarray(above[kept, :d])


def _one_by_one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    for some in whole_groups(batches, ["grp", "lang"]):
        keys = list(zip(some.column("grp").to_pylist(), some.column("lang").to_pylist(), strict=True))
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            yield some.slice(a, b - a)


def _subtrees(least: int, budget: int, plan: list[np.ndarray]):
    """Rows (lang, words, n, above, whole) of the nodes of each group.

    Nodes above the group's prefix are not ``whole``: their leaves here are only some of all, in ``above`` they are NULL.
    """
    last = [int(x.max()) for x in plan]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _one_by_one(batches):
            rows, times, held, n = np.zeros((0, DEPTH), np.uint64), np.zeros(0, np.int64), [], 0

            def merged():
                parts = [(rows, times), *held]
                return _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

            for some, number in zip(group.column("suffixes"), group.column("times"), strict=True):
                some = np.frombuffer(some.as_buffer(), np.uint64).reshape(-1, DEPTH)
                held.append((some, np.frombuffer(number.as_buffer(), np.int64)))
                n += len(some)
                if n > budget:
                    (rows, times), held, n = merged(), [], 0
            rows, times = merged()
            split = int(np.searchsorted(last, group.column("grp")[0].as_py()))
            for depth, words, count, above in subtree(rows, times, least, split):
                partial = np.broadcast_to(np.arange(depth - 1) < split, above.shape).ravel()
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * w), pa.array(x, pa.int64(), mask=m))
                         for x, w, m in ((words.ravel().view(np.int64), depth, None), (above.ravel(), depth - 1, partial))]
                yield from cut_up(pa.RecordBatch.from_pydict({
                    "lang": pa.array([group.column("lang")[0].as_py()] * len(count), pa.string()), "words": lists[0], "n": count, "above": lists[1],
                    "whole": pa.array([depth > split] * len(count), pa.bool_())}), ROWS)

    return work


def _bitmap(frequent: DataFrame) -> bytes:
    """Bitmap of the frequent words' slots; at most ``2 ** (WORD_BITS - 6)`` rows reach the driver."""

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = np.array([_salt(x) for x in batch.column("lang").to_pylist()], np.uint64)
            slot = _top_bits(mix(batch.column("word").to_numpy().view(np.uint64) + salt), WORD_BITS)
            yield pa.RecordBatch.from_pydict({"cell": slot >> 6, "bits": np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64)).view(np.int64)})

    cells = frequent.select("lang", "word").mapInArrow(slots, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(1 << (WORD_BITS - 6), np.uint64)
    words[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    return words.tobytes()


def word_counts(rows: DataFrame, work=_word_counts) -> DataFrame:
    """Rows (lang, word, n)."""
    return rows.mapInArrow(work, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def phrase_counts(tokens: DataFrame, bitmap: bytes, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """Rows (lang, words, n, above): all phrases of 1 to ``DEPTH`` words that occur ``least`` times.

    ``above`` counts their shorter prefixes, NULL where a prefix was split.
    """
    known = frequent_runs(tokens, bitmap, least)
    plan = vertical_partition(tokens, known, budget)
    parts = tokens.mapInArrow(_parts(known, plan), "grp long, lang string, suffixes binary, times binary")
    grouped = parts.repartition("grp").sortWithinPartitions("grp", "lang")
    nodes = grouped.mapInArrow(_subtrees(least, budget, plan), "lang string, words array<long>, n long, above array<long>, whole boolean")
    if len(plan) == 1:
        return nodes.drop("whole")
    nodes = materialize(nodes, "nodes")
    stems = nodes.where("NOT whole").groupBy("lang", "words", "above").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return nodes.where("whole").drop("whole").unionByName(stems)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = materialize(word_counts(texts, lambda batches: _word_counts(_tokens(batches))), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    bitmap = _bitmap(counts.where(F.col("n") >= least))
    tokens = materialize(texts.mapInArrow(_packed(bitmap), _PACKED), "tokens")
    phrases = materialize(phrase_counts(tokens, bitmap, least, budget), "phrases")
    longer = phrases.where(F.size("words") > 1).select("lang", "words", F.col("n").alias("a"), "above", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = longer.select(
        "lang", "words", "a", "k", F.element_at("above", F.col("k")).alias("l"), F.expr("slice(words, k + 1, size(words) - k)").alias("rest"))
    split = cuts.where("l IS NULL").drop("l").withColumn("first", F.expr("slice(words, 1, k)")).join(
        phrases.select("lang", F.col("words").alias("first"), F.col("n").alias("l")), ["lang", "first"]).drop("first")
    cuts = cuts.where("l IS NOT NULL").unionByName(split).join(phrases.select("lang", F.col("words").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = materialize(cuts, "cuts")
    # A phrase inside a longer one with the same count is also inside one that is longer by one word, since counts never rise.
    inner = cuts.where("size(words) > 2")
    inside = inner.where("k = 1 AND r = a").select("lang", F.col("rest").alias("words")).unionByName(
        inner.where("k = size(words) - 1 AND l = a").select("lang", F.expr("slice(words, 1, k)").alias("words"))).distinct()
    score = F.expr("(CAST(1000 * a AS DECIMAL(18,0)) * CAST(total AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = cuts.join(totals, "lang").select("lang", "words", "a", "total", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("lang", "words").agg(F.min("cut").alias("cut"), F.first("a").alias("a"), F.first("total").alias("total"))
    best = best.join(inside, ["lang", "words"], "left_anti").select("lang", "words", "a", F.col("total").alias("n"), "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a")]
    # Ties at the border stay until their words are known.
    first = materialize(best.withColumn("tied", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("tied") <= top), "first")
    wanted = first.select("lang", F.explode("words").alias("word")).distinct()
    spelt = texts.mapInArrow(_spelt(_bitmap(wanted)), "lang string, word long, spelt string")
    spelt = spelt.join(wanted, ["lang", "word"], "left_semi").dropDuplicates(["lang", "word"])
    said = first.select("*", F.posexplode("words").alias("pos", "word")).join(spelt, ["lang", "word"])
    said = said.groupBy("lang", "words", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("pos", "spelt"))).alias("s"))
    said = said.withColumn("phrase", F.array_join("s.spelt", " "))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    return said.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
grams AS (SELECT lang, w[i : i + k - 1] AS g, count(*) AS f FROM
  (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) s WHERE len(w) >= k) x
  GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, g, f FROM grams WHERE len(g) > 1),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM cand) c JOIN totals t ON t.lang = c.lang
  JOIN grams x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN grams y ON y.lang = c.lang AND y.g = c.g[k + 1 :]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT lang, g[i : i + k - 1] AS g, f FROM
  (SELECT lang, g, f, k, unnest(range(1, len(g) - k + 2)) AS i FROM cand, (SELECT unnest(range(2, 5)) AS k) s WHERE k < len(g)) z),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, t.n, b.score FROM best b JOIN totals t ON t.lang = b.lang
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.g = b.g AND i.f >= b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


@query("op12_collocation_subtrees", SQL)
def op12_collocation_subtrees(spark, sf_dir):
    return collocations(table(configure(spark, PASSED), sf_dir, "documents"))
