"""Byte-level BPE encoding and decoding, by DuckDB queries inside each partition (operator 2).

Only words that a task has not met yet are encoded. They become token-position rows, one for each byte. A recursive
query joins neighbours with the merge table, takes each word's leftmost pair of minimum rank, contracts it, and goes
on until no word has a pair left. Decoding joins token rows with the vocabulary and aggregates bytes in order. A
task starts with no words and keeps none for the next, so that its work and memory don't hang on what ran before.

A word of over ``SHORT`` bytes is cut into parts of ``PART`` bytes, which are encoded like words. Two tokens may stand side by side if the encoding
of their bytes is just these two; a row of tokens in which all neighbours may is the encoding of the whole, since no merge ever crosses a border
that it would not cross with the two neighbours alone. So borders of parts are tried, and where neighbours don't fit, a few tokens on both
sides are encoded again as one, more with each round, until all fit. Stretches of over ``SHORT`` bytes that come up there contract equal
minimum pairs together unless the new token could take part in a lower merge (``solo``), which gives what one merge at a time gives. A recursion
stops after as many rounds as its memory allows and starts again from its last rows.

NULL texts count as empty and have no ids. Nothing is shuffled; repeated, long or empty texts need no special care.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterable, Iterator, Set
from itertools import count, pairwise

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from eventlens.llm.common import SLICE, query, release, sliced, table
from eventlens.llm.words import buffers

#: Words of one recursive query, words and bytes that a task remembers, rows that one recursion may gather.
BLOCK, REMEMBERED, REMEMBERED_BYTES, GATHERED = 50_000, 500_000, 64 << 20, 2_000_000

#: Bytes of a word up to which positions fit the packed key of ``ENCODE``.
SHORT = 250

#: Bytes of a part of a longer word; bytes of one query and pairs of tokens remembered.
PART, QUERY_BYTES, PAIRS = 64, 400_000, 500_000

#: Each round: leftmost lowest pair of each word (rank, place and next place packed), whose left row goes and whose
#: right row takes its place; only the two pairs that changed look up the merge table again.
ENCODE = """
WITH RECURSIVE step AS (
  SELECT s.w, s.pos, s.tok, s.npos, s.ntok, m.made, 0 AS round FROM seed s LEFT JOIN merges m ON m.a = s.tok AND m.b = s.ntok
  UNION ALL
  (WITH low AS (
     SELECT w, min((made::BIGINT << 16) | (pos << 8) | npos) AS k FROM step WHERE made IS NOT NULL AND round < $rounds GROUP BY w),
   near AS (SELECT s.*, l.k >> 16 AS made_, (l.k >> 8) & 255 AS left_, l.k & 255 AS right_ FROM step s JOIN low l USING (w)),
   next AS (
     SELECT w, CASE WHEN pos = right_ THEN left_ ELSE pos END AS pos, CASE WHEN pos = right_ THEN made_ ELSE tok END AS tok, npos,
       CASE WHEN npos = left_ THEN made_ ELSE ntok END AS ntok, made, pos = right_ OR npos = left_ AS changed, round + 1 AS round
     FROM near WHERE pos <> left_)
  SELECT n.w, n.pos::INT, n.tok::INT, n.npos, n.ntok::INT, CASE WHEN changed THEN m.made ELSE n.made END, n.round
  FROM next n LEFT JOIN merges m ON m.a = CASE WHEN changed THEN n.tok END AND m.b = n.ntok)
)
SELECT w, pos, tok, npos, ntok, round FROM step JOIN (SELECT w, max(round) AS round FROM step GROUP BY w) USING (w, round)
"""

#: The same for long words. Each round: lowest rank of each word, its places, every other one of touching places, and
#: the contracted rows.
ENCODE_LONG = """
WITH RECURSIVE step AS (
  SELECT w, pos, tok, npos, ntok, 0 AS round FROM seed
  UNION ALL
  (WITH pair AS (SELECT s.w, s.pos, s.npos, m.made, m.solo FROM step s JOIN merges m ON s.tok = m.a AND s.ntok = m.b),
   low AS (SELECT w, min(made) AS made FROM pair GROUP BY w),
   place AS (SELECT p.* FROM pair p JOIN low USING (w, made)),
   touch AS (SELECT *, lag(npos) OVER (PARTITION BY w ORDER BY pos) IS NOT DISTINCT FROM pos AS joined FROM place),
   island AS (SELECT *, max(CASE WHEN joined THEN NULL ELSE pos END) OVER (PARTITION BY w ORDER BY pos) AS start FROM touch),
   chosen AS (
     SELECT w, pos, npos, made FROM (
       SELECT *, row_number() OVER (PARTITION BY w, start ORDER BY pos) AS nth, min(pos) OVER (PARTITION BY w) AS leftmost FROM island)
     WHERE nth % 2 = 1 AND (pos = leftmost OR NOT solo))
   SELECT s.w, s.pos, coalesce(c.made, s.tok),
          CASE WHEN c.w IS NULL THEN s.npos ELSE n.npos END,
          CASE WHEN c.w IS NULL THEN coalesce(f.made, s.ntok) ELSE coalesce(f2.made, n.ntok) END,
          s.round + 1
   FROM step s JOIN low USING (w)
   LEFT JOIN chosen c ON c.w = s.w AND c.pos = s.pos
   LEFT JOIN chosen f ON f.w = s.w AND f.pos = s.npos AND c.w IS NULL
   LEFT JOIN step n ON n.w = s.w AND n.pos = c.npos
   LEFT JOIN chosen f2 ON f2.w = n.w AND f2.pos = n.npos
   WHERE s.round < $rounds AND NOT EXISTS (SELECT 1 FROM chosen d WHERE d.w = s.w AND d.npos = s.pos))
)
SELECT w, pos, tok, npos, ntok, round FROM step JOIN (SELECT w, max(round) AS round FROM step GROUP BY w) USING (w, round)
"""

DECODE = """
SELECT i.w, unhex(string_agg(v.hex, '' ORDER BY i.pos)) AS bytes FROM ids i JOIN vocabulary v ON v.id = i.tok GROUP BY i.w
"""


class Codec:
    """Merge and vocabulary tables of a rank file in an in-process DuckDB."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.token = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        merges, low = [], set()
        for token, made in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    merges.append((a, b, made))
                low.update(r for r in (a, b) if r is not None and r > made)
        a, b, made = (np.array(x, dtype=np.int32) for x in zip(*merges, strict=True))
        merges = pa.table({"a": a, "b": b, "made": made, "solo": np.isin(made, list(low))})
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("rows", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.db.unregister("rows")
        self.known = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.known[list(ranks.values())] = True
        self.forget()

    def query(self, sql: str, name: str, rows: pa.Table, **given) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql, params=given or None).to_arrow_table()
        finally:
            self.db.unregister(name)

    def encode_parts(self, parts: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of byte strings of any length, equal ones encoded once, by queries of a bounded size."""
        made: dict[bytes, tuple[int, ...]] = {}
        for long in (False, True):
            waiting, size = [], 0
            own = [p for p in dict.fromkeys(parts) if (len(p) > SHORT) == long]
            for i, part in enumerate(own):
                waiting.append(part)
                size += len(part)
                if size >= QUERY_BYTES or i == len(own) - 1:
                    made.update(zip(waiting, (tuple(np.frombuffer(x, "<i4").tolist()) for x in self.encode_words(waiting)), strict=True))
                    waiting, size = [], 0
        return [made[p] for p in parts]

    def fit(self, pairs: Iterable[tuple[int, int]]) -> None:
        """Learn which pairs of tokens may stand side by side."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        new = [p for p in dict.fromkeys(pairs) if p not in self.pairs]
        for pair, ids in zip(new, self.encode_parts([self.token[a] + self.token[b] for a, b in new]), strict=True):
            self.pairs[pair] = ids == pair

    def encode_long(self, words: list[bytes]) -> list[bytes]:
        """Ids of long words: parts of each, encoded again around the borders where neighbours don't fit."""
        cut = [[w[i : i + PART] for i in range(0, len(w), PART)] for w in words]
        flat = iter(self.encode_parts([p for parts in cut for p in parts]))
        rows = [[list(next(flat)) for _ in parts] for parts in cut]
        turn, open_ = 0, [(w, set(range(1, len(segments)))) for w, segments in enumerate(rows)]
        while open_:
            reach = 2 << turn // 4
            self.fit((rows[w][j - 1][-1], rows[w][j][0]) for w, borders in open_ for j in borders)
            jobs, going = [], []
            for w, borders in open_:
                wrong = sorted(j for j in borders if not self.pairs[rows[w][j - 1][-1], rows[w][j][0]])
                taken, chosen = -1, []
                for j in wrong:
                    if j - 1 > taken:  # a segment takes part in one repair of a round
                        taken, right = j, list(rows[w][j])
                        while len(right) < reach and taken + 1 < len(rows[w]):
                            taken += 1
                            right += rows[w][taken]
                        chosen.append((j, taken, right))
                        jobs.append(b"".join(map(self.token.__getitem__, rows[w][j - 1][-reach:] + right[:reach])))
                if wrong:
                    going.append((w, set(wrong), chosen))
            made = iter(self.encode_parts(jobs))
            open_ = []
            for w, wrong, chosen in going:
                old, new, borders, at = rows[w], [], set(), 0
                for j, last, right in chosen:
                    new += old[at : j - 1]
                    borders |= {len(new) - (j - 1) + b for b in wrong if at < b < j - 1 or b == j - 1 > at}
                    middle = list(next(made))
                    for part in (old[j - 1][:-reach], middle, right[reach:]):
                        if part:
                            borders.add(len(new))
                            new.append(part)
                    borders.add(len(new))
                    at = last + 1
                borders |= {len(new) - at + b for b in wrong if b > at}
                rows[w] = new + old[at:]
                open_.append((w, {b for b in borders if 0 < b < len(rows[w])}))
            turn += 1
        return [np.array([t for segment in segments for t in segment], "<i4").tobytes() for segments in rows]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; all words are short or all are long."""
        raw = words
        n = np.array([len(x) for x in raw])
        end = np.cumsum(n)
        tok = self.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        pos = (np.arange(len(tok)) - np.repeat(end - n, n)).astype(np.int32)
        last = np.zeros(len(tok), dtype=bool)
        last[end - 1] = True
        ntok = np.append(tok[1:], 0).astype(np.int32)
        seed = pa.table({
            "w": np.repeat(np.arange(len(words), dtype=np.int32), n), "pos": pos, "tok": tok,
            "npos": pa.array(pos + 1, mask=last), "ntok": pa.array(ntok, mask=last),
        })
        done = []
        while seed.num_rows:
            rounds = max(8, GATHERED // seed.num_rows)
            rows = self.query(ENCODE if n.max() <= SHORT else ENCODE_LONG, "seed", seed, rounds=rounds)
            going = pc.equal(rows["round"], rounds)
            done.append(rows.filter(pc.invert(going)).select(["w", "pos", "tok"]))
            seed = rows.filter(going).drop(["round"])
        w, pos, tok = (np.concatenate([np.asarray(t[c]) for t in done]) for c in ("w", "pos", "tok"))
        order = np.lexsort((pos, w))
        at = (4 * np.searchsorted(w[order], np.arange(len(words) + 1))).tolist()
        ids = tok[order].astype("<i4").tobytes()
        return [ids[a:b] for a, b in pairwise(at)]

    def forget(self) -> None:
        """Drop all remembered words; every task starts and ends with none."""
        self.place: dict[str, int] = {}
        self.ids = self.raw = pa.array([], pa.binary())
        self.uses = np.zeros(0, dtype=np.int64)

    def shrink(self) -> None:
        """Keep the more used half of the remembered words."""
        keep = np.sort(np.argpartition(-self.uses, REMEMBERED // 2)[: REMEMBERED // 2])
        words = list(self.place)
        self.place = {words[i]: at for at, i in enumerate(keep.tolist())}
        self.ids, self.raw, self.uses = self.ids.take(pa.array(keep)), self.raw.take(pa.array(keep)), self.uses[keep]

    def learn(self, words: Set[str]) -> None:
        """Encode and decode the words not met yet; ``place`` is where ``ids`` and ``raw`` hold a word's results."""
        if self.ids.nbytes + self.raw.nbytes > REMEMBERED_BYTES:
            self.forget()
        if len(self.place) > REMEMBERED:
            self.shrink()
        new = list(words - self.place.keys())
        for a in range(0, len(new), BLOCK):
            some = [[], []]
            for word in new[a : a + BLOCK]:
                some[len(word.encode()) > SHORT].append(word)
            for group in filter(None, some):
                raw = [word.encode() for word in group]
                ids = self.encode_words(raw) if len(raw[0]) <= SHORT else self.encode_long(raw)
                self.place.update(zip(group, range(len(self.place), len(self.place) + len(group)), strict=True))
                self.ids = pa.concat_arrays([self.ids, pa.array(ids, pa.binary())])
                self.raw = pa.concat_arrays([self.raw, pa.array(self.decode(ids), pa.binary())])
        self.uses = np.append(self.uses, np.zeros(len(self.place) - len(self.uses), dtype=np.int64))

    def encode_texts(self, texts: list[str]) -> tuple[pa.ListArray, pa.BinaryArray]:
        """Ids of whole texts, and the bytes they decode to: those of their words, one after the other."""
        number: dict[str, int] = defaultdict(count().__next__)
        numbers = [np.zeros(0, dtype=np.int32)]
        for text in texts:
            words = self.split(text)
            numbers.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
        self.learn(number.keys())
        at = np.cumsum([len(some) for some in numbers]).astype(np.int64)
        flat = np.concatenate(numbers)
        own = np.fromiter(map(self.place.__getitem__, number), dtype=np.int64, count=len(number))
        self.uses[own] += np.bincount(flat, minlength=len(own))
        place = own[flat]
        (ids, ids_at), (raw, raw_at) = (buffers(some.take(pa.array(place))) for some in (self.ids, self.raw))
        ids_at, raw_at = (ids_at[at] // 4).astype(np.int32), raw_at[at].astype(np.int32)
        return (
            pa.ListArray.from_arrays(ids_at, pa.array(ids.view("<i4"))),
            pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(raw_at), pa.py_buffer(raw)]),
        )

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """As ``encode_texts``, with the ids as 4-byte integers in bytes."""
        ids, raw = self.encode_texts(texts)
        return [(np.array(some, dtype="<i4").tobytes(), bytes_) for some, bytes_ in zip(ids.to_pylist(), raw.to_pylist(), strict=True)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids; an unknown id is an error."""
        out = [b""] * len(ids)
        tok = np.frombuffer(b"".join(ids), dtype="<i4")
        w = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) // 4 for x in ids])
        if len(tok) and not (tok.min() >= 0 and tok.max() < len(self.known) and self.known[tok].all()):
            raise ValueError("unknown token id")
        for a in range(0, len(tok), GATHERED):
            part = slice(a, a + GATHERED)
            rows = pa.table({"w": w[part], "pos": np.arange(len(tok[part]), dtype=np.int32), "tok": tok[part]})
            for i, text in zip(*self.query(DECODE, "ids", rows).to_pydict().values(), strict=True):
                out[i] += text
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each rank file and Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _with_ids(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, decoded: bool) -> DataFrame:
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [StructField("id", picked.schema["id"].dataType), StructField("ids", ArrayType(IntegerType(), False))]
    schema = StructType([*fields, StructField("decoded", BinaryType())] if decoded else fields)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        own.forget()
        for batch in sliced(batches, "text", 2 * SLICE):
            ids, raw = own.encode_texts([text or "" for text in batch.column("text").to_pylist()])
            out = {"id": batch.column("id"), "ids": ids}
            if decoded:
                out["decoded"] = raw
            yield pa.RecordBatch.from_pydict(out)
        own.forget()
        release()

    return picked.mapInArrow(work, schema)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids): the token ids of each whole text, one row for each input row; NULL text has none.

    ``path`` is a rank file that every executor can read.
    """
    return _with_ids(df, id_col, text_col, path, pattern, False)


def encode_and_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with the bytes that the ids decode to in ``decoded``."""
    return _with_ids(df, id_col, text_col, path, pattern, True)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, decoded): the bytes of each row's token ids; NULL or empty ids give no bytes."""
    picked = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast(ArrayType(IntegerType())).alias("ids"))
    schema = StructType([StructField("id", picked.schema["id"].dataType), StructField("decoded", BinaryType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = [np.array(x or [], dtype="<i4").tobytes() for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "decoded": pa.array(own.decode(ids), pa.binary())})

    return picked.mapInArrow(work, schema)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, and SHA-256 of the decimal ids joined by spaces and of the decoded bytes."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode_and_decode(df, path, pattern).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


RANKS = "byte_bpe_50k.tiktoken"


@query("op2_byte_bpe")
def op2_byte_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
