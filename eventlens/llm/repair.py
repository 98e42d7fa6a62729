"""Repair of conversation structure by a Viterbi pass whose chunks run in parallel (operator 13).

The roles of a repaired conversation read ``(s?(ua)+)?``. A dynamic program over four states (nothing yet, after system, after user, after
assistant) finds the cheapest edits: for every row and state the cost of all that follows. Its vectors form a tropical semiring, where
chunks of one conversation can be worked on side by side by rank convergence:

1. Every chunk runs backward from a speculative cost vector.
2. Fix-up passes run a chunk again whose right neighbour's vector came out otherwise than assumed, until the new vectors differ from the old
   ones by a constant only; from there on all differences stay, so the rest of the chunk and all chunks before it hold. Passes end when no
   chunk's first vector moved.
3. The stitched costs drive the trace: from each state in which a chunk may be entered, it takes at every row the ASCII-least edit that keeps the
   cost least; a scan over the chunks picks the real entry, and the pieces are joined.

Conversations of up to ``LONG`` rows and ``LONG_BYTES`` bytes of text travel whole to one task, as one chunk each. Longer ones are range-partitioned by row,
so that no task holds one, and equal rows are counted before that. What must be sequential for them is streamed: the scan over chunk
summaries, and the digest of the repaired text, which SHA-256 can't compute in parts.

NULL columns count as one space (a NULL conversation stays one of its own and comes back as NULL). Rows of equal turn are ordered by role and text;
copies of a row stand together. An empty role, or one that starts with other letters, fits nowhere and is given a role or deleted. Texts of any
length are taken whole; a table without rows gives none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import query, release, table
from eventlens.session import materialize

#: A conversation above either size is cut into chunks; a chunk's most rows and bytes of text.
LONG, LONG_BYTES, CHUNK, CHUNK_BYTES = 4096, 8 << 20, 4096, 4 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role's initial, and the state after an added or changed row.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
CHANGE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Costs behind the last row, and the edits that they stand for.
END, LAST = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
FREE, BLANK, DUPLICATE, TRUNCATED = range(4)

Vector = tuple[int, int, int, int]
Symbol = tuple[str, int]


class Step(NamedTuple):
    """One row read backward: the vector before it less its least value, that value, and the first edits taken in each state."""

    before: Vector
    least: int
    edits: tuple[str, ...]
    after: tuple[int, ...]
    cost: tuple[int, ...]


_steps: dict[tuple[str, int, Vector], Step] = {}


def level(vector: Iterable[int]) -> Vector:
    vector = tuple(vector)
    return tuple(v - min(vector) for v in vector)


def step(initial: str, fault: int, behind: Vector) -> Step:
    """Edits at one row where ``behind`` are the costs after it: in each state the ASCII-least of the cheapest ones, up to the row's own."""
    key = (initial, fault, behind)
    if key in _steps:
        return _steps[key]
    own = []
    for state in range(4):
        ways = [("D", DELETE + behind[state], state, DELETE)]
        if fault not in (BLANK, DUPLICATE):
            extra = CUT if fault == TRUNCATED else 0
            if (state, initial) in STEP:
                ways.append(("K", extra + behind[STEP[state, initial]], STEP[state, initial], extra))
            ways.append(("R", CHANGE + extra + behind[NEXT[state]], NEXT[state], CHANGE + extra))
        own.append(ways)
    cost = [min(w[1] for w in ways) for ways in own]
    for _ in range(3):
        cost = [min(c, INSERT + cost[NEXT[s]]) for s, c in enumerate(cost)]

    def first(state: int) -> tuple[str, int, int]:
        ways = [(w[0], w[2], w[3]) for w in own[state] if w[1] == cost[state]]
        if INSERT + cost[NEXT[state]] == cost[state]:
            ways.append(("I", -1, INSERT))
        edit, after, paid = min(ways)
        if edit != "I":
            return edit, after, paid
        more, after, further = first(NEXT[state])
        return "I" + more, after, paid + further

    found = [first(s) for s in range(4)]
    _steps[key] = Step(level(cost), min(cost), *(tuple(x) for x in zip(*found, strict=True)))
    return _steps[key]


def backward(symbols: list[Symbol], behind: Vector) -> list[Vector]:
    """Level vectors before each row, and behind the last."""
    out = [behind]
    for initial, fault in reversed(symbols):
        out.append(step(initial, fault, out[-1]).before)
    return out[::-1]


def fixed_up(symbols: list[Symbol], assumed: Vector, actual: Vector, before: Vector) -> Vector:
    """First vector of a chunk whose costs behind it are ``actual`` instead of ``assumed``; ``before`` if the two runs become parallel."""
    for initial, fault in reversed(symbols):
        if assumed == actual:
            return before
        assumed, actual = step(initial, fault, assumed).before, step(initial, fault, actual).before
    return actual


def trace(symbols: list[Symbol], behind: Vector, state: int) -> tuple[list[str], int, int]:
    """Edits at each row (insertions before it first), the state after the last, and the cost."""
    vectors, edits, paid = backward(symbols, behind), [], 0
    for (initial, fault), after in zip(symbols, vectors[1:], strict=True):
        taken = step(initial, fault, after)
        edits.append(taken.edits[state])
        paid += taken.cost[state]
        state = taken.after[state]
    return edits, state, paid


def repaired(edits: list[str], rows: Iterable[tuple[str, str]], state: int) -> Iterator[str]:
    """Lines of the repaired rows."""
    for edit, (role, text) in zip(edits, rows, strict=True):
        for letter in edit:
            if letter == "I":
                yield f"{ROLE[state]}:"
                state = NEXT[state]
            elif letter == "K":
                yield f"{role}:{text}"
                state = STEP[state, role[:1]]
            elif letter == "R":
                yield f"{ROLE[state]}:{text}"
                state = NEXT[state]


def _ending(state: int) -> Iterator[str]:
    for _ in LAST[state]:
        yield f"{ROLE[state]}:"
        state = NEXT[state]


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else " "


def is_legal(one: str, two: str) -> bool:
    return (one, two) in (("s", "u"), ("u", "a"), ("a", "u"))


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, copies) after the stated damage."""
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.withColumn("kind", kind).where("kind <> 0").select(
        "conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _fault_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumn("last", F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1)))


def _fault(last: str, repeated: bool) -> int:
    return BLANK if not last else DUPLICATE if repeated else FREE if last in ".!?" else TRUNCATED


_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _whole(kind: pa.DataType):
    """One row for each conversation of sorted rows."""

    def solved(conv, rows: list[tuple]) -> tuple:
        seen, symbols, texts, turns = set(), [], [], []
        for turn, role, text, last, copies in rows:
            for _ in range(copies):
                symbols.append((_initial(role), _fault(last, (role, text) in seen)))
                texts.append((role, text))
                seen.add((role, text))
            if turn is not None:
                turns.append(turn)
        edits, state, cost = trace(symbols, level(END), START)
        lines = [*repaired(edits, texts, START), *_ending(state)]
        faults = [f for _, f in symbols]
        return (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)),
            sum(not is_legal(a[0], b[0]) for a, b in zip(symbols, symbols[1:])), cost + END[state], "".join(edits) + LAST[state],
            hashlib.sha256("\n".join(lines).encode()).hexdigest())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 9
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv", *_NAMES])

        now, rows, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "last", "copies")]
            for conv, *row in zip(*columns, strict=True):
                if rows and conv != now:
                    out.append(solved(now, rows))
                    rows = []
                now = conv
                rows.append(row)
            yield packed(out)
            out = []
        yield packed([solved(now, rows)] if rows else [])
        release()

    return work


# conversations in chunks

def _chunks(kind: pa.DataType):
    """Rows (conv, part, chunk, block): chunks of sorted rows, each as one Arrow file."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size, now, at = [], 0, 0, None, 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for some in held:
                    out.write_batch(some)
            return pa.RecordBatch.from_arrays([
                pa.array([now], kind), pa.array([at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["conv", "chunk", "block"])

        for batch in batches:
            convs, sizes = batch.column("conv").to_pylist(), [len(x) for x in batch.column("text").to_pylist()]
            a = 0
            while a < batch.num_rows:
                if n and convs[a] != now:
                    yield packed()
                    held, n, size, at = [], 0, 0, at + 1
                now, b = convs[a], a
                while b < batch.num_rows and convs[b] == now and n < CHUNK and (size < CHUNK_BYTES or not n):
                    n, size, b = n + 1, size + sizes[b], b + 1
                if b > a:
                    held.append(batch.slice(a, b - a))
                if n >= CHUNK or size >= CHUNK_BYTES:
                    yield packed()
                    held, n, size, at = [], 0, 0, at + 1
                a = b
        if n:
            yield packed()
        release()

    return work


def _unpacked(block: pa.Scalar) -> tuple[list[Symbol], list[tuple]]:
    """Symbols of a chunk's rows, and the rows (turn, role, text, copies).

    All copies but the first of a row are deleted: that never costs more than another edit, and comes first among equal ones.
    """
    some = pa.ipc.open_stream(block.as_buffer()).read_all()
    turn, role, text, last, copies, repeated = (some.column(c).to_pylist() for c in ("turn", "role", "text", "last", "copies", "repeated"))
    return [(_initial(r), _fault(x, again)) for r, x, again in zip(role, last, repeated, strict=True)], list(zip(turn, role, text, copies, strict=True))


def _first_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, assumed, before): speculative costs behind a chunk and before it."""
    for batch in batches:
        before = [list(backward(_unpacked(b)[0], level(END))[0]) for b in batch.column("block")]
        yield pa.RecordBatch.from_arrays([
            batch.column("chunk"), pa.array([list(level(END))] * len(before), pa.list_(pa.int32())), pa.array(before, pa.list_(pa.int32()))], names=["chunk", "assumed", "before"])


def _fix_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("assumed", "actual", "before")]
        before = [list(fixed_up(_unpacked(block)[0], *map(tuple, vectors))) for block, *vectors in zip(batch.column("block"), *columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("actual"), pa.array(before, pa.list_(pa.int32()))], names=["chunk", "assumed", "before"])


def converged(chunks: DataFrame) -> DataFrame:
    """Rows (conv, chunk, assumed, before): the costs behind and before each chunk, each less its least value.

    There are at most as many passes as chunks; one or two are the rule.
    """
    order = Window.partitionBy("conv").orderBy(F.desc("chunk"))
    keys = chunks.select("conv", "chunk")
    state = materialize(chunks.select("chunk", "block").mapInArrow(_first_pass, "chunk long, assumed array<int>, before array<int>").join(keys, "chunk"), "costs")
    while True:
        end = F.array(*[F.lit(v).cast("int") for v in level(END)])
        actual = state.withColumn("actual", F.coalesce(F.lag("before").over(order), end))
        moved = materialize(actual.where("actual <> assumed"), "moved")
        if moved.isEmpty():
            return state
        again = moved.join(chunks.select("chunk", "block"), "chunk").select("chunk", "assumed", "actual", "before", "block")
        again = again.mapInArrow(_fix_up, "chunk long, assumed array<int>, before array<int>").join(keys, "chunk")
        state = materialize(state.join(moved.select("chunk"), "chunk", "left_anti").unionByName(again), "costs")


def _entries(kind: pa.DataType):
    """Rows (chunk, state): the state in which each chunk is entered, from chunks in order with their states after every entry."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, START, False
        for batch in batches:
            out = []
            for conv, after in zip(batch.column("conv").to_pylist(), batch.column("after").to_pylist(), strict=True):
                state = state if begun and conv == now else START
                now, begun = conv, True
                out.append(state)
                state = after[state]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.int32())], names=["chunk", "state"])

    return work


def _exits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        after = [[trace(_unpacked(b)[0], tuple(v), s)[1] for s in range(4)] for b, v in zip(batch.column("block"), batch.column("assumed").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(after, pa.list_(pa.int32()))], names=["chunk", "after"])


def _traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their audit, repaired lines, exit and the summaries that are added up for a conversation."""
    names = ["chunk", "audit", "lines", "exit", "cost", "blank", "duplicate", "truncated", "illegal", "roles", "turns"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.int64())]
    for batch in batches:
        out = []
        for chunk, block, behind, state in zip(batch.column("chunk").to_pylist(), batch.column("block"), batch.column("assumed").to_pylist(), batch.column("state").to_pylist(), strict=True):
            symbols, rows = _unpacked(block)
            edits, after, cost = trace(symbols, tuple(behind), state)
            lines = "".join(f"\n{x}" for x in repaired(edits, [r[1:3] for r in rows], state))
            more = [r[3] - 1 for r in rows]
            counts = {k: sum(f == k for _, f in symbols) for k in (BLANK, DUPLICATE, TRUNCATED)}
            for m, (_, fault) in zip(more, symbols, strict=True):
                counts[BLANK if fault == BLANK else DUPLICATE] += m
            turns = [r[0] for r in rows if r[0] is not None]
            known = [min(turns), max(turns), len(set(turns))] if turns else []
            illegal = sum(not is_legal(a[0], b[0]) for a, b in zip(symbols, symbols[1:])) + sum(more)
            audit = "".join(e + "D" * m for e, m in zip(edits, more, strict=True))
            out.append((chunk, audit, lines, after, cost + DELETE * sum(more), *counts.values(), illegal,
                        symbols[0][0] + symbols[-1][0], known))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_TRACED = "chunk long, audit string, lines string, exit int, cost long, blank long, duplicate long, truncated long, illegal long, roles string, turns array<long>"


def _stitched(kind: pa.DataType):
    """One row for each conversation from its chunks in order; the repaired text is hashed as it comes."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        now, begun = None, False
        digest, audit, sums, role, turns, state = None, [], [], "", [], START

        def ended() -> pa.RecordBatch:
            for line in _ending(state):
                digest.update(f"\n{line}".encode() if digest_used[0] else line.encode())
                digest_used[0] = True
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            row = (now, gaps, *sums[1:], sums[0] + END[state], "".join(audit) + LAST[state], digest.hexdigest())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["conv", *_NAMES])

        digest_used = [False]
        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row["conv"] != now:
                    if begun:
                        yield ended()
                    now, begun = row["conv"], True
                    digest, audit, sums, role, turns, digest_used = hashlib.sha256(), [], [0] * 5, "", [], [False]
                lines = row["lines"]
                digest.update((lines if digest_used[0] else lines[1:]).encode())
                digest_used[0] |= bool(lines)
                audit.append(row["audit"])
                sums = [a + row[c] for a, c in zip(sums, ("cost", "blank", "duplicate", "truncated", "illegal"), strict=True)]
                sums[4] += bool(role) and not is_legal(role, row["roles"][0])
                role, state = row["roles"][1], row["exit"]
                if row["turns"]:
                    low, high, n = row["turns"]
                    turns = [turns[0], high, turns[2] + n - (turns[1] == low)] if turns else [low, high, n]
        if begun:
            yield ended()

    return work


def _in_chunks(rows: DataFrame, kind: pa.DataType, conv_type: str) -> DataFrame:
    """Results of long conversations, which no task holds."""
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = _fault_columns(rows).withColumn("said", F.sha2(F.col("text").cast("binary"), 256)).withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    rows = materialize(rows, "rows")
    first = rows.groupBy("conv", "role", "said").agg(F.min("place").alias("first")).toDF("_conv", "_role", "_said", "first")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("said") == F.col("_said"))
    seen = rows.join(first, same).select("conv", "turn", "role", "text", "last", "copies", (F.col("place") > F.col("first")).alias("repeated"))
    seen = materialize(seen, "seen")
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = seen.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = dealt.mapInArrow(_chunks(kind), f"conv {conv_type}, chunk long, block binary")
    # Range partitions are numbered in order.
    chunks = materialize(chunks.withColumn("chunk", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("chunk")), "chunks")
    costs = converged(chunks)
    both = chunks.select("chunk", "block").join(costs, "chunk")
    exits = materialize(both.select("chunk", "assumed", "block").mapInArrow(_exits, "chunk long, after array<int>").join(chunks.select("conv", "chunk"), "chunk"), "exits")
    entries = exits.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_entries(kind), "chunk long, state int")
    traced = both.join(entries, "chunk").select("chunk", "assumed", "state", "block").mapInArrow(_traced, _TRACED).join(chunks.select("conv", "chunk"), "chunk")
    return traced.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_stitched(kind), f"conv {conv_type}, {_OUT}")


def repair(df: DataFrame, conv_col: str = "conv_id", rows: DataFrame | None = None, **columns) -> DataFrame:
    """One row for each conversation of ``df``: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` (conv, turn, role, text, copies) are what is repaired; by default ``df`` after the stated damage.
    """
    rows = damaged(df, conv_col, **columns) if rows is None else rows
    conv_type = rows.schema["conv"].dataType.simpleString()
    kind = pa.int64() if conv_type == "bigint" else pa.int32() if conv_type == "int" else pa.string()
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.length("text") * F.col("copies")).alias("size"))
    long = materialize(sizes.where((F.col("n") > LONG) | (F.col("size") > LONG_BYTES)).select(F.col("conv").alias("_conv")), "long")
    same = F.col("conv").eqNullSafe(F.col("_conv"))
    some = not long.isEmpty()
    short = rows.join(long, same, "left_anti") if some else rows
    dealt = _fault_columns(short).repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    out = dealt.select("conv", "turn", "role", "text", "last", "copies").mapInArrow(_whole(kind), f"conv {conv_type}, {_OUT}")
    if some:
        out = out.unionByName(_in_chunks(rows.join(long, same, "left_semi"), kind, conv_type))
    every = df.select(F.col(conv_col).alias(conv_col)).distinct()
    found = every.join(out, F.col(conv_col).eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in _NAMES[:6]]
    return found.select(conv_col, *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


@query("op13_viterbi_repair")
def op13_viterbi_repair(spark, sf_dir):
    return repair(table(spark, sf_dir, "conversations"))
