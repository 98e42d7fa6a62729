"""Conversation repair against a plain search for the cheapest, then ASCII-least edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventlens.llm import repair as rp
from eventlens.llm.common import table

ROWS = "conv_id long, turn long, role string, text string, cost int, audit string, conv int"
SPACE = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """(cost, audit) of rows (initial, fault) by trying every edit."""

    @cache
    def best(i, s, inserted):
        ways = [(0, "")] if i == len(rows) and s in "_a" else []
        move = {"_": "u", "s": "u", "u": "a", "a": "u"}[s]
        if inserted < 3:
            ways.append((5, "I", i, move, inserted + 1))
        if i < len(rows):
            initial, fault = rows[i]
            ways.append((2, "D", i + 1, s, 0))
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                ways.append((1 + extra, "R", i + 1, move, 0))
                if s + initial in ("_s", "_u", "su", "ua", "au"):
                    ways.append((extra, "K", i + 1, initial, 0))
        out = []
        for way in ways:
            if len(way) == 2:
                out.append(way)
            else:
                cost, rest = best(*way[2:])
                out.append((way[0] + cost, way[1] + rest))
        return min(out, default=(10**9, ""))

    return best(0, "_", 0)


def plain(rows):
    out, ids = [], {r[0] for r in rows}
    for conv in ids:
        mine = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        mine.sort(key=lambda r: (*r[:2], r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            said = text.strip(SPACE)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[1] for r in mine if r[0]]
        initials = [r[2][:1] or " " for r in mine]
        cost, audit = plain_edits(tuple(zip(initials, faults, strict=True)))
        lines, i, s = [], 0, "_"
        for letter in audit:
            move = {"_": "user", "s": "user", "u": "assistant", "a": "user"}[s]
            if letter == "I":
                lines.append(f"{move}:")
                s = move[0]
                continue
            if letter != "D":
                role = mine[i][2] if letter == "K" else move
                lines.append(f"{role}:{mine[i][3]}")
                s = role[0]
            i += 1
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ROWS)
    got = rp.repair(df)
    assert got.columns == ["conv_id", *rp._NAMES]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def made(rng, convs, turns):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "cut off", "What? ", " \n", "", None, "ok. \t", "é。", "a.b"]
    rows = [(c, t, rng.choice(roles[:2] * 3 + roles), rng.choice(texts) if rng.random() < 0.5 else f"Line {rng.randrange(10**6)}{rng.choice(['.', '!', ''])}")
            for c in range(convs) for t in range(rng.randrange(turns))]
    rows += [(c, None, "user", f"{c}.") for c in range(0, convs, 3)] + [(None, t, "user", "Null.") for t in range(5)] + [(None, None, None, None)] * 2
    return rows + rng.sample(rows, len(rows) // 6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua "), st.integers(0, 3)), max_size=9))
def test_cheapest_least_edits(rows):
    names = {rp.FREE: "", rp.BLANK: "blank", rp.DUPLICATE: "duplicate", rp.TRUNCATED: "truncated"}
    edits, state, cost = rp.trace(rows, rp.level(rp.END), rp.START)
    assert (cost + rp.END[state], "".join(edits) + rp.LAST[state]) == plain_edits(tuple((i, names[f]) for i, f in rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua "), st.integers(0, 3)), max_size=12), st.lists(st.integers(0, 9), min_size=4, max_size=4))
def test_fix_up_equals_a_run_from_the_start(rows, other):
    """From any speculative vector; parallel runs leave the first vector alone."""
    assumed = rp.level(other)
    before = rp.backward(rows, assumed)[0]
    assert rp.fixed_up(rows, assumed, rp.level(rp.END), before) == rp.backward(rows, rp.level(rp.END))[0]


def test_whole_conversations(spark):
    rows = made(random.Random(3), 60, 9)
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize(("chunk", "size"), [(1, 1 << 20), (3, 1 << 20), (5, 30)])
def test_chunks_equal_whole_conversations(spark, monkeypatch, chunk, size):
    """Every conversation in chunks over several range partitions: a hot one, copies of a row over borders, NULL keys."""
    for name, value in (("LONG", 0), ("CHUNK", chunk), ("CHUNK_BYTES", size)):
        monkeypatch.setattr(rp, name, value)
    rng = random.Random(chunk)
    rows = made(rng, 12, 8) + [(500, t, rng.choice(["user", "assistant", "system"]), rng.choice(["So.", "And", f"{t}."])) for t in range(60)] + [(501, 1, "user", "Hi.")] * 30
    assert found(spark, rows) == plain(rows)


def test_conversation_without_rows_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert found(spark, []) == []


def test_long_texts(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", ("word " * 200_000 + " " * 300_000)) for t in range(4)]
    assert found(spark, rows) == plain(rows)


def test_whole_table_equals_plain_repair(spark):
    source = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = [tuple(r) for r in source.select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in rp.op13_viterbi_repair(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == plain(rows)
