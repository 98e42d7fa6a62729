"""Phrase mining against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import collocations as co
from eventlens.llm.common import table

DOCS = "doc_id long, text string, lang string, words int, n string, grp double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = {}
    for (lang, *g), a in counts.items():
        if len(g) < 2 or a < least:
            continue
        cuts = []
        for k in range(1, len(g)):
            left, right = counts[(lang, *g[:k])], counts[(lang, *g[k:])]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[(lang, *g)] = (a, left, right, totals[lang], score)
    gone = set()
    for key, (a, *_) in out.items():
        lang, g = key[0], key[1:]
        gone |= {(lang, *g[i : i + k]) for k in range(2, len(g)) for i in range(len(g) - k + 1) if a >= counts[(lang, *g[i : i + k])]}
    rows = []
    for lang in totals:
        kept = [(-v[4], -v[0], " ".join(k[1:]).encode(), v) for k, v in out.items() if k[0] == lang and k not in gone]
        rows += [(lang, i, p.decode(), *v) for i, (_, _, p, v) in enumerate(sorted(kept)[:top], 1)]
    return sorted(rows)


def found(spark, docs, **how):
    df = spark.createDataFrame([(i, t, g, 1, "x", 0.5) for i, (t, g) in enumerate(docs)], DOCS)
    got = co.collocations(df, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    words = ["the", "of", "The", "and", "é", "B", "x1", "日本"]
    out = [(None, "en"), ("", "en"), (" \t ", None), ("...!?", "de"), ("one", "de"), ("the of", None)]
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", ":"]) for _ in range(rng.randrange(40)))
        out.append((text, rng.choice(["en", "de", None])))
    out += [("common passage here that all share", "en")] * 30  # repeated rows, and a phrase inside longer ones
    return out


@pytest.mark.parametrize(("budget", "least", "top"), [(1 << 20, 5, 2000), (20, 5, 7), (1, 3, 50)])
def test_equals_plain_counts(spark, docs, budget, least, top):
    """Also where prefixes are split down to full depth and where ties reach over the border of the report."""
    assert found(spark, docs, least=least, top=top, budget=budget) == plain(docs, least, top)


def test_long_text_is_taken_whole(spark, monkeypatch):
    monkeypatch.setattr(co, "STREAM", 64)
    monkeypatch.setattr(co, "CHUNK", 500)
    rng = random.Random(1)
    docs = [(" ".join(rng.choice("abc") for _ in range(30_000)), "en"), ("a b c " * 5000, None)]
    assert found(spark, docs, least=50, top=500) == plain(docs, 50, 500)


def test_scores_beyond_64_bits_are_exact(spark):
    rows = spark.createDataFrame([(10**14, 10**15, 10**14, 10**14 + 1)], "a long, total long, l long, r long")
    score = F.expr("(CAST(1000 * a AS DECIMAL(18,0)) * CAST(total AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    assert rows.select(score).first()[0] == 1000 * 10**14 * 10**15 // (10**14 * (10**14 + 1))


def test_nothing_to_mine(spark):
    assert found(spark, []) == [] and found(spark, [(None, None), ("", "en")]) == []


def test_subtree_counts_leaves():
    rows = np.array([[1, 0, 0], [1, 2, 0], [1, 2, 3], [4, 2, 0]], np.uint64)
    got = [(d, w.tolist(), n.tolist(), above.tolist()) for d, w, n, above in co.subtree(rows, np.array([1, 2, 3, 1]), 2)]
    assert got == [(1, [[1]], [6], [[]]), (2, [[1, 2]], [5], [[6]]), (3, [[1, 2, 3]], [3], [[6, 5]])]


def test_groups_keep_the_budget(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = docs.select("lang", "text")
    tokens = co.materialize(texts.mapInArrow(co._tokens, co._TOKENS), "tokens")
    bitmap = co._bitmap(co.word_counts(tokens))
    known = co.frequent_runs(tokens, bitmap, 2)
    budget = 2000
    plan = co.vertical_partition(tokens, known, budget)
    parts = tokens.mapInArrow(co._parts(known, plan), "grp long, lang string, suffixes binary, times binary")
    sizes = [r[0] for r in parts.groupBy("grp").agg(F.sum(F.length("suffixes") / 40).alias("n")).select("n").collect()]
    assert len(plan) > 1 and len(sizes) > 3 and max(sizes) <= 2 * budget


def test_batches_are_small():
    assert [b.num_rows for b in co._cells(np.ones(1 << co.GRAM_BITS, np.uint8))] == [32] * 8
    words = np.random.default_rng(6).integers(1, 2**63, co.STREAM, dtype=np.uint64)
    tokens = co.pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "own": co.pa.array([co.STREAM] * 4, co.pa.int32()), "stream": [(words + np.uint64(i)).tobytes() for i in range(4)]})
    known = (b"\xff" * (1 << co.WORD_BITS - 3), *[b"\xff" * (1 << co.GRAM_BITS - 3)] * len(co.GRAMS))
    made = list(co._parts(known, [np.zeros(1 << co.SLOT_BITS, np.int64)])([tokens]))
    assert max(b.nbytes for b in made) <= 1 << 20 and sum(len(x) for b in made for x in b.column("times").to_pylist()) == 8 * 4 * co.STREAM
    counted = list(co._word_counts([tokens]))
    assert max(b.num_rows for b in counted) <= co.ROWS and sum(b.num_rows for b in counted) == 4 * co.STREAM


def packed_rows(streams, bitmap, lang="en"):
    def read(_):
        yield from ((lang, s) for s in streams)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(co, "_read", read)
        return list(co._packed(bitmap)([]))


def test_packed_tokens_leave_out_rare_words():
    rng = np.random.default_rng(8)
    often, rare = rng.integers(1, 2**63, 50, dtype=np.uint64), rng.integers(1, 2**63, 200_000, dtype=np.uint64)
    slots = co._top_bits(co.mix(often + co._salt("en")), co.WORD_BITS)
    bits = np.zeros(1 << co.WORD_BITS, np.uint8)
    bits[slots] = 1
    bitmap = np.packbits(bits, bitorder="little")
    streams = [np.insert(np.where(rng.random(100_000) < 0.7, rng.choice(often, 100_000), rng.choice(rare, 100_000)), 0, 0).astype(np.uint64) for _ in range(6)]
    made = packed_rows(streams, bitmap.tobytes())
    back = list(co._rows(made))
    assert all(n <= own + co.DEPTH - 1 for own, n in ((own, len(words)) for _, own, words in back)) and max(own for _, own, _ in back) < 2 * co.ROW
    kept = np.concatenate([words[:own] for _, own, words in back])
    want = np.concatenate(streams)
    want = np.where(co._in_bitmap(want, co._salt("en"), bitmap), want, np.uint64(0))
    assert kept[kept != 0].tolist() == want[want != 0].tolist() and ((kept[1:] == 0) & (kept[:-1] == 0)).sum() < len(streams)
    # Under 2 bytes a word of the text; as 64-bit words it took 8 before compression.
    assert sum(b.nbytes for b in made) < 2 * 600_000
    # The same suffixes as from the words as such.
    raw = co.pa.RecordBatch.from_pydict({"lang": ["en"] * 6, "own": co.pa.array([len(s) for s in streams], co.pa.int32()), "stream": [s.tobytes() for s in streams]})
    known = (bitmap.tobytes(), *[b"\xff" * (1 << co.GRAM_BITS - 3)] * len(co.GRAMS))
    ours, theirs = (co._counted(np.concatenate([s for _, _, s in co._streams(x, known)])) for x in (made, [raw]))
    assert all((a == b).all() for a, b in zip(ours, theirs, strict=True))


def test_languages_held_share_one_limit():
    held, given = co._Held(100, 150), []
    for i in range(300):
        given += held.add(f"l{i % 30}", np.arange(1 + i % 3))
        assert sum(held.size.values()) < 150 and max(held.size.values(), default=0) < 100
    given += held.all()
    assert given and sum(len(x) for _, some in given for x in some) == 600


def test_equal_suffixes_are_sent_once_by_a_task():
    """However many words it reads, as long as its distinct suffixes fit."""
    words = np.tile(np.arange(1, 1001, dtype=np.uint64), 33)[: co.STREAM]
    n = 3 * co.CHUNK // co.STREAM
    tokens = co.pa.RecordBatch.from_pydict({"lang": ["en"] * n, "own": co.pa.array([co.STREAM] * n, co.pa.int32()), "stream": [words.tobytes()] * n})
    known = (b"\xff" * (1 << co.WORD_BITS - 3), *[b"\xff" * (1 << co.GRAM_BITS - 3)] * len(co.GRAMS))
    made = list(co._parts(known, [np.zeros(1 << co.SLOT_BITS, np.int64)])(tokens.slice(i, 1) for i in range(n)))
    times = np.concatenate([np.frombuffer(x, np.int64) for b in made for x in b.column("times").to_pylist()])
    assert times.sum() == n * co.STREAM and len(times) == 1000 + co.DEPTH - 1
