"""Short test items and repetitive texts in benchmark decontamination."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa

from eventlens.llm import decontaminate as dc
from eventlens.llm.words import words_of


def hashed(text):
    return words_of(pa.array([text])).hash


def test_items_under_five_words_are_found(spark):
    docs = spark.createDataFrame([(1, "say Alpha beta now"), (2, "beta alpha"), (3, "alpha"), (4, None), (5, ""), (6, "one two three four"), (7, "one two three five"), (8, "x alpha beta alpha beta y")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(10, "alpha beta"), (11, "one two three four"), (12, ""), (13, None), (14, "y"), (15, "a much longer item of seven words")], "item_id long, text string")
    got = {(r.id, r.item, r.coverage) for r in dc.matches(docs, items).collect()}
    assert got == {(1, 10, 1.0), (8, 10, 1.0), (6, 11, 1.0), (8, 14, 1.0)}
    assert sorted(r.doc_id for r in dc.keep_clean(docs, items).collect()) == [2, 3, 4, 5, 7]


def test_tiles_by_length_equal_tiles_by_pairs(monkeypatch):
    rng = random.Random(3)
    for _ in range(150):
        words, item = (hashed(" ".join(rng.choice("abc" if rng.random() < 0.5 else "ab") for _ in range(rng.randrange(5, 60)))) for _ in range(2))
        places = np.cumsum([1 + (rng.random() < 0.1) for _ in words])
        want = dc.tiles(places, words, item, 3)
        assert dc._tiles_by_length(places, words, item, 3) == want


def test_repetitive_texts_stay_linear():
    words, item = hashed("ha " * 100_000), hashed("ha " * 20_000)
    start = time.monotonic()
    assert dc.tiles(np.arange(len(words)), words, item) == [(0, 0, 20_000)]
    mixed = hashed(("ha " * 9 + "ho ") * 3_000)
    assert sum(n for _, _, n in dc.tiles(np.arange(len(words)), words, mixed)) == 27_000
    assert time.monotonic() - start < 90
