"""Each operator against a plain version of itself, and on NULLs, empty and long texts, ties, copies, empty tables and extra columns."""

from __future__ import annotations

import base64
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlens.llm import bpe, components, decontaminate, hmm, html, jaccard, licences, neighbours, quality, token_counts, tool_calls, words

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
DOCS = "doc_id long, text string, score double, id string, n_words int"


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, texts, start=0):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(start + i, t, 0.5, "x", 1) for i, t in enumerate(texts)], DOCS)


def plain_words(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = ["", None, " ", "\n\n", "a", "  two  blanks ", "don't I'll WE'LL 12ab", "é日本 語🙂 x", "a" * 3000, "-" * 700 + " end", " \n \n x", "tab\tand\vmore",
       "x" * 251 + "ab" * 200, "line\nline\nline", "\x85nel nbsp"]


# words and shingles

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB \n\té日", max_size=40)), max_size=8))
def test_words_equal_plain_ones(texts):
    found = words.words_of(pa.array(texts, pa.string()))
    got = [[bytes(words.LOWER[found.data[a:b]]) for a, b in zip(found.begin[i:j], found.end[i:j], strict=True)]
           for i, j in zip(found.first[:-1], found.first[1:], strict=True)]
    assert got == [[w.encode() for w in plain_words(t)] for t in texts]
    by_hash = {}
    for h, w in zip(found.hash.tolist(), [w for ws in got for w in ws], strict=True):
        assert by_hash.setdefault(h, w) == w
    assert len(set(by_hash.values())) == len(by_hash)


def test_shingle_sets_equal_plain_ones():
    rng = random.Random(1)
    texts = [*ODD, *[prose(rng, n, 5) for n in (1, 4, 5, 6, 40, 200)]]
    for got, text in zip(words.sets_of(pa.array(texts, pa.string())), texts, strict=True):
        ws = plain_words(text)
        want = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
        assert len(got) == len(want)


# 1 pages

def test_main_text_of_pages(spark):
    rest = "<nav><ul><li><a href=/a>Menu, one</a></ul></nav><div class='ad'>Buy, now, please</div>"
    body = "<h1>Title &amp; more</h1><p>First,\n  paragraph &eacute;.<p>Second <b>bold</b> one<br>here</p>"
    junk = "<div class='comments'><p>Reader, says, much, more, than, all</p></div><form><p>Mail, me</p></form><script>var a='</p><p>x';</script>"
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body>{rest}<!-- c --><article>{body}{junk}</article><aside>Side, bar</aside><footer>&copy; foot</footer>"
    soup = f"<body>{rest}<div id=content><p>{'Long text, with commas, ' * 6}</p><p>Short.</p></div><div class=sidebar><p>No, no, no</p></div>"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", soup, "x"), (5, "u", "<p>cut <b", "x"), (5, "u", "<p>cut <b", "x")],
                               "page_id long, url string, html string, text string")
    got = html.main_text(df).collect()
    assert [len(r.text) for r in got] == [r.n_chars for r in got]
    assert got[0].text == "Title & more\nFirst, paragraph é.\nSecond bold one here"
    assert got[1].text == got[2].text == ""
    assert got[3].text == ("Long text, with commas, " * 6).strip() + "\nShort."
    assert got[4].text == got[5].text and got[4].text.startswith("cut")
    assert html.main_text(df.limit(0)).count() == 0


def test_article_header_and_comment_article():
    text = html.extract("<main><header class=header><h1>Head</h1></header><p>Body text, here.</p><article class=comment><p>No</p></article></main><header>Site</header>")
    assert text == "Head\nBody text, here."


def test_long_page():
    page = "<article>" + "<p>word, word</p>" * 20_000 + "</article>"
    assert html.extract(page).count("\n") == 19_999


def test_text_beside_the_best_element():
    long, short = "Long text, with commas, and more of it. " * 6, "A short section of one paragraph."
    menu = "<div><a href=/a>One</a> <a href=/b>Two</a></div>"
    both = html.extract(f"<body>{menu}<article><p>{long}</p></article><article><h2>Next</h2><p>{short}</p></article><footer>F</footer>")
    assert both == f"{long.strip()}\nNext\n{short}"
    split = html.extract(f"<body>{menu}<div><p>{long}</p><p>{long}</p><p>{long}</p></div><section><h2><a href=#n>Next</a></h2><p>{short}</p></section>"
                         f"<p>Brief.</p><div><div><p>{short}</p>{menu}</div></div><nav>N</nav>")
    assert split == "\n".join([long.strip()] * 3 + ["Next", short, "Brief.", short])
    assert html.extract(f"<body><div><p>{short}</p></div><main><p>{long}</p></main>") == long.strip()
    assert html.extract(f"<body><h1>Head</h1><article><p>{long}</p></article><a href=/x>More</a>") == f"Head\n{long.strip()}"


# 2 tokens

@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abe tThn \n\t.,!0' éß日🙂"), max_size=60))
def test_encoding_equals_the_library(oracle, text):
    ids, raw = bpe.codec(PATH, PATTERN).encode([text])[0]
    assert np.frombuffer(ids, "<i4").tolist() == oracle.encode_ordinary(text)
    assert raw == text.encode()


def test_bpe_query_and_round_trip(spark, oracle):
    df = frame(spark, [*ODD, *ODD])
    coded = bpe.encode(df, PATH, PATTERN)
    got = {r.id: r.ids for r in coded.collect()}
    assert got == {i: oracle.encode_ordinary(t or "") for i, t in enumerate([*ODD, *ODD])}
    back = {r.id: bytes(r.decoded) for r in bpe.decode(coded, PATH, PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate([*ODD, *ODD])}
    assert bpe.digests(df.limit(0), PATH, PATTERN).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        bpe.codec(PATH, PATTERN).decode([np.array([60_000], "<i4").tobytes()])


def test_long_recursion_restarts(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "GATHERED", 50)
    text = "antidisestablishmentarianism " + "ab" * 300
    ids, _ = bpe.Codec(PATH, PATTERN).encode([text])[0]
    assert np.frombuffer(ids, "<i4").tolist() == oracle.encode_ordinary(text)


@pytest.mark.parametrize("limit", [("REMEMBERED", 40), ("REMEMBERED_BYTES", 300)])
def test_small_memory_changes_nothing(oracle, monkeypatch, limit):
    monkeypatch.setattr(bpe, *limit)
    codec, rng = bpe.Codec(PATH, PATTERN), random.Random(3)
    for _ in range(40):
        sizes = [rng.choice([0, 1, 5, 80, 700]) for _ in range(rng.choice([0, 1, 9]))]
        texts = ["".join(rng.choices("abcdeéß 日🙂\n\t ,.'s 123", k=n)) for n in sizes]
        ids, raw = codec.encode_texts(texts)
        assert ids.to_pylist() == [oracle.encode_ordinary(t) for t in texts]
        assert raw.to_pylist() == [t.encode() for t in texts]


# 3 quality

def quality_data(spark, n=240):
    rng = random.Random(2)
    good = [". ".join(prose(rng, 9).capitalize() for _ in range(rng.randrange(2, 9))) + "." for _ in range(n)]
    bad = [prose(rng, rng.randrange(5, 60)).upper().replace(" ", "!! ") if i % 2 else " ".join([f"w{i}"] * 40) for i in range(n)]
    docs = frame(spark, [*good, *bad, "", None])
    labels = spark.createDataFrame([(i, int(i < n), 0) for i in range(2 * n)] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, n


def test_quality_on_held_out(spark):
    docs, labels, n = quality_data(spark)
    model = quality.train(quality.split_training(docs), labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 2 * n + 2 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.id < 2 * n and zlib.crc32(str(r.id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.5) == (r.id < n) for r in held]) > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.id for r in rows if r.score >= 0.5}


def test_quality_learns_from_all_documents(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(3, 12)) + ("." if i % 3 else "!! A1") for i in range(10_400)]
    marks = [int(i % 3 > 0) if rng.random() < 0.9 else int(i % 3 == 0) for i in range(len(texts))]
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int")
    model = quality.train(frame(spark, texts), labels)
    x, mark = quality.features(pa.array(texts)), np.array(marks)
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-8, rtol=1e-8)
    # As many documents are cut off as are marked 0, but for equal scores, and the loss over all pairs has no slope.
    assert (model.score(x) < 0.5).sum() <= (mark == 0).sum() <= (model.score(x) <= 0.5).sum()
    z = (x - model.mean) / model.spread
    score = z @ model.weights
    good, bad = z[mark == 1], z[mark == 0]
    lost = 1 / (1 + np.exp(score[mark == 1][:, None] - score[mark == 0]))
    slope = (lost.sum(axis=1) @ good - lost.sum(axis=0) @ bad) / lost.size - quality.RIDGE * model.weights
    assert np.abs(slope).max() < 1e-4


def test_quality_without_labels(spark):
    docs, labels, _ = quality_data(spark, 3)
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), None).count() == 0
    assert quality.keep_good(docs, None).count() == docs.count()


# 4 similar documents

def plain_components(texts, ids):
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := plain_words(t)) else set() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return {ids[i]: (len(sets[i]), least[find(i)]) for i in range(len(texts))}


def near_copies(rng, n, size=60, most=14):
    base = [f"b{rng.randrange(10_000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(0, most)):
            copy[rng.randrange(size)] = f"e{rng.randrange(40)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("lists", [64, 3])
def test_join_equals_brute_force(spark, monkeypatch, lists):
    """With short lists of three classes nearly everything takes the way of long lists."""
    monkeypatch.setattr(jaccard, "LIST", lists)
    monkeypatch.setattr(jaccard, "OFTEN", 2 if lists == 3 else 48)
    monkeypatch.setattr(jaccard, "BLOCK", 8 if lists == 3 else 256)
    rng = random.Random(4)
    passage = prose(rng, 30)
    texts = [*near_copies(rng, 60), *near_copies(rng, 40, 30), *[f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(40)], *[passage] * 5,
             *ODD, "One two three", "one TWO three", "one two three four five", "one two three four five six"]
    texts = [*texts, *texts[:30]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    ids = [order[i] * 7 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in zip(ids, texts, strict=True)], DOCS)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == plain_components(texts, ids)


def test_join_of_odd_tables(spark):
    assert jaccard.join(frame(spark, []).limit(0)).count() == 0
    assert jaccard.join(frame(spark, ["", None])).where("n_shingles = 0 AND component_id = id").count() == 2
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert Counter((r.id, r.component_id) for r in jaccard.join(df).collect()) == {(None, None): 1, (2, 1): 2, (1, 1): 1}
    kept = jaccard.keep_first(df.unionByName(df))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "None", "None"]


def test_join_of_ids_with_several_texts(spark):
    rng = random.Random(4)
    a, b, c = (prose(rng, 60, 5000) for _ in range(3))
    df = spark.createDataFrame([(5, a), (5, b), (2, f"{a} more"), (7, f"{b} more"), (7, f"{b} more"), (9, c), (5, "")], "doc_id long, text string")
    assert Counter((r.id, r.component_id) for r in jaccard.join(df).collect()) == {(5, 2): 2, (2, 2): 1, (7, 2): 2, (9, 9): 1, (5, 5): 1}
    batch = pa.RecordBatch.from_pydict({"text": [a, b], "cls": pa.array([jaccard._sets(pa.RecordBatch.from_pydict({"text": [a]}))[2][0]] * 2)})
    assert [x.num_rows for x in jaccard._as_sets([batch])] == [1]


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(70)] + [(200, i) for i in range(201, 260)] + [(400, 401), (401, 400), (300, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, **{i: 200 for i in range(200, 260)}, 400: 400, 401: 400}


def test_divide_skip_equals_plain_search():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40), dtype=np.uint64)) for _ in range(80)]
    index = jaccard.DivideSkip(sets)
    for one in sets:
        for least in (1, 3, 10, 20):
            assert list(index.search(one, least, lambda j: True)) == [j for j, s in enumerate(sets) if len(np.intersect1d(one, s)) >= least]


# 5 language model

def test_likelihood_equals_sum_over_paths():
    rng = np.random.default_rng(3)
    emit = rng.dirichlet(np.ones(hmm.CLASSES), 2).T
    model = hmm.Model(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.4, 0.6]]), emit)
    lengths = np.array([1, 4, 2])
    seq = np.array([5, 9, 7, -1, 2, 8, 5])
    want, at = [], 0
    for n in lengths:
        total = 0.0
        for path in np.ndindex(*[2] * n):
            p = model.start[path[0]]
            for t in range(n):
                p *= (model.step[path[t - 1], path[t]] if t else 1) * (0.01 if seq[at + t] < 0 else emit[seq[at + t], path[t]] * 0.99)
            total += p
        want.append(np.log(total))
        at += n
    assert np.allclose(hmm.log_likelihood(model, 0.01, seq, lengths), want)


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(4)
    lengths = np.array([300, 20, 1, 129])
    seq = rng.integers(1, 30, lengths.sum())
    share = np.zeros(hmm.CLASSES)
    share[:30] = 1e-9
    model = hmm.Model(np.full(8, 1 / 8), np.full((8, 8), 1 / 8), rng.dirichlet(np.ones(hmm.CLASSES), 8).T)
    counts = hmm.expected(model, seq, lengths)
    assert np.isclose(counts[2].sum(), lengths.sum(), rtol=1e-4) and np.isclose(counts[0].sum(), len(lengths), rtol=1e-4)
    assert np.isclose(counts[1].sum(), (lengths - 1).sum(), rtol=1e-4)
    better = hmm.improved(*counts[:3], share)
    assert hmm.log_likelihood(better, 1e-9, seq, lengths).sum() > hmm.log_likelihood(model, 1e-9, seq, lengths).sum()


def test_windows_count_as_whole_texts(monkeypatch):
    """Counts over windows with context come close to those of one window, and the likelihood too."""
    rng = np.random.default_rng(6)
    step = np.full((8, 8), 0.02) + 0.84 * np.eye(8)
    model = hmm.Model(rng.dirichlet(np.ones(8)), step / step.sum(axis=1, keepdims=True), rng.dirichlet(np.full(hmm.CLASSES, 0.01), 8).T + 1e-9)
    lengths = np.array([700, 129, 128, 3])
    seq = rng.integers(1, 50, lengths.sum())
    parts = hmm.expected(model, seq, lengths)
    monkeypatch.setattr(hmm, "WINDOW", 10_000)
    whole = hmm.expected(model, seq, lengths)
    assert all(np.abs(a - b).sum() < 0.02 * np.abs(b).sum() for a, b in zip(parts[:3], whole[:3], strict=True)) and np.isclose(parts[3], whole[3], rtol=1e-2)
    assert np.isclose(whole[3], hmm.log_likelihood(model, 0.0, seq, lengths).sum(), rtol=1e-3)


def test_scores_and_base(spark):
    rng = random.Random(5)
    texts = [" ".join(f"{'ab'[k % 2]}{rng.randrange(30)}{'xy'[k % 2]}" for _ in range(rng.randrange(3, 80))) for k in range(200)]
    texts += ["", None, "never seen words", prose(rng, 3000)]
    got = {r.id: r for r in hmm.score(frame(spark, texts), F.col("doc_id") % 5 != 1).collect()}
    train = [[*plain_words(t), None] for i, t in enumerate(texts) if i % 5 != 1]
    count = Counter(w for ws in train for w in ws)
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        ws, r = [*plain_words(t), None], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 == 1, len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    nothing = hmm.score(frame(spark, ["a b", "", None]), F.lit(False)).collect()
    assert {(r.train_tokens, r.base_score, r.score) for r in nothing} == {(0, 0.0, 0.0)}
    assert hmm.score(frame(spark, []).limit(0), F.lit(True)).count() == 0


# 6 licences

def test_licence_rules(spark):
    mit = ". ".join(licences.SENTENCES[i].upper() for i in (5, 6, 7)) + "."
    mixed = ". ".join(licences.SENTENCES[i] for i in (7, 6, 5)) + "."
    apache = "Licensed under the Apache License, Version 2.0.\nSomething else. You may not use this file except in compliance with the License.\n" \
        "You may obtain a copy of the License at\thttp://www.apache.org/licenses/LICENSE-2.0\nSee the License for the specific language " \
        "governing permissions and limitations under the License."
    texts = [f"Intro.\n{mit}", mixed, apache, "Released under the MIT License.", "The license plate.", "", None, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0."]
    got = {(r.id, r.rule, r.first_sentence) for r in licences.scan(frame(spark, texts)).collect()}
    assert got == {(0, "mit-text", 1), (2, "apache-header", 0), (3, "mit-notice", 0), (7, "cc-by-nc-notice", 0), (7, "cc-by-notice", 1)}
    assert all(any(m in s for m in licences.MARKERS) for s in licences.SENTENCES.values())
    assert licences.scan(frame(spark, []).limit(0)).count() == 0


def test_wrapped_originals(spark):
    mit = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."""
    commented = ["\n".join(f"{mark} {line}" for line in text.split("\n")) for mark, text in ((" *", apache), ("#", gpl), ("//", mit))]
    texts = [mit, apache, gpl, mpl, "/*\r\n" + commented[0].replace("\n", "\r\n") + "\r\n */", *commented[1:], " ".join(mit.split()), " ".join(apache.split()),
             " ".join(gpl.split()), "It was licensed under\nthe MIT license.", "Released under the MIT\nlicense plate."]
    got = {(r.id, r.rule, r.first_sentence) for r in licences.scan(frame(spark, texts)).collect()}
    assert {(i, rule) for i, rule, _ in got} == {
        (0, "mit-text"), (1, "apache-header"), (2, "gpl-header"), (3, "mpl-notice"), (4, "apache-header"), (5, "gpl-header"), (6, "mit-text"),
        (8, "apache-header"), (9, "gpl-header")}
    assert {i: place for i, _, place in got if i < 4} == {0: 2, 1: 0, 2: 0, 3: 0}


# 7 neighbours

def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(7)
    vectors = [*rng.normal(size=(150, 12)).tolist(), *[[1.0] * 12] * 6, [0.0] * 12, None, [], [float("nan")] * 12, [float("inf"), *[1.0] * 11], [None, *[1.0] * 11], [1.0, 2.0], [2.0, 1.0]]
    rows = [(i, v, 1, 0.1) for i, v in enumerate(vectors)] + [(None, [1.0] * 12, 1, 0.1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double").repartition(5)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 5 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = {i: np.array(v) for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and np.any(v)}

    def in_order(x):
        total = 0.0
        for value in x:
            total += value
        return total

    want = {}
    for q, own in fine.items():
        near = sorted((-float(in_order(own * x) / (np.sqrt(in_order(own * own)) * np.sqrt(in_order(x * x)))), i)
                      for i, x in fine.items() if i != q and len(x) == len(own)) if q % 5 == 0 else []
        if near:
            want[q] = [(k + 1, i, -score) for k, (score, i) in enumerate(near[:5])]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


# 8 tool calls

def test_linking(spark):
    calls = spark.createDataFrame([
        (1, 0, "a", "reply", '{"text":"x","lines":1}', None), (1, 2, "b", "reply", '{"z":{"y":1,"x":[2,{"b":0,"a":1}]},"lines":3,"text":""}', "a"),
        (1, 3, "c", "reply", "no json", "b"), (1, 3, "c", "reply", "no json", "b"), (1, 4, "d", "other", "{}", "gone"), (1, 5, "e", "reply", None, "e"),
        (1, 6, "f", "reply", '{"lines":"1"}', "e"), (None, 1, "g", "reply", "{}", None), (1, 7, "h", "summarise", '{"lines":2,"text":"t"}', "c"), (1, 8, "i", None, "[1]", None),
    ], "conv_id long, turn long, call_id string, tool string, arguments string, after string")
    results = spark.createDataFrame([(1, 1, "a", "yes"), (1, 1, "a", "again"), (1, 9, "zz", "lost"), (1, 3, "b", None)], "conv_id long, turn long, call_id string, content string")
    got = {r.call_id: r for r in tool_calls.link(calls, results, tool_calls.SCHEMAS).collect()}
    assert {k: (r.level, r.status, r.copies) for k, r in got.items()} == {
        "a": (0, "ok", 1), "b": (1, "invalid", 1), "c": (2, "invalid", 2), "d": (0, "unknown tool", 1), "e": (None, "cycle", 1), "f": (None, "cycle", 1),
        "h": (3, "unanswered", 1), "i": (0, "unknown tool", 1), "zz": (None, "orphan", 1)}
    assert got["b"].errors == ["lines: above 1", "text: below 1"] and got["c"].errors == ["not an object"] and got["d"].errors == ["after: missing"]
    assert got["f"].errors == ["lines: not integer", "text: missing"]
    assert got["b"].record == '{"after":"a","arguments":{"lines":3,"text":"","z":{"x":[2,{"a":1,"b":0}],"y":1}},"id":"b","name":"reply","result":null}'
    assert '"result":"again"' in got["a"].record
    assert tool_calls.link(calls.limit(0), results.limit(0), tool_calls.SCHEMAS).count() == 0


def test_long_path_of_calls(spark):
    calls = spark.range(300).selectExpr("1L AS conv_id", "concat('c', id) AS call_id", "IF(id = 0, NULL, concat('c', id - 1)) AS after")
    assert {(r.call_id, r.level) for r in tool_calls.levels(calls).collect()} == {(f"c{i}", i) for i in range(300)}


# 9 token counts

@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_equal_plain_ones(spark, oracle, rule):
    texts = [*ODD, "a\n\n\nb", "\n", "x\n", "日本\n\n語🙂\n\n\n  end"]
    got = {}
    for r in token_counts.section_tokens(frame(spark, texts), PATH, PATTERN, rule).collect():
        got[r.id, r.section] = (r.begin, r.end, r.n_tokens)
    want = {}
    for i, text in enumerate(texts):
        lines = regex.findall(r"[^\n]*\n|[^\n]+", text or "") or [""]
        owner = [k for k, line in enumerate(lines) for _ in line]
        count, at, raw = Counter(), 0, (text or "").encode()
        for token in oracle.encode_ordinary(text or ""):
            size = len(oracle.decode_single_token_bytes(token))
            spots = [len(raw[:b].decode(errors="ignore")) if raw[b] & 0xC0 != 0x80 else None for b in range(at, at + size)]
            first = len(raw[: at + 1].decode(errors="replace")) - 1
            chars = [s for s in spots if s is not None] or [first]
            inside = Counter(owner[c] for c in chars)
            most = max(inside.values())
            count[{"first": owner[chars[0]], "last": owner[chars[-1]], "majority": min(k for k, n in inside.items() if n == most)}[rule]] += 1
            at += size
        begin = 0
        for k, line in enumerate(lines):
            want[i, k] = (begin, begin + len(line), count[k])
            begin += len(line)
    assert got == want
    assert token_counts.section_tokens(frame(spark, []).limit(0), PATH, PATTERN).count() == 0


def test_field_tokens(spark, oracle):
    got = {r.field: r.n_tokens for r in token_counts.field_tokens(frame(spark, ["some\ntext here"]), ["id", "text"], PATH, PATTERN).collect()}
    assert set(got) == {"id", "text"} and sum(got.values()) == len(oracle.encode_ordinary("x\nsome text here"))


# 10 benchmark passages

def plain_tiles(doc, item, least):
    """Coverage by the textbook rule: the longest common run of unmarked words, earliest in the item, then in the document."""
    a, b, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n >= least and n > best[0]:
                    best = (n, i, j)
        if not best[0]:
            return out
        n, i, j = best
        out.append((i, j, n))
        a[i : i + n] = [True] * n
        b[j : j + n] = [True] * n


def test_repetitive_item_is_found(spark):
    line = "one two three four five six seven eight "
    docs, bench = frame(spark, [f"Before it {line * 25} after it", "one two three four five"]), spark.createDataFrame([(1, line * 25)], "item_id long, text string")
    got = [(r.id, r.item, r.size, r.tiles, r.covered) for r in decontaminate.matches(docs, bench).collect()]
    assert got == [(0, 1, 200, 1, 200)]


def test_tiles_equal_plain_ones():
    rng = np.random.default_rng(10)
    for _ in range(60):
        doc, item = (rng.integers(1, 4, n, dtype=np.uint64) for n in (rng.integers(0, 40), rng.integers(0, 25)))
        assert decontaminate.tiles(np.arange(len(doc)), doc, item, 3) == plain_tiles(doc.tolist(), item.tolist(), 3)


def test_reordered_passages_are_found(spark):
    rng = random.Random(11)
    items = [prose(rng, 40, 5000) for _ in range(5)] + ["too short item", "", None]
    a, b = items[0].split()[:20], items[0].split()[20:]
    docs = [f"{prose(rng, 50, 5000)} {items[1].upper()} {prose(rng, 9)}", " ".join([*b, "and", "so", *a]), " ".join(items[2].split()[:12]), prose(rng, 300, 5000),
            "too short item", "", None, "\n".join(items[3].split()) * 1]
    bench = spark.createDataFrame([*enumerate(items), (None, docs[3])], "item_id long, text string")
    df = frame(spark, [*docs, *docs])
    got = {(r.id, r.item): (r.tiles, r.covered) for r in decontaminate.matches(df, bench).collect()}
    n = len(docs)
    assert got == {(0, 1): (1, 40), (1, 0): (2, 40), (7, 3): (1, 40), (n, 1): (1, 40), (n + 1, 0): (2, 40), (n + 7, 3): (1, 40)}
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(2 * n)) - {k for k, _ in got}
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), bench).count() == 0
