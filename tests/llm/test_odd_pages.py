"""Pages and texts that once ended a job: deep nesting, headings with telling ids, repeated licence sentences."""

from __future__ import annotations

import time

from eventlens.llm import html, licences


def test_deep_and_unclosed_pages():
    start = time.monotonic()
    assert html.extract("<div>a" * 5_000).count("a") == 5_000
    assert "text" in html.extract("<p>some text, and more" + "<i>" * 3_000 + "deep")
    assert time.monotonic() - start < 60


def test_headings_are_kept_whatever_their_ids():
    page = "<main><h2 id='related-work'>Related work</h2><p>One, two.</p><h3 id='share-prices'>Share prices</h3><p>Three, four.</p></main>"
    assert html.extract(page) == "Related work\nOne, two.\nShare prices\nThree, four."


def test_sixty_thousand_repeated_sentences(spark):
    text = "Released under the MIT License.\n" * 60_000
    df = spark.createDataFrame([(1, text), (2, text + "Licensed under CC BY 4.0.")], "doc_id long, text string")
    got = sorted((r.id, r.rule) for r in licences.scan(df).collect())
    assert got == [(1, "mit-notice"), (2, "cc-by-notice"), (2, "mit-notice")]
