"""Words far beyond any real one through the encoder, against the tiktoken library."""

from __future__ import annotations

import base64
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from eventlens.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, PATTERN)


def ids_of(codec, text):
    codec.forget()
    ids, raw = codec.encode([text])[0]
    assert raw == text.encode()
    return np.frombuffer(ids, "<i4").tolist()


def test_long_words_equal_the_library(codec, oracle):
    """Random letters, other scripts, runs and periods, in and out of step with the parts."""
    rng = random.Random(1)
    for k in range(60):
        n = rng.randrange(251, 900)
        alphabet = rng.choice(["abcdefghijklmnopqrstuvwxyz", "ab", "aé日本語", "a", "thereing"])
        text = "".join(rng.choice(alphabet) for _ in range(n))
        if k % 3 == 0:
            text = rng.choice("bcd") + rng.choice("ae-= ") * n + "x"
        if k % 5 == 0:
            text = rng.choice(["ab", "-=", "abc", "=-="]) * n
        assert ids_of(codec, text) == oracle.encode(text, disallowed_special=())


@pytest.mark.parametrize("text", [
    "".join(random.Random(2).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)),
    "".join(chr(random.Random(i).randrange(0x4E00, 0x9FFF)) for i in range(20_000))])
def test_fifty_thousand_letters(codec, oracle, text):
    assert ids_of(codec, text) == oracle.encode(text, disallowed_special=())


@pytest.mark.parametrize("text", ["a" * 5_000_000, "b" + "a" * 200_000, "ab" * 150_000])
def test_millions_of_equal_letters_end(codec, text):
    """No memory error and no quadratic time; the ids decode to the text."""
    start = time.monotonic()
    assert len(ids_of(codec, text)) < len(text) / 2 + 9
    assert time.monotonic() - start < 120
