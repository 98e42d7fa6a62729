"""Token counts of sections by offset-mapped attribution (operator 9).

A whole document is encoded once. Tokens have character spans, sections have too; an interval join (binary search of
the tokens' borders among the sections' borders) gives each token its section. A token that crosses a border is
allocated by ``rule``: 'majority' (most of its characters, ties to the earlier section), 'first' or 'last' section.

Sections are the lines of a text with their line feed, or given fields joined by a separator. NULL and empty texts have one
empty section without tokens. Each row is worked on alone, so copies and repeated ids need no rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from eventlens.llm.common import query, sliced, table
from eventlens.llm.words import buffers

RULES = ("majority", "first", "last")


class Tokens:
    """A tokenizer and the byte length of each token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def sizes(self, texts: list[str]) -> list[np.ndarray]:
        return [self.size[np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.int64)] if text else self.size[:0] for text in texts]


_tokens: dict[tuple[str, str], Tokens] = {}


def tokens(path: str, pattern: str) -> Tokens:
    if (path, pattern) not in _tokens:
        _tokens[path, pattern] = Tokens(path, pattern)
    return _tokens[path, pattern]


def allocate(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str, chars: np.ndarray) -> np.ndarray:
    """Section of each token [begin, end) in bytes; sections start at ``starts``; ``chars`` counts characters before each byte."""
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, end - 1, "right") - 1
    if rule == "first":
        return first
    if rule == "last":
        return last
    for i in np.flatnonzero(first != last):
        borders = np.concatenate([[begin[i]], starts[first[i] + 1 : last[i] + 1], [end[i]]])
        inside = np.diff(chars[borders])
        first[i] += int(np.argmax(inside))
    return first


def _counted(path: str, pattern: str, rule: str):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(path, pattern)
        for batch in sliced(batches, "text"):
            data, at = buffers(batch.column("text"))
            inner = np.flatnonzero(data == 10) + 1
            inner = inner[~np.isin(inner, at)]
            starts = np.concatenate([at[:-1], inner])
            order = np.argsort(starts, kind="stable")  # an empty text's section stays before the next text's first
            row = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, inner, "right") - 1])[order]
            starts = starts[order]
            sizes = own.sizes(batch.column("text").to_pylist())
            size = np.concatenate([*sizes, np.zeros(0, np.int64)])
            end = np.cumsum(size)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            section = allocate(end - size, end, starts, rule, chars) if len(size) else np.zeros(0, np.int64)
            count = np.bincount(section, minlength=len(starts))
            number = np.arange(len(starts)) - np.searchsorted(row, row)
            stop = np.append(starts[1:], at[-1])
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").take(pa.array(row)), "section": number.astype(np.int32), "begin": chars[starts] - chars[at[row]],
                "end": chars[stop] - chars[at[row]], "n_tokens": count.astype(np.int64),
            })

    return work


def section_tokens(df: DataFrame, path: str, pattern: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, section, begin, end, n_tokens) of each line of each text; begin and end count characters."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = [StructField(name, LongType()) for name in ("begin", "end", "n_tokens")]
    return picked.mapInArrow(_counted(path, pattern, rule), StructType([picked.schema["id"], StructField("section", IntegerType()), *long]))


def field_tokens(df: DataFrame, fields: list[str], path: str, pattern: str, rule: str = "majority", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, section, ...) of ``fields``, which are encoded as one text, one line each (their own line feeds become spaces)."""
    line = F.concat_ws("\n", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), "\n", " "), F.lit("")) for c in fields])
    joined = df.select(F.col(id_col).alias("id"), line.alias("text"))
    counted = section_tokens(joined, path, pattern, rule, "id")
    return counted.withColumn("field", F.element_at(F.array(*map(F.lit, fields)), F.col("section") + 1))


@query("op9_section_token_counts")
def op9_section_token_counts(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return section_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")
