"""Licence scans by sentence rules (operator 6).

A text is cut into pieces at sentence marks and line feeds; pieces are lower-cased and stripped of marks. Known licence
sentences become identifiers wherever one or more whole pieces in a row have their words, so wrapped lines, comment marks and blank
lines inside a sentence don't matter. A rule is a sequence of identifiers and holds where they occur in this order, whatever stands
between. A rule inside a longer rule that holds is not reported.

Texts without any word that every known sentence has (``MARKERS``) can't match and are passed over. All work stays in one
scan. NULL and empty texts hold no licence; a sentence that occurs again counts at its first place that fits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import query, table

# Sentences of public licence texts and notices, normalised.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the apache license version 2 0",
    3: "this work is licensed under the gnu general public license version 3",
    4: "licensed under cc by nc 4 0",
    5: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
       "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
       "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
       "the following conditions",
    6: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    7: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
       "merchantability fitness for a particular purpose and noninfringement",
    8: "you may not use this file except in compliance with the license",
    9: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    10: "see the license for the specific language governing permissions and limitations under the license",
    11: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version",
    12: "you should have received a copy of the gnu general public license along with this program",
    13: "licensed under the bsd 3 clause license",
    14: "this work is licensed under a creative commons attribution 4 0 international license",
    15: "licensed under cc by 4 0",
    16: "licensed under cc by sa 4 0",
    17: "this source code form is subject to the terms of the mozilla public license v 2 0",
    18: "licensed under the mit license",
}
# Rule, licence, kind, sentences in order.
RULES = [
    ("mit-notice", "MIT", "permissive", [1]),
    ("mit-notice-licensed", "MIT", "permissive", [18]),
    ("mit-text", "MIT", "permissive", [5, 6, 7]),
    ("apache-notice", "Apache-2.0", "permissive", [2]),
    ("apache-header", "Apache-2.0", "permissive", [2, 8, 9, 10]),
    ("gpl-notice", "GPL-3.0", "copyleft", [3]),
    ("gpl-header", "GPL-3.0-or-later", "copyleft", [11, 12]),
    ("bsd-notice", "BSD-3-Clause", "permissive", [13]),
    ("cc-by-notice", "CC-BY-4.0", "permissive", [15]),
    ("cc-by-text", "CC-BY-4.0", "permissive", [14]),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", "copyleft", [16]),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "non-commercial", [4]),
    ("mpl-notice", "MPL-2.0", "copyleft", [17]),
]
# Canonical wordings that the sentences above cut differently, with the sentences they stand for.
WORDINGS = {
    f"{SENTENCES[2]} the license": [2],
    f"{SENTENCES[2]} the license {SENTENCES[8]}": [2, 8],
    f"{SENTENCES[9]} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
    "basis without warranties or conditions of any kind either express or implied": [9],
    f"{SENTENCES[5]} {SENTENCES[6]}": [5, 6],
}
#: Each known sentence holds one of these words.
MARKERS = ("license", "permission", "warranty", "licensed")

PLACE = "\\n[0-9]+\\t"
CUT = "[.!?:;]+[ \\t\\r]*\\n+|[.!?]+[ \\t\\r]+|\\n+"


def sentences(text: Column) -> Column:
    """Normalised pieces of a text, in order."""
    return F.transform(F.split(F.lower(text), CUT), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def rule_pattern(ids: list[int]) -> str:
    # A loop over single characters: Java would recurse once for each turn of a loop over a group.
    return "," + ",(?:[0-9,]*,)?".join(map(str, ids)) + ","


def run_pattern(wordings: Iterable[str]) -> str:
    """Numbered pieces in a row that together are one of the wordings, the longest first."""
    longest = sorted(wordings, key=len, reverse=True)
    return f"{PLACE}(?:{'|'.join(words.replace(' ', f'(?: |{PLACE})') for words in longest)})(?=\\n)"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, rule, licence, kind, first_sentence, n_sentences): each rule that holds in a text, with the place of its first sentence (from 0)."""
    wordings = {sentence: [number] for number, sentence in SENTENCES.items()} | WORDINGS
    known = F.create_map(*[x for words, ids in wordings.items() for x in (F.lit(words), F.array(*map(F.lit, ids)))])
    marked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        " OR ".join(f"contains(lower(text), '{word}')" for word in MARKERS))
    # Pieces with words, each after its place (from 0); a known sentence may run on over the places of the next.
    numbered = F.transform(sentences(F.col("text")), lambda s, i: F.when(s != "", F.concat(F.lit("\n"), i.cast("string"), F.lit("\t"), s)))
    runs = F.regexp_extract_all(F.concat(F.array_join(numbered, ""), F.lit("\n")), F.lit(run_pattern(wordings)), F.lit(0))
    matched = marked.select("id", F.transform(runs, lambda run: F.struct(
        F.regexp_extract(run, "[0-9]+", 0).cast("int").alias("place"),
        F.element_at(known, F.trim(F.regexp_replace(run, PLACE, " "))).alias("numbers"))).alias("matches"))
    found = matched.where("size(matches) > 0").withColumn(
        "line", F.concat(F.lit(","), F.array_join(F.flatten("matches.numbers"), ","), F.lit(",")))
    held = []
    for name, licence, kind, ids in RULES:
        longer = [other for _, other_licence, _, other in RULES if len(other) > len(ids) and set(ids) <= set(other)]
        holds = F.col("line").rlike(rule_pattern(ids))
        for other in longer:
            holds &= ~F.col("line").rlike(rule_pattern(other))
        held.append(F.when(holds, F.struct(
            F.lit(name).alias("rule"), F.lit(licence).alias("licence"), F.lit(kind).alias("kind"),
            F.expr(f"filter(matches, m -> array_contains(m.numbers, {ids[0]}))[0].place").alias("first_sentence"), F.lit(len(ids)).alias("n_sentences"))))
    return found.select("id", F.explode(F.array_compact(F.array(*held))).alias("held")).select("id", "held.*")


def _sql() -> str:
    known = ", ".join(f"('{sentence}', {number})" for number, sentence in SENTENCES.items())
    parts = []
    for name, licence, kind, ids in RULES:
        longer = [other for _, _, _, other in RULES if len(other) > len(ids) and set(ids) <= set(other)]
        where = " AND ".join([f"regexp_matches(line, '{rule_pattern(ids)}')", *[f"NOT regexp_matches(line, '{rule_pattern(o)}')" for o in longer]])
        parts.append(
            f"SELECT doc_id, '{name}' AS rule, '{licence}' AS licence, '{kind}' AS kind, "
            f"(list_position(numbers, {ids[0]}) - 1)::INT AS first_sentence, {len(ids)}::INT AS n_sentences FROM seen WHERE {where}")
    cut = CUT.replace("\\\\", "\\")
    return f"""
WITH known(sentence, number) AS (VALUES {known}),
cut AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(lower(text), '{cut}') AS parts FROM documents WHERE text IS NOT NULL),
each AS (SELECT r, doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM cut),
numbered AS (SELECT r, doc_id, i, number FROM each LEFT JOIN known ON trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) = sentence),
gathered AS (SELECT r, doc_id, list(number ORDER BY i) AS numbers FROM numbered GROUP BY r, doc_id HAVING count(number) > 0),
seen AS (SELECT doc_id, numbers, ',' || array_to_string(list_filter(numbers, lambda x: x IS NOT NULL), ',') || ',' AS line FROM gathered)
{" UNION ALL ".join(parts)}
"""


@query("op6_licence_sentences", _sql())
def op6_licence_sentences(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
