"""Licence scan by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings are normalised) and its digest is joined with the digests
of known licences. Whole documents are looked up, and every line of a document
as well, so that a notice on a line of its own is found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.licence_texts import entire_texts, with_titles
from martlens.llm.words import lower_ascii

# Known licences are broadcast; more than this many take a shuffled join.
MAX_BROADCAST = 100_000

# Texts and notices of public licences, and spellings that count
# as the same word or phrase.
LICENCE_TEXTS = (
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("all-rights-reserved", "All rights reserved."),
)
LICENCE_TEXTS += with_titles(LICENCE_TEXTS) + entire_texts()
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("fulfil", "fulfill"),
    ("merchantibility", "merchantability"),
    ("https", "http"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("version", "v"),
    ("licences", "licenses"),
    ("licencing", "licensing"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favourite", "favorite"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisations", "organizations"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("recognised", "recognized"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
COPYRIGHT_LINE = (
    r"(^|\n)[^a-z0-9\n]*(copyright *(\(c\)|©|[0-9<]|by )|\(c\) *[0-9<]|© *[0-9<])[^\n]*"
)


def _any_spelling() -> str:
    """Pattern of a text with any of the spellings, alternatives by first letter."""
    by_letter: dict[str, list[str]] = {}
    for spelling, _ in SPELLINGS:
        by_letter.setdefault(spelling[0], []).append(spelling[1:])
    return " (?:" + "|".join(f"{a}(?:{'|'.join(x)})" for a, x in sorted(by_letter.items())) + ") "


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def canonical(text: Column) -> Column:
    """Canonical form: lower-case words between single blanks; null gives ''."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r", "\n")
    text = F.regexp_replace(lower_ascii(text), COPYRIGHT_LINE, "\n")
    text = F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    text = F.concat(F.lit(" "), F.trim(text), F.lit(" "))

    def respelled(form: Column) -> Column:
        for spelling, usual in SPELLINGS:
            form = F.replace(form, F.lit(f" {spelling} "), F.lit(f" {usual} "))
        return form

    # Few texts have any of the spellings; one search tells that for all of them.
    return F.trim(_once(text, lambda x: F.when(x.rlike(_any_spelling()), respelled(x)).otherwise(x)))


def digest(text: Column) -> Column:
    """Digest of the canonical form; null where nothing of the text is left."""
    return _once(canonical(text), lambda form: F.when(form != "", F.sha2(form, 256)))


def known_licences(spark: SparkSession, texts=LICENCE_TEXTS) -> DataFrame:
    """Digest and name of each licence, canonicalised by the same expressions."""
    frame = spark.createDataFrame(list(texts), "licence string, text string")
    return (
        frame.select("licence", digest(F.col("text")).alias("digest"))
        .where(F.col("digest").isNotNull())
        .groupBy("digest").agg(F.min("licence").alias("licence"))
    )


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document row: doc_id, digest, licence, notice_lines, notices.

    ``licence`` is the licence whose text the whole document is, else null.
    ``notices`` are the licences of its lines, sorted, joined by commas ('' for
    none). A null or wordless text has a null digest. Repeated rows stay and get
    equal results. ``known`` has columns digest (unique) and licence.
    """
    known = known_licences(docs.sparkSession) if known is None else known
    known = known.select(F.col("digest").alias("k_digest"), F.col("licence").alias("k_licence"))
    if known.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    row = ["doc_id", "t1", "t2"]
    keyed = docs.select("doc_id", "text", F.xxhash64("text", F.lit(1)).alias("t1"),
                        F.xxhash64(F.lit(2), "text").alias("t2"))
    lines = F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), digest))
    found = (
        keyed.select(*row, F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("line"))
        .join(known, F.col("line") == F.col("k_digest"))
        .groupBy(*row)
        .agg(F.collect_set("k_licence").alias("names"), F.count_distinct("line").alias("notice_lines"))
        .select(*[F.col(c).alias(f"f_{c}") for c in row], "names", "notice_lines")
    )
    whole = keyed.select(*row, digest(F.col("text")).alias("digest")).join(
        known, F.col("digest") == F.col("k_digest"), "left"
    )
    same = F.col("doc_id").eqNullSafe(F.col("f_doc_id"))
    same = same & (F.col("t1") == F.col("f_t1")) & (F.col("t2") == F.col("f_t2"))
    return whole.join(found, same, "left").select(
        "doc_id", "digest", F.col("k_licence").alias("licence"),
        F.coalesce("notice_lines", F.lit(0)).cast("long").alias("notice_lines"),
        F.array_join(F.array_sort(F.coalesce("names", F.array().cast("array<string>"))), ",").alias("notices"),
    )
