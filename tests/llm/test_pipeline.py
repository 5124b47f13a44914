"""The pipeline against brute force on small documents with planted cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from martlens.llm import language_id, order_minhash, queries
from tests.llm.test_text_operators import DOCS, edited, prose

OTHER = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce".split()


def test_stages_and_result(spark, tmp_path):
    benchmark = [(1, prose(900, 40))]
    texts = {i: prose(i, 90) for i in range(60)} | {60 + i: prose(i, 90, OTHER) for i in range(40)}
    texts |= {100: texts[3], 101: edited(texts[4], 1, 1), 102: "too short", 103: None, 104: "### " * 80}
    texts |= {105: f"{prose(800, 50)} {prose(900, 40)} {prose(801, 50)}"}
    rows = [(i, t, "es" if 60 <= i < 100 else "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    assert {r.doc_id for r in docs.collect()} == set(range(100))
    library = Tokenizer.from_file(queries.VOCABULARY)
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in result} == set(range(100))
    for row in result:
        ids = np.array(library.encode(texts[row.doc_id], add_special_tokens=False).ids, "<u4")
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and row.n_tokens == len(ids)


def test_language_stage_rejects_what_no_language_explains(spark, tmp_path):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    italian = "il governo annuncia che la nuova legge sulla scuola entra in vigore questo anno per tutti".split()
    planted = {
        200: prose(200, 80, italian),
        201: " ".join("".join(rng.choices(letters, k=7)) for _ in range(80)),
        202: " ".join("".join(rng.choices("бвгдежзиклмн", k=6)) for _ in range(80)),
        203: f"{prose(1, 4)} {prose(201, 76, italian)}",
    }
    texts = {i: prose(i, 90) for i in range(60)} | {60 + i: prose(i, 90, OTHER) for i in range(40)}
    rows = [(i, t, "es" if 60 <= i < 100 else "en", f"s{i % 3}", len(t)) for i, t in texts.items()]
    rows += [(i, t, None, "s", len(t)) for i, t in planted.items()]
    docs = spark.createDataFrame(rows, DOCS)
    good = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert {r.doc_id for r in good.collect()} == set(texts) | set(planted)
    assert {r.doc_id for r in corpus_pipeline.language(spark, good, str(tmp_path)).collect()} == set(texts)


def test_equal_evidence_tells_no_language():
    grams, _ = language_id.grams_of([b"alpha beta gamma"])
    both = language_id.BitSlicedFilter(["a", "b"], np.concatenate([grams, grams]), np.repeat([0, 1], len(grams)))
    assert both.judge(["alpha beta gamma"])[0] == ("a", 0.5, False)
    one = language_id.BitSlicedFilter(["a", "b"], grams, np.zeros(len(grams), int))
    assert one.judge(["alpha beta gamma"])[0] == ("a", 1.0, True)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


CLASHES = "n class_id node _node id row label key scan guess _guess place text_2 told host t1 l1 s kept".split()


def test_columns_of_any_name_come_back_unchanged(spark, tmp_path):
    """Every filtering stage keeps further columns, whatever it calls its own."""
    rows = [(i, prose(i, 90), "en", f"s{i % 3}", 1, *[f"{i}-{c}" for c in CLASHES]) for i in range(40)]
    rows += [(90, rows[3][1], "en", "s", 1, *[f"90-{c}" for c in CLASHES])]
    rows += [(91, f"{prose(800, 50)} {prose(900, 40)}", "en", "s", 1, *[f"91-{c}" for c in CLASHES])]
    schema = DOCS + "".join(f", {c} string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, prose(900, 40))], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    left = [set(range(40)) | {90, 91}] * 2 + [set(range(40)) | {91}, set(range(40))]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[5:] == CLASHES
        docs.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        found = docs.collect()
        assert {r.doc_id for r in found} == left[number]
        assert all(r[c] == f"{r.doc_id}-{c}" for r in found for c in CLASHES)


def test_near_duplicates_leave_the_session_as_it_was(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    rows = [(i, prose(i % 5, 60), "en", "s", 1) for i in range(10)]
    order_minhash.keep_first(spark.createDataFrame(rows, DOCS)).collect()
    assert spark.conf.get(setting) == before
