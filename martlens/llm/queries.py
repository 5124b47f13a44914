"""The text operators as named queries over whole tables, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm import (
    chat, chunks, decontamination, language_id, licences, order_minhash, pivots, pu_quality,
    quality_rules, spelling, token_files, toxicity, warc,
)
from martlens.llm.sql_checks import statements
from martlens.session import tune, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.assess(table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    scanned = decontamination.scan(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    sizes = F.zip_with("scan.starts", "scan.ends", lambda a, b: b - a)
    n_hit = F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, x: acc + x)
    items = F.array_join(F.array_sort("scan.items"), ",")
    return scanned.select(
        "doc_id", "scan.n_words", n_hit.alias("n_hit"),
        F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = language_id.identify(table(spark, folder, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op5_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.read_archives(warc.archive(table(spark, folder, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.read_tokens(token_files.write_tokens(table(spark, folder, "documents"), VOCABULARY))


def op7_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(EXTRA_ID, turn, role, EXTRA_TEXT) for turn, role in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, folder, "conversations").select(*extra.columns).union(extra)
    read = chat.read_back(written(chat.format_conversations(turns)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("n_chars").alias("formatted_chars"),
    )


def op10_bpe_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.digests(chunks.encode_documents(table(spark, folder, "documents"), VOCABULARY))


def op11_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = pu_quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op12_pivot_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = pivots.cluster(table(spark, folder, "embeddings"))
    return rows


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


_QUERIES = (
    op1_quality_rules, op2_decontamination, op3_language_id, op4_licence_scan, op5_warc_bundles,
    op6_token_files, op7_order_minhash, op8_toxicity, op9_chat_formatting, op10_bpe_chunks,
    op11_quality_classifier, op12_pivot_clusters, op13_spelling_variants,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return statements()
