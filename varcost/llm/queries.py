"""One query per corpus operator over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varcost.llm import (
    decontamination, divergence, exact_dedup, katz, line_dedup, merkle, near_dedup, packing, quality, repeats, token_counts, warc,
    windows,
)
from varcost.llm.common import fold
from workload.local import prepare

# The vocabulary that token counts are made with; only its path is known here.
VOCABULARY = os.environ.get("VARCOST_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The tokenizer that windows are packed with; without a path, the public file of that name.
TOKENIZER = os.environ.get("VARCOST_TOKENIZER")


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 4) == 2
    scored = quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select(
        "doc_id", "keep_id", *_long("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", *_long("class_size"), "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", *_long("n_lines", "n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 10) == 0
    scored = katz.katz_scores(_table(spark, sf_dir, "documents"), train=~held_out)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), *_long("n_tokens", "n_known", "train_tokens"), "base_score", "score"
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.read_ranks(VOCABULARY))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    records = warc.read_warc(warc.write_warc(pages))
    return records.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", *_long("n_bytes", "n_removed", "n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", *_long("n_item", "n_shared"), "containment")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    changed = [F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in fields]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.hex_of(merkle.leaf_digest(changed)))
    proofs = merkle.merkle_proofs(_table(spark, sf_dir, "documents"), fields, also={"tampered": tampered})
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_windows(_table(spark, sf_dir, "documents"), tokenizer_path())


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_katz": op5_katz,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_repeats": op8_repeats,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_merkle": op11_merkle,
    "op12_windows": op12_windows,
    "op13_divergence": op13_divergence,
}
