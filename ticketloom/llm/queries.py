"""The registered queries of this package; each reads whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm.backoff_lm import score_documents
from ticketloom.llm.decontaminate import leaks
from ticketloom.llm.edit_embedding import edit_neighbours, fingerprint_edits
from ticketloom.llm.language_mixture import classify
from ticketloom.llm.license_scan import scan
from ticketloom.llm.multi_index import nearest
from ticketloom.llm.ngram_jaccard import jaccard_components
from ticketloom.llm.sentencepiece_codec import build_codec, encode, read_model
from ticketloom.llm.source_divergence import audit
from ticketloom.llm.substring_dedup import repeated_passages
from ticketloom.llm.url_rules import judge_urls, production_rules
from ticketloom.llm.warc import derivatives, field, responses
from ticketloom.llm.whitening import whiten

#: A public model of pieces with scores; a parameter, not part of this repository.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derivatives(responses(_table(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z"))
    return found.select(
        "record_id",
        "warc_type",
        "target_uri",
        "warc_date",
        "content_type",
        field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Concurrent-To").alias("concurrent_to"),
        field("WARC-Block-Digest").alias("block_digest"),
        field("WARC-Source-Payload-Digest").alias("source_payload_digest"),
        F.col("block").cast("string").alias("block"),
    )


def backoff_lm(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), build_codec(read_model(model)))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=3, threshold=0.9)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def edit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_neighbours(_table(spark, sf_dir, "documents"))


def sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), build_codec(read_model(model)), "doc_id")


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), production_rules())


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"))


def multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_derivatives": warc_derivatives,
        "op2_backoff_lm": backoff_lm,
        "op3_ngram_jaccard": ngram_jaccard,
        "op4_substring_dedup": substring_dedup,
        "op5_language_mixture": language_mixture,
        "op6_license_scan": license_scan,
        "op7_edit_embedding": edit_embedding,
        "op7b_edit_neighbours": edit_groups,
        "op8_sentencepiece": sentencepiece,
        "op9_decontaminate": decontaminate,
        "op10_url_rules": url_rules,
        "op11_source_divergence": source_divergence,
        "op12_multi_index": multi_index,
        "op13_whitening": whitening,
    }
