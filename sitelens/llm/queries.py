"""Registered queries of the training-data operators: one for each, over its
whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import (bpe, decontaminate, divergence, exact_dedup, hnsw, html_blocks, lm_backoff, minhash, quality, shard,
                          spelling, substring_dedup, warc)
from sitelens.llm.common import read

SHARDS = 8
PAGES_PER_FILE = 500


def tokenizer() -> tuple[str, str]:
    """(ranks file, pre-token pattern) of the production vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.substring_dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) encoded and decoded: doc_id, tokens, n_tokens
    and the digests of the ids and of the decoded bytes."""
    path, pattern = tokenizer()
    return bpe.encode(docs, path, pattern, carry=("doc_id",), decoded="decoded").select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens",
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents")).drop("tokens")


def _replica(pages: DataFrame, damaged: bool) -> DataFrame:
    """Leaves of the pages written as WARC files of ``PAGES_PER_FILE`` pages;
    the damaged replica has changed, torn and lost records."""
    rows = pages.where("page_id IS NOT NULL").select(
        F.concat(F.lit("pages-"), F.floor(F.col("page_id") / PAGES_PER_FILE).cast("string"), F.lit(".warc")).alias("file"),
        F.col("page_id").alias("record_id"), warc.record(F.col("url"), F.col("html")).alias("record"))
    body = F.col("record")
    if damaged:
        body = F.when(F.col("record_id") % 97 == 13, F.regexp_replace(body, "^WARC/1.0", "WARC/1.1")) \
            .when(F.col("record_id") % 89 == 7, F.substring(body, 1, 60)).otherwise(body)
    # Offsets are those of the undamaged files; only digests and lengths are exchanged.
    rows = rows.select("file", "record_id", F.octet_length("record").cast("long").alias("length"),
                       F.octet_length(body).cast("long").alias("stored"), F.sha2(body.cast("binary"), 256).alias("digest"))
    lost = F.col("record_id") % (83 if damaged else 79) == (11 if damaged else 5)
    return warc.place(rows).where(~lost).select("file", "offset", F.col("stored").alias("length"), "digest")


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.audit(_replica(pages, False), _replica(pages, True))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.flag(docs, read(spark, sf_dir, "benchmark"), carry=("doc_id",))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(read(spark, sf_dir, "embeddings"))


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, carry=("doc_id",)).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.extract_text(pages, carry=("page_id", "url")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_backoff.backoff_scores(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "log_score_micro", "mean_log", "n_unseen",
        F.col("n_by_order")[0].alias("n_unigram"), F.col("n_by_order")[1].alias("n_bigram"))


def op10_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    return shard.uniform_shards(docs, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(read(spark, sf_dir, "documents"), noise=True))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(read(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_byte_bpe, op3_warc_fixity, op4_decontaminate, op5_hyperminhash, op6_hnsw,
        op7_quality_mil, op8_html_blocks, op9_backoff_lm, op10_hypergeometric_shards, op11_spelling_variants,
        op12_source_divergence, op13_exact_dedup)}
