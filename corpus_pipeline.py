"""Corpus pipeline: quality, near-dedup, substring dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns the columns of ``documents``; the last returns token ids and
digests.  ``run`` writes every stage's result as Parquet in the shared folder
and rereads it for the next.

Nulls: a null text is judged like an empty one.  Rows without doc_id take no
part in the two dedup stages' decisions and stay.  SQL can express neither the
classifier nor the tokeniser, so the stages are tested against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import decontaminate, minhash, quality, queries, substring_dedup
from sitelens.llm.common import checkpoint_dir, read

ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="quality_score").where("quality_score >= 0.5").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    stay = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller doc_id also has go; texts without any
    stay as they are."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    done = substring_dedup.substring_dedup(docs, carry=rest, untouched=True)
    return done.select("doc_id", F.col("kept_text").alias("text"), "n_removed", "carried.*") \
        .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.flag(docs, read(spark, sf_dir, "benchmark"), out="benchmark_matches")
    return found.where(F.size("benchmark_matches") == 0).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of the ids and of their bytes."""
    return queries.bpe_digests(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", strip_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    top = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
