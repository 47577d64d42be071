"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` applies
them in turn and cuts the lineage after each in the session's checkpoint
folder.

Null texts are empty to every stage but stay null; the first stage drops them with
all texts without a letter.  Rows that repeat identifier and text pass or go
together.  A row without an identifier goes at near-deduplication if a document
of the same group has one.  Empty tables give empty results, and extra columns,
whatever their names, are carried along up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm import bpe_codec, decontamination, language_id, near_duplicates, pii
from stocktake.llm._graph import with_checkpoints
from stocktake.llm._rows import free


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those whose calibrated score is rejected, go."""
    return language_id.accepted(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity of 0.8 or more on five words) the smallest identifier stays."""
    name = free("_kept", docs)
    kept = near_duplicates.near_duplicates(docs, share=80, width=5).where("kept").select(F.col("doc_id").alias(name))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become placeholders; ``n_chars`` follows."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: token identifiers, and a digest of the text decoded from them."""
    coded = bpe_codec.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: Trained models and signatures have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = with_checkpoints(docs)
    return docs
