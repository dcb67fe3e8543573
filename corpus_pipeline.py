"""Corpus pipeline: documents pass through the stages in order; each stage is written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from saccadia.llm import decontaminate, language_id, near_dup, piece_codec, repeats
from saccadia.llm.common import stage


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network recognises stay; texts that are NULL, without letters or too uncertain go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints (four-word shingles, four bits at most) the one with the smallest doc_id stays.

    NULL and empty texts are one group; repeated rows of the document that stays, stay; an empty table stays empty.
    """
    return near_dup.keep_first(docs, width=4, radius=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere are cut out; every document stays, ``n_chars`` follows its text.

    NULL texts stay NULL, texts shorter than a passage stay whole.
    """
    return repeats.without_repeats(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text with their digests, and the digest of the text they decode to."""
    return piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("language ID", identified_language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("SentencePiece encoding and decoding", encoded),
]

#: No stage of this pipeline can be written as SQL; tests compare it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
