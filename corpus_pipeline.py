"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Part of the corpus operators in ``trailforge.llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.llm import bpe, line_dedup, mixing, near_text, queries, toxicity
from trailforge.llm.common import small_batches, table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below 0.5. Without any labelled row of ``docs``
    nothing can be learned, and all stay."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(~queries.held_out())
    model = toxicity.character_model(docs)
    scored = toxicity.score(docs.withColumn("__tf_body", F.col("text")), model, toxicity.train(docs, labels, model), text="__tf_body", name="__tf_score")
    return scored.where("__tf_score < 0.5").select(*docs.columns)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; ``n_chars`` is counted anew. A
    document that loses every line stays, with an empty text."""
    small_batches(spark)
    out = line_dedup.drop_frequent_lines(docs)
    fresh = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns])


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more): the one
    with the smallest id. The trie self-join of SimHash fingerprints links first, an exact comparison
    follows; pairs beyond its bits are found by bands. Every row is a document, whether or not others
    have its id."""
    small_batches(spark)
    return near_text.keep_one(docs, near=near_text.jaccard_duplicates)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as often as it is drawn."""
    return mixing.mixed(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    small_batches(spark)
    out = bpe.encode_docs(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, kept_pieces=100_000)  # workers are shared by the stages
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_once),
    ("simhash_near_dedup", near_copies_out),
    ("mixing", mixed),
    ("byte_bpe", tokenized),
]

#: A learned score and a random draw are not for SQL: tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
