"""A training-data pipeline from five of the operators; each stage is written as Parquet and read again by the next.

In every stage: a null or empty text is kept unless the stage says otherwise; rows without a doc_id are judged by their text
alone; rows equal in id and text go or stay together; other columns, whatever their names, pass through all stages but the last;
an empty table gives an empty one. Ties go to the smaller doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.llm import byte_bpe, contamination, jaccard_join, line_dedup, toxicity, workspace


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain, fitted on the labelled ones among them, does not reject; without labels none is rejected."""
    return toxicity.reject(docs, toxicity.fit(docs, workspace.table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, alike or nearly so, in an earlier document; one that is left without a word goes."""
    return line_dedup.dedup(docs)


#: What near copies are here: shingles of so many words, and percent of the union that two share; op3 has its own numbers.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id; texts without words are no copies."""
    return jaccard_join.one_of_each(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; without items nothing is taken out."""
    return contamination.decontaminate(docs, workspace.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens (0 for a null text), the ids as little-endian unsigned 32-bit integers, and the digest of what they decode to."""
    encoded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: The classifier chain, MinHash buckets and BPE have no SQL; tests hold each stage against a brute-force version or an exact round trip.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before wrote."""
    docs = workspace.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = workspace.new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
