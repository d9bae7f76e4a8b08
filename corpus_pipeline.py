"""The corpus pipeline: from raw documents to token ids, each stage written as Parquet before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm import bpe, linededup, nearcopies, quality, suffixes
from gridpulse.llm.common import Scratch, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.reject(docs, table(spark, folder, "labels"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Line dedup: runs of lines that an earlier place has go from the texts; every document stays."""
    left = linededup.delete_repeated_runs(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """SimHash near-dedup: of each group of texts that verified links (Jaccard of 0.8 or more over five-word
    shingles) connect, the document with the smallest id stays."""
    return nearcopies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark window go."""
    return suffixes.remove_contaminated(docs, table(spark, folder, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Byte-level BPE: packed ids, and the hash of what they decode to."""
    encoded = bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return encoded.select("doc_id", bpe.n_tokens().alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("line dedup", delete_repeated_lines),
    ("near dedup", keep_one_of_each),
    ("decontamination", decontaminate),
    ("encoding", tokenize),
]

# Neither the fitted classifier nor the fingerprints can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs, scratch = table(spark, folder, "documents"), Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, folder))
    return docs
