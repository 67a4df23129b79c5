"""From raw documents to token ids: quality, near copies, personal data, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents.

Rows with a null text count as empty texts; a null doc_id or source is a value like
others. Very long texts go through all stages whole. Rows that repeat, and rows whose
texts are near copies, are reduced to the one with the smallest doc_id by the second
stage, of ties one. Extra columns of documents, whatever their names, pass through
all stages but the last. An empty table passes through all of them. What a stage
writes in between, and the table that it read, are deleted once its result is written,
so that one copy of the corpus is left at the end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voicegrid.llm import bpe, mixing, neardup, pii, quality
from voicegrid.llm.store import scratch
from voicegrid.session import shared_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return neardup.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.masked(docs, pii.train(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, a last part cut to its words."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas) and the digests of ids and of the decoded text."""
    return bpe.encode_and_decode(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", one_of_each_group),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed_sources),
    ("BPE encoding and decoding", encoded),
]

#: The classifier, the skip-chain field and the encoder can't be put in SQL; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/stage-{number}-{uuid.uuid4().hex}"
        with scratch(spark) as written:
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
            if before:
                written.append(before)  # the stage before has been read for the last time
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
