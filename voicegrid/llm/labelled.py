"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Labelled documents that a classifier is fitted on, and bytes of their texts, about; those beyond are left out by hash.
SAMPLE, SAMPLE_BYTES = 16_384, 64 << 20


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, value: int) -> Column:
    """Rows that no label is learnt from. A null doc_id has no label, so it isn't one of them."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(False))


def _below(share: float, *parts: Column) -> Column:
    """A seeded draw of that probability."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 31)) < int(min(1.0, share) * (1 << 31))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, value: int, size: int = SAMPLE, size_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(key, text, label) of about ``size`` labelled documents, ``size_bytes`` at most about, whose remainder isn't ``value``.

    First doc_ids are chosen by hash, about ``size`` of them, so they are broadcast and the
    documents are neither shuffled nor sorted. A doc_id with several texts, however many,
    is represented by one of them, chosen by hash: so neither repeats nor other texts of
    a doc_id make the sample larger or crowd others out. If the texts are too large together,
    they are thinned out by hash. A rerun has the same sample. Contradicting labels of
    a doc_id give the larger.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), modulus, value))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.where(_below(size / max(1, known.count()), F.col("doc_id"), F.lit("sample")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text", "label")
    found = texts.groupBy("doc_id").agg(F.min(F.struct("key", F.octet_length("text").alias("bytes"))).alias("one")).select("one.*")
    keys = materialize(found, "sample-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    few = keys.where(_below(size_bytes / max(1, total), F.col("key"), F.lit("text"))).select("key").distinct()
    return texts.drop("doc_id").join(F.broadcast(few), "key").dropDuplicates(["key"])
