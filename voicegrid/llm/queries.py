"""The thirteen operators on their tables, as registered in ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, fingerprints, mixing, neardup, packing, pii, quality, search, secrets, topk, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(kind: str, spans: Column | str = "found") -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _line(spans: Column | str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"].isin(*secrets.BASE))
    counts = [_count(kind) for kind in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(_line(base), 256).alias("base_sha256"), _line("found").alias("spans"), (F.size("found") - F.size(base)).alias("n_linked"), "held_back")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.scan(docs, pii.train(docs))
    base = F.filter("found", lambda x: ~x["added"])
    counts = [_count(kind, base) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_line(base), 256).alias("base_sha256"), _line("found").alias("spans"), (F.size("found") - F.size(base)).alias("n_added"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_toxicity, op2_url_filter, op3_secrets, op4_fingerprints, op5_pii, op6_mixing, op7_bpe, op8_top_k, op9_quality, op10_near_duplicates, op11_source_divergence, op12_ranked_search, op13_packing)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.ORACLE_SQL, "op6_mixing": mixing.ORACLE_SQL, "op8_top_k": topk.ORACLE_SQL, "op11_source_divergence": divergence.ORACLE_SQL, "op12_ranked_search": search.ORACLE_SQL}
