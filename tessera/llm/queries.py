"""Queries of the training-data operators over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import binpack, cutoff, encode, neardup, similar, spam, textform
from tessera.shared import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return textform.same_reading_pairs(spark.read.parquet(f"{d}/corpus.parquet"))


def p1_form(spark: SparkSession, d: str) -> DataFrame:
    return textform.with_form(table(spark, d, "corpus").select("ord", "text")).select("ord", "form")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return textform.same_reading_groups(table(spark, d, "corpus"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(spark.read.parquet(f"{d}/corpus.parquet"), threshold=0.6, k=3)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "corpus"), threshold=0.6, k=3)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    calls = cutoff.cut_calls(spark.read.parquet(f"{d}/llm_responses.parquet"), spark.read.parquet(f"{d}/extraction_results.parquet"))
    return calls.where("is_cut").select("record_kind", "record_id", "attempt_number")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_rates(cutoff.cut_calls(table(spark, d, "llm_responses"), table(spark, d, "extraction_results")))


def p4_evidence(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_evidence(cutoff.cut_calls(table(spark, d, "llm_responses"), table(spark, d, "extraction_results")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.nearest_pairs(similar.usable_vectors(spark.read.parquet(f"{d}/vector_store.parquet")))


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    near = similar.nearest(similar.usable_vectors(table(spark, d, "vector_store")), miss=0.00003)
    return near.withColumn("cosine", F.round("cosine", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.similarity_clusters(similar.usable_vectors(spark.read.parquet(f"{d}/vector_store.parquet"))).select("id", "cluster_id")


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vector_store")
    return similar.describe_clusters(similar.similarity_clusters(similar.usable_vectors(rows)), rows)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = encode.encode(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), out="size", count_only=True)
    return binpack.pack(sizes, "doc_id", "size", capacity=2048)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    scores = spam.spam_scores(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/page_labels.parquet"))
    return scores.where("is_spam").select("doc_id")


def p9_hosts(spark: SparkSession, d: str) -> DataFrame:
    scores = spam.spam_scores(table(spark, d, "documents"), table(spark, d, "page_labels"))
    return scores.groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.col("is_spam").cast("int")).alias("spam"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
