"""The corpus operators as queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import classify, decontaminate, oracle, pack, pii, secrets, shard, simhash, substrings, vectors


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = classify.train_quality(docs, read(spark, sf_dir, "labels"))
    return classify.digest(classify.quality(docs.select("doc_id", "text"), model), classify.KEEP_AT)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(read(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model, thresholds = classify.train_toxicity(docs, read(spark, sf_dir, "labels"))
    found = classify.toxicity(docs.select("doc_id", "text", "lang"), model, thresholds)
    return classify.digest(found, classify.TOXIC_AT, "threshold", "flagged")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.digest(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.digest(read(spark, sf_dir, "embeddings"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.digest(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_substrings": op3_substrings,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_pack": op7_pack,
    "op8_simhash": op8_simhash,
    "op9_embeddings": op9_embeddings,
    "op10_shard": op10_shard,
}

ORACLE = {
    "op1_decontaminate": oracle.DECONTAMINATE,
    "op3_substrings": oracle.SUBSTRINGS,
    "op4_secrets": oracle.SECRETS,
    "op6_pii": oracle.PII,
    "op9_embeddings": oracle.VECTORS,
}
