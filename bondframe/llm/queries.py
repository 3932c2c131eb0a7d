"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, embeddings, langid, lines, quality, secrets, shard, simhash, urls

SHARDS = 8
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return out.withColumn("law", F.lit("key"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(table(spark, sf_dir, "documents"), width=3)
    return out.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages by the document number in their url: low quality counts as bad."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (F.lit(1) - F.col("quality")).alias("bad"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge_urls(table(spark, sf_dir, "pages"), RULES, url_labels(spark, sf_dir))
    return out.select("page_id", "host", "path", "rule", "verdict", "template")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.dedup_embeddings(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", "kept", "recall")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(langid.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    learn = docs.filter(F.col("doc_id").isNotNull() & ~held)
    net = langid.train(learn.select(F.col("doc_id").alias("key"), "text", "lang"))
    out = langid.predict(docs, net)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), F.col("n_common").cast("bigint").alias("n_common"))


def quality_net(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.PuNet:
    """A network from the rows of ``docs`` outside the held-out fold and their labels."""
    labels = table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("positive"))
    labels = labels.groupBy("key").agg(F.bool_and("positive").alias("positive"))
    texts = docs.select(F.col("doc_id").alias("key"), "text").filter(F.coalesce(langid.fold(F.col("key"), 3) != 1, F.lit(False)))
    return quality.train(texts.select("key").join(labels, "key", "left"), texts)[0]


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score_documents(docs, quality_net(spark, docs, sf_dir))
    held = F.coalesce(langid.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_simhash, op3_url_filter, op4_bpe, op5_line_dedup, op6_secrets, op7_embedding_dedup, op8_language_id, op9_decontamination, op10_quality)
}
