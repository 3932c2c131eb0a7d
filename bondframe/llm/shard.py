"""Sharding: rendezvous hashing of stable keys over weighted shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import docs_only

#: Rows that share a slot block; the number of blocks follows the row count.
BLOCK_ROWS = 65_536
LEAST_BLOCKS = 128


def _unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) from 52 bits of md5(key:salt); equal on any engine."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":" + salt))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(2**52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard 0..n-1 with the highest score -weight / ln(unit(key, shard)).

    Each shard's score depends on the key and that shard alone: a further
    shard can only take rows into itself, a removed one only gives its own
    rows away, and a changed weight moves rows to or from that shard only.
    A null key counts as the empty string. Ties go to the higher shard.
    """
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("weights must be positive and finite")
    key = F.coalesce(key.cast("string").cast("binary"), F.lit("").cast("binary"))
    scores = [F.struct((F.lit(-float(w)) / F.ln(_unit(key, str(i)))).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    return F.array_max(F.array(*scores))["i"] if len(scores) > 1 else F.lit(0)


def block_count(rows: int) -> int:
    return max(LEAST_BLOCKS, -(-rows // BLOCK_ROWS))


def assign_shards(docs: DataFrame, weights: list[float]) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of all documents.

    size: UTF-8 bytes of the text plus 1 (null text: 1); text_crc32: of the
    UTF-8 text (null text: null). slot numbers a shard's rows from 0 without
    gaps: rows are dealt over hashed blocks, numbered inside each block, and
    shifted by the sum of the earlier blocks' counts, so no task holds more
    than about BLOCK_ROWS rows of a shard. grown_shard: the shard once one
    more shard of the mean weight exists. Null ids form one key; repeated
    rows get slots of their own; an empty table gives an empty result.
    """
    d = docs_only(docs, doc_id="bigint", text="string")
    blocks = block_count(d.count())
    key = F.col("doc_id").cast("string")
    more = [*weights, sum(weights) / len(weights)]
    d = d.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, more).alias("grown_shard"),
        F.floor(_unit(F.coalesce(key, F.lit("")).cast("binary"), "slot") * blocks).cast("int").alias("block"),
    )
    counts = d.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    d = d.withColumn("rank", F.row_number().over(inside) - 1)
    return d.join(starts, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).alias("slot"), "grown_shard")
