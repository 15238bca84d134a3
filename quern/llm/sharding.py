"""Sharding by rendezvous hashing.

Each record key draws one exponential variate per shard from a hash of (key, shard), divided by the shard's weight,
and goes to the shard with the least. A key's draws don't depend on how many shards there are, so another shard only
takes the keys for which its own draw is the least, and no key moves between the old ones. Everything is computed
row by row; only the gapless slot numbers need a shuffle, of narrow rows.

Defined cases: a null key is a key like any other (all null keys share a shard); a null text is empty; rows with equal
keys share a shard and have slots of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed


def draw(key: Column, shard: int, weight: float) -> Column:
    """(exponential variate of the key at this shard, shard); the least one wins. A shard of weight 0 never does."""
    if weight < 0:
        raise ValueError("a shard's weight can't be negative")
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    cost = -F.log(u) / F.lit(float(weight)) if weight else F.lit(float("inf"))
    return F.struct(cost.alias("cost"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of each key."""
    if not weights or not any(weights):
        raise ValueError("at least one shard needs a positive weight")
    return F.array_min(F.array(*(draw(key, s, w) for s, w in enumerate(weights))))["shard"]


def slots(df: DataFrame, shard: str, order: Sequence[str]) -> DataFrame:
    """Add slot: 0, 1, ... within each shard. Each shard is numbered in many parts side by side, then the parts are offset."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    df = df.withColumn("__part", part)
    numbered = df.withColumn("__at", F.row_number().over(Window.partitionBy(shard, "__part").orderBy(*order)) - 1)
    counts = df.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return numbered.join(starts, [shard, "__part"]).withColumn("slot", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def shard_records(df: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """One row per record: the key, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, and grown_shard, its shard with one more."""
    body = F.coalesce(F.col(text), F.lit(""))
    placed = df.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
    )
    return slots(checkpointed(placed), "shard", [key, "text_crc32", "size"]).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
