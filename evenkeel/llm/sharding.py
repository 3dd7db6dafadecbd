"""Sharding by rendezvous hashing: each key goes to the shard with the best weighted score.

Every (key, shard) pair has a pseudo-random score that depends on nothing else, so a shard that is
added takes rows only into itself and a shard that is removed gives up only its own. All of it is
DataFrame functions; the rows' other columns never move.

Only key and text are read; the key's name must not be one of the result's other columns. Null keys are
one key like any other. Equal keys share a shard, however many rows they have; rows
alike get slots of their own. A null or empty text has size 1 and the checksum of no bytes. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import documents
from evenkeel.session import materialize


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0 to len(weights)-1 for a key; a shard of twice the weight gets twice the keys.

    The score of a shard is -ln(u) / weight with u uniform in (0, 1) from the hash of key and shard;
    the least score wins.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return (F.least(*scores) if len(scores) > 1 else scores[0]).getField("shard")


def with_slots(df: DataFrame, shard: str, slot: str, buckets: int = 1024) -> DataFrame:
    """Number the rows of each shard from 0 without a gap, in an order given by the rows' values.

    Equal rows are counted before they are shuffled. A shard's rows fall into ``buckets`` buckets by
    hash; the bucket totals (shards x buckets rows, whatever the input) give where each bucket
    starts, and a window within the bucket does the rest, so no task holds a whole shard.
    """
    values = [c for c in df.columns if c != shard]
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    counted = materialize(counted.withColumn("__bucket", F.pmod(F.xxhash64(*values), F.lit(buckets))))  # read twice below
    starts = counted.groupBy(shard, "__bucket").agg(F.sum("__n").alias("__total"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(shard, "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(shard, "__bucket").orderBy(*values).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))
    return (
        placed.join(F.broadcast(starts), [shard, "__bucket"])
        .select(*df.columns, "__start", "__before", copies.alias("__copy"))
        .select(*df.columns, (F.col("__start") + F.col("__before") + F.col("__copy")).alias(slot))
    )


def shard_texts(docs: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """``key``, size, text_crc32, law, shard, slot and grown_shard (with one shard more) in equally weighted shards."""
    whole = F.coalesce(docs[text], F.lit(""))
    keyed = docs.select(
        key,
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(docs[key], [1.0] * shards).alias("shard"),
        rendezvous_shard(docs[key], [1.0] * (shards + 1)).alias("grown_shard"),
    )
    return with_slots(keyed, "shard", "slot").select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards, and where each would go with one shard more."""
    return shard_texts(documents(spark, sf_dir), "doc_id", "text", 16)
