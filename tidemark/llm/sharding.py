"""Sharding: rendezvous hashing of record keys over weighted shards. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import gapless, read

#: Rows that one task ranks at once.
SLOT_ROWS = 50_000


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """(score, shard) of one shard; the smallest score of a key wins it, which happens in proportion to the weight. Depends on no other shard."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return F.struct((-F.log(uniform) / weight).alias("score"), shard.alias("shard"))


def assign(key: Column, weights: list[float]) -> Column:
    """The (score, shard) that wins the key among shards 0, 1, ... of the given weights."""
    shards = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in enumerate(weights)])
    return F.array_min(F.transform(shards, lambda x: draw(key, x["s"], x["w"])))


def shard_records(docs: DataFrame, weights: list[float], next_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard): a row for each row of docs.

    A shard scores every key by a hash of the two and its weight, and the smallest score wins: key and shards alone decide. With one more
    shard (of next_weight), the rows that it wins move to it and no other row moves: grown_shard. slot counts a shard's rows from 0 without gaps.
    size: UTF-8 bytes of the text and 16. Null text counts as empty, a null id is a key like others, repeated rows go together to one shard and
    have slots of their own. No rows give no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), assign(F.col(id_col), weights).alias("won"))
    more = draw(F.col("id"), F.lit(len(weights)), F.lit(float(next_weight)))
    rows = rows.select("id", "size", "text_crc32", F.col("won.shard").alias("shard"), F.when(more < F.col("won"), len(weights)).otherwise(F.col("won.shard")).alias("grown_shard"))
    chunks = 1 + docs.count() // (SLOT_ROWS * len(weights))
    return gapless(rows, ["shard"], ["id", "text_crc32", "size"], "slot", F.pmod(F.xxhash64("id"), F.lit(chunks)))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_records(read(spark, sf_dir, "documents"), [1.0] * 40)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
