"""Sharding by jump consistent hashing, natively.

A key's shard follows from the key and the number of shards alone: a linear congruential generator seeded with the
key jumps forward through the bucket numbers, and the last bucket below the count is the shard. No ring table exists,
and one more shard takes only rows that jump into it. The jumps are 64-bit unsigned arithmetic; decimals hold the
products exactly, as bigint would overflow.

Cases: a null key counts as 0; a null text has size 1 and the checksum of the empty string; repeated rows each get a slot
of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, settle, text_of

#: Fixed values of the published generator.
MULTIPLIER, MODULUS = 2862933555777941757, 2**64


def jump_path(key: Column, shards: int) -> Column:
    """Struct (shard, grown_shard): the key's shard among `shards` and among one more."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    wide = "decimal(20,0)"
    seed = F.coalesce(key, F.lit(0)).cast("decimal(20,0)")
    unsigned = F.when(seed < 0, (seed + F.lit(Decimal(MODULUS))).cast(wide)).otherwise(seed)

    def advanced(state: Column) -> Column:
        return ((state * F.lit(Decimal(MULTIPLIER)).cast("decimal(19,0)") + F.lit(Decimal(1))) % F.lit(Decimal(MODULUS))).cast(wide)

    def top31(state: Column) -> Column:
        return F.floor(state / F.lit(Decimal(2**33))).cast("long")

    def step(s: Column, _: Column) -> Column:
        here = s["j"]
        ahead = F.floor(((here + 1) * F.lit(2**31)).cast("decimal(20,0)") / (top31(s["state"]) + 1).cast("decimal(20,0)")).cast("long")
        moved = F.struct(
            advanced(s["state"]).alias("state"), ahead.alias("j"),
            F.when(here < shards, here).otherwise(s["shard"]).alias("shard"), here.alias("grown_shard"),
        )
        return F.when(here <= shards, moved).otherwise(s)

    zero = F.lit(0).cast("long")
    start = F.struct(advanced(unsigned).alias("state"), zero.alias("j"), zero.alias("shard"), zero.alias("grown_shard"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: F.struct(s["shard"], s["grown_shard"]))


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id") -> DataFrame:
    """Each row's size, checksum, shard, place in the shard and the shard it would have among one more.

    Slots need no sort of a whole shard: rows are numbered inside (input partition, shard), and offsets come from the
    counts of those pairs. The keyed rows, without texts, are settled first, so both uses see the same numbering.
    """
    text = text_of(docs)
    placed = settle(
        docs.select(
            docs[key].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            jump_path(docs[key].cast("long"), shards).alias("path"), F.monotonically_increasing_id().alias("row"),
        ).select("doc_id", "size", "text_crc32", F.col("path.shard").cast("int").alias("shard"), F.col("path.grown_shard").cast("int").alias("grown_shard"), "row", F.shiftright("row", 33).alias("part")),
        "placed",
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return placed.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + inside - 1).alias("slot"), "grown_shard",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    return shard_documents(documents(spark, sf_dir))
