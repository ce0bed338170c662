"""Jump consistent hashing: stable keys to shards, with no table of the ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, salted_rank

#: Fixed value: multiplier of the published algorithm's 64-bit congruential generator.
MULTIPLIER = 2862933555777941757
#: Parts that the rows of a shard are ranked in; a fixed number, so that slots do not depend on the cluster.
SALTS = 1024
_HIGH, _LOW, _MASK = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF, 0xFFFFFFFF


def _next_key(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) 32-bit halves of key * MULTIPLIER + 1 mod 2**64, no product passing 2**49."""
    top, bottom = F.shiftright(low, 16), low.bitwiseAND(0xFFFF)
    cross = top * _LOW
    low_sum = bottom * _LOW + 1 + F.shiftleft(cross.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(low_sum, 32) + F.shiftright(cross, 16)

    def product(a: Column, b: int) -> Column:
        return (a.bitwiseAND(0xFFFF) * b + F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(0xFFFF), 16)).bitwiseAND(_MASK)

    new_high = (carry + product(low, _HIGH) + product(high, _LOW)).bitwiseAND(_MASK)
    return new_high, low_sum.bitwiseAND(_MASK)


def jump_shards(key: Column, shards: int) -> tuple[Column, Column]:
    """(shard of ``shards``, shard of ``shards + 1``) of a 64-bit key.

    The sequence of jumps does not depend on the number of shards, so one walk
    up to ``shards + 1`` gives both: the last jump below each. A null key
    counts as 0. Everything is long and double arithmetic in the JVM.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    long = lambda c: c.cast("long")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_MASK).cast("long")).alias("low"),
        long(F.lit(0)).alias("jump"),
        long(F.lit(0)).alias("small"),
        long(F.lit(0)).alias("grown"),
    )

    def walk(s: Column, _: Column) -> Column:
        high, low = _next_key(s["high"], s["low"])
        jump = s["jump"]
        to = F.floor((jump + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        return F.when(jump > shards, s).otherwise(
            F.struct(
                high.alias("high"),
                low.alias("low"),
                long(to).alias("jump"),
                F.when(jump < shards, jump).otherwise(s["small"]).alias("small"),
                F.when(jump < shards + 1, jump).otherwise(s["grown"]).alias("grown"),
            )
        )

    # every jump is at least one shard, so shards + 1 steps pass the last shard
    done = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 2)), start, walk)
    return done["small"].cast("int"), done["grown"].cast("int")


def shard_table(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shard and slot of every row of ``docs(doc_id, text)``.

    Size is the text's UTF-8 bytes plus 8 (null text: 8, crc of no bytes).
    Rows that share a doc_id share a shard and take slots of their own; a null
    doc_id is key 0. Other columns are ignored. An empty table gives no rows.
    Slots are ranked in salted parts of each shard, so no task gets a shard: by doc_id and checksum modulo SALTS
    (each, and their sum), then doc_id (null first), checksum and size.
    """
    rows = columns_of(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    small, grown = jump_shards(F.col("doc_id"), shards)
    rows = rows.withColumn("law", F.lit("key")).withColumn("shard", small).withColumn("grown_shard", grown)
    rest = lambda c: F.pmod(c, F.lit(SALTS))
    salt = rest(F.coalesce(rest(F.col("doc_id")), F.lit(0)) + rest(F.col("text_crc32")))
    ranked = salted_rank(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], salt, "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
