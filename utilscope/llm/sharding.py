"""Stable shards by jump consistent hashing, in Spark SQL expressions only.

A key's generator is seeded with the key and visits a rising sequence of shards; with n shards
the key lies in the last one visited below n. So the shard depends on the key and n alone, there
is no ring or table, and one more shard takes its share of keys and moves no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utilscope.llm.numbering import numbered

# The generator of the published algorithm.
MULTIPLIER = 2862933555777941757
WORD = 1 << 64


def jump_shards(key: str, shards: int) -> Column:
    """Struct (`shard`, `grown_shard`) of the LONG column `key`, for `shards` and one more.

    A NULL key counts as 0. The generator's 64-bit words are decimals: their products stay
    below 10**38, so nothing overflows.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    step = f"""
      transform(
        array(cast((a.key * {MULTIPLIER}BD + 1) % {WORD}BD as decimal(38,0))),
        k -> named_struct(
          'key', k,
          'next', cast(floor((a.next + 1) * (2147483648D / cast((k div 8589934592BD) + 1 as double))) as bigint),
          'shard', if(a.next < {shards}, a.next, a.shard),
          'grown_shard', a.next))[0]"""
    start = f"""
      named_struct(
        'key', cast(pmod(cast(coalesce({key}, 0) as decimal(38,0)), {WORD}BD) as decimal(38,0)),
        'next', 0L, 'shard', 0L, 'grown_shard', 0L)"""
    return F.expr(f"""
      aggregate(
        sequence(1, {shards + 1}), {start},
        (a, i) -> if(a.next > {shards}, a, {step}),
        a -> named_struct('shard', cast(a.shard as int), 'grown_shard', cast(a.grown_shard as int)))""")


def shard_rows(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row: `id`, `size`, `text_crc32`, `law`, `shard`, `slot`, `grown_shard`.

    The law is `key`: the id and the number of shards decide. `size` is the text's UTF-8 bytes
    plus one. Slots count a shard's rows from 0 by id, checksum and place in the input, so they
    are gapless also for repeated rows. NULL texts have no bytes; rows of NULL id share a shard.
    """
    data = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id).cast("long").alias("_id"), (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(F.encode(data, "UTF-8")).alias("text_crc32"),
    )
    placed = rows.withColumn("_jump", jump_shards("_id", shards)).select(
        "_id", "size", "text_crc32", F.lit("key").alias("law"), "_jump.shard", "_jump.grown_shard"
    )
    return numbered(placed, ["_id", "text_crc32"], "slot", within="shard").select(
        F.col("_id").alias(id), "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
