"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own (an offset and a stride from hashes of its
name).  Shards take turns in claiming their next free slot until the table is full, so all get within one of the same
number of slots and a removed shard moves little more than its own slots.  The table has a fixed size, which bounds the
broadcast; a row's slot is its key's hash modulo that size, so placing a row takes constant time and no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots, a prime well above 100 times the shards; rows in the broadcast table.
TABLE_SIZE = 65_537
#: Slots of a table, at most: it is broadcast.
MOST_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of its shard.  ValueError: no shards, a name given twice, more shards than slots, or a size that isn't prime or is above MOST_SLOTS."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if size > MOST_SLOTS or not _is_prime(size) or len(shards) > size:
        raise ValueError(f"the table's size must be a prime, at most {MOST_SLOTS}, and not less than the number of shards")
    start, stride = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(digest[:8], "big") % size)
        stride.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1)
    table, at, free = [-1] * size, list(start), size
    while free:
        for shard in range(len(shards)):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + stride[shard]) % size
            table[slot], at[shard] = shard, (slot + stride[shard]) % size
            free -= 1
            if not free:
                break
    return table


def lookup_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """slot, shard and shard_name for each slot."""
    rows = [(slot, shard, shards[shard]) for slot, shard in enumerate(fill_table(shards, size))]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the size.  A null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with the columns slot, shard and shard_name.

    Nulls in the key: all such rows go to the slot of the empty text, with the rows of that key.  Equal keys share a shard.  No other column is
    read; columns of ``df`` named slot, shard or shard_name are replaced.  An empty table stays empty.
    """
    rows = df.drop("slot", "shard", "shard_name").withColumn("slot", slot_of(df[key], size))
    return rows.join(F.broadcast(lookup_table(df.sparkSession, shards, size)), "slot", "left")


# ---- query ------------------------------------------------------------------------------------------------------

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard among 64 shards, by its id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard", "shard_name")


def sql() -> str:
    """The placement in SQL; the filled table is written out in it (its filling takes turns, which SQL can't express)."""
    return f"""
WITH t AS (SELECT {fill_table(SHARDS)} AS filled),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {TABLE_SIZE} AS INTEGER) AS slot FROM documents),
s AS (SELECT doc_id, slot, CAST(filled[slot + 1] AS INTEGER) AS shard FROM d, t)
SELECT doc_id, slot, shard, 'shard-' || lpad(CAST(shard AS VARCHAR), 3, '0') AS shard_name FROM s
"""
