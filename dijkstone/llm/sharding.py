"""Sharding by a permutation-filled lookup table, in DataFrame and SQL functions.

Every shard has its own order of preference over the slots of a table of prime size: it starts at an offset and steps by a
skip, both hashed from its name. Shards take turns (a shard of weight w takes w at a time), each claiming its first free
slot, until the table is full. A key's slot is its hash modulo the table size: constant time, by a broadcast of the table,
whose size is a parameter. Taking a shard away moves its keys and few others.

Placement needs no shuffle, so a key that holds many rows is no hot spot; ``within`` deals the rows of a shard out further.

Defined results: null keys hash like the empty text. Equal keys lie in one shard. Extra columns pass through; one that has
the name of a result column is replaced. An empty table stays empty; no shards is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime of a hundred times the number of shards or more spreads keys within a few hundredths.
TABLE_SIZE = 65_537
RESULTS = ("slot", "shard")


def _number(text: str) -> int:
    """The first 60 bits of the MD5 of a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime, no less than the number of shards")
    offset = [_number(f"{s}/offset") % size for s in shards]
    skip = [_number(f"{s}/skip") % (size - 1) + 1 for s in shards]
    owner, next_, left = [-1] * size, [0] * len(shards), size
    while left:
        for i, s in enumerate(shards):
            for _ in range((weights or {}).get(s, 1)):
                if not left:
                    break
                while owner[slot := (offset[i] + next_[i] * skip[i]) % size] >= 0:
                    next_[i] += 1
                owner[slot] = i
                left -= 1
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign(rows: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """``rows`` with slot and shard."""
    rows = rows.drop(*(c for c in RESULTS if c != key))
    owners = ",".join(map(str, fill_table(shards, size, weights)))
    names = F.array(*map(F.lit, shards))
    table = rows.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner")).select("slot", F.get(names, F.col("owner").cast("int")).alias("shard"))
    placed = rows.withColumn("slot", slot_of(F.col(key), size))
    return placed.join(F.broadcast(table), "slot").select(*(c for c in rows.columns), "slot", "shard")


def write_shards(placed: DataFrame, path: str, within: int = 1) -> None:
    """Write one folder a shard; ``within`` tasks share the rows of each (dealt by a hash of the row, so a retried task deals alike)."""
    dealt = placed.withColumn("__part", F.pmod(F.xxhash64(*placed.columns), F.lit(within))).repartition("shard", "__part").drop("__part")
    dealt.write.partitionBy("shard").parquet(path)
