"""Operator 1, sharding: a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, given by an offset and a
skip that come from its name. Shards take turns; at its turn a shard claims the next slot of its
order that is still free, until the table is full. A key's place is then one lookup:
``table[hash(key) mod size]``. Shares differ by one slot at most, and when a shard leaves few keys
of the others move.

The table has ``size`` rows whatever the data (65,537 by default, under 1 MB), so it is broadcast.

Defined results: a null key is placed as the empty string; repeated keys go to one shard; the input
may have columns named like the outputs, which are then replaced; an empty input gives no rows; no
shards, repeated names or a size that is no prime raise ``ValueError``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh

TABLE_SIZE = 65_537
SHARDS = 64


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's order: slot ``offset + turn * skip mod size``."""
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1


def lookup_table(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard's index for each slot."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names, one at least")
    if not _is_prime(size) or size < len(names):
        raise ValueError("the table's size must be a prime, not under the number of shards")
    orders = [preference(n, size) for n in names]
    at = [offset for offset, _ in orders]
    table, free = [-1] * size, size
    while True:
        for shard, (_, skip) in enumerate(orders):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + skip) % size
            table[slot] = shard
            at[shard] = (slot + skip) % size
            free -= 1
            if not free:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """60 bits of the key's MD5, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str, names: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` (int) and ``shard`` (the name): a map-side lookup, no shuffle."""
    names = shard_names() if names is None else names
    at, free, found = fresh(df, "at", "free_slot", "found_shard")
    rows = [(slot, names[i]) for slot, i in enumerate(lookup_table(names, size))]
    table = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(free, T.IntegerType()), T.StructField(found, T.StringType())])).coalesce(1)
    placed = df.withColumn(at, slot_of(F.col(key), size))
    joined = placed.join(F.broadcast(table), F.col(at) == F.col(free))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    return joined.select(*kept, F.col(at).alias("slot"), F.col(found).alias("shard"))


def write_shards(df: DataFrame, key: str, path: str, **options) -> None:
    """Write a folder for each shard. Rows are dealt by shard; large shards, and hot keys with them,
    are split over several tasks by their measured size (an adaptive rebalancing), and small ones
    share a task."""
    assign_shards(df, key, **options).drop("slot").hint("rebalance", F.col("shard")).write.partitionBy("shard").parquet(path)
