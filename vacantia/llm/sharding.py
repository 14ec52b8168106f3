"""Sharding by a permutation-filled lookup table.

Every shard has a preference order of all slots of a table of prime size m (start and step
derived from hashes of its name; any step is coprime to a prime, so the order is a permutation).
Shards take turns, each claiming its first slot that is still free, until the table is full:
shares differ by one slot at most, and when a shard leaves, few slots of the others move. The table
has m small rows whatever the input (m is a parameter), so it is broadcast, and a document's
shard is one lookup: no shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime table size and number of shards of the registered query.
SLOTS = 65537
SHARDS = 64


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Shard number of every slot. ``slots`` must be prime and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, at most as many as slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table size must be prime")
    at = [_hash(s, "start") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    owner, free = np.full(slots, -1, np.int32), slots
    table = owner.tolist()
    while free:
        for k in range(len(shards)):
            c = at[k]
            while table[c] >= 0:
                c = (c + step[k]) % slots
            table[c] = k
            at[k] = (c + step[k]) % slots
            free -= 1
            if not free:
                break
    return np.array(table, np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key's text: the first 60 bits of its md5, modulo the size (null: the empty text)."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots).cast("int")


def table_rows(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    rows = [(i, int(k), shards[k]) for i, k in enumerate(fill(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def place(docs: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``docs`` with slot, shard and shard_name, a row for a row: equal keys share a slot, a null key is the empty text.

    Columns of these names that ``docs`` has already are kept as input_slot and so on (input_input_slot where that is taken too).
    """
    names = {}
    for c in ("slot", "shard", "shard_name"):
        free = c
        while free in docs.columns or free in names.values():
            free = f"input_{free}"
        if free != c:
            names[c] = free
    base = docs.withColumn("__slot", slot_of(F.col(key), slots)).withColumnsRenamed(names).withColumnRenamed("__slot", "slot")
    return base.join(F.broadcast(table_rows(docs.sparkSession, shards, slots)), "slot")


def placements(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row per row of ``docs`` (repeated and null ids too): doc_id, slot, shard, and shard_without_last: the shard if the last one leaves."""
    names = [f"shard-{i:04d}" for i in range(shards)]
    rest = table_rows(docs.sparkSession, names[:-1] or names, slots).select("slot", F.col("shard").alias("shard_without_last"))
    placed = place(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", names, slots)
    return placed.join(F.broadcast(rest), "slot").select("doc_id", "slot", "shard", "shard_without_last")
