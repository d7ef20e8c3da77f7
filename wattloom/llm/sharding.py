"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: offset + i x skip. The
shards take turns and each claims the first free slot of its order, until the table is full. A row goes to the
shard of slot hash(key) mod size. When a shard is added or removed, few slots change hands, and shards differ
by few slots. The table depends on the shard names only (4 bytes a slot), so it is broadcast.

A null key is hashed like any other value. Repeated rows go to one shard; extra columns are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import free_name

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preferences(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.blake2b(name.encode(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def lookup_table(names: list[str] | tuple[str, ...] = SHARDS, slots: int = SLOTS) -> np.ndarray:
    """Shard index of each slot. ``slots`` must be a prime and not below the number of shards."""
    names = list(names)
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and distinct")
    if not is_prime(slots) or slots < len(names):
        raise ValueError("the number of slots must be a prime and not below the number of shards")
    table, free = np.full(slots, -1, np.int32), slots
    # turns go by name, so the order in which the shards are listed does not matter
    turn = sorted(range(len(names)), key=names.__getitem__)
    at, skip = map(list, zip(*(preferences(n, slots) for n in names)))
    while free:
        for s in turn:
            while table[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            table[at[s]] = s
            free -= 1
            if not free:
                break
    return table


def place(df: DataFrame, key: str = "doc_id", names: list[str] | tuple[str, ...] = SHARDS, slots: int = SLOTS,
          slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Adds the slot and the shard of each row: one lookup in the broadcast table per row, no shuffle. Columns of the input that
    already have these names go on as ``input_slot`` and ``input_shard``."""
    import pandas as pd
    lookup = df.sparkSession.createDataFrame(pd.DataFrame({
        slot: np.arange(slots, dtype=np.int32), shard: [list(names)[i] for i in lookup_table(names, slots)]}))
    at = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0"))), F.lit(slots)).cast("int")
    to = {c: free_name(df, f"input_{c}") if c.lower() in (slot, shard) else c for c in df.columns}
    own = df.select(*[F.col(f"`{c}`").alias(n) for c, n in to.items()], at.alias(slot))
    return own.join(F.broadcast(lookup), slot).select(*[F.col(f"`{n}`") for n in to.values()], slot, shard)


def write_shards(df: DataFrame, folder: str, key: str = "doc_id", names=SHARDS, slots: int = SLOTS,
                 files: int = 4) -> None:
    """Whole rows and their slot as Parquet, one folder per shard. The rows of a shard are spread over ``files``
    parts by a hash of the row, so that a frequent key is not one task; Spark splits parts that are still large
    and joins small ones."""
    placed = place(df, key, names, slots)
    hashed = [F.col(f"`{f.name}`") for f in placed.schema.fields if "map<" not in f.dataType.simpleString()]
    salt = free_name(placed, "_salt")
    placed.withColumn(salt, F.pmod(F.xxhash64(*hashed), F.lit(files))) \
        .hint("rebalance", F.col("shard"), F.col(salt)).drop(salt).write.partitionBy("shard").parquet(folder)
