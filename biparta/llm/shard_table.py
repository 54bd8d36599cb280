"""Sharding: a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (a start and
a step, both hashes of its name); shards take turns and each claims its first free
slot. A key goes to the owner of slot hash(key) mod size. The table is a configuration:
its size does not depend on the data, so broadcasting it as a literal is safe. Adding or
removing a shard moves few keys besides those it must move.

Defined cases: a null key hashes as the empty string; equal keys meet in one shard; an
empty table gives no rows; a column named like a new one is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biparta.functions.hashing import draw_int

TABLE_SIZE = 4099
SEED = 23


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}|{name}".encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Owner (place in ``shards``) of each slot; owners differ by one slot at most."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime not below the number of shards")
    at = [_number(s, "start") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return (draw_int(SEED, F.coalesce(key.cast("string"), F.lit(""))) % F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``: constant time per row, no shuffle."""
    table = F.lit(fill_table(shards, size))
    names = F.lit(shards)
    placed = df.withColumn("slot", slot_of(F.col(key), size))
    return placed.withColumn("shard", F.element_at(names, F.element_at(table, F.col("slot") + 1) + 1))


def write_shards(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("shard").parquet(path)
