"""Consistent sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a step from hashes of its
name). The shards take turns; each claims the first free slot of its permutation until the table is full. Placing a
row is then one hash and one lookup. The table depends only on the shard names and the prime, so its size is fixed
(65,537 rows of two small columns by default) and it can be broadcast whatever the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = 65_537
MAX_TABLE = 5_000_000


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = PRIME) -> np.ndarray:
    """For each slot, the index in `shards` of its owner. Shards must be distinct; size must be a prime above their number."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if size <= len(shards) or size > MAX_TABLE or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"size must be a prime above the number of shards and at most {MAX_TABLE}")
    offset = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 for s in shards]
    turn = [0] * len(shards)
    table, free = np.full(size, -1, dtype=np.int64), size
    while True:
        for i in range(len(shards)):
            while table[slot := (offset[i] + turn[i] * step[i]) % size] >= 0:
                turn[i] += 1
            table[slot] = i
            turn[i] += 1
            free -= 1
            if not free:
                return table


def slot_of(key_col: str, size: int = PRIME):
    """The slot of a key: 60 bits of the MD5 of its text, modulo the prime. A null key counts as the empty text."""
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("long")


def place(df: DataFrame, key_col: str, shards: list[str], size: int = PRIME, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """df with the columns slot and shard; existing columns of these names are replaced. Rows with equal keys go to one shard;
    nothing is shuffled, so a hot key costs nothing here. An empty table gives an empty table."""
    table = lookup_table(shards, size)
    rows = [(int(slot), shards[owner]) for slot, owner in enumerate(table)]
    owners = df.sparkSession.createDataFrame(rows, "slot long, shard string")
    keep = [c for c in df.columns if c not in (slot_name, shard_name)]
    keyed = df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("row"), slot_of(key_col, size).alias("slot"))  # apart, so that no name clashes
    met = keyed.join(F.broadcast(owners), "slot")
    return met.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("slot").alias(slot_name), F.col("shard").alias(shard_name))


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(docs, "doc_id", shard_names(64))
