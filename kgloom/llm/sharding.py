"""Stable shard placement by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. The shards take turns claiming the
next free slot in their order of preference until the table is full, so shards hold equal numbers of slots,
and adding or removing a shard moves little else. Placing a row is one hash and one lookup in the
table, which is broadcast; its size is that of the table, whatever the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65537
SHARDS = 256


def fill(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """Index into names for each slot. Names must be distinct and not more than slots, a prime."""
    if not names or len(set(names)) < len(names) or len(names) > slots:
        raise ValueError("shard names must be distinct, at least one, and no more than the slots")
    if slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime above 2")
    digest = [hashlib.sha256(n.encode()).digest() for n in names]
    at = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digest]
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(names)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return np.array(table, np.int32)


def shard(rows: DataFrame, id_col: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """(id, slot, shard) of every row; shard is a name's index. Default: 256 shards named shard-0000 on.

    Rows with equal ids, repeated rows included, and so of one hot id, share a shard, on every run and cluster. A null id counts as the empty string; any
    id type goes by its string form; other columns don't matter; an empty table gives no rows. Where the id
    is itself called slot or shard, the new column of that name has an underscore more.
    """
    names = names or [f"shard-{i:04d}" for i in range(SHARDS)]
    table = rows.sparkSession.createDataFrame(list(enumerate(fill(names, slots).tolist())), "__slot int, __shard int")
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(slots)).cast("int")
    placed = rows.select(F.col(id_col).alias("__id"), slot.alias("__at")).join(F.broadcast(table), F.col("__at") == F.col("__slot"))
    free = lambda c: c + "_" if c == id_col.lower() else c
    return placed.select(F.col("__id").alias(id_col), F.col("__slot").alias(free("slot")), F.col("__shard").alias(free("shard")))
