"""Placement of rows on shards by a permutation-filled lookup table.

Each shard walks its own permutation of the slots of a prime-sized table; in turns, every shard claims the
next slot of its walk that is still free. A row's key hashes to a slot. Adding or removing one shard moves
few keys, and each shard holds the same number of slots to within one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime; the table is at most so many rows whatever the data, so it may be broadcast.
SLOTS = 65_537
MAX_SLOTS = 1_000_003
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and one at least")
    if slots > MAX_SLOTS or slots < len(shards) or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    at = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of its text's MD5, modulo the table's size. A null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots))


def assign_shards(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, *, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df with a column for the slot and one for the shard's name; columns of these names are replaced.

    No shuffle: the table has a fixed number of rows and is broadcast. Equal keys (repeated rows, null keys)
    get equal shards; choose a key that is fine enough, such as a document's id, where one source may
    hold a third of all rows. An empty df gives an empty result.
    """
    own = [c for c in df.columns if c.lower() not in (shard.lower(), slot.lower())]
    rows = df.sparkSession.createDataFrame(list(enumerate(shards[i] for i in lookup_table(shards, slots))), "at int, shard string")
    # All columns of df go through the join in one struct, so that no name of theirs can clash.
    kept = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.lit(0)
    keyed = df.select(kept.alias("row"), slot_of(F.col(f"`{key}`"), slots).cast("int").alias("at"))
    placed = keyed.join(F.broadcast(rows), "at")
    return placed.select(*[F.col("row").getField(c).alias(c) for c in own], F.col("at").alias(slot), F.col("shard").alias(shard))


def oracle_sql(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> str:
    claimed = "".join(chr(48 + i) for i in lookup_table(shards, slots))
    return f"""
WITH s AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {slots} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot,
       'shard-' || lpad(CAST(ascii(substr('{claimed}', CAST(slot AS INTEGER) + 1, 1)) - 48 AS VARCHAR), 2, '0') AS shard
FROM s
"""
