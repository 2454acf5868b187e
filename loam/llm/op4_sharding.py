"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table whose size is a prime: an offset and a step,
both from the shard's name. Shards take turns; at its turn a shard claims the first slot of its order that is still free,
until none is. Every shard ends with the same number of slots, but for one, and when a shard is added or lost few slots
change hands. A document's key is hashed to a slot, and the table, whose size is a parameter, is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: A prime far above the number of shards.
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The place in ``shards`` of each slot's owner."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime of at least the number of shards")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    offset = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    owner, turn, left = np.full(slots, -1, np.int32), list(offset), slots
    while left:
        for shard in range(len(shards)):
            slot = turn[shard]
            while owner[slot] >= 0:
                slot = (slot + step[shard]) % slots
            owner[slot], turn[shard] = shard, (slot + step[shard]) % slots
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A slot from the key's md5, so that any engine agrees; slot 0 for null."""
    number = F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long")
    return F.coalesce(F.pmod(number, F.lit(slots)), F.lit(0)).cast("int")


def free_name(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as it takes to meet none of ``columns``, in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shard_documents(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``docs`` with two columns after its own: the slot and the owner's name; no shuffle, the table's ``slots`` rows are broadcast.

    They are called _slot and _shard, or free_name() of those where ``docs`` has such columns, which keep names and values.
    Rows of one key share a shard, so repeated rows and copies of an id stay together; a null key is in slot 0. Texts
    of any length are not read. An empty table stays empty.
    """
    owner = lookup_table(shards, slots)
    slot, shard = free_name(docs.columns, "_slot"), free_name(docs.columns, "_shard")
    table = docs.sparkSession.createDataFrame([(k, shards[place]) for k, place in enumerate(owner.tolist())], "of int, owner string")
    placed = docs.withColumn(slot, slot_of(F.col(key), slots))
    joined = placed.join(F.broadcast(table), placed[slot] == table["of"])  # slot and table are never null, every slot has an owner
    return joined.select(*[placed[c] for c in placed.columns], table["owner"].alias(shard))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, of what shard_documents() gave: its last column names the folders, the one before is dropped."""
    slot, shard = sharded.columns[-2:]
    sharded.drop(slot).write.partitionBy(shard).parquet(path)


def oracle_sql(shards: list[str], slots: int = SLOTS) -> str:
    """The query's SQL; the table is a list of places in it."""
    owners = ",".join(map(str, lookup_table(shards, slots).tolist()))
    names = ",".join(f"'{name}'" for name in shards)
    return f"""
WITH placed AS (
  SELECT doc_id, coalesce(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % {slots}, 0)::INTEGER AS slot,
         coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes
  FROM documents
), t AS (SELECT [{owners}]::SMALLINT[] AS owner, [{names}] AS name)
SELECT doc_id, slot, t.name[t.owner[slot + 1] + 1] AS shard, n_bytes FROM placed, t
"""
