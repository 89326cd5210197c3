"""Sharding by a permutation-filled lookup table.

Every shard walks its own permutation of the slots of a prime-sized table; the shards take turns, each claiming the
first slot of its walk that is still free, until the table is full. Slots per shard differ by one at most, and a
changed list of shards moves few slots. A row's place is one lookup: ``table[hash(key) mod size]``.

The table has ``size`` small integers whatever the data (65,537 by default, about 1 MB as a relation), so that it is
broadcast safely; placement needs no shuffle. The hash is the top 60 bits of md5 over the key's text.

Cases: a null key counts as the empty text, so all null keys share a shard. Repeated keys get the same shard.
Extra columns stay; if they have the names of added columns, the input's are replaced. An empty table stays empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

SHARDS, TABLE_SIZE = 256, 65_537


def _digest(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The shard index of each slot. ``size`` must be a prime and at least the number of shards."""
    if not is_prime(size) or not 1 <= len(shards) <= size:
        raise ValueError("size must be a prime that is no less than the number of shards")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must differ")
    at = np.array([_digest(s, "offset") % size for s in shards])
    skip = np.array([_digest(s, "skip") % (size - 1) + 1 for s in shards]) if size > 1 else np.ones(len(shards), int)
    out, free = np.full(size, -1, np.int32), size
    while free:
        for k in range(min(len(shards), free)):
            while out[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            out[at[k]] = k
            free -= 1
    return out


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard`` (index into ``shards``)."""
    slots = df.sparkSession.createDataFrame(
        [(i, int(s)) for i, s in enumerate(lookup_table(shards, size))], "slot long, shard int"
    )
    added = ("slot", "shard")
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in added or c == key])
    if key.lower() in added:
        kept = kept.withColumnRenamed(key, f"{key}_key")
        key = f"{key}_key"
    return kept.withColumn("slot", slot_of(F.col(f"`{key}`"), size)).join(F.broadcast(slots), "slot").select(
        *[F.col(f"`{c}`") for c in kept.columns], "slot", "shard"
    )


def _names(shards: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)]


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, with its size as the consumer of a shard needs it."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    )
    return place(docs, "doc_id", _names(SHARDS)).select("doc_id", "slot", "shard", "n_bytes")


def op6_sql() -> str:
    owners = ",".join(map(str, lookup_table(_names(SHARDS))))
    return f"""
WITH owners AS (SELECT string_split('{owners}', ',') AS shard_of),
placed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot
  FROM documents)
SELECT doc_id, slot, shard_of[slot + 1]::INTEGER AS shard, n_bytes FROM placed, owners
"""
