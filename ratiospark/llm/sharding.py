"""Permutation-filled lookup table: constant-time placement of rows on shards.

Each shard has a permutation of the slots of a prime-sized table, given by an
offset and a step taken from its name.  The shards take turns; at its turn a
shard claims the first slot of its permutation that is still free.  A row's key
is hashed to a slot, and the slot's owner is the row's shard.  Adding or
removing a shard moves little more than that shard's share of the slots.

The table has a fixed size (``TABLE_SIZE``), so broadcasting it is bounded
whatever the data.  Filling it is a loop over those slots; placing rows uses
DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, about 128 slots for each of 128 shards.
TABLE_SIZE = 16381
#: Placement of the query.
SHARDS = tuple(f"shard-{k:03d}" for k in range(128))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The owner (index in ``shards``) of every slot; ``size`` must be prime and the names distinct."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one, at most one a slot")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    place = [_number(f"{s}/offset") % size for s in shards]
    step = [_number(f"{s}/step") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        k = turn % len(shards)
        while owner[place[k]] >= 0:
            place[k] = (place[k] + step[k]) % size
        owner[place[k]] = k
    return owner


def lookup_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The table as rows (slot, shard): ``size`` rows, from one literal."""
    owners = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select(F.col("slot").cast("long"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key's text: its MD5's first 60 bits, modulo the size; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(size)


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with its ``slot`` (long) and ``shard`` (string); columns of these names are replaced.

    Every row is placed: null keys go where the empty text goes, repeated rows
    go together.  No shuffle: the table is broadcast.
    """
    rows = df.drop("slot", "shard") if key not in ("slot", "shard") else df.withColumnRenamed(key, f"{key}_key").drop("slot", "shard")
    key = key if key in rows.columns else f"{key}_key"
    return rows.withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(lookup_frame(df.sparkSession, shards, size)), "slot", "left")
