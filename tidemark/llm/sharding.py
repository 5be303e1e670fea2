"""Placement of rows on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4099


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of every slot. ``slots`` is prime, so offset + j * skip visits all slots for each shard; shards
    take turns, each claiming the first free slot of its own order. Offset and skip come from the md5 of the name, so a
    shard that joins or leaves moves few slots of the others. Bounded by ``slots``, whatever the data."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct and at most as many as slots")
    digest = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    at = [int(d[:12], 16) % slots for d in digest]
    skip = [int(d[12:24], 16) % (slots - 1) + 1 for d in digest]
    out, taken = [-1] * slots, 0
    while taken < slots:
        for i in range(len(shards)):
            if taken == slots:
                break
            while out[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            out[at[i]] = i
            taken += 1
    return out


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard: ``slots`` rows, fit to be broadcast."""
    text = ",".join(map(str, fill(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with the columns slot and shard (a number into ``shards``), found by one broadcast look-up for each row
    and without a shuffle. Equal keys share a shard. A null key is placed as the empty text; rows may repeat; columns
    named slot and shard are replaced. An empty table gives an empty one. Only DataFrame functions are used."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    slot = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % slots).cast("int")
    keyed = df.drop("slot", "shard").withColumn("slot", slot)
    return keyed.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS, spread: int = 16) -> DataFrame:
    """Parquet files of ``df`` with its slot below ``path``/shard=N, and these files read again. Each shard's rows are
    dealt to ``spread`` tasks by a hash of all their columns (but maps, which have none), so that neither a shard nor the
    rows of one key are one task's work. Rows may repeat; null keys go where :func:`place` puts them; of an empty table
    there is an empty file. Only DataFrame functions are used."""
    placed = place(df, key, shards, slots)
    deal = F.pmod(F.xxhash64(*(c for c, kind in placed.dtypes if "map<" not in kind and "variant" not in kind)), F.lit(spread))
    placed.repartition(F.col("shard"), deal).write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)
