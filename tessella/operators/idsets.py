"""Exact sets of ids as distributed bitmaps: one row for each bucket of 32,768 neighbouring ids that holds any.

A set is built by a partial aggregate that sends a bitmap for each bucket in place of the ids themselves, sets are joined by
or, and rows are tested by an equi-join on the bucket number with a bit test behind it. Buckets are few where ids are dense,
so the set is usually broadcast, after a check of its bytes, and the rows that are tested do not move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.bounded import hinted

IDS = 1 << 15  # bits of a bucket
BUCKETS = 5_000  # that are broadcast at most: 20 MB


def id_set(ids: DataFrame, key: str) -> DataFrame:
    """bucket, bits: the distinct ids of a column; null ids are left out."""
    v = F.col(key).cast("long")
    return ids.where(v.isNotNull()).groupBy(F.bitmap_bucket_number(v).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits"))


def either(*sets: DataFrame) -> DataFrame:
    """The union of sets."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _byte(bits: Column, at: Column) -> Column:
    """A byte of a bitmap (from 0) as a number."""
    return F.conv(F.hex(F.substring(bits, at + 1, F.lit(1))), 16, 10).cast("int")


def holds(bits: Column, id_: Column) -> Column:
    """Whether the bitmap of its bucket has the bit of an id."""
    at = F.bitmap_bit_position(id_.cast("long")).cast("int")
    return F.call_function("shiftright", _byte(bits, F.shiftright(at, 3)), at % 8).bitwiseAND(1) == 1


def within(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is in the set."""
    found = rows.alias("r").join(hinted(ids, BUCKETS).alias("s"), F.bitmap_bucket_number(F.col(f"r.{key}").cast("long")) == F.col("s.bucket"))
    return found.where(holds(F.col("s.bits"), F.col(f"r.{key}"))).select("r.*")


def members(ids: DataFrame, key: str) -> DataFrame:
    """The ids of a set, one a row: bytes that hold any, then their bits."""
    at = ids.select("bucket", F.posexplode(F.split(F.hex("bits"), "(?<=\\G..)")).alias("byte", "two")).where("two not in ('00', '')")
    bit = at.select("bucket", "byte", F.conv("two", 16, 10).cast("int").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    pos = (F.col("byte") * 8 + F.col("bit")).cast("long")
    above = (F.col("bucket") - 1) * IDS + pos + 1
    return bit.where(F.call_function("shiftright", F.col("v"), F.col("bit")).bitwiseAND(1) == 1).select(F.when(F.col("bucket") > 0, above).otherwise(F.col("bucket") * IDS - pos).alias(key))


def size(ids: DataFrame) -> int:
    """How many ids a set has."""
    return ids.agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0
