"""A map of bits of one size for any number of keys: those that it says are absent are absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A megabyte, whatever it is made of; chance hits only cost time.
MAP_BITS = 1 << 23


def bit_of(key: Column, bits: int = MAP_BITS) -> Column:
    return F.pmod(key, F.lit(bits))


def collected(keys: DataFrame, key: Column, *more: Column, bits: int = MAP_BITS) -> tuple[bytes, list]:
    """The map of keys (longs, nulls left out), and the rows of aggregates `more` by stretch of the map."""
    at, size = bit_of(key, bits) + 1, bits // 8  # numbered from 1
    parts = keys.groupBy(F.coalesce(F.bitmap_bucket_number(at), F.lit(0)).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"), *more).collect()
    out = bytearray(size)
    for r in parts:
        if r.part:
            out[(r.part - 1) * len(r.bits) : r.part * len(r.bits)] = r.bits
    return bytes(out), parts


def marked(rows: DataFrame, key: Column, keys: DataFrame, of: Column) -> DataFrame:
    """rows with a column hit: whether `key` may be among the longs `of` of keys.

    The map is a table of at most 256 rows of 4 KB, so it can be broadcast whatever
    the keys; as a constant it would swell every plan.
    """
    at = bit_of(of) + 1
    stretches = keys.groupBy(F.bitmap_bucket_number(at).alias("stretch")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    place = F.bitmap_bit_position(bit_of(key) + 1)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(stretches), F.bitmap_bucket_number(bit_of(key) + 1) == F.col("stretch"), "left").select(*rows.columns, hit.alias("hit"))
