"""Bloom filters as a small table of bitmaps, built and probed with DataFrame functions alone.

A filter has 16 bits per key in bitmaps of 4 KiB, and at most 32 MiB in all, which bounds its broadcast.
Both bits of a key lie in the same bitmap, so that one join probes them. With more than some 16 million
keys the share of false hits grows; a filter never misses a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITMAP_BITS = 32_768
_BITS_A_KEY = 16
_MOST_BITMAPS = 8_192


@dataclass
class Filter:
    """`table` has bitmap and bits; there are `bitmaps` of them, a power of two."""

    table: DataFrame
    bitmaps: int


def _places(key: str, bitmaps: int) -> tuple[Column, Column, Column]:
    """The bitmap of a key and its two bits there."""
    h = F.xxhash64(key)
    bit = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_BITMAP_BITS - 1))
    return h.bitwiseAND(F.lit(bitmaps - 1)), bit(32), bit(48)


def _is_set(bitmap: str, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7)).cast("int"))) > 0


def build(keys: DataFrame, key: str, repeated: bool = False) -> Filter:
    """A filter of the keys of a stored frame, or with `repeated` of the bits that two or more rows have set."""
    full = -(-keys.count() * _BITS_A_KEY // _BITMAP_BITS)
    bitmaps = min(_MOST_BITMAPS, 1 << max(0, full - 1).bit_length())
    where, one, two = _places(key, bitmaps)
    bits = keys.select(where.alias("bitmap"), F.explode(F.array(one, two)).alias("bit"))
    if repeated:
        bits = bits.groupBy("bitmap", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return Filter(bits.groupBy("bitmap").agg(F.bitmap_construct_agg("bit").alias("bits")), bitmaps)


def probe(rows: DataFrame, key: str, found: Filter, name: str) -> DataFrame:
    """The rows with a boolean column `name`: whether their key may be in the filter."""
    where, one, two = _places(key, found.bitmaps)
    probed = rows.withColumn("bitmap", where).join(F.broadcast(found.table), "bitmap", "left")
    return probed.withColumn(name, F.coalesce(_is_set("bits", one) & _is_set("bits", two), F.lit(False))).drop("bitmap", "bits")
