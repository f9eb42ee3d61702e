"""A Bloom filter as one array of bits, built by grouping and read through a scalar subquery.

It keeps rows that cannot match from being shuffled; it never turns a listed key away. Each key has two bits. The
array has some 16 bits per key and at most 32 MiB, which bounds what a task holds; beyond some 16 million keys more
rows pass that match nothing, and results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS_A_KEY = 16
_MOST_BITS = 2**28


def bits_for(keys: int) -> int:
    """Number of bits of a filter of so many keys, a power of two."""
    return min(_MOST_BITS, max(1024, 1 << (keys * _BITS_A_KEY - 1).bit_length())) if keys else 1024


def _places(key: Column, bits: int) -> list[Column]:
    h = F.xxhash64(key)
    return [F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(bits - 1)) for shift in (0, 32)]


def build(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row with the column `words`: the bits of all keys, 64 in a number."""
    word, one = F.shiftright("place", 6).cast("int"), F.expr("shiftleft(1L, cast(place & 63L as int))")
    places = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("place"))
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    filled = places.select(word.alias("word"), one.alias("bits")).unionAll(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return filled.agg(F.expr("transform(array_sort(collect_list(struct(word, bits))), x -> x.bits) as words"))


def may_hold(built: DataFrame, key: Column, bits: int) -> Column:
    """Whether the key may be one of those that the filter was built from."""
    words = built.scalar()

    def is_set(place: Column) -> Column:
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    first, second = (is_set(place) for place in _places(key, bits))
    return first & second
