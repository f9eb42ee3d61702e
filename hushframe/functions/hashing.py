"""SHA-1 and HMAC-SHA1 as built-in expressions, so hashing stays inside whole-stage codegen.

A key that is given as text is inlined as two literals, which show in query plans and event logs. A key that is
given as a `KeyFile` is named only: its pads are read from a protected file when the query runs, by a scalar subquery,
and no plan and no event log holds them. Keep encoding maps apart from the de-identified output either way.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_BLOCK = 64


def plain_sha1(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def key_pads(secret_key: str) -> tuple[bytes, bytes]:
    """Inner and outer pad of RFC 2104 for a SHA-1 key; keys over one block are hashed first."""
    key = secret_key.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha1(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


@dataclass(frozen=True)
class KeyFile:
    """A secret key by reference: a file in a protected folder that holds its two pads."""

    spark: SparkSession
    path: str

    def pads(self) -> tuple[Column, Column]:
        content = self.spark.read.format("binaryFile").load(self.path)
        return tuple(content.select(F.substring("content", at, _BLOCK)).scalar() for at in (1, _BLOCK + 1))


def write_key(spark: SparkSession, secret_key: str, path: str) -> KeyFile:
    """Store the pads of a key; the file is written by the driver without a Spark job, and may not exist yet.

    Give the folder the access rights of the key itself.
    """
    inner, outer = key_pads(secret_key)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    try:
        stream.write(inner + outer)
    finally:
        stream.close()
    return KeyFile(spark, path)


def keyed_sha1(text: Column, secret_key: str | KeyFile) -> Column:
    if isinstance(secret_key, KeyFile):
        inner, outer = secret_key.pads()
    else:
        inner, outer = (F.lit(pad) for pad in key_pads(secret_key))
    first = F.sha1(F.concat(inner, text.cast("binary")))
    return F.sha1(F.concat(outer, F.unhex(first)))
