"""What the corpus operators share: columns by position, stored intermediates, shared files."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task takes into memory at once.
SLICE_BYTES = 2_000_000


def position(df: DataFrame, name: str) -> int:
    """Where column `name` stands; the exact spelling goes before other spellings of letter case."""
    names = df.columns
    for same in (lambda x: x == name, lambda x: x.lower() == name.lower()):
        for i, x in enumerate(names):
            if same(x):
                return i
    raise ValueError(f"no column {name!r} among {names}")


def by_position(df: DataFrame) -> DataFrame:
    """The frame with columns c0, c1, ..., so that no name of a caller can clash with ours."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def narrow(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, each under our name for it: narrow(df, id="doc_id")."""
    plain = by_position(df)
    return plain.select(*[plain[f"c{position(df, name)}"].alias(ours) for ours, name in wanted.items()])


def text_or_empty(column: str) -> Column:
    """A text column with nulls as empty texts."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder of the session.

    Only a local session without spark.checkpoint.dir gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can read")
        base = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


_held: dict = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """What `make` makes, kept by this worker process for later tasks under the same key.

    One thing at a time is kept, so that the caches of stages that follow each other don't add up.
    """
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give back what this worker process keeps, before work that needs none of it."""
    if _held:
        _held.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back to the system: workers stand idle beside later stages, and the allocators would keep it for them."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.pythonapi, "malloc_trim", None)  # only some C libraries have it
    if give_back:
        give_back(0)


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to Python tasks some SLICE_BYTES at a time, unless the session has a limit of its own.

    A batch of 10,000 rows of long texts would be held whole on both sides, once by each task.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(SLICE_BYTES))


@contextmanager
def no_cycles() -> Iterator[None]:
    """For work that makes very many objects and no reference cycles: the search for cycles would go through all of them."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


def importable_in_tasks(spark: SparkSession) -> None:
    """Hand this package to the Python workers, if they can't find it where the driver does.

    Workers look in PYTHONPATH and in the working folder; a driver that was started elsewhere and only
    extended its own path would fail in the first task. Spark itself distributes the file.
    """
    root = Path(__file__).resolve().parents[2]
    paths = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    context = spark.sparkContext
    if root in paths or getattr(context, "_llm_handed_out", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='llm-')}/hushframe", "zip", root, "hushframe")
    context.addPyFile(archive)
    context._llm_handed_out = True


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into a scratch folder and read it back: later steps don't compute it again."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, *folders: str) -> None:
    """Delete scratch folders that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_files(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that the executors share, for reading and writing files in tasks."""
    if "://" not in folder:
        folder = folder.replace("file:/", "/", 1) if folder.startswith("file:/") else folder
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `most` bytes of text; a longer text stands in a piece of its own."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(array: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8 bytes, nulls as empty."""
    return [x or b"" for x in array.cast(pa.binary() if not pa.types.is_large_string(array.type) else pa.large_binary()).to_pylist()]
