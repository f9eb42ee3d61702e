"""Files of token ids under a canonical length-limited Huffman code of the whole corpus.

Writing takes two steps. Texts are range-partitioned and sorted by doc_id, encoded, and kept as
compressed raw ids, with the counts of each id; each task then reads its part again and writes it under
the code made from the global counts. What the driver sees is one row per file and one count per id of
the vocabulary.

A folder holds `code.bin` (a byte per id: its code length), one `part-N.ids` per range of doc_ids, and a
Parquet table `files` that names the committed files in order. A file is a row of blocks and a footer:

    block   documents, ids, checkpoints, payload bytes (4 x uint32); doc_ids (int64); known (uint8: the
            doc_id is not null); ids per document (uint32); bit offset of every 256th id (uint32); payload
    footer  offset and size of each block (2 x uint64), the number of blocks (uint64), "HUFIDS01"

Numbers are little-endian. A block is decoded by itself, and inside it from any checkpoint.

Defined cases: a null text is empty and has the end id alone; a null doc_id goes before all others;
rows that repeat a doc_id follow each other; an empty table gives a folder without files, which reads
as no rows; other columns are ignored. doc_ids must be integers.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, narrow, scratch, shared_files, slices
from .huffman import Code, code_lengths
from .tokens import encoder

_MAGIC = b"HUFIDS01"
#: Pieces of text that a worker keeps with their ids; more save time and take memory, and results are the same.
PIECES = 400_000


def _raw_parts(rows: DataFrame, folder: str, tokenizer: str, end_id: int, pieces: int) -> DataFrame:
    """Encode sorted rows into raw files; a row per file with its counts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer, end_id, pieces).encode
        files, base = shared_files(folder)
        files.create_dir(base, recursive=True)
        path, counts, docs, total = f"{base}/raw-{part}-{uuid.uuid4().hex}", np.zeros(0, np.int64), 0, 0
        squeeze = zstandard.ZstdCompressor(level=3)
        with files.open_output_stream(path) as out:
            for batch in slices(batches, 1):
                ids, n = encode([t or "" for t in batch.column(1).to_pylist()])
                seen = np.bincount(ids)
                counts = np.pad(counts, (0, max(0, len(seen) - len(counts))))
                counts[: len(seen)] += seen
                ident = batch.column(0)
                known = ident.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                names = ident.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
                small = ids.max(initial=0) < 65_536
                data = squeeze.compress(ids.astype("<u2" if small else "<u4").tobytes())
                head = struct.pack("<4I", len(names), 2 if small else 4, len(ids), len(data))
                out.write(head + names.tobytes() + known.tobytes() + n.astype("<u4").tobytes() + data)
                docs, total = docs + len(names), total + len(ids)
        if docs:
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([path]), pa.array([total]), pa.array([at.astype(np.int32).tolist()], pa.list_(pa.int32())), pa.array([counts[at].tolist()], pa.list_(pa.int64()))],
                ["part", "path", "ids", "seen", "times"],
            )
        else:
            files.delete_file(path)

    return rows.mapInArrow(run, "part int, path string, ids long, seen array<int>, times array<long>")


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One count per id from the lists of counts of many files."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        at, n = (np.asarray(c.flatten()) for c in batch.columns)
        seen = np.bincount(at, n).astype(np.int64) if len(at) else total[:0]
        total = np.pad(total, (0, max(0, len(seen) - len(total))))
        total[: len(seen)] += seen
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["seen", "n"])


def _blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """names, known, ids per document and ids of each raw block."""
    expand = zstandard.ZstdDecompressor()
    while head := stream.read(16):
        docs, width, total, size = struct.unpack("<4I", head)
        names = np.frombuffer(stream.read(8 * docs), "<i8")
        known = np.frombuffer(stream.read(docs), np.uint8)
        n = np.frombuffer(stream.read(4 * docs), "<u4")
        data = expand.decompress(stream.read(size), max_output_size=total * width)
        yield names, known, n, np.frombuffer(data, f"<u{width}").astype(np.int64)


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, pieces: int = PIECES) -> None:
    """Encode the texts and write their ids into `folder`, in ascending order of doc_id."""
    spark = docs.sparkSession
    raw = scratch(spark, "raw-ids")
    rows = narrow(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    parts = max(1, rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    _raw_parts(ordered, f"{raw}/ids", tokenizer, end_id, pieces).write.parquet(f"{raw}/parts")
    listed = spark.read.parquet(f"{raw}/parts")
    summed = listed.select("seen", "times").mapInArrow(_sum_counts, "seen long, n long")
    counted = summed.groupBy("seen").agg(F.sum("n").alias("n")).collect()  # a row per id of the vocabulary
    counts = np.zeros(1 + max([end_id, *(r["seen"] for r in counted)]), np.int64)
    for r in counted:
        counts[r["seen"]] = r["n"]
    files, base = shared_files(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/code.bin") as out:
        out.write(code_lengths(counts).tobytes())
    start, numbered = 0, []
    for r in listed.select("part", "path", "ids").orderBy("part").collect():
        numbered.append((r["part"], r["path"], start, r["ids"]))
        start += r["ids"]
    spread = spark.createDataFrame(numbered, "part int, path string, start long, ids long").repartition(max(1, len(numbered)))
    spread.mapInPandas(_writer(folder), "part int, path string, start long, ids long, bytes long").write.parquet(f"{folder}/files")
    discard(spark, raw)


def _writer(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = shared_files(folder)
        code = _code(folder)
        for frame in frames:
            for part, path, start, ids in frame.itertuples(index=False):
                made = f"{base}/part-{part:06d}-{uuid.uuid4().hex[:8]}.ids"
                size = _write_file(files, path, made, code)
                yield pd.DataFrame({"part": [part], "path": [made], "start": [start], "ids": [ids], "bytes": [size]})

    return run


def _write_file(files, source: str, target: str, code: Code) -> int:
    footer, at = [], 0
    with files.open_input_stream(source) as stream, files.open_output_stream(target) as out:
        for names, known, n, ids in _blocks(stream):
            payload, offsets = code.encode(ids)
            head = struct.pack("<4I", len(names), len(ids), len(offsets), len(payload))
            block = head + names.tobytes() + known.tobytes() + n.tobytes() + offsets.astype("<u4").tobytes() + payload
            out.write(block)
            footer.append((at, len(block)))
            at += len(block)
        out.write(np.array(footer, "<u8").tobytes() + struct.pack("<Q", len(footer)) + _MAGIC)
    return at + 16 * len(footer) + 16


@lru_cache(maxsize=2)
def _code(folder: str) -> Code:
    files, base = shared_files(folder)
    with files.open_input_file(f"{base}/code.bin") as stream:
        return Code(np.frombuffer(stream.read(), np.uint8))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (the ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) per document."""
    listed = spark.read.schema("part int, path string, start long, ids long, bytes long").parquet(f"{folder}/files")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        files, _ = shared_files(folder)
        code = _code(folder)
        for frame in frames:
            for path, start in zip(frame.column("path").to_pylist(), frame.column("start").to_pylist()):
                with files.open_input_file(path) as file:
                    file.seek(file.size() - 16)
                    count, magic = struct.unpack("<Q8s", file.read(16))
                    if magic != _MAGIC:
                        raise ValueError(f"{path} is not a file of ids")
                    file.seek(file.size() - 16 - 16 * count)
                    places = np.frombuffer(file.read(16 * count), "<u8").reshape(-1, 2).tolist()
                    for at, size in places:
                        file.seek(at)
                        names, known, n, ids = _read_block(file.read(size), code)
                        ends = np.cumsum(n)
                        data = ids.astype("<u4")
                        cut = [data[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names, mask=known == 0), pa.array(start + ends - n), pa.array(n), pa.array(cut, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        start += int(n.sum())

    spread = listed.select("path", "start").repartition(max(1, listed.count()))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _read_block(block: bytes, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    docs, total, marks, size = struct.unpack_from("<4I", block)
    at, parts = 16, []
    for count, kind in ((docs, "<i8"), (docs, "u1"), (docs, "<u4"), (marks, "<u4")):
        parts.append(np.frombuffer(block, kind, count, at))
        at += parts[-1].nbytes
    names, known, n, offsets = parts
    return names, known, n.astype(np.int64), code.decode(block[at : at + size], offsets, total)
