"""CSV with line breaks inside quotes, read in many tasks by the parity of quotes.

Whether a line starts inside a quoted value depends on all quotes before it, so Spark's own reader takes such a file in
one task. Here one pass counts, in each split of each file, the lines with an odd number of quotes. A running sum over
the splits, a row each, tells whether a split starts inside a value, and in which split that value's record began. The
second pass joins lines to records inside each split; the pieces of the few records that cross from one split into
another are grouped by the split in which they began. The records are parsed by Spark's CSV expressions.

What is read is CSV as RFC 4180 has it, in UTF-8: values may be quoted, quotes inside are doubled. A file whose first line
ends in CRLF has CRLF at all line ends, and those inside quotes are read as LF; in other files lines end in LF and a CR
is kept. These are the results of Spark's own reader. Each file begins with a header record; names are taken
from the first. Empty lines outside of quotes are skipped. A quote inside a value that isn't quoted would make the parity
wrong, so such a record is an error and never a wrong table; `tables.read_table` without `split` takes those files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VALUE = r'(?:[^",]*|"(?:[^"]|"")*")'
#: A record of quoted and plain values.
_RECORD = rf"\A{_VALUE}(?:,{_VALUE})*\z"
_PIECES = "file string, start bigint, block bigint, whole boolean, heading boolean, record string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; an empty value is null, as in Spark's own reader."""
    names = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
    lines = _lines(spark, path)
    # A row per split. The driver holds as much for each split when it plans the scan, so a broadcast is no larger.
    known = lines.join(F.broadcast(_states(lines)), ["file", "block"], "left")
    line = F.expr("if(crlf and endswith(record, '\r'), substring(record, 1, char_length(record) - 1), record)").alias("record")
    pieces = known.select(line, "file", "block", "inside", "began").mapInArrow(_joined, _PIECES)
    cut = pieces.where("not whole").groupBy("file", "start").agg(
        F.bool_or("heading").alias("heading"), F.expr("array_join(transform(array_sort(collect_list(struct(block, record))), x -> x.record), '\\n') as record")
    )
    checked = cut.select("heading", "record").mapInArrow(_checked_records, "heading boolean, record string")
    records = pieces.where("whole").select("heading", "record").unionByName(checked).where("not heading")
    kept = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    parsed = records.select(F.from_csv("record", ", ".join(f"{f.name} string" for f in kept), {"escape": '"'}).alias("row"))
    return parsed.select("row.*").toDF(*names)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(path, lineSep="\n").select(F.col("value").alias("record"), *place)


def _states(lines: DataFrame) -> DataFrame:
    """Per split: whether it starts inside a quoted value, and the split in which that value's record began."""
    quotes = "char_length(record) - char_length(replace(record, '\"', ''))"
    # a split is read in one task and in order, so its first line is the first of the group
    counted = lines.groupBy("file", "block").agg(F.expr(f"count_if(({quotes}) % 2 = 1) as odd"), F.expr("first(endswith(record, '\r')) as crlf"))
    before = "over (partition by file order by block rows between unbounded preceding and 1 preceding)"
    started = counted.selectExpr("*", f"coalesce(sum(odd) {before}, 0) % 2 = 1 as inside")
    # a split leaves a record open if it ends inside a value of a record that it began itself
    opened = started.selectExpr("*", "if(inside, odd > 0 and odd % 2 = 0, odd % 2 = 1) as opens")
    first = "first(crlf) over (partition by file order by block) as crlf"
    return opened.selectExpr("file", "block", "inside", first, f"last(if(opens, block, null), true) {before} as began")


class _Split:
    """Joins the lines of one split to records, batch by batch."""

    def __init__(self, file: str, block: int, inside: bool, began: int | None) -> None:
        self.file, self.block, self.inside = file, block, inside
        self.start = began if inside else block
        self.head = inside  # the lines so far belong to a record of an earlier split
        self.first = block == 0
        self.waiting: list[pa.Array] = []

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        odd = pc.bit_wise_and(pc.count_substring(lines, '"'), 1).to_numpy(zero_copy_only=False).astype(np.int64)
        after = (int(self.inside) + np.cumsum(odd)) & 1
        starts = np.flatnonzero((after ^ odd) == 0)
        self.inside = bool(after[-1])
        if not len(starts):
            self.waiting.append(lines)
            return
        if starts[0]:
            self.waiting.append(lines.slice(0, starts[0]))
        yield from self.close(True)
        if len(starts) > 1:
            grouped = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), lines.slice(0, starts[-1]))
            yield from self.whole(pc.binary_join(grouped, "\n"))
        self.waiting = [lines.slice(starts[-1])]

    def whole(self, records: pa.Array) -> Iterator[pa.RecordBatch]:
        records = _checked(records)
        if len(records):
            heading = np.zeros(len(records), bool)
            heading[0] = self.first
            self.first = False
            yield self._batch(self.block, records, True, heading)

    def close(self, ended: bool) -> Iterator[pa.RecordBatch]:
        """Give out the lines that wait; `ended` if their record ends with them."""
        if not self.waiting:
            return
        lines = pa.concat_arrays(self.waiting)
        self.waiting = []
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")
        if ended and not self.head:
            yield from self.whole(text)
        else:
            heading, self.first = self.first and not self.head, False
            yield self._batch(self.start if self.head else self.block, text, False, np.array([heading]))
        self.head = False

    def _batch(self, start: int, records: pa.Array, whole: bool, heading: np.ndarray) -> pa.RecordBatch:
        n = len(records)
        columns = [pa.repeat(self.file, n), pa.repeat(pa.scalar(start, pa.int64()), n), pa.repeat(pa.scalar(self.block, pa.int64()), n)]
        names = ["file", "start", "block", "whole", "heading", "record"]
        return pa.RecordBatch.from_arrays([*columns, pa.repeat(whole, n), pa.array(heading), records], names=names)


def _checked(records: pa.Array) -> pa.Array:
    """The records without empty ones; one that isn't CSV is an error."""
    records = records.filter(pc.not_equal(records, ""))
    quoted = records.filter(pc.match_substring(records, '"'))
    if len(quoted) and not pc.all(pc.match_substring_regex(quoted, _RECORD)).as_py():
        raise ValueError("a quote stands inside a value that is not quoted; read this file without `split`")
    return records


def _checked_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            record = _checked(batch.column(1).slice(i, 1))
            if len(record):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), record], names=["heading", "record"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of records from lines that come split by split, each split in the order of its file."""
    split: _Split | None = None
    for batch in batches:
        files, blocks = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        codes = files.indices.to_numpy()
        changes = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for at, end in zip([0, *changes], [*changes, batch.num_rows], strict=True):
            if at == end:
                continue
            file, block = files.dictionary[codes[at]].as_py(), int(blocks[at])
            if split is None or (split.file, split.block) != (file, block):
                if split is not None:
                    yield from split.close(not split.inside)
                inside, began = batch.column(3)[at].as_py(), batch.column(4)[at].as_py()
                if inside is None:
                    raise RuntimeError("the splits of the file have changed between two passes")
                split = _Split(file, block, inside, began)
            yield from split.add(batch.column(0).slice(at, end - at))
    if split is not None:
        yield from split.close(not split.inside)
