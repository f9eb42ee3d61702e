"""Cost-balanced packing of documents into sequences of a fixed length.

The cost of a piece is linear (per token) plus quadratic (attention inside the piece). Pieces go in
descending order of cost, each to the sequence of the lowest cost that has room for it. What fits nowhere
is cut: it fills the sequence with the most room, and the remainder is placed in its turn. Sequences are
laid out to hold exactly the tokens of a group: as many full ones as there are, and the remainder as
powers of two, which need no padding.

Documents are packed in groups of `group` tokens, in the order of the input and each by one task, so nothing is
shuffled, and a lost task gives the same groups when it runs again. A group ends with the document that fills it, or with
its input partition; it has no more than twelve sequences that are shorter than the others. How the texts reach a task,
in which batches or with which cache, changes nothing. A sequence_id is the number of the input partition times
2^32 plus the number of the sequence in it.

Defined cases: a null text is empty and gives the end id alone; a null doc_id is packed as any other; a longer text
than a sequence, or than a group, is cut; of pieces of equal length the earlier document's goes first; repeated rows are
packed each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import narrow, slices, trim
from .tokens import encoder


#: Tokens that are packed together; a task holds the ids of a group, 4 bytes each.
GROUP = 4_000_000
#: Pieces of text that a worker keeps with their ids; more save time and take memory, and results are the same.
PIECES = 300_000
#: Bytes of text that are encoded at once, and tokens that are handed on at once.
_ENCODED_AT_ONCE = 300_000
_OUT_AT_ONCE = 250_000


def capacities(total: int, length: int) -> np.ndarray:
    """Sequences that hold exactly `total` tokens: full ones, then powers of two."""
    rest = total % length
    return np.array([length] * (total // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def pack(lengths: np.ndarray, length: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths."""
    size = capacities(int(lengths.sum()), length)
    used, cost = np.zeros(len(size), np.int64), np.zeros(len(size))
    heap = []
    for i, n in enumerate(lengths.tolist()):
        for start in range(0, n, length):
            heap.append((-min(length, n - start), i, start))
    heapq.heapify(heap)
    pieces = []
    while heap:
        n, i, start = heapq.heappop(heap)
        n = -n
        room = size - used
        fits = room >= n
        if fits.any():
            to = int(np.where(fits, cost, np.inf).argmin())
        else:
            to = int(np.lexsort((cost, -room))[0])
            heapq.heappush(heap, (int(room[to]) - n, i, start + int(room[to])))
            n = int(room[to])
        pieces.append((i, start, n, to, int(used[to])))
        used[to] += n
        cost[to] += linear * n + quadratic * n * n
    return pieces


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    length: int = 4096,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    group: int = GROUP,
    pieces: int = PIECES,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(tokenizer, end_id, pieces).encode, TaskContext.get().partitionId() << 32
        names, counts, total = [], [], 0
        held = np.empty(min(group, GROUP), "<u4")  # the ids of a group; it grows where a document goes beyond
        for batch in slices(batches, 1, _ENCODED_AT_ONCE):
            ids, n = encode([t or "" for t in batch.column(1).to_pylist()])
            at = first = 0  # documents and ids of this batch that are dealt with
            while at < len(n):
                reach = np.cumsum(n[at:])
                take = min(len(reach), int(np.searchsorted(reach, group - total)) + 1)
                size = int(reach[take - 1])
                # a copy: a slice would keep the texts of its batch
                names.append(batch.column(0).take(pa.array(np.arange(at, at + take))))
                counts.append(n[at : at + take])
                if total + size > len(held):
                    held = np.concatenate([held[:total], np.empty(max(size, total), "<u4")])
                held[total : total + size] = ids[first : first + size]
                at, first, total = at + take, first + size, total + size
                if total >= group:
                    before = yield from _packed(names, counts, held, length, linear, quadratic, before)
                    names, counts, total = [], [], 0
        if names:
            yield from _packed(names, counts, held, length, linear, quadratic, before)
        del held
        trim()

    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return rows.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(run, schema)


def _packed(names: list, counts: list, ids: np.ndarray, length: int, linear: float, quadratic: float, before: int) -> Generator[pa.RecordBatch, None, int]:
    """The pieces of a group, some at a time; returns the number of the next sequence."""
    n, name = np.concatenate(counts), pa.concat_arrays(names)
    doc, start, size, sequence, offset = np.array(pack(n, length, linear, quadratic), np.int64).reshape(-1, 5).T
    first = (np.cumsum(n) - n)[doc] + start
    numbers = np.column_stack([start, size, n[doc], sequence + before, offset])
    part = np.cumsum(size) // _OUT_AT_ONCE
    for at in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(part)) + 1):
        cut = [ids[a : a + b].tobytes() for a, b in zip(first[at].tolist(), size[at].tolist())]
        columns = [name.take(pa.array(doc[at])), *map(pa.array, numbers[at].T.copy()), pa.array(cut, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return before + int(sequence.max()) + 1
