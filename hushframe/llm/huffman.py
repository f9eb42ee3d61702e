"""Canonical length-limited Huffman codes of ids: lengths from counts, packing, table-driven decoding."""

from __future__ import annotations

import numpy as np

#: Ids between two stored bit offsets; decoding goes on at all offsets of a block at once.
CHECKPOINT = 256
_LEAST_BITS = 16


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """The code length of each id with a count, by package-merge; 0 for ids that don't occur.

    No length is over 16 bits, or over what the number of ids needs if that is more.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    most = max(_LEAST_BITS, int(len(used) - 1).bit_length())
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.float64)
    level, chosen = weights, []
    for _ in range(most - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        chosen.append(rank < len(weights))
        level = both[rank]
    take, total = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for single in reversed(chosen):
        n = int(single[:take].sum())
        total[:n] += 1
        take = 2 * (take - n)
    total[:take] += 1
    lengths[order] = total
    return lengths


class Code:
    """The canonical code of given lengths: ascending by length, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.bits = int(self.lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        span = 1 << (self.bits - self.lengths[order])
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = first >> (self.bits - self.lengths[order])
        # each entry of the table is the id, and the length of its code, for the next `bits` bits
        size = 1 << self.bits
        self.table_ids, self.table_lengths = np.zeros(size, np.uint32), np.ones(size, np.int64)
        covered = int(span.sum())
        self.table_ids[:covered] = np.repeat(order, span)
        self.table_lengths[:covered] = np.repeat(self.lengths[order], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The packed bits of the ids, and the bit offset of every CHECKPOINT-th of them."""
        if not len(ids):
            return b"", np.empty(0, np.uint32)
        n = self.lengths[ids]
        ends = np.cumsum(n)
        begins = ends - n
        shifted = self.codes[ids] << (64 - (begins & 31) - n).astype(np.uint64)
        word = begins >> 5
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.add.reduceat(shifted, starts)  # the codes share no bits
        out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        out[word[starts]] += sums >> np.uint64(32)
        out[word[starts] + 1] += sums & np.uint64(0xFFFFFFFF)
        return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], begins[::CHECKPOINT].astype(np.uint32)

    def decode(self, packed: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The `n` ids of a block; all checkpoints advance in step."""
        data = np.frombuffer(packed + bytes(8), np.uint8).astype(np.int64)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at, last, mask = offsets.astype(np.int64), len(window) - 1, (1 << self.bits) - 1
        out = np.empty((len(at), CHECKPOINT), np.uint32)
        for k in range(CHECKPOINT):
            seen = window[np.minimum(at >> 3, last)] >> (32 - self.bits - (at & 7)) & mask
            out[:, k] = self.table_ids[seen]
            at += self.table_lengths[seen]
        return out.ravel()[:n]
