"""Counts of terms: packed by length, radix-sorted and run-counted in numpy.

A term is a run of letters (A-Z, a-z) and of bytes beyond ASCII; A-Z are lower-cased. A term holds no zero byte, so
its bytes padded with zeros name it. Up to 8 bytes make one big-endian 64-bit word, up to 16 bytes two; these are
sorted by their 16-bit digits, the last one first, which keeps earlier order among equal terms. Longer terms go to
buckets by width (32, 64, 128, ... bytes) that are sorted by their bytes, so a bucket's padding at most doubles them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[97:123] = _IN_TERM[65:91] = _IN_TERM[128:] = True


def spans(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each term in `raw`; a term doesn't go over a place in `breaks`."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IN_TERM[raw]
    starts_here = inside[1:-1] & ~inside[:-2]
    ends_here = inside[1:-1] & ~inside[2:]
    cut = breaks[(breaks > 0) & (breaks < len(raw))]
    starts_here[cut] |= inside[1:-1][cut]
    ends_here[cut - 1] |= inside[1:-1][cut - 1]
    starts = np.flatnonzero(starts_here)
    return starts, np.flatnonzero(ends_here) - starts + 1


def words(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each term as one number that sorts as they do; `padded` has 8 bytes after the last term."""
    raw = np.lib.stride_tricks.sliding_window_view(padded, 8)[starts]
    value = np.ascontiguousarray(raw).view(">u8").ravel().astype(np.uint64)
    surplus = (8 * (8 - np.clip(lengths, 0, 8))).astype(np.uint64)
    kept = (value >> np.minimum(surplus, 63)) << np.minimum(surplus, 63)
    return np.where(surplus == 64, np.uint64(0), kept)


def radix_order(*digits: np.ndarray) -> np.ndarray:
    """The stable order of rows by 64-bit words, the first word being the most significant."""
    order = np.arange(len(digits[0]))
    for word in reversed(digits):
        for shift in range(0, 64, 16):
            part = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(part) and (part != part[0]).any():
                order = order[np.argsort(part[order], kind="stable")]  # a radix sort for 16-bit numbers
    return order


def buckets(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bucket of lengths: its terms in stable byte order, and whether each differs from the one before."""
    for least, most in ((1, 8), (9, 16)):
        chosen = np.flatnonzero((lengths >= least) & (lengths <= most))
        if len(chosen):
            packed = [words(padded, starts[chosen] + at, lengths[chosen] - at) for at in range(0, most, 8)]
            order = radix_order(*packed)
            yield chosen[order], _differs(*[word[order] for word in packed])
    width = 32
    while width // 2 < lengths.max(initial=0):
        chosen = np.flatnonzero((lengths > width // 2) & (lengths <= width))
        if len(chosen):
            table = np.zeros((len(chosen), width), np.uint8)
            rows = np.repeat(np.arange(len(chosen)), lengths[chosen])
            table[rows, _within(lengths[chosen])] = padded[np.repeat(starts[chosen], lengths[chosen]) + _within(lengths[chosen])]
            names = table.view(f"S{width}").ravel()
            order = np.argsort(names, kind="stable")
            yield chosen[order], _differs(names[order])
        width *= 2


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of the given lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _differs(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for column in columns:
        out[1:] |= column[1:] != column[:-1]
    return out


def taken(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Stretches of `data` as a column of texts."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    chosen = data[np.repeat(starts, lengths) + _within(lengths)]
    return pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chosen)])


def count(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and texts with it, once for each group and term; `groups` ascend along the texts."""
    joined = b"".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts, lengths = spans(raw, ends)
    padded = np.zeros(len(raw) + 24, np.uint8)
    padded[: len(raw)] = _LOWER[raw]
    doc = np.searchsorted(ends, starts, "right")
    group = np.asarray(groups)[doc]
    out_first, out_count, out_docs = [], [], []
    for order, fresh_term in buckets(padded, starts, lengths):
        fresh = fresh_term | _differs(group[order])
        fresh_doc = fresh | _differs(doc[order])
        at = np.flatnonzero(fresh)
        out_first.append(order[at])
        out_count.append(np.diff(np.append(at, len(order))))
        out_docs.append(np.add.reduceat(fresh_doc.astype(np.int64), at))
    first = np.concatenate(out_first) if out_first else np.empty(0, np.int64)
    numbers = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_count, out_docs)]
    return group[first], taken(padded, starts[first], lengths[first]), *numbers
