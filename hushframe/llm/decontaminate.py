"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet where they share a seed of `least` words in a row. For each pair,
running Karp-Rabin marks the longest matches that don't overlap, longest first, down to `least` words;
the share of the item's words in tiles is its coverage. Tiles may stand in any order, so a passage
whose parts were reordered is found too.

The benchmark goes to the tasks in blocks of at most 8 MB of text (a longer item is a block by itself),
and each block is held against all documents; the documents are not shuffled. A pair is tiled only if
the words under its shared seeds could reach the threshold, which loses none.

Words are runs of letters, digits and underscores, lower-cased. Defined cases: null or empty texts of
either side match nothing, as do items of fewer than `least` words; equal items are each reported; rows
that repeat a doc_id are each reported; a null doc_id is reported as null; an empty table on either side
leaves all documents clean; other columns are ignored by `find` and carried by `drop`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, narrow, position, release, slices

_BLOCK_BYTES = 8_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_words = re.compile(r"\w+").findall


def rolling(ids: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """The polynomial hash of the windows of `length` ids that start at `at`; of all windows by default."""
    at = np.arange(max(0, len(ids) - length + 1)) if at is None else at
    total = np.zeros(len(at), np.uint64)
    for k in range(length):
        total = total * _BASE + (ids[at + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return total


def _known_windows(ids: np.ndarray, length: int) -> np.ndarray:
    """Where a window of `length` words of the benchmark's vocabulary starts."""
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.flatnonzero(unknown[length:] == unknown[:-length]) if len(ids) >= length else np.empty(0, np.int64)


def greedy_tiles(test: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in test, start in doc, length): the longest matches first, none overlapping another.

    Each pass looks for matches of the search length by Karp-Rabin hashes, extends them, and marks the
    longest. A pass that finds one of over twice that length starts again with its length; else the
    search length is halved, down to `least`.
    """
    free_test, free_doc, tiles = np.ones(len(test), bool), np.ones(len(doc), bool), []
    search = max(least, min(len(test), len(doc)) // 2)
    while True:
        matches = _scan(test, doc, free_test, free_doc, search)
        longest = max((n for n, _, _ in matches), default=0)
        if longest > 2 * search:
            search = longest
            continue
        for n, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if free_test[i : i + n].all() and free_doc[j : j + n].all():
                free_test[i : i + n] = free_doc[j : j + n] = False
                tiles.append((i, j, n))
            else:
                shorter = _free_runs(free_test, free_doc, i, j, n)
                if any(m >= search for m, _, _ in shorter):
                    break  # what is left of it must be ordered anew among the rest
        else:
            if search == least:
                return tiles
            search = max(least, search // 2)


def _free_runs(free_test: np.ndarray, free_doc: np.ndarray, i: int, j: int, n: int) -> list[tuple[int, int, int]]:
    """The runs of a match in which both sides are free."""
    free = np.concatenate([[False], free_test[i : i + n] & free_doc[j : j + n], [False]])
    edges = np.flatnonzero(free[1:] != free[:-1])
    return [(int(b - a), i + int(a), j + int(a)) for a, b in edges.reshape(-1, 2)]


def _scan(test: np.ndarray, doc: np.ndarray, free_test: np.ndarray, free_doc: np.ndarray, search: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, start in test, start in doc) of at least `search` free words."""
    at = defaultdict(list)
    for i, h in enumerate(rolling(test, search).tolist()):
        if free_test[i : i + search].all():
            at[h].append(i)
    found, hashes = [], rolling(doc, search)
    for j in np.flatnonzero(np.isin(hashes, np.array(list(at), np.uint64))).tolist():
        for i in at[int(hashes[j])]:
            begins = i == 0 or j == 0 or test[i - 1] != doc[j - 1] or not (free_test[i - 1] and free_doc[j - 1])
            if not begins or not free_doc[j : j + search].all() or (test[i : i + search] != doc[j : j + search]).any():
                continue
            most = min(len(test) - i, len(doc) - j)
            same = (test[i : i + most] == doc[j : j + most]) & free_test[i : i + most] & free_doc[j : j + most]
            found.append((most if same.all() else int(same.argmin()), i, j))
    return found


@dataclass
class Block:
    """Benchmark items in the form that the tasks search."""

    vocabulary: dict[str, int]
    items: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted hashes, an entry per place in an item
    seed_item: np.ndarray
    seed_at: np.ndarray


def make_block(rows: list[tuple[int, str]], least: int) -> Block:
    """The searchable form of (item_id, text) rows."""
    vocabulary: dict[str, int] = {}
    items, words, seeds = [], [], []
    for item, text in rows:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in _words((text or "").lower())], np.int64)
        if len(ids) >= least:
            hashes = rolling(ids, least)
            seeds.append((hashes, np.full(len(hashes), len(items)), np.arange(len(hashes))))
            items.append(item)
            words.append(ids)
    parts = [np.concatenate(x) for x in zip(*seeds)] or [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]
    order = np.argsort(parts[0], kind="stable")
    return Block(vocabulary, items, words, *(p[order] for p in parts))


def matches(texts: list[str | None], block: Block, least: int, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text number, item number, coverage, matched words, tiles) of all pairs at or over the threshold."""
    lookup, ids, ends = block.vocabulary.get, [], []
    for text in texts:
        ids += [lookup(w, 0) for w in _words((text or "").lower())]
        ids.append(0)
        ends.append(len(ids))
    ids, ends = np.array(ids, np.int64), np.array(ends, np.int64)
    starts = _known_windows(ids, least)
    hashes = rolling(ids, least, starts)
    low, high = np.searchsorted(block.seeds, hashes, "left"), np.searchsorted(block.seeds, hashes, "right")
    hit = high > low
    low, high = low[hit], high[hit]
    text_of = np.searchsorted(ends, starts[hit], "right")
    under: dict[tuple[int, int], set[int]] = defaultdict(set)
    for t, a, b in zip(text_of.tolist(), low.tolist(), high.tolist()):
        for k in range(a, b):
            under[t, int(block.seed_item[k])].add(int(block.seed_at[k]))
    found = []
    for (t, item), places in under.items():
        test = block.words[item]
        covered = np.zeros(len(test), bool)
        for s in places:
            covered[s : s + least] = True
        if covered.mean() < threshold:
            continue
        tiles = greedy_tiles(test, ids[(ends[t - 1] if t else 0) : ends[t]], least)
        matched = sum(n for _, _, n in tiles)
        if matched >= threshold * len(test):
            found.append((t, item, matched / len(test), matched, len(tiles)))
    return found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, least: int) -> Iterator[Block]:
    rows = narrow(benchmark, item_id=item_col, text=text_col).withColumn("text", F.col("text").cast("string")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-2 * size // _BLOCK_BYTES)) if size > _BLOCK_BYTES else 1
    for b in range(count):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        yield make_block([(r["item_id"], r["text"]) for r in mine.sort("item_id", "text").collect()], least)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = 5,
    threshold: float = 0.6,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per contaminated pair: doc_id, item_id, coverage, matched_words, tiles."""
    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    item_kind = dict(narrow(benchmark, item_id=item_col).dtypes)["item_id"]
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {item_kind}, coverage double, matched_words long, tiles long"
    found = None
    for block in _blocks(benchmark, item_col, item_text_col, least):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release()
            for batch in slices(batches, 1):
                if pairs := matches(batch.column(1).to_pylist(), shared.value, least, threshold):
                    at, item, coverage, matched, tiles = zip(*pairs)
                    ids = batch.column(0).take(pa.array(at))
                    items = pa.array([shared.value.items[i] for i in item])
                    yield pa.RecordBatch.from_arrays([ids, items, *map(pa.array, (coverage, matched, tiles))], ["doc_id", "item_id", "coverage", "matched_words", "tiles"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.6, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns."""
    plain, text = by_position(docs), position(docs, text_col)
    for block in _blocks(benchmark, "item_id", "text", least):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release()
            for batch in slices(batches, text):
                texts = batch.column(text).cast(pa.string()).to_pylist()
                bad = {t for t, *_ in matches(texts, shared.value, least, threshold)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))

        plain = plain.mapInArrow(run, plain.schema)
    return plain.toDF(*docs.columns)
