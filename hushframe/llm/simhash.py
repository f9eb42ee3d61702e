"""SimHash near-dedup with a generalised pigeonhole index.

Fingerprints: XXH64 (seed 42) of the word shingles of the lower-cased text; a bit is 1 if it is set in
over half of the hashes. Fingerprints that differ in at most `distance` bits are linked, and linked
documents form components.

The index splits the 64 bits into groups, correlated bits together, and gives each group a threshold.
If the thresholds sum to distance - groups + 1, two fingerprints within the distance lie within the
threshold of at least one group. Groups and thresholds come from a dynamic programme over the expected
work, which is estimated from bit and bit-pair counts of all fingerprints. Each fingerprint is stored
under its value in each group and probes all values within the threshold; what meets is verified by
the full distance.

Defined cases: a null or empty text has fingerprint zero, linked like any other; equal fingerprints are
folded before the search; a null doc_id is returned with its fingerprint and the component of that
fingerprint; rows that repeat a doc_id are returned each, with their own fingerprint; an empty table
gives an empty result; other columns are ignored by `components` and carried by `drop`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import by_position, narrow, position, release, settle, slices, texts_of
from .graph import smallest_reachable

_SEED = 42
_HASHES_AT_ONCE = 100_000


def hash_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASHES_AT_ONCE):
        part = np.ascontiguousarray(hashes[i : i + _HASHES_AT_ONCE])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return total


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The hashes of all word shingles of a UTF-8 text; a shorter text is one shingle, an empty one none."""
    # bytes.lower and bytes.split know A-Z and \\x20 \\x09-\\x0D alone
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, _SEED)], np.uint64)
    ends = list(accumulate(map(len, parts)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends)]
    found = [digest(joined[s:e], _SEED) for s, e in zip(starts, ends[words - 1 :])]
    return np.array(found, np.uint64)


def fingerprint(text: bytes, words: int) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    hashes = shingle_hashes(text, words)
    ones = hash_bits(hashes) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id and fingerprint (a signed long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, 1):
            found = np.array([fingerprint(t, words) for t in texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def bit_pairs(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, for all i and j; 4096 numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(values), _HASHES_AT_ONCE):
                part = np.ascontiguousarray(values[i : i + _HASHES_AT_ONCE])
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(4096)
    for row in rows:
        pairs[row["cell"]] = row["n"]
    return pairs.reshape(64, 64)


def correlated_groups(pairs: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """The 64 bits in `groups` lists of like length; each is grown from its most correlated pair."""
    p = np.diag(pairs) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((pairs / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    free, made = list(range(64)), []
    for g in range(groups):
        width = -(-len(free) // (groups - g))
        inside = near[np.ix_(free, free)]
        group = [free[int(inside.max(axis=1).argmax())]]
        while len(group) < width:
            rest = [b for b in free if b not in group]
            group.append(rest[int(near[np.ix_(rest, group)].sum(axis=1).argmax())])
        free = [b for b in free if b not in group]
        made.append(group)
    return made


def share_within(group: list[int], pairs: np.ndarray, n: int, most: int) -> list[float]:
    """The expected share of fingerprint pairs that differ in at most 0, 1, ..., `most` bits of the group.

    The bits form a chain: whether two fingerprints agree on a bit depends on whether they agree on the
    one before, by the joint counts of the two.
    """
    p = np.diag(pairs) / n

    def agree(i: int) -> float:
        return p[i] ** 2 + (1 - p[i]) ** 2

    first = agree(group[0])
    same, other = np.zeros(most + 2), np.zeros(most + 2)
    same[0], other[1] = first, 1 - first
    for i, j in zip(group, group[1:]):
        one, two, both = p[i], p[j], pairs[i, j] / n
        aa = both**2 + (one - both) ** 2 + (two - both) ** 2 + (1 - one - two + both) ** 2
        a, b = agree(i), agree(j)
        from_same = aa / a if a > 0 else 0.0
        from_other = (b - aa) / (1 - a) if a < 1 else 0.0
        new_same = same * from_same + other * from_other
        new_other = np.roll(same * (1 - from_same) + other * (1 - from_other), 1)
        new_other[0] = 0
        same, other = new_same, new_other
    return np.cumsum((same + other)[: most + 1]).clip(0, 1).tolist()


def _flips(width: int, threshold: int) -> list[int]:
    """All masks of at most `threshold` of `width` bits."""
    return [sum(1 << b for b in c) for k in range(threshold + 1) for c in combinations(range(width), k)]


#: A shuffled probe costs as much as so many comparisons.
_PROBE_COST = 30


def allocate(groups: list[list[int]], pairs: np.ndarray, n: int, distance: int) -> tuple[float, list[int]]:
    """The cheapest thresholds (-1: the group is left out) with sum distance - groups + 1, and their cost."""
    target = distance - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        shares = share_within(group, pairs, n, distance)
        probes = np.cumsum([1.0] + [np.prod([(len(group) - i) / (i + 1) for i in range(k)]) for k in range(1, distance + 1)])
        cost = [0.0] + [n * _PROBE_COST * v + 0.5 * n * n * s for v, s in zip(probes, shares)]
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for t in range(-1, distance + 1):
                option = (spent + cost[t + 1], [*chosen, t])
                if used + t not in after or option < after[used + t]:
                    after[used + t] = option
        best = after
    return best[target]


def plan_index(pairs: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """The groups of bits that are searched, each with its threshold."""
    options = []
    for count in range(2, distance + 2):
        groups = correlated_groups(pairs, n, count)
        cost, thresholds = allocate(groups, pairs, n, distance)
        options.append((cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


def _value(group: list[int]) -> Column:
    """The bits of a group as a number."""
    value = F.lit(0).cast("long")
    for place, bit in enumerate(group):
        value = value.bitwiseOR(F.shiftleft(F.shiftright("fp", bit).bitwiseAND(F.lit(1).cast("long")), place))
    return value


def _group_keys(g: int, group: list[int], masks: list[int]) -> Column:
    """An array of (g, key), the group's value under each mask."""
    value = _value(group)

    def masked(m: Column) -> Column:
        return F.struct(F.lit(g).alias("g"), value.bitwiseXOR(m).alias("key"))

    return F.transform(F.lit(masks).cast("array<long>"), masked)


def _keys(fps: DataFrame, plan: list[tuple[list[int], int]], probing: bool) -> DataFrame:
    """fp, g and key: the own value in each group, or all values within the threshold."""
    entries = [_group_keys(g, group, _flips(len(group), t if probing else 0)) for g, (group, t) in enumerate(plan)]
    return fps.select("fp", F.explode(F.concat(*entries)).alias("k")).select("fp", "k.g", "k.key")


def links_within(fps: DataFrame, distance: int, crowd: int = 2048) -> DataFrame:
    """Links (a, b) whose components are those of all fingerprints within `distance`. fps: stored, distinct.

    A key that more than `crowd` fingerprints have is not searched pair by pair. All that meet there
    emit the values within half the distance instead: two of them within the distance share one of
    these, and everyone links to the smallest with the same value, so the work stays linear.
    """
    if distance % 2 or distance < 2:
        raise ValueError("the distance must be an even number from 2 on")
    n = fps.count()
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    plan = plan_index(bit_pairs(fps), n, distance)
    index = _keys(fps, plan, False)
    probes = _keys(fps, plan, True) if any(t for _, t in plan) else index
    crowded = settle(index.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("g", "key"), "crowded")
    balls = None
    if not crowded.isEmpty():
        meeting = index.unionByName(probes).join(crowded, ["g", "key"], "left_semi").select("fp").distinct()
        top = -(1 << 63)
        masks = _flips(63, distance // 2) + [top + m for m in _flips(63, distance // 2 - 1)]
        around = F.transform(F.lit(masks).cast("array<long>"), lambda m: F.col("fp").bitwiseXOR(m))
        near = meeting.select("fp", F.explode(around).alias("near"))
        least = near.groupBy("near").agg(F.min("fp").alias("m"), F.max("fp").alias("most")).where("m < most").select("near", "m")
        balls = near.join(least, "near").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()
        index, probes = (x.join(crowded, ["g", "key"], "left_anti") for x in (index, probes))
    left, right = index.withColumnRenamed("fp", "a"), probes.withColumnRenamed("fp", "b")
    met = left.join(right, ["g", "key"]).where(F.col("a") > F.col("b"))
    near = met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    return near if balls is None else near.unionByName(balls)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, crowd: int = 2048) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    rows = settle(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = smallest_reachable(links_within(distinct.select("fp"), distance, crowd))
    found = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    component = found.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprint(rows: DataFrame, text: int, words: int) -> DataFrame:
    """The rows and their fingerprint `fp`. text: where the text stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, batch_text):
            found = np.array([fingerprint(t, words) for t in texts_of(batch.column(batch_text))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    batch_text = len(rows.columns)
    schema = type(rows.schema)([*rows.schema.fields]).add("fp", "long")
    return rows.withColumn("text_as_read", rows[rows.columns[text]].cast("string")).mapInArrow(run, schema)


def drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """`docs` with one document per component, that with the smallest doc_id; rows without a doc_id stay.

    Rows that repeat a doc_id with other texts go or stay each with their own component.
    """
    found = components(docs, id_col, text_col, words, distance)
    gone = found.where("doc_id <> component_id").select("doc_id", F.conv("fingerprint", 16, -10).cast("long").alias("gone_fp"))
    gone = settle(gone.distinct(), "gone")
    plain, ident = by_position(docs), f"c{position(docs, id_col)}"
    # only rows that may go meet the ids in a shuffle; the rest pass straight through
    probed = bloom.probe(plain, ident, bloom.build(gone, "doc_id"), "maybe")
    maybe = _with_fingerprint(probed.where("maybe"), position(docs, text_col), words)
    same = (F.col(ident) == gone["doc_id"]) & (F.col("fp") == gone["gone_fp"])
    rest = maybe.join(gone.hint("merge"), same, "left_anti").drop("fp")
    return probed.where("not maybe").unionByName(rest).drop("maybe").toDF(*docs.columns)
