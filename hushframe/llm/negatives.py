"""Hard negatives by exact scores: matrix products in residues, then a window below each positive.

Vectors become integers. In each cell (see `grids`) the products of a group of anchors with a lane of rows are
computed modulo several small primes, one float32 matrix product for each: residues lie around zero, so a sum over
`_span` components stays below 2**24 and is exact in float32; longer vectors are added up piece by piece. The
signed scores are put together by Chinese remaindering, from as many primes as the norms of the cell ask for.

Two passes over all rows. The first finds an anchor's positives, its best rows of the same label. The second keeps,
for each anchor and positive, the best rows of another label whose score lies between `low` and `high` hundredths of
the positive's: the scores of a lane are sorted once and each window is cut out by binary search. Lanes are merged by
rank after both passes.

Defined cases: a row with a null label, a null vector, or a null, NaN or infinite component takes no part; a
missing component counts as zero; a row is not its own positive, but rows that repeat its id or vector may be; a null
id is no anchor and comes last among ties; an anchor without positives, or a positive with nothing in its window
(always so below a score of zero), gives no rows; an empty table gives an empty result; a component beyond 32 bits, or
scores too large for the primes (beyond some 10**16), are an error; other columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grids
from .common import settle
from .topk import best, numbered

#: Each gives some eight bits of a score.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
#: Anchors whose scores are in memory at a time.
_BLOCK = 256


def _span(prime: int) -> int:
    """Components whose products of residues sum to less than 2**24."""
    return (2**24 - 1) // (prime // 2) ** 2


def _residues(values: np.ndarray, prime: int) -> np.ndarray:
    """values mod prime, from -(prime // 2) to prime // 2."""
    half = prime // 2
    return ((values + half) % prime - half).astype(np.float32)


def primes_for(left: np.ndarray, right: np.ndarray) -> tuple[int, ...]:
    """The first primes whose product exceeds the width of all possible scores, by the largest norms."""
    norm = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) for x in (left, right)]
    bound = int(norm[0] * norm[1] * (1 + 1e-9)) + 1
    if 2 * bound >= prod(PRIMES) or 100 * bound >= 2**63:
        raise OverflowError("scores too large")
    n = 1
    while prod(PRIMES[:n]) <= 2 * bound:
        n += 1
    return PRIMES[:n]


class Products:
    """Exact inner products with the rows of a lane."""

    def __init__(self, lane: np.ndarray, primes: tuple[int, ...]) -> None:
        self.primes = primes
        self.sides = [np.ascontiguousarray(_residues(lane, p).T) for p in primes]

    def of(self, queries: np.ndarray) -> np.ndarray:
        """One row of scores per query."""
        score, modulus = np.zeros((len(queries), self.sides[0].shape[1]), np.int64), 1
        for prime, side in zip(self.primes, self.sides, strict=True):
            asked, step = _residues(queries, prime), _span(prime)
            total = np.zeros(score.shape, np.int32)
            for at in range(0, side.shape[0], step):
                total = (total + (asked[:, at : at + step] @ side[at : at + step]).astype(np.int32)) % prime
            digit = (total - score % prime) * pow(modulus, -1, prime) % prime  # mixed radix, one digit a prime
            score += modulus * digit
            modulus *= prime
        return np.where(score > modulus // 2, score - modulus, score)


def _scored(rows: pa.Table, queries: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Place of a query in its table, and its scores with all rows."""
    width = grids.widest(rows["vector"], queries["vector"])
    lane, asked = grids.matrix(rows["vector"], width), grids.matrix(queries["vector"], width)
    products = Products(lane, primes_for(lane, asked))
    for at in range(0, len(asked), _BLOCK):
        yield from enumerate(products.of(asked[at : at + _BLOCK]), at)


_POSITIVE = pa.schema([("query_row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def positives_in_cell(k: int, rows: pa.Table, queries: pa.Table) -> pa.Table:
    """The k best other rows of the same label, for each query of a group, in a lane."""
    rows = grids.by_id(rows)
    labels, numbers = rows["label"].to_numpy(), rows["row"].to_numpy()
    asked, own = queries["label"].to_numpy(), queries["row"].to_numpy()
    query, chosen, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, scores in _scored(rows, queries):
        same = np.flatnonzero((labels == asked[i]) & (numbers != own[i]))
        top = same[best(scores[same], k)]
        query.append(np.full(len(top), own[i]))
        chosen.append(top)
        score.append(scores[top])
    columns = [pa.array(np.concatenate(query)), rows["id"].take(np.concatenate(chosen)), pa.array(np.concatenate(score))]
    return pa.table(columns, schema=_POSITIVE)


_NEGATIVE = pa.schema(
    [
        ("query_row", pa.int64()),
        ("place", pa.int32()),
        ("anchor_id", pa.int64()),
        ("positive_id", pa.int64()),
        ("id", pa.int64()),
        ("positive_score", pa.int64()),
        ("score", pa.int64()),
    ]
)


def window(descending: np.ndarray, positive: int, low: int, high: int, k: int) -> slice:
    """The first k of the scores that low * positive <= 100 * score <= high * positive holds for."""
    most, least = high * positive // 100, -(-low * positive // 100)
    start = int(np.searchsorted(-descending, -most, "left"))
    end = int(np.searchsorted(-descending, -least, "right"))
    return slice(start, max(start, min(end, start + k)))


def negatives_in_cell(k: int, low: int, high: int, rows: pa.Table, queries: pa.Table) -> pa.Table:
    """The k best rows of another label inside the window of each positive, for each query of a group, in a lane."""
    rows = grids.by_id(rows)
    labels = rows["label"].to_numpy()
    asked, own, ids = queries["label"].to_numpy(), queries["row"].to_numpy(), queries["id"].to_pylist()
    positives = queries["positives"].to_pylist()
    parts, chosen, score = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, scores in _scored(rows, queries):
        other = np.flatnonzero(labels != asked[i])
        order = other[np.lexsort((other, -scores[other]))]
        descending = scores[order]
        for x in positives[i]:
            cut = window(descending, x["score"], low, high, k)
            parts.append((own[i], x["place"], ids[i], x["id"], x["score"], cut.stop - cut.start))
            chosen.append(order[cut])
            score.append(descending[cut])
    times = np.array([x[-1] for x in parts], np.int64)
    row, place, anchor, positive, height = (
        pa.array([x[j] for x in parts], kind).take(pa.array(np.repeat(np.arange(len(parts)), times)))
        for j, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))
    )
    columns = [row, place, anchor, positive, rows["id"].take(np.concatenate(chosen)), height, pa.array(np.concatenate(score))]
    return pa.table(columns, schema=_NEGATIVE)


def mine(
    vectors: DataFrame,
    is_anchor: Column | str,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Hard negatives of each row that `is_anchor` (a condition on the column `id`) holds for.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = numbered(vectors, scale, id_col, vector_col, label=label_col)
    anchors = rows.where(is_anchor)
    count, anchors_count = rows.count(), anchors.count()
    found = grids.in_cells(rows, anchors, count, anchors_count, lambda a, b: positives_in_cell(positives, a, b), _POSITIVE)
    order = (F.desc("score"), F.asc_nulls_last("id"))
    kept = found.withColumn("place", F.row_number().over(Window.partitionBy("query_row").orderBy(*order))).where(F.col("place") <= positives)
    # at most `positives` of them for an anchor
    known = kept.groupBy(F.col("query_row").alias("row")).agg(F.collect_list(F.struct("place", "id", "score")).alias("positives"))
    asked = settle(anchors.join(known, "row"), "anchors")
    hard = grids.in_cells(rows, asked, count, anchors_count, lambda a, b: negatives_in_cell(negatives, low, high, a, b), _NEGATIVE)
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy("query_row", "place").orderBy(*order))).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
