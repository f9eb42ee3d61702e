"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Vectors become integers, and a component is a term. In each cell (see `grids`) the lane of rows is turned into
postings, one list per term of the rows that have it and their weights. A query is a sparse row: for each of its
non-zero terms its weight times the postings is added to a dense array of scores, one per row of the lane. The
k best of that array come from a partition around the k-th best score; lanes are merged by rank. Every row of the
lane gets its full score; nothing is pruned.

Scores are exact: sums are done in float64 as long as none can pass 2**53, and in 64-bit integers beyond.

Defined cases: a vector that is null, or holds a null, NaN or infinity, takes no part, neither as query nor as row; a
missing component counts as zero, so vectors of different length and empty vectors have scores; a row is no
candidate for itself, but rows that repeat its id or vector are; a null id is no query, and comes last among ties;
an empty table gives an empty result; a component or a score that might not fit (32 bits, 64 bits) is an error;
other columns of any name are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grids
from .common import narrow, settle

_FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def postings(lane: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Per term (column of the lane): the rows that have it, and their weights.

    A list that most rows are on keeps a weight for all of them, zeros included, and needs no row numbers.
    """
    lists = []
    for weights in lane.T:
        rows = np.flatnonzero(weights)
        full = 2 * len(rows) > len(weights)
        lists.append((slice(None), np.ascontiguousarray(weights)) if full else (rows, weights[rows]))
    return lists


def accumulate(query: np.ndarray, lists: list, scores: np.ndarray, work: np.ndarray) -> None:
    """Set `scores` to the inner products of the query with all rows, one term after the other."""
    scores[:] = 0
    for term in np.flatnonzero(query):
        rows, weights = lists[term]
        part = np.multiply(weights, query[term], out=work[: len(weights)])
        if isinstance(rows, slice):
            scores += part
        else:
            scores[rows] += part  # a row is on a list once


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, best first; of equal scores the earlier place goes first."""
    if k < len(scores):
        least = -np.partition(-scores, k - 1)[k - 1]
        above = np.flatnonzero(scores > least)
        chosen = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((chosen, -scores[chosen]))]


def _exact_type(lane: np.ndarray, queries: np.ndarray) -> type:
    bound = int(np.abs(lane).max(initial=0)) * int(np.abs(queries).max(initial=0)) * lane.shape[1]
    if bound >= 2**63:
        raise OverflowError("an inner product might not fit 64 bits")
    return np.float64 if bound < 2**53 else np.int64


def search_cell(k: int, rows: pa.Table, queries: pa.Table) -> pa.Table:
    """The k best rows of a lane for each query of a group."""
    rows = grids.by_id(rows)
    width = grids.widest(rows["vector"], queries["vector"])
    lane, asked = grids.matrix(rows["vector"], width), grids.matrix(queries["vector"], width)
    kind = _exact_type(lane, asked)
    lists, asked = postings(lane.astype(kind)), asked.astype(kind)
    scores, work = np.empty(len(lane), kind), np.empty(len(lane), kind)
    place = {row: i for i, row in enumerate(rows["row"].to_pylist())}
    query_rows = queries["row"].to_pylist()
    taken, found, values = [], [], []
    for query, row in zip(asked, query_rows, strict=True):
        accumulate(query, lists, scores, work)
        own = place.get(row)
        top = best(scores, k if own is None else k + 1)
        if own is not None:
            top = top[top != own][:k]
        taken.append(len(top))
        found.append(top)
        values.append(scores[top])
    chosen = np.concatenate(found) if found else np.empty(0, np.int64)
    of_query = np.repeat(np.arange(len(query_rows)), taken)
    total = np.concatenate(values).astype(np.int64) if values else np.empty(0, np.int64)
    columns = [queries["row"].take(of_query), queries["id"].take(of_query), rows["id"].take(chosen), pa.array(total)]
    return pa.table(columns, schema=_FOUND)


def numbered(vectors: DataFrame, scale: int, id_col: str, vector_col: str, **more: str) -> DataFrame:
    """Usable vectors as integers, stored, with a number `row` that identifies a row of the stored table.

    Rows with a null in one of the columns `more` are left out too.
    """
    plain = narrow(vectors, id=id_col, vector=vector_col, **more)
    whole = plain.select(F.col("id").cast("long"), grids.integer_vector("vector", scale).alias("vector"), *more)
    for column in ("vector", *more):
        whole = whole.where(F.col(column).isNotNull())
    return settle(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")


def search(
    vectors: DataFrame, is_query: Column | str, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k best other rows for each row that `is_query` (a condition on the column `id`) holds for.

    query_id, rank, id, score.
    """
    rows = numbered(vectors, scale, id_col, vector_col)
    queries = rows.where(is_query)
    found = grids.in_cells(rows, queries, rows.count(), queries.count(), lambda a, b: search_cell(k, a, b), _FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
