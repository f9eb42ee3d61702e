"""Integer vectors, and a query set against all rows in cells of bounded size.

A cell is a lane of rows and a group of queries. Rows go to lanes and queries to groups by their place in a
stored table, not by a value, so no id, label or copy makes a cell larger than another. A cell holds
`lane` rows and `group` queries at most, whatever the size of the table; rows are shuffled once per group of
queries, queries once per lane.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: Most rows and most queries of a cell.
LANE = 4096
GROUP = 4096


def integer_vector(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, or null for a vector that is null or has a null or non-finite component.

    A component that doesn't fit 32 bits after scaling is an error.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    usable = F.col(vector).isNotNull() & F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    )
    fits = F.forall(whole, lambda x: x.between(-(2**31) + 1, 2**31 - 1))
    checked = F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.lit("a vector component is too large for exact scores")))
    return F.when(usable, checked)


def in_cells(rows: DataFrame, queries: DataFrame, count: int, queries_count: int, score: Callable, schema: pa.Schema) -> DataFrame:
    """`score(rows, queries)` of every cell, as Arrow tables of `schema`; `rows` and `queries` are stored frames."""
    lanes, groups = -(-max(count, 1) // LANE), -(-max(queries_count, 1) // GROUP)
    place = F.monotonically_increasing_id()
    left = rows.withColumn("lane", F.pmod(place, F.lit(lanes)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # under names of their own: a cogroup of a frame with a part of itself would mix up their columns
    own = queries.select(*[F.col(c).alias(f"{c}_asked") for c in queries.columns], F.pmod(place, F.lit(groups)).cast("int").alias("group"))
    right = own.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    rows_columns, asked_columns = rows.columns, queries.columns
    cells = left.groupBy("lane", "group").cogroup(right.groupBy("lane", "group"))

    def cell(_key: tuple, some: pa.Table, asked: pa.Table) -> pa.Table:
        if not some.num_rows or not asked.num_rows:
            return schema.empty_table()
        return score(some.select(rows_columns), pa.table([asked[f"{c}_asked"] for c in asked_columns], names=asked_columns))

    return cells.applyInArrow(cell, from_arrow_schema(schema))


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """The vectors of a column as rows of 64-bit integers; shorter vectors end in zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):  # no chunk at all
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0)) if width is None else width
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def widest(*columns: pa.ChunkedArray) -> int:
    """The number of components of the longest vector."""
    longest = [pa.compute.max(pa.compute.list_value_length(c)).as_py() for c in columns]
    return max((x for x in longest if x is not None), default=0)


def by_id(table: pa.Table) -> pa.Table:
    """The rows in ascending order of `id`, null ids last, so that an earlier place is a smaller id."""
    return table.sort_by([("id", "ascending")])
