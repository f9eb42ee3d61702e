"""Stored sketches of distinct values per column, for tables that grow by parts.

A part of a table (a day, a file, a partition) is sketched once: per column the number of clean values and a sketch of
the distinct ones (HyperLogLog, some kilobytes whatever the part holds). The profile of the whole table is the sum and the
union of its parts' rows, so a new part costs one scan of that part and none of the others. `sinks.write_sketches`
keeps the rows by part; a part that is sketched again replaces its rows.

Sketches don't hold values in clear, but tell whether a given value may occur: keep them with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.values import clean_sql, distinct_keys_sql, is_text, text_sql
from hushframe.operators.profile import scalar_fields
from hushframe.session import rows_frame

#: 2 ** 14 registers: estimates scatter by less than one in a hundred.
REGISTERS = 14

_SCHEMA = "part string, table_name string, column_name string, is_text boolean, n_values bigint, sketch binary"


def _key(field: T.StructField) -> str:
    """The value as the sketch takes it: a whole number, or bytes."""
    keys = distinct_keys_sql(field)
    filled = next(name for name, key in keys.items() if not key.startswith("cast(null"))
    if filled == "fraction":
        return f"cast(cast({keys[filled]} + 0D as string) as binary)"  # zero has one sign
    return f"cast(cast({keys[filled]} as string) as binary)" if filled == "moment" else keys[filled]


def column_sketches(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None, part: str = "all") -> DataFrame:
    """A row per column of the tables' given part: part, table_name, column_name, is_text, n_values, sketch.

    One scan of each table, without a shuffle of values.
    """
    branches = []
    for table, df in tables.items():
        own = scalar_fields(df, None if columns is None else columns.get(table, []))
        if not own:
            continue
        counted, cells = [], []
        for i, f in enumerate(own):
            value = f"case when {clean_sql(f)} then {_key(f)} end"
            counted += [F.expr(f"count({value})").alias(f"n_{i}"), F.expr(f"hll_sketch_agg({value}, {REGISTERS})").alias(f"s_{i}")]
            cells.append(f"struct({text_sql(f.name)} as column_name, {str(is_text(f)).lower()} as is_text, n_{i} as n_values, s_{i} as sketch)")
        listed = df.agg(*counted).selectExpr(f"inline(array({', '.join(cells)}))")
        branches.append(listed.select(F.lit(part).alias("part"), F.lit(table).alias("table_name"), "*"))
    session = next(iter(tables.values())).sparkSession
    return reduce(DataFrame.unionAll, branches) if branches else rows_frame(session, [], _SCHEMA)


def merged(stored: DataFrame) -> DataFrame:
    """The parts' rows as one per column: table_name, column_name, is_text, n_values, n_distinct (an estimate).

    A part may lack a column. A column that is text in one part is text.
    """
    both = stored.groupBy("table_name", "column_name").agg(
        F.bool_or("is_text").alias("is_text"),
        F.sum("n_values").alias("n_values"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"),
    )
    return both.withColumn("n_distinct", F.least("n_distinct", "n_values"))
