"""Phone and date shapes of column values, on the first values or on all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.fixed_values import SAMPLED_VALUES
from hushframe.functions.values import (
    as_text_sql,
    is_date_value_sql,
    is_phone_value_sql,
    name_sql,
    present_sql,
    quoted,
    text_sql,
)
from hushframe.operators.profile import scalar_fields

# Rows looked at before any column is read whole. Enough for columns filled in one row of twenty.
_ROWS_PER_VALUE = 20


def first_values(
    df: DataFrame,
    order_by: tuple[str, ...],
    columns: list[str] | None = None,
    n: int = SAMPLED_VALUES,
) -> DataFrame:
    """The first `n` non-empty values of each column, in the order of `order_by`.

    Columns: `column_name`, `position` (1..n), `value` (text). `order_by` must identify a row.

    Most columns have their first values within the first rows of the table; those are read first
    (`early_values`). Columns that are too empty there are searched in the whole table instead, all
    of them by one scan.
    """
    fields = scalar_fields(df, columns)
    if not fields:
        return _nothing(df)
    early = early_values(df, order_by, columns, n)
    counts = early.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("filled")
    )
    short = [r.column_name for r in counts.collect() if needs_whole_table(r.rows, r.filled, n)]
    found = early.where(F.col("value").isNotNull() & (F.col("position") <= n))
    if not short:
        return found
    late = whole_table_values(df, order_by, short, n)
    return found.where(~F.col("column_name").isin(short)).select("column_name", "position", "value").unionByName(late)


def needs_whole_table(rows: int, filled: int, n: int = SAMPLED_VALUES) -> bool:
    """Whether a column has fewer than `n` values in the early rows although the table goes on."""
    return filled < n and rows >= n * _ROWS_PER_VALUE


def early_values(
    df: DataFrame, order_by: tuple[str, ...], columns: list[str] | None = None, n: int = SAMPLED_VALUES
) -> DataFrame:
    """The values of the first 20n rows, per column, non-empty ones first: (column_name, position, value).

    The order key of row 20n bounds the rows; the bound is a filter on the scan, so only their part
    of the file is read.
    """
    if not order_by:
        raise ValueError("'first values' need an order: name the columns that order the rows")
    order = [quoted(c) for c in order_by]
    key, rows = order[0], n * _ROWS_PER_VALUE
    bound = df.select(key.alias("k")).orderBy("k").limit(rows).agg(F.max("k")).scalar()
    # A null bound means that all of those rows have a null key, which sorts first.
    early = df.where(key.isNull() | (key <= bound)).orderBy(*order).limit(rows)
    cells = ", ".join(
        f"struct({text_sql(f.name)} as column_name, case when {present_sql(f)} then {as_text_sql(f)} end as value)"
        for f in scalar_fields(df, columns)
    )
    keys = [f"k{i}" for i in range(len(order))]
    named = [f"{name_sql(c)} as {k}" for c, k in zip(order_by, keys)]
    long = early.selectExpr(f"inline(array({cells}))", *named)
    return _numbered(long, ["value is null", *keys])


def whole_table_values(df: DataFrame, order_by: tuple[str, ...], columns: list[str], n: int = SAMPLED_VALUES) -> DataFrame:
    """The first `n` non-empty values of each column, searched in the whole table by one scan.

    Non-empty cells become rows, and each task keeps its first `n` per column before the shuffle.
    """
    keys = [f"k{i}" for i in range(len(order_by))]
    cells = ", ".join(
        f"case when {present_sql(f)} then struct({text_sql(f.name)} as column_name, {as_text_sql(f)} as value) end"
        for f in scalar_fields(df, columns)
    )
    named = [f"{name_sql(c)} as {k}" for c, k in zip(order_by, keys)]
    long = df.selectExpr(f"inline(filter(array({cells}), x -> x is not null))", *named)
    return _numbered(long, keys).where(F.col("position") <= n)


def _nothing(df: DataFrame) -> DataFrame:
    return df.select(
        F.lit("").alias("column_name"), F.lit(0).alias("position"), F.lit("").alias("value")
    ).where(F.lit(False))


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    return df.selectExpr(
        "column_name",
        f"row_number() over (partition by column_name order by {', '.join(order)}) as position",
        "value",
    )


def sample_shapes(sample: DataFrame, keys: tuple[str, ...] = ("column_name",)) -> DataFrame:
    """Which columns of a sample of values hold at least one phone or date shape."""
    return sample.groupBy(*keys).agg(*shape_tests())


def shape_tests() -> list[Column]:
    """Aggregates `is_phone` and `is_date` over the column `value`."""
    return [
        F.expr(f"bool_or({is_phone_value_sql('value')}) as is_phone"),
        F.expr(f"bool_or({is_date_value_sql('value')}) as is_date"),
    ]


def typed_shapes_sql(field: T.StructField) -> tuple[str, str]:
    """Whether a value has phone shape and date shape; null where it is empty.

    The type spares most pattern tests: a whole number has phone shape from seven digits on, and no
    number has the two separators of a date.
    """
    value, text = name_sql(field.name), as_text_sql(field)
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        phone, date = f"({value} >= 1000000 or {value} <= -1000000)", "false"
    elif isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        phone, date = f"(char_length({text}) > 7 and {is_phone_value_sql(text)})", "false"
    else:
        phone, date = is_phone_value_sql(text), is_date_value_sql(text)
    filled = present_sql(field)
    return f"case when {filled} then {phone} end", f"case when {filled} then {date} end"


def scan_shapes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Which columns hold at least one phone or date shape anywhere: one pass, one result row,
    turned into a row per column that has any non-empty value."""
    fields = scalar_fields(df, columns)
    if not fields:
        return sample_shapes(_nothing(df))
    tests, cells = [], []
    for i, f in enumerate(fields):
        phone, date = typed_shapes_sql(f)
        tests += [F.expr(f"bool_or({phone}) as phone_{i}"), F.expr(f"bool_or({date}) as date_{i}")]
        cells.append(
            f"struct({text_sql(f.name)} as column_name, phone_{i} as is_phone, date_{i} as is_date)"
        )
    return df.agg(*tests).selectExpr(f"inline(array({', '.join(cells)}))").where("is_phone is not null")
