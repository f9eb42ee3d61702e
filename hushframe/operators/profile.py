"""Filled and distinct values per column, and value-label counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.fixed_values import (
    COLUMN_MISSING_CODES,
    MANY_VALUE_LABELS,
    SPARSE_ENTRY_RATIO,
    SPARSE_STRING_RATIO,
)
from hushframe.functions.values import (
    clean,
    clean_sql,
    distinct_keys_sql,
    is_scalar,
    is_text,
    name_sql,
    quoted,
    text_sql,
)
from hushframe.session import rows_frame

def scalar_fields(df: DataFrame, columns: list[str] | None = None) -> list[T.StructField]:
    """The value-testable fields of `df`, in schema order, limited to `columns` if given."""
    return [f for f in df.schema.fields if is_scalar(f) and (columns is None or f.name in columns)]


def clean_values(df: DataFrame, column: str, missing_codes: list[str] = COLUMN_MISSING_CODES) -> DataFrame:
    """Rows whose value in `column` is filled and not a missing-answer code."""
    return df.where(clean(df.schema[column], missing_codes))


def sparsity_profile(
    tables: dict[str, DataFrame],
    columns: dict[str, list[str]] | None = None,
    mode: str = "exact",
    thresholds: tuple[float, ...] = (SPARSE_STRING_RATIO, SPARSE_ENTRY_RATIO),
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Count of clean values, of distinct clean values, and their ratio, per column.

    Exact mode turns the cells of all tables into rows of (column, value), keeping the value's type,
    and counts them in one grouping, whose map side folds repeated values before the shuffle.

    Approximate mode estimates all columns of all tables in one job without a shuffle of values and
    counts exactly only the columns whose estimate lies near one of the `thresholds` that the profile is for.
    With stored `sketches` (`operators.sketches.merged`) there is no such job: estimates are read, and only the columns
    near a threshold are scanned. Columns without a stored estimate are estimated by a scan.
    """
    session = next(iter(tables.values())).sparkSession
    fields = [
        (t, f)
        for t, df in tables.items()
        for f in scalar_fields(df, None if columns is None else columns.get(t, []))
    ]
    if mode == "exact":
        counted = _exact(tables, fields)
    elif mode == "approx":
        counted = _approximate(tables, fields, thresholds, sketches)
    else:
        raise ValueError(f"mode must be 'exact' or 'approx', not {mode!r}")
    listed = rows_frame(
        session, [(i, t, f.name, is_text(f)) for i, (t, f) in enumerate(fields)], _LISTED_SCHEMA
    )
    if counted is None:
        counted = rows_frame(session, [], _COUNTED_SCHEMA)
    none = F.lit(0).cast("bigint")
    return listed.join(counted, "id", "left").select(
        "table_name",
        "column_name",
        "is_text",
        F.coalesce("n_values", none).alias("n_values"),
        F.coalesce("n_distinct", none).alias("n_distinct"),
        F.try_divide("n_distinct", "n_values").alias("ratio"),
    )


# Few columns per scan keep the rows of one scan few; few scans per table keep the tasks few.
_COLUMNS_PER_SCAN = 4
_SCANS_PER_TABLE = 8

_LISTED_SCHEMA = "id int, table_name string, column_name string, is_text boolean"
_COUNTED_SCHEMA = "id int, n_values bigint, n_distinct bigint"


def _exact(tables: dict[str, DataFrame], fields: list[tuple[str, T.StructField]]) -> DataFrame | None:
    if not fields:
        return None
    scans = []
    for table, df in tables.items():
        own = [(i, f) for i, (t, f) in enumerate(fields) if t == table]
        group = max(_COLUMNS_PER_SCAN, -(-len(own) // _SCANS_PER_TABLE))
        scans += [_cells(df, own[k : k + group]) for k in range(0, len(own), group)]
    per_value = (
        reduce(DataFrame.unionAll, scans)
        .groupBy("id", "whole", "fraction", "moment", "bytes")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_value.groupBy("id").agg(
        F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct")
    )


def _cells(df: DataFrame, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    """The clean values of some columns, one row per value."""
    cells = []
    for i, f in fields:
        keys = ", ".join(f"{key} as {name}" for name, key in distinct_keys_sql(f).items())
        cells.append(f"case when {clean_sql(f)} then struct({i} as id, {keys}) end")
    # An unclean cell is a null struct, which inline turns into a row of nulls.
    return df.selectExpr(f"inline(array({', '.join(cells)}))").where("id is not null")


# The estimates scatter by this much, so a column within the band around a threshold is recounted.
_ERROR, _BAND = 0.02, 0.1


def _approximate(
    tables: dict[str, DataFrame], fields: list[tuple[str, T.StructField]], thresholds: tuple[float, ...], sketches: DataFrame | None
) -> DataFrame | None:
    """One pass over each table, all tables in one job, and exact counts of what lies near a threshold."""
    if not fields:
        return None
    known = {} if sketches is None else {(r.table_name, r.column_name): (r.n_values, r.n_distinct) for r in sketches.collect()}
    estimates = [(i, *known[t, f.name]) for i, (t, f) in enumerate(fields) if (t, f.name) in known]
    branches = []
    for table, df in tables.items():
        own = [(i, f) for i, (t, f) in enumerate(fields) if t == table and (t, f.name) not in known]
        if not own:
            continue
        counted, cells = [], []
        for i, f in own:
            value = f"case when {clean_sql(f)} then {name_sql(f.name)} end"
            counted += [
                F.expr(f"count({value})").alias(f"n_{i}"),
                F.expr(f"approx_count_distinct({value}, {_ERROR})").alias(f"d_{i}"),
            ]
            cells.append(f"struct({i} as id, n_{i} as n, d_{i} as d)")
        branches.append(df.agg(*counted).selectExpr(f"inline(array({', '.join(cells)}))"))
    if branches:
        estimates += [tuple(r) for r in reduce(DataFrame.unionAll, branches).collect()]
    rows, near = [], []
    for i, n, d in estimates:
        if n and any(abs(d / n - limit) <= _BAND * limit for limit in thresholds):
            near.append((i, *fields[i]))
        else:
            rows.append((i, n, min(n, d)))
    session = next(iter(tables.values())).sparkSession
    estimated = rows_frame(session, rows, _COUNTED_SCHEMA)
    if not near:
        return estimated
    order = rows_frame(session, [(k, i) for k, (i, _, _) in enumerate(near)], "id int, own int")
    recounted = _exact(tables, [(t, f) for _, t, f in near]).join(order, "id")
    return estimated.unionAll(recounted.select("own", "n_values", "n_distinct"))


def value_counts(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Count of clean values per column (table_name, column_name, n_values): one pass, no shuffle of values."""
    branches = []
    for table, df in tables.items():
        own = scalar_fields(df, None if columns is None else columns.get(table, []))
        if own:
            counted = [F.expr(f"count_if({clean_sql(f)})").alias(f"n_{i}") for i, f in enumerate(own)]
            cells = ", ".join(f"struct({text_sql(f.name)} as column_name, n_{i} as n_values)" for i, f in enumerate(own))
            listed = df.agg(*counted).selectExpr(f"inline(array({cells}))")
            branches.append(listed.select(F.lit(table).alias("table_name"), "*"))
    session = next(iter(tables.values())).sparkSession
    return reduce(DataFrame.unionAll, branches) if branches else rows_frame(session, [], "table_name string, column_name string, n_values bigint")


def sparse(profile: DataFrame, threshold: float = SPARSE_ENTRY_RATIO) -> DataFrame:
    """Columns whose distinct values exceed the given share; a column without values never does."""
    return profile.where(F.col("ratio") > threshold)


def sparse_strings(profile: DataFrame, threshold: float = SPARSE_STRING_RATIO) -> DataFrame:
    """Sparse columns of type string."""
    return sparse(profile.where("is_text"), threshold)


def many_value_labels(value_labels: DataFrame, more_than: int = MANY_VALUE_LABELS) -> DataFrame:
    """Columns with more labelled codes than the limit."""
    keys = [k for k in ("table_name", "column_name") if k in value_labels.columns]
    counted = value_labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_labels"))
    return counted.where(F.col("n_labels") > more_than)


def distinct_values(df: DataFrame, column: str, order_by: tuple[str, ...]) -> DataFrame:
    """Distinct clean values of a column with the order key of their first row.

    Columns: `value` (text) and `first_seen` (struct of the order columns).
    """
    return distinct_values_of(df, [column], order_by).drop("column_name")


def distinct_values_of(df: DataFrame, columns: list[str], order_by: tuple[str, ...]) -> DataFrame:
    """The same for several columns in one scan: column_name, value, first_seen."""
    cells = ", ".join(
        f"case when {clean_sql(df.schema[c])} then struct({text_sql(c)} as column_name, cast({name_sql(c)} as string) as value) end"
        for c in columns
    )
    first = f"struct({', '.join(name_sql(c) for c in order_by)})"
    # An unclean cell is a null struct, which inline turns into a row of nulls.
    values = df.selectExpr(f"{first} as seen", f"inline(array({cells}))").where("column_name is not null")
    return values.groupBy("column_name", "value").agg(F.min("seen").alias("first_seen"))
