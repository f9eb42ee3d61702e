"""Replacing values by 1..n in the order of their keyed hash, and the map that undoes it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.hashing import KeyFile, keyed_sha1
from hushframe.functions.values import name_sql, quoted, short_key_sql, text_sql
from hushframe.session import small_groups

# A value is hot when it fills more than this share of a column, so at most 1000 values are hot.
_HOT_SHARE = 0.001


def _value_text(column: str, number_formats: dict[str, str] | None) -> str:
    """The value as text: in its printf format if one is given, else as Spark prints it."""
    name = name_sql(column)
    if number_formats and column in number_formats:
        return f"case when {name} is not null then format_string({text_sql(number_formats[column])}, {name}) end"
    return f"cast({name} as string)"


def encoding_map(
    df: DataFrame,
    columns: list[str],
    secret_key: str | KeyFile,
    number_formats: dict[str, str] | None = None,
    range_digits: int = 3,
) -> DataFrame:
    """Rows (variable, original_value, encoded_value, is_hot) for the given columns.

    Values are taken as text, numbers in their display format where `number_formats` names one;
    nulls have no code. The rank is not computed by one global sort: hashes are uniform, so their
    leading hex digits cut them into equal ranges. The ranges (4096 per column with three digits) are
    counted and summed up in order, and each range is sorted on its own. A fourth digit makes ranges
    a sixteenth as long, for columns with more than some billions of values.

    The map undoes the encoding: write it to a protected place and read it back before `encode` uses
    it (`sinks`); that keeps the published map and the published codes the same and spares a second
    ranking. `code_map` gives the codes without the values.
    """
    ranked = _ranked(df, columns, secret_key, number_formats, range_digits)
    return ranked.select("variable", "original_value", "encoded_value", "is_hot")


def code_map(
    df: DataFrame,
    columns: list[str],
    secret_key: str | KeyFile,
    number_formats: dict[str, str] | None = None,
    range_digits: int = 3,
) -> DataFrame:
    """Rows (variable, hash, encoded_value, is_hot): the codes by keyed hash, with no value in clear.

    It may be checkpointed or stored where the values may not; `encode` then needs the key.
    """
    ranked = _ranked(df, columns, secret_key, number_formats, range_digits)
    return ranked.select("variable", "hash", "encoded_value", "is_hot")


def _ranked(
    df: DataFrame, columns: list[str], secret_key: str | KeyFile, number_formats: dict[str, str] | None, range_digits: int
) -> DataFrame:
    """All values of the columns with their hash, rank and whether they are hot; one scan."""
    _checked(df, columns)
    cells = ", ".join(
        f"struct({text_sql(c)} as variable, {_value_text(c, number_formats)} as original_value)" for c in columns
    )
    values = df.selectExpr(f"inline(array({cells}))").where("original_value is not null")
    hashed = (
        values.groupBy("variable", "original_value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("hash", keyed_sha1(F.col("original_value"), secret_key))
        # A range that cannot be null: otherwise the join below would add a null check, pushed down
        # to the scan, that hashes every row instead of every value and hides the shared shuffle.
        .withColumn("range", F.coalesce(F.substring("hash", 1, range_digits), F.lit("")))
    )
    sizes = hashed.groupBy("variable", "range").agg(
        F.count(F.lit(1)).alias("in_range"), F.sum("n").alias("rows_in_range")
    )
    starts = sizes.selectExpr(
        "variable",
        "range",
        "sum(in_range) over (partition by variable order by range) - in_range as start",
        "sum(rows_in_range) over (partition by variable) as n_rows",
    )
    # No broadcast is asked for: there are 16 ** range_digits ranges per encoded column, and the
    # ranking below needs the shuffle by range anyway.
    return hashed.join(starts, ["variable", "range"]).selectExpr(
        "variable",
        "original_value",
        "hash",
        "start + row_number() over (partition by variable, range order by hash) as encoded_value",
        f"n > {_HOT_SHARE} * n_rows as is_hot",
    )


def _checked(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")


def encode(
    df: DataFrame,
    columns: list[str],
    mapping: DataFrame,
    number_formats: dict[str, str] | None = None,
    secret_key: str | KeyFile | None = None,
    broadcast: bool = True,
) -> DataFrame:
    """Replace the values of `columns` by their codes in `mapping`; null stays null, labels stay.

    `mapping` comes from `encoding_map`, or from `code_map` and then needs the key. A value without
    a code ends the job with an error: it would be lost otherwise.

    Codes of measured small size are broadcast, as many columns as fit the limit together, unless
    `broadcast` is off. The codes of all other columns are looked up together, and the table is shuffled once:
    see `_replace_together`.
    """
    _checked(df, columns)
    by_hash = "hash" in mapping.columns
    if by_hash and secret_key is None:
        raise ValueError("a map of hashes needs the secret key")
    map_key = F.col("hash") if by_hash else F.expr(short_key_sql("original_value"))
    keyed = mapping.where(F.col("variable").isin(columns)).select("variable", map_key.alias("__key"), F.col("encoded_value").alias("__code"), "is_hot")
    small = small_groups(keyed, "variable", ["__key"]) if broadcast and columns else set()

    def value_key(column: str) -> Column:
        text = _value_text(column, number_formats)
        return keyed_sha1(F.expr(text), secret_key) if by_hash else F.expr(short_key_sql(text))

    large = {}
    for column in dict.fromkeys(columns):
        codes = keyed.where(F.col("variable") == column).drop("variable")
        if column in small:
            marked = df.withColumn("__value", value_key(column))
            found = marked.join(F.broadcast(codes), F.col("__value") == F.col("__key"), "left")
            df = _coded(found, df, {column: ("__value", "__code")})
        else:
            large[column] = (value_key(column), codes)
    if len(large) == 1:
        ((column, (key, codes)),) = large.items()
        df = _coded(_lookup_without_skew(df.withColumn("__value", key), codes), df, {column: ("__value", "__code")})
    elif large:
        df = _replace_together(df, large)
    return df


def _coded(found: DataFrame, df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """The columns of `df`, those in `columns` replaced by their codes; a value without one is an error."""

    def code(column: str) -> Column:
        value, looked_up = (F.col(x) for x in columns[column])
        lost = F.raise_error(F.lit(f"a value of column {column!r} has no code in the encoding map"))
        checked = F.when(value.isNull() | looked_up.isNotNull(), looked_up).otherwise(lost.cast("bigint"))
        return checked.alias(column, metadata=df.schema[column].metadata)

    return found.select([code(c) if c in columns else quoted(c) for c in df.columns])


def _replace_together(df: DataFrame, large: dict[str, tuple[Column, DataFrame]]) -> DataFrame:
    """Codes of several columns with one shuffle of the table.

    Hot values are looked up by broadcast joins (at most 1000 for a column, with keys of at most 64 bytes). The values
    of a row that are still open make its tuple, known by its digest. The cells of the tuples meet the codes of all
    columns in one join, are folded back to a row per tuple, and that row meets the table. A tuple holds a value that
    isn't hot, so no tuple is in more than a small share of the rows; rows without one spread over all tasks.
    """
    marked, open_cells, rest = df, [], []
    for i, (key, codes) in enumerate(large.values()):
        hot = codes.where("is_hot").select(F.col("__key").alias(f"__hot_{i}"), F.col("__code").alias(f"__hot_code_{i}"))
        marked = marked.withColumn(f"__value_{i}", key).join(F.broadcast(hot), F.col(f"__value_{i}") == F.col(f"__hot_{i}"), "left")
        cell = F.struct(F.lit(i).alias("i"), F.col(f"__value_{i}").alias("value"))
        open_cells.append(F.when(F.col(f"__value_{i}").isNotNull() & F.col(f"__hot_code_{i}").isNull(), cell))
        rest.append(codes.where("not is_hot").select(F.lit(i).alias("i"), F.col("__key").alias("value"), "__code"))
    spelled = "array_join(transform(__open, x -> concat(x.i, ':', octet_length(x.value), ':', x.value)), '')"
    marked = marked.withColumn("__open", F.filter(F.array(*open_cells), lambda x: x.isNotNull()))
    tuples = marked.where("size(__open) > 0").select(F.expr(f"sha2({spelled}, 256)").alias("__tuple"), F.explode("__open").alias("cell"))
    met = tuples.select("__tuple", "cell.i", "cell.value").join(reduce(DataFrame.unionAll, rest), ["i", "value"])
    folded = met.groupBy("__tuple").agg(*[F.max(F.when(F.col("i") == i, F.col("__code"))).alias(f"__rest_{i}") for i in range(len(large))])
    own = F.expr(f"case when size(__open) > 0 then sha2({spelled}, 256) else concat('p', cast(spark_partition_id() as string)) end")
    found = marked.withColumn("__own", own).drop("__open").join(folded, F.col("__own") == F.col("__tuple"), "left")
    for i in range(len(large)):
        found = found.withColumn(f"__code_{i}", F.coalesce(f"__hot_code_{i}", f"__rest_{i}"))
    return _coded(found, df, {c: (f"__value_{i}", f"__code_{i}") for i, c in enumerate(large)})


def _lookup_without_skew(marked: DataFrame, keyed: DataFrame) -> DataFrame:
    """Adds `__code` by a shuffle join that sends no hot value to one task.

    Hot values (at most 1000, with keys of at most 64 bytes) are looked up by a broadcast join. Their
    rows, and rows with null, need no second lookup: instead of a value they take the number of their
    input partition as join key, which no value equals, and so spread over all tasks of the shuffle.
    """
    hot = keyed.where("is_hot").select(F.col("__key").alias("__hot"), F.col("__code").alias("__hot_code"))
    rest = keyed.where("not is_hot").select(
        F.concat(F.lit("v"), "__key").alias("__key"), F.col("__code").alias("__rest_code")
    )
    own_key = F.expr(
        "case when __hot_code is null and __value is not null then concat('v', __value)"
        " else concat('p', cast(spark_partition_id() as string)) end"
    )
    return (
        marked.join(F.broadcast(hot), F.col("__value") == F.col("__hot"), "left")
        .withColumn("__key", own_key)
        .join(rest, "__key", "left")
        .withColumn("__code", F.coalesce("__hot_code", "__rest_code"))
    )


def decode_value_labels(df: DataFrame, columns: list[str], value_labels: DataFrame) -> DataFrame:
    """Replace labelled codes by their label text; codes without a label become null."""
    _checked(df, columns)
    for column in columns:
        labels = (
            value_labels.where(F.col("column_name") == column)
            .groupBy(F.col("code").alias("__code"))
            .agg(F.max("label").alias("__label"))
        )
        label = F.col("__label").alias(column, metadata=df.schema[column].metadata)
        kept = [label if c == column else quoted(c) for c in df.columns]
        df = df.join(labels, quoted(column) == F.col("__code"), "left").select(kept)
    return df


def strip_value_labels(value_labels: DataFrame, columns: list[str]) -> DataFrame:
    """Value labels without those of the given columns; the codes in the data stay."""
    return value_labels.where(~F.col("column_name").isin(columns))
