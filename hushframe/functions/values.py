"""Expressions on single values: what counts as filled, how a value reads as text, what shape it has.

Field-wise expressions are built as SQL text, because catalogs have many columns and one parsed text
costs far less than dozens of Column calls. The functions without `_sql` wrap them as Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.fixed_values import COLUMN_MISSING_CODES, DATE_SHAPES, PHONE_SHAPES

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_DIGEST_BYTES = 32


def name_sql(name: str) -> str:
    """The column called exactly `name`, also when the name holds dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def text_sql(value: str) -> str:
    """A string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def quoted(name: str) -> Column:
    return F.col(name_sql(name))


def is_scalar(field: T.StructField) -> bool:
    """Nested columns are listed in a catalog but never value-tested."""
    return not isinstance(field.dataType, _NESTED)


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def present_sql(field: T.StructField) -> str:
    """True where the value is neither null, nor NaN, nor an empty string."""
    value = name_sql(field.name)
    if is_text(field):
        return f"({value} is not null and {value} <> '')"
    if isinstance(field.dataType, _FLOATING):
        return f"({value} is not null and not isnan({value}))"
    return f"({value} is not null)"


def clean_sql(field: T.StructField, missing_codes: list[str] = COLUMN_MISSING_CODES) -> str:
    """`present`, and for text also not one of the missing-answer codes.

    The codes are text, so they never remove a number from a numeric column.
    """
    if not is_text(field):
        return present_sql(field)
    codes = ", ".join(text_sql(code) for code in missing_codes)
    return f"({present_sql(field)} and {name_sql(field.name)} not in ({codes}))"


def clean(field: T.StructField, missing_codes: list[str] = COLUMN_MISSING_CODES) -> Column:
    return F.expr(clean_sql(field, missing_codes))


def as_text_sql(field: T.StructField) -> str:
    """The value as it would be printed in a flat file.

    Spark prints doubles from 1e7 up and below 1e-3 in scientific form, which would hide digit runs
    from the phone shape; between 1e-4 and 1e16 the plain digits are restored without padding.
    """
    value = name_sql(field.name)
    text = f"cast({value} as string)"
    if not isinstance(field.dataType, _FLOATING):
        return text
    return (
        f"(case when abs({value}) >= 1e7 and abs({value}) < 1e16"
        rf" then regexp_replace(cast(try_cast({text} as decimal(38,10)) as string), r'(\.\d+?)0*$', '$1')"
        f" when abs({value}) >= 1e-4 and abs({value}) < 1e-3"
        f" then rtrim('0', cast(try_cast({text} as decimal(38,24)) as string))"
        f" else {text} end)"
    )


def as_text(field: T.StructField) -> Column:
    return F.expr(as_text_sql(field))


def distinct_keys_sql(field: T.StructField) -> dict[str, str]:
    """Values `whole`, `fraction`, `moment` and `bytes` that are equal exactly when the values are equal.

    One of them is filled, by the type of the field, so that columns of all types can be grouped
    together without printing numbers as text. Long text is replaced by its 32-byte SHA-256, so that
    counting distinct documents does not shuffle the documents; shorter text stays as it is, and the
    lengths keep the two kinds apart.
    """
    value = name_sql(field.name)
    keys = {
        "whole": "cast(null as bigint)",
        "fraction": "cast(null as double)",
        "moment": "cast(null as timestamp_ntz)",
        "bytes": "cast(null as binary)",
    }
    if isinstance(field.dataType, _INTEGRAL):
        keys["whole"] = f"cast({value} as bigint)"
    elif isinstance(field.dataType, T.BooleanType):
        keys["whole"] = f"cast(cast({value} as int) as bigint)"
    elif isinstance(field.dataType, T.DateType):
        keys["whole"] = f"cast(unix_date({value}) as bigint)"
    elif isinstance(field.dataType, T.TimestampType):
        keys["whole"] = f"unix_micros({value})"
    elif isinstance(field.dataType, T.TimestampNTZType):
        keys["moment"] = value
    elif isinstance(field.dataType, _FLOATING):
        keys["fraction"] = f"cast({value} as double)"
    else:
        text = value if isinstance(field.dataType, T.BinaryType) else f"cast(cast({value} as string) as binary)"
        keys["bytes"] = (
            f"(case when octet_length({text}) < {_DIGEST_BYTES} then {text} else unhex(sha2({text}, 256)) end)"
        )
    return keys


def short_key_sql(text: str) -> str:
    """The text itself, or the digest of a long one: a join key of at most 64 bytes.

    A digest has 64 characters and is never equal to a shorter text.
    """
    return f"(case when octet_length({text}) < 64 then {text} else sha2({text}, 256) end)"


def _java(shapes: list[str]) -> str:
    # \s in the shapes includes the four ASCII separators 1C..1F, which Java leaves out even
    # with (?U), the flag that widens \d and \s beyond ASCII.
    either = "|".join(shapes)
    widened = either.replace(r"[-.\s]", r"[-.\s\x1c-\x1f]").replace(r"\s*", r"[\s\x1c-\x1f]*")
    if widened.count(r"\x1c-\x1f") != either.count(r"\s"):
        raise ValueError("a shape uses \\s in a form that is not widened to the ASCII separators")
    either = widened
    return "(?:" + either + ")"


def is_phone_value_sql(text: str) -> str:
    """A phone number that begins on the first line of the value."""
    return f"({text} rlike {text_sql('(?Ud)^.*' + _java(PHONE_SHAPES))})"


def is_date_value_sql(text: str) -> str:
    """A value that begins with a day-month-year, month-day-year or year-month-day date."""
    return f"({text} rlike {text_sql('(?U)^' + _java(DATE_SHAPES))})"


def is_phone_token(token: Column) -> Column:
    """A token that begins with a phone number."""
    return token.rlike("(?U)^" + _java(PHONE_SHAPES))


def word_list(text: Column) -> Column:
    """The words of a comma-separated box: trimmed, without empty entries."""
    trimmed = F.transform(F.split(text, ","), lambda w: F.regexp_replace(w, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda w: w != "")


def population_number(text: Column, strict_units: bool = False) -> Column:
    """A population as printed on a search page, as a whole number; null where it cannot be read.

    Commas go, the first line counts, and of several words the last one is dropped. If two or more
    are left, the first is the number and a second word `million` multiplies it. By default
    `17 million` therefore reads as 17; `strict_units` keeps the unit when it is the last word.
    """
    line = F.substring_index(F.replace(text, F.lit(","), F.lit("")), "\n", 1)
    words = F.split(line, " ")
    drop_last = F.size(words) > 1
    if strict_units:
        drop_last = drop_last & (F.element_at(words, -1) != "million")
    kept = F.when(drop_last, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    first = F.regexp_replace(F.get(kept, F.lit(0)), r"^\s+|\s+$", "")
    factor = F.when(F.get(kept, F.lit(1)) == "million", F.lit(1e6)).otherwise(F.lit(1.0))
    decimal = F.when(first.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), first.try_cast("double"))
    # A number that stands alone must be whole: 12.5 cannot be read.
    whole = F.when(first.rlike(r"^[+-]?\d+$"), first.try_cast("bigint"))
    return F.when(F.size(kept) > 1, (decimal * factor).try_cast("bigint")).otherwise(whole)
