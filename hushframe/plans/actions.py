"""Choosing an action per found column, and applying the choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.fixed_values import MASK
from hushframe.functions.hashing import KeyFile
from hushframe.operators.encode import encode
from hushframe.operators.mask import mask_found_words, mask_words

ACTIONS = ("Drop", "Encode", "Keep")


def action_plan(findings: DataFrame, overrides: DataFrame | None = None, default: str = "Drop") -> DataFrame:
    """One action per found column; `overrides(column_name, action)` replaces the default.

    Overrides may name the table too. Two of them for one column are an error.
    """
    keys = ["column_name"]
    if "table_name" in findings.columns:
        keys = ["table_name"] + keys
    found = findings.select(keys).distinct()
    if overrides is None:
        return found.withColumn("action", F.lit(default))
    on = [k for k in keys if k in overrides.columns]
    double = overrides.groupBy(on).agg(F.count_distinct("action").alias("n")).where("n > 1").limit(1).collect()
    if double:
        raise ValueError(f"several actions are given for {' '.join(str(double[0][k]) for k in on)}")
    chosen = overrides.select(*on, "action").distinct()
    return found.join(chosen, on, "left").withColumn("action", F.coalesce("action", F.lit(default)))


def chosen_actions(plan: DataFrame, table_name: str | None = None) -> dict[str, str]:
    """The plan of one table on the driver: a row per found column.

    A plan of several tables needs the name of the table that is meant.
    """
    if table_name is not None:
        plan = plan.where(F.col("table_name") == table_name)
    rows = plan.collect()
    tables = sorted({row.table_name for row in rows}) if "table_name" in plan.columns else []
    if len(tables) > 1:
        raise ValueError(f"the plan is of several tables, name one: {', '.join(tables)}")
    chosen = {row.column_name: row.action for row in rows}
    unknown = sorted(set(chosen.values()) - set(ACTIONS))
    if unknown:
        raise ValueError(f"unknown actions {unknown}; use {', '.join(ACTIONS)}")
    if len(rows) > len(chosen):
        raise ValueError("the plan has several actions for one column")
    return chosen


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns that must exist (Spark itself ignores unknown names)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")
    return df.select([F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in columns])


def deidentify(
    df: DataFrame,
    actions: dict[str, str],
    encoding: DataFrame | None = None,
    text_columns: list[str] | None = None,
    words: list[str] | DataFrame | None = None,
    mask: str = MASK,
    secret_key: str | KeyFile | None = None,
) -> DataFrame:
    """Apply the actions, and mask `words` in those text columns that are kept as they are.

    `encoding` is the stored map of the columns to encode (`operators.encode.encoding_map`, written
    and read back by `sinks.write_encoding_map`, or `code_map` with the `secret_key`). `words` is an
    edited list, or a DataFrame with the column `word` for any number of words. Columns that are named
    and don't exist are an error. Column labels stay.

    Drop and a word list are one projection; each encoded column is one join with its map.
    """
    to_drop = [c for c, action in actions.items() if action == "Drop"]
    to_encode = [c for c, action in actions.items() if action == "Encode"]
    if to_encode and encoding is None:
        raise ValueError(f"an encoding map is needed for {', '.join(to_encode)}")
    masked = [c for c in text_columns or [] if c not in to_drop + to_encode]
    if masked and isinstance(words, DataFrame):
        df = mask_found_words(df, masked, words, mask)
    elif masked and words:
        df = mask_words(df, masked, words, mask)
    kept = drop_columns(df, to_drop)
    return encode(kept, to_encode, encoding, secret_key=secret_key) if to_encode else kept


def plan_report(plan: DataFrame) -> DataFrame:
    """One line per action with its columns; kept columns and empty groups give no line.

    The grouped names are those of one schema.
    """
    line = F.concat(
        F.format_string("Columns to %s: ", F.lower("action")),
        F.array_join(F.array_sort(F.collect_list("column_name")), " "),
    )
    keys = [k for k in ("table_name", "action") if k in plan.columns]
    return plan.where("action <> 'Keep'").groupBy(keys).agg(line.alias("line"))


def apply_messages(
    actions: dict[str, str],
    table_name: str,
    map_path: str | None = None,
    masked: list[str] | None = None,
    words: DataFrame | list[str] | None = None,
) -> list[str]:
    """Lines for the log of what the apply step does: dropped, encoded, map written, words masked.

    Words are counted and not named, as the log is no protected place.
    """
    lines = []
    for action, done in (("Drop", "Dropped columns"), ("Encode", "Encoded columns")):
        names = sorted(c for c, a in actions.items() if a == action)
        if names:
            lines.append(f"{table_name}: {done}: {' '.join(names)}")
    if map_path is not None:
        lines.append(f"{table_name}: Encoding map written to {map_path}")
    if masked and words is not None:
        n = words.select("word").distinct().count() if isinstance(words, DataFrame) else len({w for w in words if w})
        lines.append(f"{table_name}: {n} words masked in: {' '.join(masked)}")
    return lines
