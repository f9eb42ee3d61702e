"""Session helpers: small driver-side tables, cutting lineage, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def rows_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few driver-side rows (schemas, findings, word lists).

    Going through Arrow makes Catalyst see a local relation with a known size, so it is broadcast
    by the ordinary size check and needs no Python workers.
    """
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = [pa.array([row[i] for row in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=fields)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors can read.

    Only a local session without one gets a folder of its own; a cluster session without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can read")
        folder = tempfile.mkdtemp(prefix="hushframe-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint `df` into the shared folder, so that later uses read it instead of recomputing it.

    What is settled must hold no personal value in clear.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_BROADCAST_ROWS = 500_000
_BROADCAST_BYTES = 32 * 1024 * 1024


def fits_broadcast(rows: int, octets: int) -> bool:
    """Whether so many rows with so many bytes of text may be broadcast."""
    return rows <= _BROADCAST_ROWS and octets <= _BROADCAST_BYTES


def is_small(df: DataFrame, texts: list[str]) -> bool:
    """Whether a stored or settled frame may be broadcast, by its measured rows and bytes of text.

    `texts` are SQL expressions for the parts of variable length.
    """
    size = " + ".join(f"coalesce(octet_length({t}), 0)" for t in texts)
    measured = df.selectExpr("count(1) as n", f"coalesce(sum(cast({size} as bigint)), 0) as b").first()
    return fits_broadcast(measured["n"], measured["b"])


def small_groups(df: DataFrame, by: str, texts: list[str]) -> set[str]:
    """The groups of a stored or settled frame that may be broadcast together, the smallest first, by measured size.

    One job measures all groups; `by` names few of them, such as the columns of a table.
    """
    size = " + ".join(f"coalesce(octet_length({t}), 0)" for t in texts)
    measured = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.expr(f"coalesce(sum(cast({size} as bigint)), 0) as b"))
    small, rows, held = set(), 0, 0
    for group, n, b in sorted(measured.collect(), key=lambda r: (r["b"], r["n"])):
        rows, held = rows + n, held + b
        if rows <= _BROADCAST_ROWS and held <= _BROADCAST_BYTES:
            small.add(group)
    return small


def broadcast_if_small(df: DataFrame, texts: list[str]) -> DataFrame:
    """Mark a stored or settled frame for broadcasting if its measured size allows it.

    Otherwise the frame is returned as it is, and the join shuffles both sides.
    """
    return F.broadcast(df) if is_small(df, texts) else df
