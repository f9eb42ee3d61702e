"""Outside knowledge as tables: countries, names and places. No remote calls."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.fixed_values import COUNTRY_ISO
from hushframe.functions.values import population_number

NAME_RESULTS = (
    "struct<results:array<struct<name:string,jurisdictions:array<string>,"
    "world:struct<incidence:string>>>>"
)


def country_iso(country: Column) -> Column:
    """ISO code of a country name; null for countries outside the table."""
    codes = F.create_map(*[F.lit(x) for x in chain.from_iterable(COUNTRY_ISO.items())])
    return F.try_element_at(codes, country)


def ingest_name_answers(answers: DataFrame, body: str, name_type: str | None = None) -> DataFrame:
    """Name-registry answers as rows of `names(name, name_type, incidence, jurisdictions)`.

    Each row of `answers` holds one JSON answer in the column `body`. Results whose incidence is not
    a whole number, and answers without results, give no rows. Thresholds are applied on use.
    """
    parsed = F.from_json(F.col(body), NAME_RESULTS)
    kind = F.lit(name_type).cast("string") if name_type else F.col("name_type")
    return (
        answers.select(kind.alias("name_type"), F.explode(parsed["results"]).alias("r"))
        .select(
            F.col("r.name").alias("name"),
            "name_type",
            F.col("r.world.incidence").try_cast("double").try_cast("bigint").alias("incidence"),
            F.col("r.jurisdictions").alias("jurisdictions"),
        )
        .where("incidence is not null")
    )


def ingest_population_answers(
    answers: DataFrame, name: str, text: str, strict_units: bool = False
) -> DataFrame:
    """Scraped population texts as rows of `second_source(name, population)`."""
    number = population_number(F.col(text), strict_units)
    return answers.select(F.col(name).alias("name"), number.alias("population"))
