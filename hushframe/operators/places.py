"""Place names: which exist, how many people live there, and which are small enough to identify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.fixed_values import LOW_POPULATION

# The unknown places of a list meet its first large place in so many parts.
_PARTS = 32


def known_places(gazetteer: DataFrame, country_iso: str | None = None) -> DataFrame:
    """One row per name with its largest population; zero counts as unknown.

    Columns: `place`, `population`. Without a country code all countries are searched.
    """
    chosen = gazetteer if country_iso is None else gazetteer.where(F.col("country_iso") == country_iso)
    return chosen.groupBy(F.col("name").alias("place")).agg(
        F.max(F.nullif(F.col("population"), F.lit(0))).alias("population")
    )


def place_lookup(
    places: DataFrame,
    gazetteer: DataFrame,
    country_iso: str | None = None,
    second_source: DataFrame | None = None,
) -> DataFrame:
    """Add `place_exists` and `population` to the rows of `places`, by exact name in `place`.

    `second_source(name, population)` is asked only for places that exist without a known
    population; it never makes a place exist.
    """
    known = known_places(gazetteer, country_iso).withColumn("place_exists", F.lit(True))
    found = places.join(known, "place", "left").withColumn(
        "place_exists", F.coalesce("place_exists", F.lit(False))
    )
    if second_source is None:
        return found
    other = second_source.groupBy(F.col("name").alias("place")).agg(
        F.max(F.nullif(F.col("population"), F.lit(0))).alias("other_population")
    )
    needed = F.when(F.col("place_exists"), F.coalesce("population", "other_population"))
    return found.join(other, "place", "left").withColumn("population", needed).drop("other_population")


def low_population_places(
    found: DataFrame,
    threshold: int = LOW_POPULATION,
    unknown_is_low: bool = False,
    list_by: str | None = None,
) -> DataFrame:
    """Places under the threshold, from the result of `place_lookup`.

    An existing place of unknown population counts too, if some place of the same list is known to
    reach the threshold (then the list does hold places), or always with `unknown_is_low`. Rows with
    equal `list_by` form a list; without it all rows are one list.
    """
    population = F.col("population")
    existing = found.where("place_exists")
    low = population < threshold
    unknown = population.isNull()
    if unknown_is_low:
        return existing.where(low | unknown)
    high = existing.where(population >= threshold)
    if list_by is None:
        # count of one row at most: enough to know whether there is any
        any_high = high.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
        return existing.where(low | (unknown & any_high))
    with_high = high.select(list_by).distinct()
    return existing.where(low).unionByName(
        existing.where(unknown).join(with_high, list_by, "left_semi").select(existing.columns)
    )


def first_low_population_place(
    found: DataFrame,
    order: str,
    threshold: int = LOW_POPULATION,
    unknown_is_low: bool = False,
    list_by: tuple[str, ...] = (),
) -> DataFrame:
    """The first low place of each list, going through the list in the order of column `order`.

    That is the first place known to be under the threshold, or an earlier one of unknown population
    if a place known to reach the threshold came before it. Lists without such a place give no row.
    Columns: the `list_by` columns and `place`.
    """
    population, position = F.col("population"), F.col(order)
    existing = found.where("place_exists")
    if unknown_is_low:
        candidates = existing.where((population < threshold) | population.isNull())
        return _first(candidates, position, list_by)
    start = _per_list(existing.where(population >= threshold), list_by, F.min(position).alias("start"))
    low = existing.where(population < threshold)
    unknown = existing.where(population.isNull())
    if list_by:
        # A list meets its start in parts, so that a list of very many places isn't one task's work.
        dealt = start.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
        own = F.pmod(F.xxhash64("place"), F.lit(_PARTS)).cast("int")
        later = unknown.withColumn("part", own).join(dealt, [*list_by, "part"]).where(position > F.col("start"))
    else:
        later = unknown.where(position > start.scalar())
    columns = [*list_by, "place", order]
    return _first(low.select(columns).unionByName(later.select(columns)), position, list_by)


def _per_list(df: DataFrame, list_by: tuple[str, ...], aggregate: Column) -> DataFrame:
    return df.groupBy(*list_by).agg(aggregate) if list_by else df.agg(aggregate)


def _first(df: DataFrame, position: Column, list_by: tuple[str, ...]) -> DataFrame:
    first = F.min_by("place", position).alias("place")
    return _per_list(df, list_by, first).where("place is not null")
