"""Words of free-text columns: tokenising, and finding phones, names and small places among them.

All functions work on distinct tokens, so a word that fills a third of the text is one row.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.fixed_values import (
    MIN_NAME_INCIDENCE,
    MIN_TOKEN_LENGTH,
    NAME_LIKE_TAGS,
    TEXT_MISSING_CODES,
)
from hushframe.functions.values import clean, is_phone_token, quoted
from hushframe.operators.places import low_population_places, place_lookup
from hushframe.sources.words import default_stopwords

log = logging.getLogger(__name__)


def tokens(df: DataFrame, columns: list[str], min_length: int = MIN_TOKEN_LENGTH) -> DataFrame:
    """Distinct words of the given text columns, split at single spaces, punctuation kept."""
    words = [
        F.when(clean(df.schema[c], TEXT_MISSING_CODES), F.split(quoted(c), " ")) for c in columns
    ]
    each = words[0] if len(words) == 1 else F.flatten(F.array_compact(F.array(*words)))
    said = df.select(F.explode(each).alias("token"))
    return said.where(F.char_length("token") >= min_length).distinct()


def phone_tokens(found: DataFrame) -> DataFrame:
    """Tokens that begin with a phone number."""
    return found.where(is_phone_token(F.col("token")))


def without_stopwords(found: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Tokens that are not stop words; the comparison respects case."""
    words = stopwords.select(F.col("word").alias("token"))
    return found.join(words, "token", "left_anti")


def trimmed(token: str = "token"):
    """A token without punctuation at its edges."""
    return F.regexp_replace(F.col(token), r"^\p{Punct}+|\p{Punct}+$", "")


def name_like(
    found: DataFrame,
    token_tags: DataFrame,
    language: str,
    tags: list[str] = NAME_LIKE_TAGS,
    trim: bool = True,
) -> DataFrame:
    """Tokens whose word class in `token_tags(language, token, tag)` is that of a name."""
    accepted = _accepted(token_tags, language, tags)
    if trim:
        found = found.select(trimmed().alias("token")).where("token <> ''").distinct()
    return found.join(accepted, "token", "left_semi")


def _accepted(token_tags: DataFrame, language: str, tags: list[str]) -> DataFrame:
    chosen = (F.col("language") == language) & F.col("tag").isin(tags)
    return token_tags.where(chosen).select("token").distinct()


def _personal(names: DataFrame, min_incidence: int) -> DataFrame:
    known = (F.col("incidence") > min_incidence) & (F.size("jurisdictions") > 0)
    return names.where(known).select(F.col("name").alias("token")).distinct()


def person_names(found: DataFrame, names: DataFrame, min_incidence: int = MIN_NAME_INCIDENCE) -> DataFrame:
    """Tokens that the name registry knows as forename or surname of enough people."""
    return found.join(_personal(names, min_incidence), "token", "left_semi")


def personal_tokens(
    df: DataFrame,
    columns: list[str],
    stopwords: DataFrame | None,
    names: DataFrame,
    gazetteer: DataFrame,
    country_iso: str | None = None,
    token_tags: DataFrame | None = None,
    language: str | None = None,
    second_source: DataFrame | None = None,
) -> DataFrame:
    """Personal words in the given text columns: rows (token, kind), kind phone, name or place.

    Phones are taken first, from untouched tokens. The rest loses stop words, then words that are
    not name-like (skipped when no tag table is given), then is looked up as name, and what is no
    name as place with low population.

    Every step marks or drops rows of one chain of joins on distinct tokens. The rule for places of
    unknown population looks at all places first; that second use shares the shuffle of the tokens,
    and no word is stored on the way.
    """
    words = tokens(df, columns).withColumn("is_phone", is_phone_token(F.col("token")))
    if stopwords is None:
        stopwords = default_stopwords(df.sparkSession)
    stop = stopwords.select(F.col("word").alias("stop_word")).distinct()
    words = words.join(stop, (F.col("token") == F.col("stop_word")) & ~F.col("is_phone"), "left_anti")
    if token_tags is None:
        log.warning("no token tags given: word classes are not checked")
    else:
        tagged = _accepted(token_tags, language, NAME_LIKE_TAGS).withColumn("name_like", F.lit(True))
        bare = F.when(F.col("is_phone"), F.col("token")).otherwise(trimmed())
        words = (
            words.select(bare.alias("token"), "is_phone")
            .groupBy("token")
            .agg(F.bool_or("is_phone").alias("is_phone"))
            .join(tagged, "token", "left")
            .where("token <> '' and (is_phone or name_like)")
            .select("token", "is_phone")
        )
    is_name = _personal(names, MIN_NAME_INCIDENCE).withColumn("is_name", F.lit(True))
    looked_up = place_lookup(
        words.join(is_name, "token", "left").withColumnRenamed("token", "place"),
        gazetteer,
        country_iso,
        second_source,
    )
    kind = F.when(F.col("is_phone"), "phone").when(F.col("is_name"), "name").otherwise("place")
    found = (
        looked_up.withColumn("kind", kind)
        .where("kind <> 'place' or place_exists")
        .select("place", "kind", "place_exists", "population")
    )
    low = low_population_places(found.where("kind = 'place'"))
    return (
        found.where("kind <> 'place'")
        .unionByName(low)
        .select(F.col("place").alias("token"), "kind")
    )
