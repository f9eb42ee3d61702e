"""Restricted words and stop words."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe import fixed_values as fixed
from hushframe.session import rows_frame

DICTIONARY_SCHEMA = "word string, match_kind string, word_group string, position int"

_GROUPS = [
    ("location", "strict", fixed.LOCATION_STRICT),
    ("location", "fuzzy", fixed.LOCATION_FUZZY),
    ("abbreviation", "strict", fixed.ABBREVIATION_STRICT),
    ("guideline", "strict", fixed.GUIDELINE_STRICT),
    ("guideline", "fuzzy", fixed.GUIDELINE_FUZZY),
    ("spanish", "fuzzy", fixed.SPANISH_FUZZY),
    ("swahili", "strict", fixed.SWAHILI_STRICT),
]


def word_groups(spark: SparkSession) -> DataFrame:
    """All built-in words with their group; a word may stand in several groups and kinds."""
    rows = [(word, kind, group) for group, kind, words in _GROUPS for word in words]
    return rows_frame(
        spark, [(*row, i) for i, row in enumerate(rows)], DICTIONARY_SCHEMA
    )


def effective_dictionary(groups: DataFrame, with_locations: bool) -> DataFrame:
    """One row per word: a word listed as both kinds is fuzzy; location words only on request."""
    chosen = groups if with_locations else groups.where("word_group <> 'location'")
    precedence = F.struct((F.col("match_kind") == "fuzzy").alias("wins"), -F.col("position"))
    return chosen.groupBy("word").agg(
        F.max_by("match_kind", precedence).alias("match_kind"),
        F.max_by("word_group", precedence).alias("word_group"),
        F.max_by("position", precedence).alias("position"),
    )


def location_dictionary(groups: DataFrame) -> DataFrame:
    """Only the location words, for the population check."""
    return effective_dictionary(groups.where("word_group = 'location'"), with_locations=True)


def system_columns(spark: SparkSession) -> DataFrame:
    """Names of the columns that the survey platform adds by itself."""
    return rows_frame(spark, [(w,) for w in fixed.SURVEY_SYSTEM_STRICT], "column_name string")


def read_stopwords(spark: SparkSession, folder: str, languages: list[str] | None = None) -> DataFrame:
    """Stop words from a folder with one newline-separated file, or folder of files, per language.

    Without `languages` all lists are read: what has a name without an ending.
    """
    base = folder.rstrip("/")
    paths = [base] if languages is None else [f"{base}/{language}" for language in languages]
    lines = spark.read.option("recursiveFileLookup", languages is None).text(paths)
    inside = F.substring_index(F.col("_metadata.file_path"), f"/{base.rsplit('/', 1)[-1]}/", -1)
    language = F.split(inside, "/")[0]
    read = lines.select(language.alias("language"), F.col("value").alias("word")).where("word <> ''")
    if languages is None:
        read = read.where(~F.contains("language", F.lit(".")) & (F.lower("language") != "readme"))
    return read.distinct()


#: The languages whose stop words ship with Spark.
SHIPPED_LANGUAGES = (
    "danish", "dutch", "english", "finnish", "french", "german", "hungarian", "italian", "norwegian", "portuguese",
    "russian", "spanish", "swedish", "turkish",
)


def default_stopwords(
    spark: SparkSession, languages: tuple[str, ...] | None = ("english", "spanish")
) -> DataFrame:
    """The stop words that ship with Spark, for languages it knows; None means all of them."""
    languages = SHIPPED_LANGUAGES if languages is None else languages
    rows = [
        (language, word)
        for language in languages
        for word in StopWordsRemover.loadDefaultStopWords(language)
    ]
    return rows_frame(spark, rows, "language string, word string").distinct()
