"""Queries on free text: words, phones, names, places, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe import fixed_values as fixed
from hushframe.functions.values import word_list
from hushframe.operators import freetext, mask
from hushframe.plans import detect
from hushframe.session import rows_frame
from hushframe.sources.tables import Survey
from workload.shared import PHONE_TOKEN_SQL, in_list, quote, table
from workload.sources import STOP_SQL, stopwords


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _tokens(spark, sf_dir):
    return freetext.tokens(_documents(spark, sf_dir), ["text"])


def _words_of(spark, sf_dir, name):
    """Words of a table's text without punctuation at their edges, with their number."""
    split = F.explode(F.split("text", " ")).alias("token")
    bare = table(spark, sf_dir, name).select(split).select(freetext.trimmed().alias("token"))
    return bare.where("char_length(token) > 2").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def names(spark, sf_dir):
    """A name registry made from the conversations: their capitalised words."""
    return (
        _words_of(spark, sf_dir, "conversations")
        .where("token rlike '^[A-Z]'")
        .selectExpr(
            "token as name",
            "case when char_length(token) % 2 = 0 then 'forename' else 'surname' end as name_type",
            "n * 10 as incidence",
            "case when char_length(token) % 5 = 0 then array() else array('xx') end as jurisdictions",
        )
    )


def token_tags(spark, sf_dir):
    """Word classes for the words of the benchmark and the conversations."""
    both = _words_of(spark, sf_dir, "benchmark").unionAll(_words_of(spark, sf_dir, "conversations"))
    return both.select("token").distinct().selectExpr(
        "'english' as language",
        "token",
        """case char_length(token) % 4 when 0 then 'PROPN' when 1 then 'NOUN' when 2 then '' else 'VERB' end
           as tag""",
    )


def towns(spark, sf_dir):
    """A gazetteer made from the words of the benchmark."""
    return _words_of(spark, sf_dir, "benchmark").selectExpr(
        "token as name",
        "case when char_length(token) % 2 = 0 then 'mx' else 'ke' end as country_iso",
        "cast(case char_length(token) % 5 when 0 then 0 when 1 then null else char_length(token) * 4000 end"
        " as bigint) as population",
    )


def text_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir)


def text_tokens_many_columns(spark, sf_dir):
    return freetext.tokens(table(spark, sf_dir, "conversations"), ["role", "text"])


def phone_tokens(spark, sf_dir):
    return freetext.phone_tokens(_tokens(spark, sf_dir))


def text_no_stopwords(spark, sf_dir):
    return freetext.without_stopwords(_tokens(spark, sf_dir), stopwords(spark))


def text_tag_filter(spark, sf_dir):
    return freetext.name_like(_tokens(spark, sf_dir), token_tags(spark, sf_dir), "english")


def text_tag_filter_untrimmed(spark, sf_dir):
    return freetext.name_like(_tokens(spark, sf_dir), token_tags(spark, sf_dir), "english", trim=False)


def name_tokens(spark, sf_dir):
    return freetext.person_names(_tokens(spark, sf_dir), names(spark, sf_dir))


def text_pii(spark, sf_dir):
    return freetext.personal_tokens(
        _documents(spark, sf_dir),
        ["text"],
        stopwords(spark),
        names(spark, sf_dir),
        towns(spark, sf_dir),
        country_iso="mx",
        token_tags=token_tags(spark, sf_dir),
        language="english",
    )


def text_pii_without_tags(spark, sf_dir):
    return freetext.personal_tokens(
        _documents(spark, sf_dir), ["text"], stopwords(spark), names(spark, sf_dir), towns(spark, sf_dir)
    )


def free_text_search(spark, sf_dir):
    """Runs the cascade on the conversations, picks the open-text columns left, finds their words."""
    survey = Survey("conversations", table(spark, sf_dir, "conversations"), order_by=("conv_id", "turn"))
    _, columns, found = detect.cascade_with_free_text(
        [survey], stopwords(spark), names(spark, sf_dir), towns(spark, sf_dir), country="Kenya"
    )
    return found.select("token", "kind", F.lit(" ".join(columns["conversations"])).alias("columns"))


def free_text_search_with_locations(spark, sf_dir):
    """The same with the population check: a column of towns leaves before the text is searched."""
    town = F.concat(F.lit("Town "), F.col("conv_id").cast("string"))
    data = table(spark, sf_dir, "conversations").withColumn("home_village", town)
    known = towns(spark, sf_dir).unionByName(
        data.selectExpr("home_village as name", "'ke' as country_iso", "cast(1000 as bigint) as population").distinct()
    )
    survey = Survey("conversations", data, order_by=("conv_id", "turn"), country="Kenya")
    findings, columns, found = detect.cascade_with_free_text(
        [survey], stopwords(spark), names(spark, sf_dir), known, with_locations=True
    )
    located = findings.where("method = 'location'").select(F.col("column_name").alias("located"))
    return found.select("token", "kind", F.lit(" ".join(columns["conversations"])).alias("columns")).join(located)


def _words_sql(name: str) -> str:
    return (
        "SELECT regexp_replace(t, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS token"
        f" FROM (SELECT unnest(string_split(text, ' ')) AS t FROM {name})"
    )


def tokens_sql(name: str, columns: tuple[str, ...] = ("text",)) -> str:
    parts = " UNION ALL ".join(
        f"SELECT unnest(string_split({c}, ' ')) AS token FROM {name}"
        f" WHERE {c} IS NOT NULL AND {c} <> '' AND {c} NOT IN {in_list(fixed.TEXT_MISSING_CODES)}"
        for c in columns
    )
    return f"SELECT DISTINCT token FROM ({parts}) WHERE length(token) > 2"


_IS_PHONE = f"regexp_matches(token, {quote(PHONE_TOKEN_SQL)})"
_CTES = f"""
tokens AS MATERIALIZED ({tokens_sql("documents")}),
stop AS {STOP_SQL},
names AS (SELECT token AS name, count(*) * 10 AS incidence, length(token) % 5 <> 0 AS has_jurisdiction
  FROM ({_words_sql("conversations")}) WHERE length(token) > 2 AND regexp_matches(token, '^[A-Z]') GROUP BY token),
person AS MATERIALIZED (SELECT name FROM names WHERE incidence > 50 AND has_jurisdiction),
tags AS (SELECT DISTINCT token, CASE length(token) % 4 WHEN 0 THEN 'PROPN' WHEN 1 THEN 'NOUN'
    WHEN 2 THEN '' ELSE 'VERB' END AS tag
  FROM ({_words_sql("benchmark")} UNION ALL {_words_sql("conversations")}) WHERE length(token) > 2),
accepted AS MATERIALIZED (SELECT DISTINCT token FROM tags WHERE tag IN {in_list(fixed.NAME_LIKE_TAGS)}),
towns AS (SELECT DISTINCT token AS name, CASE WHEN length(token) % 2 = 0 THEN 'mx' ELSE 'ke' END AS country_iso,
    CASE length(token) % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE length(token) * 4000 END AS population
  FROM ({_words_sql("benchmark")}) WHERE length(token) > 2)"""


def _search_sql(rest: str, towns_where: str) -> str:
    """The search over CTE `tokens`; `rest` names the words left after phones, stop words and tags."""
    return f"""
phones AS MATERIALIZED (SELECT token FROM tokens WHERE {_IS_PHONE}),
said AS MATERIALIZED (SELECT t.token FROM tokens t ANTI JOIN stop s ON s.word = t.token WHERE NOT {_IS_PHONE}),
bare AS MATERIALIZED (SELECT DISTINCT regexp_replace(token, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS token FROM said),
tagged AS MATERIALIZED (SELECT b.token FROM bare b SEMI JOIN accepted a ON a.token = b.token),
named AS MATERIALIZED (SELECT r.token FROM {rest} r SEMI JOIN person p ON p.name = r.token),
placed AS MATERIALIZED (SELECT r.token, t.population FROM {rest} r
  JOIN (SELECT * FROM towns {towns_where}) t ON t.name = r.token ANTI JOIN named n ON n.token = r.token),
highest AS MATERIALIZED (SELECT coalesce(max(population) >= 20000, false) AS any_high FROM placed),
found AS (SELECT token, 'phone' AS kind FROM phones UNION ALL SELECT token, 'name' FROM named
  UNION ALL SELECT token, 'place' FROM placed, highest WHERE population < 20000 OR (population IS NULL AND any_high))"""


# ------------------------------------------------------------------------------------ masking

# Words that nest ('that' in 'thatin'), that look like patterns, an empty one.
MASKED = ["that", "thatin", "the***", "(", "Ana", "", "of the", "é"]


def mask_text(spark, sf_dir):
    return mask.mask_words(_documents(spark, sf_dir), ["text"], MASKED).select("doc_id", "text")


def mask_conversations(spark, sf_dir):
    data = table(spark, sf_dir, "conversations")
    return mask.mask_words(data, ["role", "text"], ["user", "la", "de"], mask="[-]")


def _listed(spark):
    return rows_frame(spark, [(w,) for w in MASKED], "word string")


def mask_text_by_join(spark, sf_dir):
    """The same list as `mask_text`, by the way that takes any number of words."""
    found = mask.mask_found_words(_documents(spark, sf_dir), ["text"], _listed(spark))
    return found.select("doc_id", "text")


def mask_found_words(spark, sf_dir):
    """Masks every phone-like word that the documents themselves contain."""
    found = phone_tokens(spark, sf_dir).withColumnRenamed("token", "word")
    masked = mask.mask_found_words(_documents(spark, sf_dir), ["text", "source"], found)
    return masked.select("doc_id", "text", "source")


def mask_found_words_null_key(spark, sf_dir):
    """The same in documents whose key is null in every seventh row."""
    key = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id"))
    data = _documents(spark, sf_dir).select(key.alias("doc_id"), "text")
    found = phone_tokens(spark, sf_dir).withColumnRenamed("token", "word")
    return mask.mask_found_words(data, ["text"], found)


def mask_phrases(spark, sf_dir):
    """Masks, in the documents, all pairs of neighbouring words of the benchmark."""
    said = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    pairs = (
        table(spark, sf_dir, "benchmark")
        .select(F.explode(F.transform(F.sequence(F.lit(1), F.size(said) - 1), lambda i: F.concat_ws(" ", F.slice(said, i, F.lit(2))))).alias("word"))
        .where("word not like ' %' and word not like '% '")
        .distinct()
    )
    return mask.mask_found_words(_documents(spark, sf_dir).select("doc_id", "text"), ["text"], pairs)


def _ordered(words) -> list[str]:
    return sorted({w for w in words if w}, key=lambda w: (-len(w), w))


def _mask_sql(text: str, words: str, with_: str = fixed.MASK) -> str:
    return (
        f"list_reduce(list_filter({words}, lambda w: contains({text}, w)),"
        f" lambda done, w: replace(done, w, {quote(with_)}), {text})"
    )


def _literal(words) -> str:
    return "[" + ", ".join(quote(w) for w in _ordered(words)) + "]"


_MASK_TEXT = f"SELECT doc_id, {_mask_sql('text', _literal(MASKED))} AS text FROM documents"


def edited_word_list(spark, sf_dir):
    """Each conversation turn read as a comma-separated word box."""
    words = F.posexplode(word_list(F.col("text"))).alias("position", "word")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", words).select(
        "conv_id", "turn", F.col("position").cast("bigint").alias("position"), "word"
    )


ENTRIES = {
    "text_tokens": (text_tokens, tokens_sql("documents")),
    "text_tokens_many_columns": (
        text_tokens_many_columns,
        tokens_sql("conversations", ("role", "text")),
    ),
    "phone_tokens": (phone_tokens, f"WITH {_CTES} SELECT token FROM tokens WHERE {_IS_PHONE}"),
    "text_no_stopwords": (
        text_no_stopwords,
        f"WITH {_CTES} SELECT token FROM tokens WHERE token NOT IN (SELECT word FROM stop)",
    ),
    "text_tag_filter": (
        text_tag_filter,
        f"""WITH {_CTES} SELECT DISTINCT regexp_replace(token, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS token
FROM tokens WHERE regexp_replace(token, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') IN (SELECT token FROM accepted)""",
    ),
    "text_tag_filter_untrimmed": (
        text_tag_filter_untrimmed,
        f"WITH {_CTES} SELECT token FROM tokens WHERE token IN (SELECT token FROM accepted)",
    ),
    "name_tokens": (
        name_tokens,
        f"WITH {_CTES} SELECT token FROM tokens WHERE token IN (SELECT name FROM person)",
    ),
    "text_pii": (
        text_pii,
        f"WITH {_CTES}, {_search_sql('tagged', chr(10) + 'WHERE country_iso = ' + quote('mx'))}"
        " SELECT token, kind FROM found",
    ),
    "text_pii_without_tags": (
        text_pii_without_tags,
        f"WITH {_CTES}, {_search_sql('said', '')} SELECT token, kind FROM found",
    ),
    "free_text_search": (
        free_text_search,
        f"WITH {_CTES.replace(tokens_sql('documents'), tokens_sql('conversations'))},"
        f" {_search_sql('said', 'WHERE country_iso = ' + quote('ke'))}"
        " SELECT token, kind, 'text' AS columns FROM found",
    ),
    "free_text_search_with_locations": (
        free_text_search_with_locations,
        f"WITH {_CTES.replace(tokens_sql('documents'), tokens_sql('conversations'))},"
        f" {_search_sql('said', 'WHERE country_iso = ' + quote('ke'))}"
        " SELECT token, kind, 'text' AS columns, 'home_village' AS located FROM found",
    ),
    "mask_found_words_null_key": (
        mask_found_words_null_key,
        f"""WITH {_CTES},
words AS (SELECT list(token ORDER BY length(token) DESC, token) AS listed FROM tokens WHERE {_IS_PHONE})
SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS doc_id, {_mask_sql("text", "listed")} AS text FROM documents, words""",
    ),
    "mask_phrases": (
        mask_phrases,
        f"""WITH b AS (SELECT string_split(replace(text, chr(10), ' '), ' ') AS w FROM benchmark),
pairs AS (SELECT DISTINCT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS word FROM b),
words AS (SELECT list(word ORDER BY length(word) DESC, word) AS listed FROM pairs WHERE word NOT LIKE ' %' AND word NOT LIKE '% ')
SELECT doc_id, {_mask_sql("text", "listed")} AS text FROM documents, words""",
    ),
    "mask_text": (mask_text, _MASK_TEXT),
    "mask_text_by_join": (mask_text_by_join, _MASK_TEXT),
    "mask_conversations": (
        mask_conversations,
        f"""SELECT conv_id, turn, {_mask_sql("role", _literal(["user", "la", "de"]), "[-]")} AS role,
  {_mask_sql("text", _literal(["user", "la", "de"]), "[-]")} AS text FROM conversations""",
    ),
    "mask_found_words": (
        mask_found_words,
        f"""WITH {_CTES},
words AS (SELECT list(token ORDER BY length(token) DESC, token) AS listed FROM tokens WHERE {_IS_PHONE})
SELECT doc_id, {_mask_sql("text", "listed")} AS text, {_mask_sql("source", "listed")} AS source
FROM documents, words""",
    ),
    "edited_word_list": (
        edited_word_list,
        r"""SELECT conv_id, turn, position, word FROM (
  SELECT conv_id, turn, unnest(range(len(w))) AS position, unnest(w) AS word FROM (
    SELECT conv_id, turn, list_filter(list_transform(string_split(text, ','),
      lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS w FROM conversations))""",
    ),
}
