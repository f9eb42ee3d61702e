"""The registered queries of the corpus operators, and the same in SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, exact_dedup, html_text, kneser_ney, language_id, line_dedup, negatives, packing, simhash, token_files, topk, warc
from .common import importable_in_tasks, narrow, scratch

#: Pieces of text that a worker keeps in the queries that do nothing but encode; the pipeline keeps fewer beside its other stages.
PIECES = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable_in_tasks(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), pieces=PIECES)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), pieces=PIECES)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = html_text.extract(pages, html_text.train(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean_lines(_table(spark, sf_dir, "documents"), ratio=0.02, least=3)
    return cleaned.withColumnRenamed("host", "source")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"), words=4, distance=4)


def held_out(ident: Column) -> Column:
    """Documents that the language model must not learn from: crc32 of the id as text is 2 mod 4."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "lang", "text"))
    return language_id.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(_table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The documents that the quality model learns from: labelled good, and not labelled toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(_table(spark, sf_dir, "documents"), trusted_ids(_table(spark, sf_dir, "labels")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.flag(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), least=3, most=200)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024)
    return found.withColumnRenamed("id", "vec_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = narrow(_table(spark, sf_dir, "embeddings"), vec_id="vec_id", embedding="embedding", label="label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.mine(plain.withColumn("label", moved), F.col("id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


_OP4 = """
WITH p AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     n AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
     l AS (SELECT source, unnest(list_distinct([trim(x) for x in lines])) AS line FROM p),
     c AS (SELECT source, line, count(*) AS k FROM l WHERE line <> '' GROUP BY source, line),
     b AS (SELECT c.source, list(line) AS bad FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source
           WHERE k >= 3 AND k > 0.02 * pages GROUP BY c.source),
     k AS (SELECT doc_id, p.source, lines, [x for x in lines if NOT list_contains(coalesce(bad, []), trim(x))] AS stay
           FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, array_to_string(stay, chr(10)) AS text, len(lines) - len(stay) AS lines_dropped FROM k
"""
_OP7 = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
     f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d, n) END AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
_OP10 = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
_OP11 = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
t AS MATERIALIZED (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
),
k AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_n FROM k GROUP BY lang),
g AS MATERIALIZED (
  SELECT x.lang, x.source, coalesce(v, 0) AS v, coalesce(lang_n, 0) + coalesce(v, 0) AS lang_size, coalesce(n, 0) + coalesce(v, 0) AS size
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) USING (lang, source)
),
p AS MATERIALIZED (
  SELECT lang, g.source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // size AS p,
         1 + (1000000000::HUGEINT * (lang_n + 1)) // lang_size AS q
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
),
every AS (
  SELECT * FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM every QUALIFY part = 'pair' OR rank <= 200
"""
_VECTORS = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, {label} AS label, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0{labelled}
),
s AS MATERIALIZED (
  SELECT q.r, c.r AS c, q.vec_id AS query_id, c.vec_id, q.label = c.label AS same, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0
)
"""
_OP12 = _VECTORS.format(scale=1024, label="NULL", labelled="") + """
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""
_OP13 = _VECTORS.format(scale=256, label="CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END", labelled=" AND label IS NOT NULL") + """,
p AS (
  SELECT r, query_id, vec_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same QUALIFY place <= 5
)
SELECT p.query_id AS anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.r = s.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""

QUERIES = {
    "op1_huffman_ids": op1_huffman_ids,
    "op2_packing": op2_packing,
    "op3_block_labeller": op3_block_labeller,
    "op4_site_lines": op4_site_lines,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_topk": op12_topk,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {
    "op4_site_lines": _OP4,
    "op7_warc": _OP7,
    "op10_exact_dedup": _OP10,
    "op11_source_divergence": _OP11,
    "op12_topk": _OP12,
    "op13_hard_negatives": _OP13,
}
