"""Queries on hashing, encoding and applying a plan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hushframe import sinks
from hushframe.functions.hashing import key_pads, keyed_sha1, plain_sha1, write_key
from hushframe.operators import encode, freetext, profile
from hushframe.plans import actions, detect
from hushframe.session import rows_frame, settle, shared_folder
from hushframe.sources import tables
from hushframe.sources.tables import Survey
from workload.shared import (
    PHONE_TOKEN_SQL,
    SECRET_KEY,
    VALUE_LABELS_SQL,
    findings_ctes,
    quote,
    surveys,
    table,
    value_labels,
    values_sql,
)
from workload.text import tokens_sql

LONG_KEY = "a key that is longer than one block of the hash, so it is hashed before use " * 2


def keyed_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        keyed_sha1(F.col("c_name"), SECRET_KEY).alias("hash"),
        keyed_sha1(F.col("c_name"), LONG_KEY).alias("hash_long_key"),
    )


def keyed_hash_by_file(spark, sf_dir):
    """The keys are in protected files; plans and event logs don't hold them."""
    folder = f"{shared_folder(spark).rstrip('/')}/keys-{uuid.uuid4().hex[:12]}"
    key, long_key = (write_key(spark, k, f"{folder}/{i}") for i, k in enumerate((SECRET_KEY, LONG_KEY)))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", keyed_sha1(F.col("c_name"), key).alias("hash"), keyed_sha1(F.col("c_name"), long_key).alias("hash_long_key")
    )


def sha1_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", plain_sha1(F.col("text")).alias("hash"))


def _hmac_sql(value: str, key: str = SECRET_KEY) -> str:
    inner, outer = (pad.hex() for pad in key_pads(key))
    return f"sha1(unhex('{outer}') || unhex(sha1(unhex('{inner}') || encode({value}))))"


_KEYED_SQL = f"SELECT c_custkey, {_hmac_sql('c_name')} AS hash, {_hmac_sql('c_name', LONG_KEY)} AS hash_long_key FROM customer"


def _encoded(spark, sf_dir, name, columns):
    data = table(spark, sf_dir, name)
    return encode.encode(data, columns, settle(encode.code_map(data, columns, SECRET_KEY)), secret_key=SECRET_KEY)


def encode_ordinal(spark, sf_dir):
    encoded = _encoded(spark, sf_dir, "customer", ["c_name", "c_mktsegment"])
    return encoded.select("c_custkey", "c_name", "c_mktsegment")


def encode_numeric(spark, sf_dir):
    encoded = _encoded(spark, sf_dir, "orders", ["o_custkey", "o_totalprice"])
    return encoded.select("o_orderkey", "o_custkey", "o_totalprice")


MANY = ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]


def encode_many_columns(spark, sf_dir):
    """Four columns whose maps are not broadcast: they are looked up together, with one shuffle of the table."""
    data = table(spark, sf_dir, "orders").select("o_orderkey", *MANY)
    mapping = settle(encode.code_map(data, MANY, SECRET_KEY))
    return encode.encode(data, MANY, mapping, secret_key=SECRET_KEY, broadcast=False)


def encode_display_format(spark, sf_dir):
    """Amounts are encoded as displayed, with two decimals."""
    data, shown = table(spark, sf_dir, "part"), {"p_retailprice": "%.2f"}
    mapping = settle(encode.code_map(data, ["p_retailprice"], SECRET_KEY, shown))
    return encode.encode(data, ["p_retailprice"], mapping, shown, SECRET_KEY).select("p_partkey", "p_retailprice")


def encode_text(spark, sf_dir):
    """Long texts with many copies of each other."""
    return _encoded(spark, sf_dir, "documents", ["text"]).select("doc_id", "text")


def encoding_map(spark, sf_dir):
    data = table(spark, sf_dir, "customer")
    mapping = encode.encoding_map(data, ["c_name", "c_mktsegment", "c_nationkey"], SECRET_KEY)
    return mapping.select("variable", "original_value", "encoded_value")


def _map_sql(name: str, column: str, value: str | None = None) -> str:
    value = value or f"CAST({column} AS VARCHAR)"
    return (
        f"SELECT {quote(column)} AS variable, v AS original_value,"
        f" row_number() OVER (ORDER BY {_hmac_sql('v')}) AS encoded_value"
        f" FROM (SELECT DISTINCT {value} AS v FROM {name}) WHERE v IS NOT NULL"
    )


def decode_value_labels(spark, sf_dir):
    decoded = encode.decode_value_labels(
        table(spark, sf_dir, "customer"), ["c_nationkey"], value_labels(spark, sf_dir)
    )
    return decoded.select("c_custkey", "c_nationkey")


def decode_then_encode(spark, sf_dir):
    """Labelled codes are encoded by their label text."""
    decoded = encode.decode_value_labels(
        table(spark, sf_dir, "customer"), ["c_nationkey"], value_labels(spark, sf_dir)
    )
    mapping = settle(encode.code_map(decoded, ["c_nationkey"], SECRET_KEY))
    return encode.encode(decoded, ["c_nationkey"], mapping, secret_key=SECRET_KEY).select("c_custkey", "c_nationkey")


def strip_value_labels(spark, sf_dir):
    return encode.strip_value_labels(value_labels(spark, sf_dir), ["p_partkey", "n_regionkey"])


def apply_drop(spark, sf_dir):
    return actions.drop_columns(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"])


CHOICES = [("c_name", "Encode"), ("c_acctbal", "Keep"), ("c_mktsegment", "Encode")]


def apply_plan(spark, sf_dir):
    """Find, plan, apply: the customer table without its keys and with encoded names."""
    survey = surveys(spark, sf_dir, ("customer",))[0]
    findings = detect.cascade([survey])
    overrides = rows_frame(spark, CHOICES, "column_name string, action string")
    chosen = actions.chosen_actions(actions.action_plan(findings, overrides))
    to_encode = [c for c, action in chosen.items() if action == "Encode"]
    mapping = settle(encode.code_map(survey.data, to_encode, SECRET_KEY))
    return actions.deidentify(survey.data, chosen, mapping, secret_key=SECRET_KEY)


LABELS_KEPT = [("c_name", "Name of the customer"), ("c_mktsegment", "Segment"), ("c_acctbal", "Balance")]


def apply_plan_labels(spark, sf_dir):
    """The labels that the columns of the result carry, with the number of values in each."""
    listed = rows_frame(spark, LABELS_KEPT, "column_name string, label string")
    data = tables.attach_labels(table(spark, sf_dir, "customer"), listed)
    mapping = settle(encode.code_map(data, ["c_name"], SECRET_KEY))
    result = actions.deidentify(
        data, {"c_name": "Encode", "c_custkey": "Drop"}, mapping, ["c_mktsegment"], ["BUILD"], secret_key=SECRET_KEY
    )
    found = rows_frame(spark, list(tables.labels_in_schema(result.schema).items()), "column_name string, label string")
    return profile.value_counts({"customer": result}).select("column_name", "n_values").join(found, "column_name")


# Two tables that share the names of their columns.
TWO = {
    "buyers": ("customer", "c_custkey as id", "c_name as name", "c_acctbal as amount"),
    "sales": ("orders", "o_orderkey as id", "o_orderpriority as name", "o_totalprice as amount"),
}
TWO_CHOICES = [("buyers", "amount", "Keep"), ("sales", "amount", "Encode")]


def apply_plan_two_tables(spark, sf_dir):
    """Found in one run, planned per table: the keys go, one name goes, one amount is encoded."""
    both = [Survey(n, table(spark, sf_dir, t).selectExpr(*columns), order_by=("id",)) for n, (t, *columns) in TWO.items()]
    overrides = rows_frame(spark, TWO_CHOICES, "table_name string, column_name string, action string")
    plan = actions.action_plan(detect.cascade(both), overrides)
    results = []
    for s in both:
        chosen = actions.chosen_actions(plan, s.name)
        to_encode = [c for c, action in chosen.items() if action == "Encode"]
        mapping = settle(encode.code_map(s.data, to_encode, SECRET_KEY)) if to_encode else None
        result = actions.deidentify(s.data, chosen, mapping, secret_key=SECRET_KEY)
        results.append(result.select(F.lit(s.name).alias("table_name"), F.lit(" ".join(result.columns)).alias("columns"), F.col("amount").cast("double").alias("amount")))
    return results[0].unionAll(results[1])


def apply_plan_with_mask(spark, sf_dir):
    """A table with open text: key and length dropped, language encoded, words masked."""
    data = table(spark, sf_dir, "documents")
    chosen = {"n_chars": "Drop", "lang": "Encode", "source": "Keep"}
    mapping = settle(encode.code_map(data, ["lang"], SECRET_KEY))
    return actions.deidentify(
        data, chosen, mapping, text_columns=["text"], words=["that", "thatin", "555-"], secret_key=SECRET_KEY
    )


def apply_plan_with_found_words(spark, sf_dir):
    """Open text whose phone-like words are found, and then masked by joins."""
    data = table(spark, sf_dir, "documents")
    found = freetext.phone_tokens(freetext.tokens(data, ["text"])).withColumnRenamed("token", "word")
    return actions.deidentify(
        data, {"doc_id": "Drop", "source": "Drop"}, text_columns=["text", "source"], words=found
    )


def write_deidentified(spark, sf_dir):
    """Customers without balance and with coded names, written as CSV with their labels, and read back."""
    listed = rows_frame(spark, LABELS_KEPT, "column_name string, label string")
    data = tables.attach_labels(table(spark, sf_dir, "customer"), listed)
    mapping = settle(encode.code_map(data, ["c_name"], SECRET_KEY))
    chosen = {"c_name": "Encode", "c_acctbal": "Drop", "c_mktsegment": "Keep"}
    result = actions.deidentify(data, chosen, mapping, secret_key=SECRET_KEY)
    folder = f"{shared_folder(spark).rstrip('/')}/out-{uuid.uuid4().hex[:12]}"
    path = sinks.write_deidentified(result, "/in/customer.csv", folder)
    kept = tables.read_labels(spark, f"{path}_labels", "csv").withColumnRenamed("column_name", "labelled")
    return tables.read_table(spark, path).join(kept, F.lit("c_mktsegment") == F.col("labelled"), "left").drop("labelled")


_MANY_CAST = {c: f"CAST({c} AS VARCHAR)" for c in MANY}
_MANY_SQL = (
    "WITH " + ", ".join(f"m{i} AS ({_map_sql('orders', c)})" for i, c in enumerate(MANY))
    + " SELECT o_orderkey, " + ", ".join(f"m{i}.encoded_value AS {c}" for i, c in enumerate(MANY)) + " FROM orders "
    + " ".join(f"LEFT JOIN m{i} ON m{i}.original_value = {_MANY_CAST[c]}" for i, c in enumerate(MANY))
)

# The oracle fixes which columns the plan drops; `cascade` has its own oracle.
_APPLY_SQL = f"""
WITH {findings_ctes(("customer",))}, m AS ({_map_sql("customer", "c_name")})
SELECT m.encoded_value AS c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment
FROM customer c LEFT JOIN m ON m.original_value = c.c_name
WHERE (SELECT string_agg(column_name, ' ' ORDER BY column_name) FROM findings) = 'c_acctbal c_custkey c_name'"""

ENTRIES = {
    "keyed_hash": (keyed_hash, _KEYED_SQL),
    "keyed_hash_by_file": (keyed_hash_by_file, _KEYED_SQL),
    "plain_sha1": (sha1_hash, "SELECT doc_id, sha1(text) AS hash FROM documents"),
    "encode_ordinal": (
        encode_ordinal,
        f"""WITH a AS ({_map_sql("customer", "c_name")}), b AS ({_map_sql("customer", "c_mktsegment")})
SELECT c_custkey, a.encoded_value AS c_name, b.encoded_value AS c_mktsegment FROM customer c
LEFT JOIN a ON a.original_value = c.c_name LEFT JOIN b ON b.original_value = c.c_mktsegment""",
    ),
    "encode_numeric": (
        encode_numeric,
        f"""WITH a AS ({_map_sql("orders", "o_custkey")}), b AS ({_map_sql("orders", "o_totalprice")})
SELECT o_orderkey, a.encoded_value AS o_custkey, b.encoded_value AS o_totalprice FROM orders o
LEFT JOIN a ON a.original_value = CAST(o.o_custkey AS VARCHAR)
LEFT JOIN b ON b.original_value = CAST(o.o_totalprice AS VARCHAR)""",
    ),
    "encode_many_columns": (encode_many_columns, _MANY_SQL),
    "encode_display_format": (
        encode_display_format,
        f"""WITH s AS (SELECT p_partkey, printf('%.2f', p_retailprice) AS shown FROM part),
  m AS ({_map_sql("s", "shown")})
SELECT p_partkey, m.encoded_value AS p_retailprice FROM s LEFT JOIN m ON m.original_value = s.shown""",
    ),
    "encode_text": (
        encode_text,
        f"""WITH a AS ({_map_sql("documents", "text")})
SELECT doc_id, a.encoded_value AS text FROM documents d LEFT JOIN a ON a.original_value = d.text""",
    ),
    "encoding_map": (
        encoding_map,
        " UNION ALL ".join(
            f"({_map_sql('customer', c)})" for c in ("c_name", "c_mktsegment", "c_nationkey")
        ),
    ),
    "decode_value_labels": (
        decode_value_labels,
        "SELECT c_custkey, n_name AS c_nationkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    ),
    "decode_then_encode": (
        decode_then_encode,
        f"""WITH d AS (SELECT c_custkey, n_name AS c_nationkey FROM customer
    LEFT JOIN nation ON n_nationkey = c_nationkey),
  m AS ({_map_sql("d", "c_nationkey")})
SELECT c_custkey, m.encoded_value AS c_nationkey FROM d LEFT JOIN m ON m.original_value = d.c_nationkey""",
    ),
    "strip_value_labels": (
        strip_value_labels,
        f"SELECT * FROM ({VALUE_LABELS_SQL}) WHERE column_name NOT IN ('p_partkey', 'n_regionkey')",
    ),
    "apply_drop": (apply_drop, "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "apply_plan": (apply_plan, _APPLY_SQL),
    "write_deidentified": (
        write_deidentified,
        f"""WITH m AS ({_map_sql("customer", "c_name")})
SELECT c_custkey, m.encoded_value AS c_name, c_nationkey, c_mktsegment, 'Segment' AS label
FROM customer LEFT JOIN m ON m.original_value = c_name""",
    ),
    "apply_plan_labels": (
        apply_plan_labels,
        f"""SELECT l.column_name, l.label, n.n_values FROM {values_sql(LABELS_KEPT, "column_name, label")} l
JOIN (SELECT 'c_name' AS column_name, count(DISTINCT c_custkey) AS n_values FROM customer WHERE c_name IS NOT NULL
  UNION ALL SELECT 'c_mktsegment', count(c_mktsegment) FROM customer
  UNION ALL SELECT 'c_acctbal', count(c_acctbal) FROM customer) n USING (column_name)""",
    ),
    "apply_plan_two_tables": (
        apply_plan_two_tables,
        f"""WITH m AS ({_map_sql("orders", "o_totalprice")})
SELECT 'buyers' AS table_name, 'amount' AS columns, c_acctbal AS amount FROM customer
UNION ALL SELECT 'sales', 'name amount', CAST(m.encoded_value AS DOUBLE) FROM orders o
  LEFT JOIN m ON m.original_value = CAST(o.o_totalprice AS VARCHAR)""",
    ),
    "apply_plan_with_found_words": (
        apply_plan_with_found_words,
        f"""WITH words AS (SELECT list(token ORDER BY length(token) DESC, token) AS listed
  FROM ({tokens_sql("documents")}) WHERE regexp_matches(token, {quote(PHONE_TOKEN_SQL)}))
SELECT list_reduce(list_filter(listed, lambda w: contains(text, w)),
  lambda done, w: replace(done, w, 'XXXX'), text) AS text, lang, n_chars FROM documents, words""",
    ),
    "apply_plan_with_mask": (
        apply_plan_with_mask,
        f"""WITH a AS ({_map_sql("documents", "lang")})
SELECT doc_id, list_reduce(list_filter(['thatin', '555-', 'that'], lambda w: contains(text, w)),
    lambda done, w: replace(done, w, 'XXXX'), text) AS text, a.encoded_value AS lang, source
FROM documents d LEFT JOIN a ON a.original_value = d.lang""",
    ),
}
