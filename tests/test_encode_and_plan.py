"""Encoding, plans, writers and the registered queries."""

import hashlib
import hmac
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import check_queries
from __spark_entry__ import entry, oracle_sql, queries
from hushframe import session, sinks
from hushframe.operators import encode
from hushframe.plans import actions, detect
from hushframe.session import settle
from hushframe.sources import tables
from workload import ORACLES, QUERIES
from workload.shared import SCHEMA

KEY = "[SECRET KEY]"


def expected_codes(values, key=KEY):
    ordered = sorted(
        {v for v in values if v is not None},
        key=lambda v: hmac.new(key.encode(), v.encode(), hashlib.sha1).hexdigest(),
    )
    return {v: i + 1 for i, v in enumerate(ordered)}


def skewed(spark, n=6000):
    """A third of the rows hold one value, a third null, the rest many values."""
    return spark.range(n).selectExpr(
        "id",
        "case id % 3 when 0 then 'hot' when 2 then concat('v', id) end as v",
        "id % 5 as small",
        "'kept' as other",
    )


@pytest.mark.parametrize(("partitions", "rows_to_broadcast"), [(1, 500000), (16, 500000), (1, 0), (16, 0)])
def test_encode_is_a_bijection_onto_1_to_n(spark, monkeypatch, partitions, rows_to_broadcast):
    monkeypatch.setattr(session, "_BROADCAST_ROWS", rows_to_broadcast)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = skewed(spark).repartition(7)
        mapping = settle(encode.encoding_map(df, ["v", "small"], KEY))
        data = {r.id: r.v for r in df.collect()}
        codes = expected_codes(data.values())
        stored = {r.original_value: r.encoded_value for r in mapping.where("variable = 'v'").collect()}
        assert stored == codes
        assert {r.original_value for r in mapping.where("variable = 'v' and is_hot").collect()} == {"hot"}
        encoded = encode.encode(df, ["v", "small"], mapping)
        assert encoded.columns == df.columns
        rows = encoded.collect()
        assert {r.id: r.v for r in rows} == {i: codes.get(v) for i, v in data.items()}
        small = expected_codes([str(i) for i in range(5)])
        assert all(r.small == small[str(r.id % 5)] and r.other == "kept" for r in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_small_maps_do_not_shuffle_the_table(spark):
    df = skewed(spark)
    encoded = encode.encode(df, ["v"], settle(encode.encoding_map(df, ["v"], KEY)))
    assert "Exchange hashpartitioning" not in encoded._jdf.queryExecution().executedPlan().toString()


def test_hot_rows_are_spread_over_the_shuffle(spark, monkeypatch):
    """With broadcasting of the large map switched off, no task gets the hot value or the nulls."""
    monkeypatch.setattr(session, "_BROADCAST_ROWS", 0)
    df = skewed(spark, 30000).repartition(64)
    mapping = settle(encode.encoding_map(df, ["v"], KEY))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        encoded = encode.encode(df, ["v"], mapping)
        sizes = [r["count"] for r in encoded.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and sum(sizes) == 30000 and max(sizes) < 30000 / 4


def test_decode_before_encode_and_strip(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, None)], "id int, code int")
    labels = spark.createDataFrame(
        [("code", 10, "ten"), ("code", 20, "twenty"), ("other", 10, "x")],
        "column_name string, code bigint, label string",
    )
    decoded = encode.decode_value_labels(df, ["code"], labels)
    assert {r.id: r.code for r in decoded.collect()} == {1: "ten", 2: "twenty", 3: None, 4: None}
    assert encode.strip_value_labels(labels, ["code"]).collect() == [("other", 10, "x")]


def test_values_are_hashed_once_and_grouped_once(spark):
    """The hash is above the grouping, and the ranking and the range counts share one shuffle."""
    mapping = encode.encoding_map(spark.range(100).selectExpr("cast(id as string) as v"), ["v"], KEY)
    mapping.collect()
    plan = mapping._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and "Filter isnotnull(substring" not in plan


@pytest.mark.parametrize("digits", [1, 4])
def test_ranges_of_any_length_rank_alike(spark, digits):
    df = spark.range(500).selectExpr("concat('v', id % 333) as v")
    mapping = encode.encoding_map(df, ["v"], KEY, range_digits=digits)
    codes = {r.original_value: r.encoded_value for r in mapping.collect()}
    assert codes == expected_codes([f"v{i}" for i in range(333)])


def test_values_without_a_code_are_an_error(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "v string, w string").withMetadata("v", {"label": "Name"})
    mapping = settle(encode.encoding_map(df.where("v = 'a'"), ["v"], KEY))
    with pytest.raises(Exception, match="has no code"):
        encode.encode(df, ["v"], mapping).collect()
    with pytest.raises(Exception, match="has no code"):
        encode.encode(df, ["w"], mapping).collect()  # no entry of the column at all
    with pytest.raises(ValueError, match="nope"):
        encode.encode(df, ["nope"], mapping)
    whole = encode.encode(df, ["v"], settle(encode.encoding_map(df, ["v"], KEY)))
    assert whole.schema["v"].metadata == {"label": "Name"} and whole.count() == 2


@pytest.mark.parametrize("rows_to_broadcast", [500000, 0])
def test_codes_by_hash_equal_codes_by_value(spark, monkeypatch, rows_to_broadcast):
    monkeypatch.setattr(session, "_BROADCAST_ROWS", rows_to_broadcast)
    df = skewed(spark, 2000)
    by_value = encode.encode(df, ["v"], settle(encode.encoding_map(df, ["v"], KEY)))
    hashed = settle(encode.code_map(df, ["v"], KEY))
    assert hashed.columns == ["variable", "hash", "encoded_value", "is_hot"]
    assert sorted(by_value.collect(), key=str) == sorted(encode.encode(df, ["v"], hashed, secret_key=KEY).collect(), key=str)
    with pytest.raises(ValueError, match="key"):
        encode.encode(df, ["v"], hashed)


def test_no_value_stays_in_the_shared_folder(spark):
    """Finding, encoding and masking leave no value in clear among the intermediate files."""
    from hushframe.operators import freetext

    secret = "Wilhelmina"
    df = spark.createDataFrame([(secret, f"ask {secret} or 555-1234")], "v string, t string")
    names = spark.createDataFrame([(secret, "forename", 900, ["xx"])], "name string, name_type string, incidence long, jurisdictions array<string>")
    towns = spark.createDataFrame([], "name string, country_iso string, population long")
    words = freetext.personal_tokens(df, ["t"], None, names, towns).withColumnRenamed("token", "word")
    codes = settle(encode.code_map(df, ["v"], KEY))
    result = actions.deidentify(df, {"v": "Encode"}, codes, ["t"], words, secret_key=KEY).collect()
    assert [tuple(r) for r in result] == [(1, "ask XXXX or XXXX")]
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    for path in Path(folder).rglob("*"):
        assert not path.is_file() or secret.encode() not in path.read_bytes(), path


def test_long_hot_texts_are_encoded(spark):
    long = "copy " * 5000
    df = spark.range(3000).selectExpr("id", f"case when id % 3 = 0 then '{long}' else concat('{long}', id) end as t")
    encoded = encode.encode(df, ["t"], settle(encode.encoding_map(df, ["t"], KEY)))
    rows = {r.id: r.t for r in encoded.collect()}
    assert len({rows[i] for i in range(0, 3000, 3)}) == 1 and len(set(rows.values())) == 2001


def test_drop_checks_names(spark):
    with pytest.raises(ValueError, match="nope"):
        actions.drop_columns(spark.range(1), ["nope"])


def test_plan_defaults_to_drop(spark):
    findings = spark.createDataFrame([("a",), ("b",), ("c",)], "column_name string")
    overrides = spark.createDataFrame([("b", "Encode"), ("c", "Keep"), ("d", "Drop")], "column_name string, action string")
    plan = actions.action_plan(findings, overrides)
    assert actions.chosen_actions(plan) == {"a": "Drop", "b": "Encode", "c": "Keep"}
    assert {r.line for r in actions.plan_report(plan).collect()} == {"Columns to drop: a", "Columns to encode: b"}
    wrong = spark.createDataFrame([("a", "Erase")], "column_name string, action string")
    with pytest.raises(ValueError, match="Erase"):
        actions.chosen_actions(actions.action_plan(findings, wrong))


def test_plans_of_several_tables(spark):
    findings = spark.createDataFrame([("a", "text", "r1"), ("b", "text", "r2")], "table_name string, column_name string, reason string")
    overrides = spark.createDataFrame([("b", "text", "Keep")], "table_name string, column_name string, action string")
    plan = actions.action_plan(findings, overrides)
    assert actions.chosen_actions(plan, "a") == {"text": "Drop"} and actions.chosen_actions(plan, "b") == {"text": "Keep"}
    with pytest.raises(ValueError, match="a, b"):
        actions.chosen_actions(plan)
    double = spark.createDataFrame([("text", "Keep"), ("text", "Drop")], "column_name string, action string")
    with pytest.raises(ValueError, match="text"):
        actions.action_plan(findings, double)


def test_report_and_log_name_their_tables(spark, tmp_path):
    findings = spark.createDataFrame([("a", "text", "r"), ("b", "text", "r")], "table_name string, column_name string, reason string")
    sinks.write_plan_report(actions.action_plan(findings), str(tmp_path / "report"))
    assert {r[0] for r in spark.read.text(str(tmp_path / "report")).collect()} == {"a: Columns to drop: text", "b: Columns to drop: text"}
    applied = actions.apply_messages({"text": "Drop", "id": "Encode"}, "a", "/protected/map", ["note"], ["Ana", "Bo", ""])
    sinks.append_log(findings, str(tmp_path / "log"), applied)
    assert {r[0] for r in spark.read.text(str(tmp_path / "log")).collect()} == {
        "a: Column 'text' considered possible pii: r", "b: Column 'text' considered possible pii: r",
        "a: Dropped columns: text", "a: Encoded columns: id", "a: Encoding map written to /protected/map", "a: 2 words masked in: note",
    }


def test_maps_stay_out_of_the_output(spark):
    mapping = spark.createDataFrame([], "variable string, original_value string, encoded_value long")
    for path in ("/out/m", "/out/../out/m", "file:///out/./m"):
        with pytest.raises(ValueError, match="inside"):
            sinks.write_encoding_map(mapping, path, "/out")
        with pytest.raises(ValueError, match="inside"):
            sinks.export_encoding_map(mapping, path, "/out/")


def test_labels_are_written_beside_the_table(spark, tmp_path):
    labels = spark.createDataFrame([("a", "Second"), ("a", "First")], "column_name string, label string")
    df = tables.attach_labels(spark.createDataFrame([("x", 1)], "a string, b long"), labels)
    encoded = encode.encode(df, ["a"], settle(encode.encoding_map(df, ["a"], KEY)))
    path = sinks.write_deidentified(encoded, "/in/t.parquet", str(tmp_path))
    assert [tuple(r) for r in tables.read_labels(spark, f"{path}_labels", "csv").collect()] == [("a", "First / Second")]


def test_csv_is_parsed_once_into_a_folder(spark, tmp_path):
    write_csv(tmp_path / "s.csv")
    plain = tables.read_table(spark, str(tmp_path / "s.csv"))
    stored = tables.read_table(spark, str(tmp_path / "s.csv"), stored=str(tmp_path / "stored"))
    assert stored.schema == plain.schema and sorted(stored.collect(), key=str) == sorted(plain.collect(), key=str)
    assert all(f.endswith(".parquet") for f in stored.inputFiles())


def write_csv(path):
    path.write_text(
        "id,name,age,score,note,when,empty\n"
        '1,Ana,30,1.5,"likes, commas",2020-01-02,\n'
        "2,N/A,NA,2,null,2020-01-03,NaN\n"
        '3,"Bo ""B""",31,,n/a,2020-01-04,\n',
        encoding="utf-8",
    )


def test_csv_reader_types_and_nulls(spark, tmp_path):
    write_csv(tmp_path / "s.csv")
    df = tables.read_table(spark, str(tmp_path / "s.csv"))
    assert dict(df.dtypes) == {
        "id": "bigint", "name": "string", "age": "bigint", "score": "double", "note": "string",
        "when": "string", "empty": "string",
    }
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "Ana", 30, 1.5, "likes, commas", "2020-01-02", None),
        (2, None, None, 2.0, None, "2020-01-03", None),
        (3, 'Bo "B"', 31, None, None, "2020-01-04", None),
    ]
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_table(spark, "x.sav")


def test_whole_run_from_csv_to_csv(spark, tmp_path):
    write_csv(tmp_path / "s.csv")
    (tmp_path / "labels.csv").write_text("variable,label\nscore,Your address\nnote,Remark\n", encoding="utf-8")
    (tmp_path / "codes.csv").write_text("variable,code,label\nage,30,thirty\n", encoding="utf-8")
    survey = tables.read_survey(
        spark, str(tmp_path / "s.csv"), str(tmp_path / "labels.csv"), str(tmp_path / "codes.csv"), ("id",)
    )
    assert survey.name == "s" and survey.value_labels.first() == ("age", 30, "thirty")
    findings = detect.cascade([survey])
    chosen = actions.chosen_actions(actions.action_plan(findings))
    assert chosen == {c: "Drop" for c in ("id", "name", "age", "when", "score", "note")}
    chosen |= {"name": "Encode", "note": "Keep", "id": "Keep", "score": "Keep"}
    out = str(tmp_path / "out")
    mapping = encode.encoding_map(survey.data, ["name"], "secret")
    with pytest.raises(ValueError, match="inside"):
        sinks.write_encoding_map(mapping, out + "/map", out)
    stored = sinks.write_encoding_map(mapping, str(tmp_path / "protected"), out)
    result = actions.deidentify(survey.data, chosen, stored, text_columns=["note"], words=["commas"])
    for _ in range(2):  # a second run replaces the first
        path = sinks.write_deidentified(result, str(tmp_path / "s.csv"), out)
    assert path == out + "/s_deidentified.csv"
    codes = expected_codes(["Ana", 'Bo "B"'], "secret")
    back = tables.read_table(spark, path)
    assert [tuple(r) for r in back.orderBy("id").collect()] == [
        (1, codes["Ana"], 1.5, "likes, XXXX", None),
        (2, None, 2.0, None, None),
        (3, codes['Bo "B"'], None, None, None),
    ]
    sinks.export_encoding_map(stored, str(tmp_path / "map.csv"), out)
    exported = spark.read.csv(str(tmp_path / "map.csv"), header=True, escape='"')
    assert exported.columns == ["variable", "original_value", "encoded_value"]
    assert {r.original_value: int(r.encoded_value) for r in exported.collect()} == codes
    sinks.append_log(findings, str(tmp_path / "log"))
    sinks.append_log(findings, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2 * findings.count()
    sinks.write_plan_report(actions.action_plan(findings), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first()[0] == "s: Columns to drop: age id name note score when"


@pytest.mark.parametrize("file_format", ["parquet", "json", "orc"])
def test_other_formats_round_trip(spark, tmp_path, file_format):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, v string")
    path = sinks.write_deidentified(df, f"/in/data.{file_format}", str(tmp_path))
    assert path.endswith(f"data_deidentified.{file_format}")
    assert {tuple(r) for r in tables.read_table(spark, path).collect()} == {(1, "a"), (2, None)}


def test_labels_in_schema(spark):
    df = spark.createDataFrame([(1, 2)], ["a", "b"])
    labels = spark.createDataFrame([("a", "First"), ("z", "None")], "column_name string, label string")
    assert tables.labels_in_schema(tables.attach_labels(df, labels).schema) == {"a": "First"}


def test_stateless_steps_run_on_a_stream(spark, tmp_path):
    from hushframe.functions.hashing import keyed_sha1

    spark.range(20).selectExpr("id", "concat('Ana ', id) as t", "'x' as secret").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, t string, secret string").parquet(str(tmp_path / "in"))
    masked = actions.deidentify(stream, {"secret": "Drop"}, text_columns=["t"], words=["Ana"])
    hashed = masked.withColumn("id", keyed_sha1(F.col("id").cast("string"), KEY))
    query = (
        hashed.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 20 and all(r.t.startswith("XXXX ") and len(r.id) == 40 for r in rows)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for name in SCHEMA:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    return connection


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_its_sql(spark, connection, key):
    outcome = check_queries.compare(spark, connection, key, "/root/testdata/sf0.001")
    assert outcome.startswith("ok"), outcome
