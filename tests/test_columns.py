"""Matching, profiling and the detectors, on small tables with known answers."""

import datetime as dt

import pytest

from hushframe.operators import catalog, evaluate, formats, profile
from hushframe.plans import detect
from hushframe.session import rows_frame
from hushframe.sources import words
from hushframe.sources.tables import Survey


def dictionary(spark, with_locations=True):
    return words.effective_dictionary(words.word_groups(spark), with_locations)


def columns(spark, *names):
    rows = [("t", n, True, True, i) for i, n in enumerate(names)]
    return rows_frame(spark, rows, catalog.CATALOG_SCHEMA)


def test_dictionary_sizes_and_precedence(spark):
    with_ = {r.word: r.match_kind for r in dictionary(spark).collect()}
    without = {r.word: r.match_kind for r in dictionary(spark, False).collect()}
    assert len(with_) == 161 and len(without) == 68 + 67 - 2
    assert with_["name"] == with_["random"] == with_["parish"] == "fuzzy"
    assert without["parish"] == "strict" and "village" not in without


def hits(spark, cols, labels=None):
    found = catalog.match_words(cols, dictionary(spark), labels).collect()
    return {(r.column_name, r.word, r.matched_on) for r in found}


def test_strict_and_fuzzy_match(spark):
    found = hits(spark, columns(spark, "ID", "my_id", "VillageCode", "x_NAME", "agenda"))
    assert ("ID", "id", "name") in found and not [h for h in found if h[0] in ("my_id", "agenda")]
    assert {h[1] for h in found if h[0] == "VillageCode"} == {"village", "villa"}
    assert {h[1] for h in found if h[0] == "x_NAME"} == {"name", "_name"}


def test_label_match(spark):
    labels = spark.createDataFrame(
        [("q1", "Name of the enumerator and more"), ("q2", ""), ("q3", "AGE"), ("q4", "the enumerator")],
        "column_name string, label string",
    )
    found = hits(spark, columns(spark, "q1", "q2", "q3", "q4", "q5"), labels)
    assert found == {
        ("q1", "name", "label"),
        ("q1", "enumerator ", "label"),  # the word ends in a space
        ("q3", "age", "label"),
    }


def test_match_agrees_with_plain_containment(spark):
    names = ["alcaldía", "tarahe ya kuzaliwa", "survey_location_name", "", "a", "numero_pais_email", "İname"]
    entries = [(r.word, r.match_kind) for r in dictionary(spark).collect()]
    expected = {
        (n, w, "name")
        for n in names
        for w, kind in entries
        if n and ((kind == "strict" and n.lower() == w) or (kind == "fuzzy" and w in n.lower()))
    }
    assert hits(spark, columns(spark, *names)) == expected


def test_system_columns(spark):
    cols, system = columns(spark, "key", "KEY", "keys", "caseid"), words.system_columns(spark)
    left = {r.column_name for r in catalog.exclude_system_columns(cols, system).collect()}
    flagged = {r.column_name for r in catalog.flag_system_columns(cols, system).collect()}
    assert left == {"KEY", "keys"} and flagged == {"key", "KEY", "caseid"}


def typed(spark):
    moment = dt.datetime(1969, 12, 31, 23, 59, 59, 500000)
    rows = [
        (1, 0.0, "a", moment, True, b"x", [1]),
        (1, -0.0, "", dt.datetime(1970, 1, 1, 0, 0, 0, 500000), True, b"x", [2]),
        (2, float("nan"), None, moment, None, None, None),
        (3, 1.5, "777", None, False, b"y" * 50, None),
        (None, None, "b" * 40, None, None, b"y" * 50, None),
    ]
    return spark.createDataFrame(
        rows, "i int, d double, s string, t timestamp_ntz, b boolean, r binary, nested array<int>"
    )


EXPECTED = {"i": (4, 3), "d": (3, 2), "s": (2, 2), "t": (3, 2), "b": (3, 2), "r": (4, 2)}


@pytest.mark.parametrize("mode", ["exact", "approx"])
def test_profile_of_all_types(spark, mode):
    seen = profile.sparsity_profile({"t": typed(spark)}, mode=mode).collect()
    assert {r.column_name: (r.n_values, r.n_distinct) for r in seen} == EXPECTED
    assert {r.column_name for r in seen if r.is_text} == {"s"}


def test_empty_columns_are_not_sparse(spark):
    df = spark.createDataFrame([(None, "")], "a string, b string")
    seen = profile.sparsity_profile({"t": df})
    assert {(r.n_values, r.n_distinct, r.ratio) for r in seen.collect()} == {(0, 0, None)}
    assert profile.sparse(seen).count() == 0


def test_long_equal_and_different_texts_count_exactly(spark):
    long = ["x" * 5000 + str(i % 7) for i in range(100)] + ["y" * 31, "y" * 32, "y" * 33]
    df = spark.createDataFrame([(t,) for t in long], "s string")
    assert profile.sparsity_profile({"t": df}).first()["n_distinct"] == 10


def test_approximate_mode_decides_as_exact_mode(spark):
    df = spark.range(20000).selectExpr(
        "id as unique", "id % 100 as few", "id % 4000 as fifth", "cast(id % 6100 as string) as third"
    )
    for threshold in (0.2, 0.3):
        exact = profile.sparse(profile.sparsity_profile({"t": df}), threshold)
        approx = profile.sparse(profile.sparsity_profile({"t": df}, mode="approx"), threshold)
        assert {r.column_name for r in exact.collect()} == {r.column_name for r in approx.collect()}


def test_value_labels_more_than_ten(spark):
    rows = [("ten", i, str(i)) for i in range(10)] + [("eleven", i, str(i)) for i in range(11)]
    labels = spark.createDataFrame(rows, "column_name string, code bigint, label string")
    assert [r.column_name for r in profile.many_value_labels(labels).collect()] == ["eleven"]


def sampled(spark, n_rows=1000):
    """`late` has values only far down, `rare` fewer than ten, `none` none."""
    return spark.range(n_rows).selectExpr(
        "id as k",
        "concat('v', id) as early",
        "case when id >= 900 then concat('w', id) when id = 3 then '' end as late",
        "case when id % 300 = 0 then id end as rare",
        "cast(null as string) as none",
    )


@pytest.mark.parametrize("n_rows", [5, 150, 1000])
def test_first_values(spark, n_rows):
    df = sampled(spark, n_rows).repartition(4)
    rows = formats.first_values(df, ("k",)).orderBy("column_name", "position").collect()
    got = {}
    for r in rows:
        got.setdefault(r.column_name, []).append((r.position, r.value))

    def first(items):
        return [(i + 1, v) for i, v in enumerate(items[:10])]

    expected = {
        "k": first([str(i) for i in range(n_rows)]),
        "early": first([f"v{i}" for i in range(n_rows)]),
        "rare": first([str(i) for i in range(0, n_rows, 300)]),
    }
    if n_rows > 900:
        expected["late"] = first([f"w{i}" for i in range(900, n_rows)])
    assert got == expected


def test_first_values_need_an_order(spark):
    with pytest.raises(ValueError, match="order"):
        formats.first_values(sampled(spark), ())


def test_first_values_with_null_keys(spark):
    df = spark.createDataFrame([(None, "a")] + [(i, f"b{i}") for i in range(300)], "k int, v string")
    rows = formats.first_values(df, ("k",), ["v"]).orderBy("position").collect()
    assert [r.value for r in rows] == ["a"] + [f"b{i}" for i in range(9)]


def test_shapes_of_the_first_ten_and_of_all(spark):
    df = spark.range(400).selectExpr(
        "id as k",
        "case when id = 11 then '555-1234' else 'x' end as eleventh",
        "case when id >= 390 then '31/12/2020 555-1234' end as late",
        "case when id = 9 then '555-1234' else 'x' end as tenth",
        "id + 999601 as number",
        "cast(id + 0.5 as decimal(20, 4)) as amount",
    )
    survey = Survey("t", df, order_by=("k",))
    reasons = {r.column_name: r.reason for r in detect.by_format([survey]).collect()}
    assert reasons == {
        "late": "Column entries have date format",
        "tenth": "Column entries have phone number format",
    }
    everywhere = {r.column_name: r.evidence for r in detect.by_format([survey], full_scan=True).collect()}
    assert everywhere == {
        "eleventh": "phone number",
        "late": "date",
        "tenth": "phone number",
        "number": "phone number",
        # three digits, the point, four decimals
        "amount": "phone number",
    }


def survey(spark):
    df = spark.range(40).selectExpr(
        "id",
        "concat('p', id) as respondent_name",
        "cast(id % 2 as string) as pet_name",
        "cast(id % 12 as int) as village",
        "cast(id % 3 as int) as county",
        "concat('a', id) as name",
        "concat('b', id % 2) as url",
        "concat('open ', id) as q1",
        "id % 2 as q2",
        "'x' as key",
    )
    labels = spark.createDataFrame(
        [("q1", "Name of your mother"), ("q2", "Age"), ("url", "E-Mail or email")],
        "column_name string, label string",
    )
    value_labels = spark.createDataFrame(
        [("village", i, f"v{i}") for i in range(12)] + [("county", i, f"c{i}") for i in range(3)],
        "column_name string, code bigint, label string",
    )
    return Survey("s", df, labels, value_labels, ("id",))


def test_detect_by_name_reasons(spark):
    reasons = {r.column_name: r.reason for r in detect.by_name([survey(spark)]).collect()}
    sparse, many = " and has sufficiently sparse strings", " and values labels are sparse"
    assert reasons == {
        "id": "Name had strict match with restricted word 'id'",
        "respondent_name": "Name had fuzzy match with restricted word '_name'" + sparse,
        "village": "Name had fuzzy match with restricted word 'villa'" + many,
        "name": "Name had fuzzy match with restricted word 'name'" + sparse,
        "url": "Name had strict match with restricted word 'url'",
        "q1": "Label had fuzzy match with restricted word 'mother'" + sparse,
        # a strict hit on the label is worded as a name hit; matched_on tells
        "q2": "Name had strict match with restricted word 'age'",
    }
    on = {r.column_name: r.matched_on for r in detect.by_name([survey(spark)]).collect()}
    assert on["q2"] == "label" and on["url"] == "name"


def test_name_needs_sparse_strings(spark):
    df = spark.range(100).selectExpr("cast(id % 3 as string) as name", "id as name2")
    assert detect.by_name([Survey("t", df)]).count() == 0


def test_cascade_finds_each_column_once(spark):
    found = detect.cascade([survey(spark)]).collect()
    names = [r.column_name for r in found]
    assert len(names) == len(set(names)) and "key" not in names
    assert {r.column_name: r.method for r in found}["id"] == "name"
    with_system = detect.cascade([survey(spark)], exclude_system=False).collect()
    assert "key" not in {r.column_name for r in with_system if r.method == "name"}


def test_wide_tables_run_in_batches(spark):
    wide = spark.range(50).selectExpr("id as k", *[f"concat('v', id * {i}) as c{i}" for i in range(130)])
    found = detect.cascade([Survey("wide", wide, order_by=("k",))]).collect()
    assert {r.column_name for r in found} == {"k"} | {f"c{i}" for i in range(1, 130)}
    assert [b for b in detect._batches({"a": ["x"] * 70, "b": ["y"] * 50})] == [
        {"a": ["x"] * 60},
        {"a": ["x"] * 10, "b": ["y"] * 50},
    ]


def test_evaluate_respects_case(spark):
    found = spark.createDataFrame([("a",), ("B",)], "column_name string")
    truth = spark.createDataFrame([("a",), ("b",)], "column_name string")
    got = {(r.column_name, r.outcome) for r in evaluate.evaluate(found, truth).collect()}
    assert got == {("B", "wrongly detected"), ("b", "not detected")}


def test_findings_view_shows_labels(spark):
    s = survey(spark)
    labels = {r.column_name: r.candidate for r in detect.findings_view(detect.by_name([s]), s.labels).collect()}
    assert labels["q1"] == "q1: Name of your mother" and labels["id"] == "id"


@pytest.mark.parametrize("partitions", [1, 13])
def test_findings_do_not_depend_on_partitions(spark, partitions):
    s = survey(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = {tuple(r) for r in detect.cascade([s]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        spread = Survey("s", s.data.repartition(partitions), s.labels, s.value_labels, s.order_by)
        assert {tuple(r) for r in detect.cascade([spread]).collect()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_system_columns_as_findings(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["KEY", "caseid", "age"])
    found = detect.by_system([Survey("t", df)]).collect()
    assert {(r.column_name, r.reason) for r in found} == {
        ("KEY", "SurveyCTO variable"),
        ("caseid", "SurveyCTO variable"),
    }


def test_columns_left_after_findings(spark):
    s = survey(spark)
    open_ = detect.searched_columns([s])
    left = detect.remaining_columns(open_, detect.by_name([s]))["s"]
    assert "key" not in open_["s"] and left == ["pet_name", "county"]


def test_early_rows_bound_reaches_the_scan(spark, tmp_path):
    """Only the row groups that can hold the first rows are read."""
    path = str(tmp_path / "t")
    data = spark.range(0, 200000, 1, 20).selectExpr("id as k", "concat('v', id) as v")
    data.write.parquet(path)
    early = formats.early_values(spark.read.parquet(path), ("k",))
    assert early.count() == 400
    plan = early._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(IsNull(k),LessThanOrEqual(k,ScalarSubquery" in plan


def test_all_labels_of_a_column_are_searched(spark):
    df = spark.createDataFrame([("a",)], "q1 string")
    labels = spark.createDataFrame([("q1", "zone"), ("q1", "Phone")], "column_name string, label string")
    words = spark.createDataFrame([("phone", "strict"), ("zone", "strict")], "word string, match_kind string")
    hits = catalog.match_words(catalog.column_catalog({"t": df}), words, labels).collect()
    assert {(r.word, r.matched_on) for r in hits} == {("phone", "label"), ("zone", "label")}


def test_plain_counts_equal_the_profile(spark):
    df = typed(spark)
    exact = {r.column_name: r.n_values for r in profile.sparsity_profile({"t": df}).collect()}
    assert {r.column_name: r.n_values for r in profile.value_counts({"t": df}).collect()} == exact


def test_sparse_columns_are_sampled_by_one_scan(spark, tmp_path):
    spark.range(5000).selectExpr("id", *[f"case when id % 100 = {k} then concat('v', id) end as c{k}" for k in range(6)]).write.parquet(str(tmp_path / "t"))
    found = formats.whole_table_values(spark.read.parquet(str(tmp_path / "t")), ("id",), [f"c{k}" for k in range(6)])
    rows = found.collect()
    assert {(r.column_name, r.position, r.value) for r in rows} == {(f"c{k}", p + 1, f"v{100 * p + k}") for k in range(6) for p in range(10)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") + plan.count("Scan parquet") <= 2 and "WindowGroupLimit" in plan
