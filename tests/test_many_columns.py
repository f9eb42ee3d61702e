"""Encoding many columns at once, masking behind a filter, stored sketches, thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from hushframe import session, sinks
from hushframe.operators import encode, filters, mask, profile, sketches
from hushframe.plans import detect
from hushframe.session import settle
from hushframe.sources.tables import Survey

KEY = "secret"


def wide(spark, n=4000):
    """Hot values, nulls, rows that repeat, numbers, and a column whose values are all hot."""
    return spark.range(n).selectExpr(
        "id",
        "case id % 3 when 0 then 'hot' when 2 then concat('v', id div 4) end as v",
        "if(id % 5 = 0, null, concat('w:', id % 1777)) as w",
        "cast(id % 1500 as double) / 7 as x",
        "concat(repeat('long ', 20), id % 1900) as y",
        "id % 2 = 0 as z",
    ).repartition(5)


def encoded(df, columns, mapping, **more):
    return sorted(map(tuple, encode.encode(df, columns, mapping, **more).collect()))


@pytest.mark.parametrize("by_hash", [False, True])
def test_many_columns_together_equal_one_by_one(spark, monkeypatch, by_hash):
    df, columns, shown = wide(spark), ["v", "w", "x", "y", "z"], {"x": "%.3f"}
    made = (encode.code_map if by_hash else encode.encoding_map)(df, columns, KEY, shown)
    mapping, more = settle(made), {"number_formats": shown, "secret_key": KEY}
    together = encoded(df, columns, mapping, broadcast=False, **more)
    assert together == encoded(df, columns, mapping, **more)
    one = df
    for c in columns:
        one = encode.encode(one, [c], mapping, broadcast=False, **more)
    assert together == sorted(map(tuple, one.collect()))
    monkeypatch.setattr(session, "_BROADCAST_ROWS", 1600)  # two of them fit, three don't
    assert together == encoded(df, columns, mapping, **more)


def test_many_large_maps_shuffle_the_table_once(spark):
    df = wide(spark).withColumn("payload", F.lit("kept"))
    mapping = settle(encode.code_map(df, ["v", "w", "x", "y"], KEY))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = encode.encode(df, ["v", "w", "x", "y"], mapping, secret_key=KEY, broadcast=False)
        plan = found._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    by_tuple = [x for x in plan.splitlines() if "Exchange hashpartitioning(__own" in x]
    assert len(by_tuple) == 1 and plan.count("RoundRobinPartitioning") <= 2  # the rest moves cells, or is the table's own
    assert sum(sizes) == 4000 and max(sizes) < 4000 / 3


def test_a_lost_value_of_many_columns_is_an_error(spark):
    df = wide(spark, 50)
    mapping = settle(encode.encoding_map(df.where("id <> 8"), ["v", "w"], KEY))
    with pytest.raises(Exception, match="has no code"):
        encode.encode(df, ["v", "w"], mapping, broadcast=False).collect()
    empty = df.where("false")
    assert encode.encode(empty, ["v", "w"], settle(encode.encoding_map(empty, ["v", "w"], KEY)), broadcast=False).count() == 0


def test_filter_never_turns_a_key_away(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as key")
    bits = filters.bits_for(5000)
    built = filters.build(keys, "key", bits)
    assert keys.where(filters.may_hold(built, F.col("key"), bits)).count() == 5000
    others = spark.range(20000).selectExpr("concat('o', id) as key").where(filters.may_hold(built, F.col("key"), bits)).count()
    assert others < 20000 * 0.03
    none = filters.build(keys.where("false"), "key", filters.bits_for(0))
    assert keys.where(filters.may_hold(none, F.col("key"), 1024)).count() == 0
    assert filters.bits_for(10**12) == 2**28


def test_masking_reads_the_texts_once_before_the_last_join(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i} of Ana") for i in range(50)], "id int, text string").write.parquet(str(tmp_path / "t"))
    words = spark.createDataFrame([("Ana",), ("text 7",)], "word string")
    masked = mask.mask_found_words(spark.read.parquet(str(tmp_path / "t")), ["text"], words)
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # once to find the words, once to replace them
    got = {r.id: r.text for r in masked.collect()}
    assert got[7] == "XXXX of XXXX" and got[8] == "text 8 of XXXX"


def test_masking_with_a_hot_text_and_phrases(spark):
    draw = random.Random(4)
    vocabulary = ["Ana", "Anna", "de", "la", "x\ny", "é", "ab", "abc", "abcd", "abcde", "(", "of the", "the end", "d e"]
    texts = ["of the end" for _ in range(200)] + [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 9))) for _ in range(200)] + [None, ""]
    words = ["Ana", "bcd", "é", "the end", "x\ny", "of the", "la de", "", "  ", "(", "nowhere", "e"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.text for r in mask.mask_found_words(df, ["text"], spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    listed = sorted({w for w in words if w.strip()}, key=lambda w: (-len(w), w))
    for i, text in enumerate(texts):
        expected = text
        for w in [w for w in listed if text and w in text]:
            expected = expected.replace(w, "XXXX")
        assert got[i] == expected


def many_types(spark, start, end):
    return spark.range(start, end).selectExpr(
        "id", "cast(id % 50 as string) as some", "cast(if(id % 2 = 0, 0.0, -0.0) as double) as zero", "cast(id as double) / 3 as real",
        "date_add(date'2020-01-01', cast(id % 900 as int)) as day", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, id % 700) as moment",
        "id % 2 = 1 as odd", "cast(null as string) as none", "repeat(cast(id % 300 as string), 40) as long", "cast(id % 40 as decimal(10,2)) as amount",
    )


def test_sketches_of_parts_merge_to_the_profile(spark, tmp_path):
    parts = [(0, 400), (400, 1000), (900, 1300)]  # overlapping values
    for i, (a, b) in [*enumerate(parts), (1, parts[1])]:
        stored = sinks.write_sketches(sketches.column_sketches({"t": many_types(spark, a, b)}, part=f"p{i}"), str(tmp_path / "s"))
    assert stored.count() == 3 * 10
    whole = many_types(spark, 0, 400).unionAll(many_types(spark, 400, 1000)).unionAll(many_types(spark, 900, 1300))
    exact = {r.column_name: r for r in profile.sparsity_profile({"t": whole}).collect()}
    found = sketches.merged(stored).collect()
    assert len(found) == 10
    for r in found:
        known = exact[r.column_name]
        assert (r.n_values, r.is_text) == (known.n_values, known.is_text)
        assert abs(r.n_distinct - known.n_distinct) <= 0.03 * known.n_distinct
    seen = profile.sparsity_profile({"t": whole}, mode="approx", sketches=sketches.merged(stored).where("column_name <> 'day'"))
    assert {r.column_name: r.n_distinct for r in seen.collect()}.keys() == exact.keys()


def test_only_columns_near_the_threshold_are_scanned(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 310 as near", "id % 3 as few").write.parquet(str(tmp_path / "t"))
    data = spark.read.parquet(str(tmp_path / "t"))
    rows = settle(sketches.column_sketches({"t": data}))
    found = detect.by_sparsity([Survey("t", data)], mode="approx", sketches=sketches.merged(rows))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<near:bigint>" in plan and plan.count("FileScan parquet") == 1
    assert sorted(r.column_name for r in found.collect()) == ["id", "near"]


@pytest.mark.parametrize(("distinct", "threshold"), [(505, 0.5), (500, 0.5), (905, 0.9), (49, 0.05), (51, 0.05)])
def test_a_threshold_of_the_caller_is_decided_exactly(spark, distinct, threshold):
    data = spark.range(1000).selectExpr(f"cast(id % {distinct} as string) as c", "id")
    exact = detect.by_sparsity([Survey("t", data)], threshold=threshold).collect()
    assert sorted(detect.by_sparsity([Survey("t", data)], threshold=threshold, mode="approx").collect()) == sorted(exact)
    assert ("c" in {r.column_name for r in exact}) == (distinct > 1000 * threshold)
