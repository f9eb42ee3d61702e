"""Single values: filled or not, printed form, shapes, populations, hashes."""

import hashlib
import hmac
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe import fixed_values as fixed
from hushframe.functions import hashing, values
from hushframe.operators import freetext, profile

PHONES = "|".join(fixed.PHONE_SHAPES)


def texts(spark, items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "i int, t string")


def flags(spark, items, expression):
    rows = texts(spark, items).select("i", expression.alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_counts_of_fixed_values():
    assert len(fixed.SURVEY_SYSTEM_STRICT) == 23
    assert (len(fixed.LOCATION_STRICT), len(fixed.LOCATION_FUZZY)) == (2, 27)
    assert len(fixed.ABBREVIATION_STRICT) == 23
    assert (len(fixed.GUIDELINE_STRICT), len(set(fixed.GUIDELINE_STRICT))) == (34, 31)
    assert (len(fixed.GUIDELINE_FUZZY), len(fixed.SPANISH_FUZZY)) == (35, 34)
    assert len(fixed.SWAHILI_STRICT) == 15
    assert len(fixed.COUNTRY_ISO) == 21
    assert sorted(fixed.COLUMN_MISSING_CODES) == sorted(str(111 * i) for i in range(-9, 10) if i)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("tel 555-1234", True),
        ("x\n555-1234", False),
        ("555\n1234", True),
        ("١٢٣٤٥٦٧", True),
        ("(763) 555-6869", True),
        ("123456", False),
        ("1.2E7", False),
        ("12000000.0", True),
        ("900.1", False),
        ("900.100000", True),
        ("555\x1f1234", True),
        ("a 555-1234", True),
    ],
)
def test_phone_value(spark, text, expected):
    assert bool(re.match(f".*(?:{PHONES}).*", text)) is expected
    shape = F.expr(values.is_phone_value_sql("t"))
    assert flags(spark, [text], shape) == [expected]


def test_phone_token_is_anchored(spark):
    items = ["555-1234", "x555-1234", "5551234567", "(763)555-6869", "55-1234"]
    expected = [bool(re.match(PHONES, t)) for t in items]
    assert flags(spark, items, values.is_phone_token(F.col("t"))) == expected == [True, False, True, True, False]


def test_date_value(spark):
    yes = ["31/12/2020", "12/31/2020", "2020.12.31", "2020-12-31 10:00:00", "31-12.2020x"]
    no = ["on 2020-12-31", "1/2/2020", "31/13/2020", "3020-01-01", "2020-1-1", "12/31/20"]
    shape = F.expr(values.is_date_value_sql("t"))
    assert flags(spark, yes + no, shape) == [True] * len(yes) + [False] * len(no)


def test_numbers_print_as_in_a_flat_file(spark):
    numbers = [900.1, 12000000.0, 12345678.9, 1e15, 0.0001234567, 0.5, -98765432.1, 1e6, 100000.0, -0.00025]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n double")
    printed = [r.x for r in df.select("i", values.as_text(df.schema["n"]).alias("x")).orderBy("i").collect()]
    assert printed == [repr(n) for n in numbers]


def test_clean_values(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("", 2.0), (None, float("nan")), ("-999", None), ("777", -999.0), ("NA", 3.0)],
        "s string, n double",
    )
    assert [r.s for r in profile.clean_values(df, "s").collect()] == ["a", "NA"]
    # the codes are text: they never remove a number, while NaN counts as missing
    assert [r.n for r in profile.clean_values(df, "n").collect()] == [1.0, 2.0, -999.0, 3.0]
    kept = profile.clean_values(df, "s", fixed.TEXT_MISSING_CODES).collect()
    assert [r.s for r in kept] == ["a", "-999", "NA"]


def test_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2)], ["a.b", "c`d"])
    rows = profile.sparsity_profile({"t": df}).collect()
    assert {(r.column_name, r.n_values, r.n_distinct) for r in rows} == {("a.b", 2, 2), ("c`d", 2, 2)}


@pytest.mark.parametrize(
    ("text", "expected", "strict"),
    [
        ("3,685\n2010", 3685, 3685),
        ("91,411 (2018)", 91411, 91411),
        ("14,810,001", 14810001, 14810001),
        ("17 million people", 17000000, 17000000),
        ("1.655 million (2010)", 1655000, 1655000),
        ("17 million", 17, 17000000),
        ("3 thousand people", 3, 3),
        ("12.5", None, None),
        ("12.5 x", None, None),
        ("abc", None, None),
        ("", None, None),
        ("n/a x y", None, None),
        ("17d million x", None, None),
        ("17  million people", 17, 17),
    ],
)
def test_population_number(spark, text, expected, strict):
    one = texts(spark, [text]).select(
        values.population_number(F.col("t")).alias("a"),
        values.population_number(F.col("t"), strict_units=True).alias("b"),
    )
    assert tuple(one.first()) == (expected, strict)


def test_word_list(spark):
    assert flags(spark, ["Ana,  Juan Perez , ,(x*", "", " , "], values.word_list(F.col("t"))) == [
        ["Ana", "Juan Perez", "(x*"],
        [],
        [],
    ]


def test_known_hash(spark):
    got = flags(spark, ["héllo"], hashing.keyed_sha1(F.col("t"), "[SECRET KEY]"))
    assert got == ["4102262702ef175917f7b99b84e02d995347bbbb"]


@settings(max_examples=8, deadline=None)
@given(st.text(min_size=1, max_size=90), st.lists(st.text(max_size=30), min_size=1, max_size=10))
def test_hashes_equal_the_standard_library(spark, key, items):
    items = [t for t in items if not any("\ud800" <= ch <= "\udfff" for ch in t)] or ["x"]
    if any("\ud800" <= ch <= "\udfff" for ch in key):
        key = "k"
    got = flags(spark, items, hashing.keyed_sha1(F.col("t"), key))
    assert got == [hmac.new(key.encode(), t.encode(), hashlib.sha1).hexdigest() for t in items]
    plain = flags(spark, items, hashing.plain_sha1(F.col("t")))
    assert plain == [hashlib.sha1(t.encode()).hexdigest() for t in items]


def test_tokens_split_at_single_spaces(spark):
    df = spark.createDataFrame(
        [("Ana  likes,\tthis", "777"), ("999", "whole-row"), (None, ""), ("ab abc", None)], "a string, b string"
    )
    found = {r.token for r in freetext.tokens(df, ["a", "b"]).collect()}
    assert found == {"Ana", "likes,\tthis", "whole-row", "abc"}
