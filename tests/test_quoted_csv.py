import random

import pytest

from hushframe.sources import quoted_csv, tables


def value(draw):
    if draw.random() < 0.3:
        return draw.choice(["", "a", "1", "NA", " sp ace ", '""', "é"])
    return '"' + "".join(draw.choice(["x", "\n", '""', ",", "é", "\r\n", "\n\n", " ", "y" * 10]) for _ in range(draw.randint(0, 12))) + '"'


def put(path, rows, end, last=True):
    path.write_bytes((end.join(rows) + (end if last else "")).encode())


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def choose(size):
        for n, x in zip(names, (size, "1")):
            spark.conf.set(n, x)

    yield choose
    for n, x in before.items():
        spark.conf.set(n, x)


@pytest.mark.parametrize(("end", "seed"), [("\n", 1), ("\r\n", 2)])
def test_equals_the_multi_line_reader(spark, tmp_path, small_splits, end, seed):
    draw = random.Random(seed)
    rows = ["id,a b,c,d`q"] + [",".join([str(i)] + [value(draw) for _ in range(3)]) for i in range(600)]
    rows.insert(200, '7777,"' + "long\n" * 2000 + '",b,c')  # over several splits
    rows.insert(50, "")
    rows += ['8888,"unfinished columns"', "9,1,2,3,4,5"]
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "f.csv", rows, end, last=seed == 1)
    put(tmp_path / "in" / "g.csv", rows[:5], end)
    path = str(tmp_path / "in")
    expected = spark.read.csv(path, header=True, multiLine=True, escape='"')
    plain = sorted(map(str, expected.collect()))
    for size in ("128m", "4k", "900"):
        small_splits(size)
        got = quoted_csv.read(spark, path)
        assert got.columns == expected.columns and sorted(map(str, got.collect())) == plain
    assert quoted_csv._lines(spark, path).rdd.getNumPartitions() > 8


def test_quote_states_of_splits(spark):
    lines = [("f", 0, 'a,"b'), ("f", 0, 'c",d'), ("f", 10, '"open'), ("f", 20, "inside"), ("f", 20, 'two "" quotes'), ("f", 30, 'close"'), ("f", 30, 'x,"again'), ("f", 40, '"')]
    frame = spark.createDataFrame(lines, "file string, block bigint, record string").coalesce(1)
    states = {r["block"]: (r["inside"], r["began"]) for r in quoted_csv._states(frame).collect()}
    assert states == {0: (False, None), 10: (False, None), 20: (True, 10), 30: (True, 10), 40: (True, 30)}


def test_wrong_quotes_are_an_error(spark, tmp_path):
    put(tmp_path / "f.csv", ["a,b", '5" pipe,x', "1,2"], "\n")
    with pytest.raises(Exception, match="not quoted"):
        quoted_csv.read(spark, str(tmp_path / "f.csv")).collect()
    put(tmp_path / "g.csv", ["a,b", '"x" y,x'], "\n")
    with pytest.raises(Exception, match="not quoted"):
        quoted_csv.read(spark, str(tmp_path / "g.csv")).collect()


def test_empty_and_header_only(spark, tmp_path):
    put(tmp_path / "f.csv", ["a,b"], "\n")
    got = quoted_csv.read(spark, str(tmp_path / "f.csv"))
    assert got.columns == ["a", "b"] and got.count() == 0
    put(tmp_path / "g.csv", ["", '"a\nx",b', "1,", ',""'], "\n")
    got = quoted_csv.read(spark, str(tmp_path / "g.csv"))
    assert got.columns == ["a\nx", "b"] and sorted(map(tuple, got.collect()), key=str) == [("1", None), (None, None)]


def test_survey_of_split_files(spark, tmp_path):
    put(tmp_path / "s.csv", ["id,note", '1,"two\nlines"', "2,NA"], "\n")
    survey = tables.read_survey(spark, str(tmp_path / "s.csv"), split=True)
    assert survey.data.dtypes == [("id", "bigint"), ("note", "string")]
    assert sorted(map(tuple, survey.data.collect())) == [(1, "two\nlines"), (2, None)]
