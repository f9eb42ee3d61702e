"""Places, free-text search and masking against plain Python on small inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hushframe import fixed_values as fixed
from hushframe import session
from hushframe.functions.values import population_number
from hushframe.operators import freetext, mask, places
from hushframe.plans import detect
from hushframe.sources import registries, words
from hushframe.sources.tables import Survey


def gazetteer(spark):
    rows = [
        ("Big", "mx", 50000), ("Edge", "mx", 20000), ("Small", "mx", 19999), ("Zero", "mx", 0),
        ("Null", "mx", None), ("Both", "mx", 100), ("Both", "ke", 900000), ("Kenya only", "ke", 5),
    ]
    return spark.createDataFrame(rows, "name string, country_iso string, population bigint")


def second(spark):
    rows = [("Zero", "1,200 (2010)"), ("Null", "abc"), ("Nowhere", "5"), ("Big", "3")]
    texts = spark.createDataFrame(rows, "name string, text string")
    return registries.ingest_population_answers(texts, "name", "text")


def place_list(spark, names, list_id="a"):
    return spark.createDataFrame([(list_id, i, n) for i, n in enumerate(names)], "l string, idx int, place string")


def test_lookup_by_country_and_second_source(spark):
    names = ["Big", "Zero", "Null", "Both", "Kenya only", "Nowhere"]
    def looked(country, other):
        found = places.place_lookup(place_list(spark, names), gazetteer(spark), country, other)
        return {r.place: (r.place_exists, r.population) for r in found.collect()}

    assert looked("mx", None) == {
        "Big": (True, 50000), "Zero": (True, None), "Null": (True, None), "Both": (True, 100),
        "Kenya only": (False, None), "Nowhere": (False, None),
    }
    assert looked(None, None)["Both"] == (True, 900000)
    assert looked("mx", second(spark)) == looked("mx", None) | {"Zero": (True, 1200)}


def reference_search(found, threshold=20000, one=False, unknown_is_low=False):
    """The rule read off step by step: `found` lists (place, population or None) that exist."""
    low, waiting, sure = [], [], unknown_is_low
    for place, population in found:
        if population:
            if population < threshold:
                low.append(place)
            elif not sure:
                sure = True
                if not one:
                    low += waiting
        elif sure:
            low.append(place)
        else:
            waiting.append(place)
        if one and low:
            return low[0]
    return None if one else low


@pytest.mark.parametrize("seed", range(6))
def test_low_population_rules_agree_with_a_step_by_step_reading(spark, seed):
    dice = random.Random(seed)
    lists = {}
    for name in "abcdef":
        kinds = dice.choice([[None], [None, 50000], [None, 50000, 100], [50000], [None, 20000, 19999]])
        lists[name] = [(f"{name}{i}", dice.choice(kinds)) for i in range(dice.randint(1, 8))]
    rows = [(name, i, p, True, n) for name, listed in lists.items() for i, (p, n) in enumerate(listed)]
    rows += [("a", -1, "not a place", False, None), ("g", 0, "nor this", False, None)]
    found = spark.createDataFrame(rows, "l string, idx int, place string, place_exists boolean, population bigint")
    for conservative in (False, True):
        got = places.low_population_places(found, unknown_is_low=conservative, list_by="l").collect()
        expected = {p for listed in lists.values() for p in reference_search(listed, unknown_is_low=conservative)}
        assert {r.place for r in got} == expected and len(got) == len(expected)
        first = places.first_low_population_place(found, "idx", unknown_is_low=conservative, list_by=("l",))
        one = {n: reference_search(listed, one=True, unknown_is_low=conservative) for n, listed in lists.items()}
        assert {r.l: r.place for r in first.collect()} == {n: p for n, p in one.items() if p}
        alone = found.where("l = 'a'")
        single = places.first_low_population_place(alone, "idx", unknown_is_low=conservative).collect()
        assert [r.place for r in single] == ([one["a"]] if one["a"] else [])
        together = places.low_population_places(alone, unknown_is_low=conservative).collect()
        assert {r.place for r in together} == set(reference_search(lists["a"], unknown_is_low=conservative))


def test_detect_by_location(spark):
    df = spark.createDataFrame(
        [(1, "Null", "Big", "Small", "-888"), (2, "Big", "Edge", "Small", "Null"), (3, "Null", "", "x", None)],
        "id int, village string, home_town string, q string, lc string",
    )
    survey = Survey("s", df, order_by=("id",))
    found = detect.by_location([survey], gazetteer(spark), "Mexico").collect()
    assert {r.column_name: (r.word, r.evidence) for r in found} == {}
    # 'Null' comes before the first known place at first sight; a later unknown one counts
    more = df.unionAll(spark.createDataFrame([(4, "Zero", "Both", "y", "")], df.schema))
    found = detect.by_location([Survey("s", more, order_by=("id",))], gazetteer(spark), "Mexico").collect()
    assert {r.column_name: r.reason for r in found} == {
        "village": "Name had fuzzy match with restricted word 'village' and has a location with population under"
        " 20,000: Zero",
        "home_town": "Name had fuzzy match with restricted word 'town' and has a location with population under"
        " 20,000: Both",
    }
    with pytest.raises(ValueError, match="order_by"):
        detect.by_location([Survey("s", df)], gazetteer(spark), "Mexico").collect()


def test_country_codes(spark):
    df = spark.createDataFrame([("Mexico",), ("mexico",), ("Cote dIvoire",), (None,)], "c string")
    assert [r.iso for r in df.select(registries.country_iso(F.col("c")).alias("iso")).collect()] == [
        "mx", None, "ci", None,
    ]


def test_name_answers(spark):
    bodies = [
        '{"results": [{"name": "Ana", "jurisdictions": [{"iso": "mx"}], "world": {"incidence": 51}},'
        ' {"name": "Rare", "jurisdictions": [{"iso": "mx"}], "world": {"incidence": 50}},'
        ' {"name": "None", "jurisdictions": [], "world": {"incidence": 900}},'
        ' {"name": "Text", "jurisdictions": [1], "world": {"incidence": "77"}},'
        ' {"name": "Bad", "jurisdictions": [1], "world": {"incidence": "many"}}, {"name": "Bare"}]}',
        '{"error": 1}',
        "not json",
        None,
    ]
    answers = spark.createDataFrame([(b,) for b in bodies], "body string")
    names = registries.ingest_name_answers(answers, "body", "surname")
    asked = spark.createDataFrame([(n,) for n in ("Ana", "Rare", "None", "Text", "Bad", "Bare")], "token string")
    assert {r.token for r in freetext.person_names(asked, names).collect()} == {"Ana", "Text"}


def names_table(spark):
    return spark.createDataFrame(
        [("Ana", "forename", 900, ["mx"]), ("Lopez", "surname", 51, ["mx"]), ("Big", "surname", 50, ["mx"]),
         ("the", "forename", 999, ["us"])],
        "name string, name_type string, incidence bigint, jurisdictions array<string>",
    )


def test_free_text_search(spark):
    df = spark.createDataFrame(
        [(1, "Ana, lives in Small near Big the 555-1234."), (2, "Lopez visits Null and (Ana)"), (3, "999")],
        "id int, text string",
    )
    stop = spark.createDataFrame([("english", "the"), ("english", "555-1234.")], "language string, word string")
    tags = spark.createDataFrame(
        [("english", w, t) for w, t in [("Ana", "PROPN"), ("Small", "LOC"), ("Null", ""), ("Lopez", "VERB"), ("Big", "X")]]
        + [("spanish", "Lopez", "PROPN")],
        "language string, token string, tag string",
    )
    survey = Survey("s", df)
    lookups = dict(country="Mexico")
    columns, found = detect.by_free_text(survey, ["text"], stop, names_table(spark), gazetteer(spark), **lookups)
    assert columns == ["text"]
    # without tags punctuation stays: 'Ana,' and '(Ana)' are no names
    assert {(r.token, r.kind) for r in found.collect()} == {
        ("555-1234.", "phone"), ("Lopez", "name"), ("Small", "place"), ("Null", "place"),
    }
    lookups |= dict(token_tags=tags, language="english")
    _, found = detect.by_free_text(survey, ["text"], stop, names_table(spark), gazetteer(spark), **lookups)
    assert {(r.token, r.kind) for r in found.collect()} == {
        ("555-1234.", "phone"), ("Ana", "name"), ("Small", "place"), ("Null", "place"),
    }
    assert detect.by_free_text(survey, ["id"], stop, names_table(spark), gazetteer(spark)) == ([], None)


def test_stop_words_from_files_and_from_spark(spark, tmp_path):
    (tmp_path / "english").write_text("the\nand\n", encoding="utf-8")
    (tmp_path / "spanish").write_text("los\nel", encoding="utf-8")
    (tmp_path / "README").write_text("not a language", encoding="utf-8")
    read = words.read_stopwords(spark, str(tmp_path), ["english", "spanish"])
    assert {tuple(r) for r in read.collect()} == {
        ("english", "the"), ("english", "and"), ("spanish", "los"), ("spanish", "el"),
    }
    (tmp_path / "notes.txt").write_text("no list\n", encoding="utf-8")
    every = {tuple(r) for r in words.read_stopwords(spark, str(tmp_path)).collect()}
    assert every == {tuple(r) for r in read.collect()}
    assert {r.language for r in words.default_stopwords(spark, None).select("language").collect()} == set(words.SHIPPED_LANGUAGES)
    shipped = {tuple(r) for r in words.default_stopwords(spark).collect()}
    assert ("english", "the") in shipped and ("spanish", "los") in shipped and len(shipped) > 400


# ------------------------------------------------------------------------------------ masking


def masked_in_python(text, listed):
    if text is None:
        return None
    inside = [w for w in sorted({w for w in listed if w}, key=lambda w: (-len(w), w)) if w in text]
    for word in inside:
        text = text.replace(word, "XXXX")
    return text


def both_ways(spark, texts_, listed):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts_)], "id int, a string, b string")
    listed_df = spark.createDataFrame([(w,) for w in listed], "word string")
    projected = mask.mask_words(df, ["a", "b"], [w for w in listed if w is not None])
    joined = mask.mask_found_words(df, ["a", "b"], listed_df)
    assert projected.columns == joined.columns == ["id", "a", "b"]
    return [[(r.a, r.b) for r in d.orderBy("id").collect()] for d in (projected, joined)]


def test_masking_nested_and_pattern_words(spark):
    listed = ["Ana", "Anabel", "(x*", "", "Juan Perez", "XX"]
    texts_ = ["Anabel and Ana", "(x*) xx", "Juan Perez, Juan  Perez", None, "", "aXXb", "bananAnas"]
    expected = [(masked_in_python(t, listed),) * 2 for t in texts_]
    projected, joined = both_ways(spark, texts_, listed)
    assert projected == joined == expected
    assert expected[0][0] == "XXXX and XXXX"


def test_no_words_masks_nothing(spark):
    projected, joined = both_ways(spark, ["a b", None], [""])
    assert projected == joined == [("a b", "a b"), (None, None)]


@pytest.mark.parametrize(("seed", "rows_to_broadcast"), [(0, 500000), (1, 500000), (2, 0), (3, 0)])
def test_masking_agrees_with_python_on_random_texts(spark, monkeypatch, seed, rows_to_broadcast):
    monkeypatch.setattr(session, "_BROADCAST_ROWS", rows_to_broadcast)
    dice = random.Random(seed)
    word = lambda most: "".join(dice.choice("ab(é ") for _ in range(dice.randint(1, most)))
    texts_ = [word(60) for _ in range(60)]
    listed = [w for w in (word(5).strip() for _ in range(12)) if w]
    expected = [(masked_in_python(t, listed),) * 2 for t in texts_]
    projected, joined = both_ways(spark, texts_, listed)
    assert projected == joined == expected


def test_masking_very_long_tokens_and_words(spark):
    """Words longer than the anchor, tokens longer than a piece, hits across piece borders."""
    dice = random.Random(5)
    token = "".join(dice.choice("abcdefgh") for _ in range(5000))
    listed = [token[1010:1040], token[1020:1120], token[4990:], token[2047:2050], "zz" * 40]
    projected, joined = both_ways(spark, [f"x {token} y", token, "nothing"], listed)
    expected = [(masked_in_python(t, listed),) * 2 for t in (f"x {token} y", token, "nothing")]
    assert projected == joined == expected


def test_phrases_of_a_common_token_are_told_apart_by_their_neighbours(spark):
    listed = ["the " + w for w in ("a", "of", "old", "oldest", "older", "é")] + ["in the", "xin the end", "at  the", " the", "the "]
    texts_ = ["the oldest of the old", "then the older", "xin the ends", "at  the a", "the", "", None, "in the éa", "the o", " the of"]
    words_df = spark.createDataFrame([(w,) for w in listed], "word string")
    masked = mask.mask_found_words(spark.createDataFrame([(t,) for t in texts_], "a string"), ["a"], words_df)
    assert sorted((r.a for r in masked.collect()), key=str) == sorted((masked_in_python(t, listed) for t in texts_), key=str)
    # a token meets the phrases with the same characters beside it, not all that it is part of
    many = spark.range(2000).selectExpr("concat('the ', lpad(cast(id as string), 4, '0')) as word")
    filed = many.selectExpr("word", "'the' as part", "cast(null as string) as before", "split(word, ' ')[1] as after", "'the' as gram")
    hits = mask._hits(spark.createDataFrame([("the",)], "token string"), filed, [3])
    assert hits.select("token", "beside").distinct().count() == hits.count() == 2000


def test_phrases_make_no_row_per_token_that_they_might_be_part_of(spark, monkeypatch):
    """What is stored grows with the list, not with the tokens of the texts that end as a phrase's first word does."""
    texts_ = [f"w{i}a b{i} a b w{i}a" for i in range(300)] + ["xa by", "xa c", "za  b", "a", None, "ca ef g", "ca ef gh", "xca ef g"]
    listed = ["a b", "a by", "a c", " b", "b ", "a  b", "ca ef g"]
    stored, settle = [], mask.settle
    monkeypatch.setattr(mask, "settle", lambda df: stored.append(settle(df)) or stored[-1])
    masked = mask.mask_found_words(spark.createDataFrame([(t,) for t in texts_], "a string"), ["a"], spark.createDataFrame([(w,) for w in listed], "word string"))
    assert sorted((r.a for r in masked.collect()), key=str) == sorted((masked_in_python(t, listed) for t in texts_), key=str)
    assert sum(df.count() for df in stored) == len(listed)


@pytest.mark.parametrize(("seed", "few"), [(0, True), (1, True), (2, False), (3, False)])
def test_masking_phrases_agrees_with_python_on_random_texts(spark, monkeypatch, seed, few):
    if not few:
        monkeypatch.setattr(session, "_BROADCAST_ROWS", 0)
        monkeypatch.setattr(mask, "_FEW_HITS", 0)
    dice = random.Random(seed)
    draw = lambda most: "".join(dice.choice("aab(é   \n") for _ in range(dice.randint(1, most)))
    texts_ = [draw(60) for _ in range(80)] + [None, "", " ", "   "]
    listed = [w for w in (draw(9) for _ in range(60)) if w.strip(" ")]
    df = spark.createDataFrame([(t,) for t in texts_], "a string")
    masked = mask.mask_found_words(df, ["a"], spark.createDataFrame([(w,) for w in listed + [None]], "word string"))
    assert sorted((r.a for r in masked.collect()), key=str) == sorted((masked_in_python(t, listed) for t in texts_), key=str)


@pytest.mark.parametrize("hidden", ["XXXX", "X b", "", "a", "\n", "$1\\"])
def test_masking_line_by_line_changes_nothing(spark, hidden):
    texts_ = ["a b\nab c\n\na b", "XX\na b", "a a b b\nXX b\n", "c\n c\na  b", "\n", "a b\n" * 30]
    for listed in (["a b", "c", "b c"], ["a b", "XX", "X b", "b"], ["a b", "b\na", "ab"]):
        df = spark.createDataFrame([(t,) for t in texts_], "a string").coalesce(1)
        masked = mask.mask_found_words(df, ["a"], spark.createDataFrame([(w,) for w in listed], "word string"), hidden)
        expected = []
        for t in texts_:
            done = t
            for w in sorted((w for w in listed if w in t), key=lambda w: (-len(w), w)):
                done = done.replace(w, hidden)
            expected.append(done)
        assert sorted(r.a for r in masked.collect()) == sorted(expected)


def test_bytes_that_are_no_text_stay_as_they_are(spark):
    df = spark.range(1).selectExpr("cast(X'FF0A616E612062' as string) as a")
    masked = mask.mask_found_words(df, ["a"], df.selectExpr("'ana b' as word"))
    assert masked.selectExpr("hex(a) as h").first().h == "FF0A58585858"


def test_masking_unknown_columns_is_an_error(spark):
    df = spark.createDataFrame([("call Ana",)], "t string")
    for call in (lambda: mask.mask_words(df, ["tt"], ["Ana"]), lambda: mask.mask_found_words(df, ["tt"], df.select(F.lit("Ana").alias("word")))):
        with pytest.raises(ValueError, match="tt"):
            call()


def test_rows_without_a_key_are_masked(spark):
    df = spark.createDataFrame([(None, "call Ana now"), (None, "call Ana now"), (1, "Ana"), (2, None)], "id int, t string")
    masked = mask.mask_found_words(df, ["t"], spark.createDataFrame([("Ana",)], "word string"))
    assert sorted((r.t for r in masked.collect()), key=str) == [None, "XXXX", "call XXXX now", "call XXXX now"]


def test_phrases_with_a_shared_part_meet_few_tokens(spark):
    """A phrase is filed under its rarest piece, and no text gets a word that it does not contain."""
    phrases = spark.range(20_000).selectExpr("concat('customer ', id) as word")
    df = spark.range(400).selectExpr("id", "concat('to customer ', id * 50, ' and customer x') as t")
    filed = mask._filed(phrases)
    assert filed.groupBy("gram").count().agg(F.max("count")).first()[0] < 50
    tokens = df.select(F.explode(F.split("t", " ")).alias("token")).distinct()
    hits = mask._hits(tokens, filed, [1, 2, 3, 4])
    assert hits.where("not contains(token, split(word, ' ')[1])").count() == 0 and hits.count() < 20_000
    masked = mask.mask_found_words(df, ["t"], phrases).collect()
    listed = [f"customer {i}" for i in range(20_000)]
    for r in masked[::40]:
        assert r.t == masked_in_python(f"to customer {r.id * 50} and customer x", listed)


def test_masking_keeps_labels(spark):
    df = spark.createDataFrame([("Ana",)], "t string").withMetadata("t", {"label": "Remark"})
    for masked in (mask.mask_words(df, ["t"], ["Ana"]), mask.mask_found_words(df, ["t"], df.selectExpr("'Ana' as word"))):
        assert masked.schema["t"].metadata == {"label": "Remark"}


def test_masking_with_a_hot_word_in_every_row(spark):
    df = spark.range(3000).selectExpr("id", "concat('Maria 555-', id, ' end') as t")
    words_ = spark.range(3000).selectExpr("concat('555-', id) as word").unionAll(
        spark.createDataFrame([("Maria",)], "word string")
    )
    got = mask.mask_found_words(df, ["t"], words_)
    assert got.count() == 3000
    left = got.where("t like '%Maria%' or t like '%555-%' or t not like 'XXXX XXXX%'")
    assert left.count() == 0


def test_population_unit_switch(spark):
    df = spark.createDataFrame([("17 million",)], "t string")
    assert df.select(population_number(F.col("t"), True).alias("n")).first()["n"] == 17000000


def test_phone_shapes_of_tokens_match_python(spark):
    dice = random.Random(1)
    items = ["".join(dice.choice("0123456789-.() ") for _ in range(dice.randint(5, 14))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in items], "token string")
    expected = {t for t in items if re.match("|".join(fixed.PHONE_SHAPES), t)}
    assert {r.token for r in freetext.phone_tokens(df).collect()} == expected


def test_shipped_stop_words_are_the_default(spark):
    df = spark.createDataFrame([("the Ana los",)], "text string")
    found = freetext.personal_tokens(df, ["text"], None, names_table(spark), gazetteer(spark))
    # 'the' is a known name in the table, but a stop word first
    assert {(r.token, r.kind) for r in found.collect()} == {("Ana", "name")}
