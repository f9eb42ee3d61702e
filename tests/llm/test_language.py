import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import language_id as li
from hushframe.llm.queries import held_out, op6_language_id

PARTS = {"aa": ["the", "an", "ing", "wh"], "bb": ["ei", "sch", "ung", "ß"], "gr": ["και", "το", "ση"], "cy": ["что", "не", "ый"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(n))


def documents(spark):
    rng = random.Random(6)
    rows = [(i, text(lang := list(PARTS)[i % 4], rng.randrange(1, 60), rng), lang) for i in range(200)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 ½ ², !!", "bb"), (903, text("aa", 40, rng) + ". " + text("bb", 60, rng), None), (904, "το " * 100_000, "gr"), (None, "the thing", "aa"), (5, "ungsch", "bb"), (5, "ungsch", "bb")]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")


def brute_viterbi(scores, penalty):
    best = [(s, [i]) for i, s in enumerate(scores[0])]
    for row in scores[1:]:
        best = [max(((v - (penalty if p[-1] != j else 0) + row[j], p + [j]) for v, p in best), key=lambda x: x[0]) for j in range(len(row))]
    return max(best, key=lambda x: x[0])


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    sizes = np.array([5, 0, 1, 30, 12, 12])
    starts = np.cumsum(sizes) - sizes
    scores = rng.normal(size=(sizes.sum(), 3)) * 3
    got = li.viterbi(scores, starts, sizes, 4.0)
    for a, n in zip(starts, sizes):
        if n:
            value, _ = brute_viterbi(scores[a : a + n].tolist(), 4.0)
            path = got[a : a + n]
            own = scores[np.arange(a, a + n), path].sum() - 4.0 * (np.diff(path) != 0).sum()
            assert own == pytest.approx(value)


def test_languages_and_spans(spark):
    docs = documents(spark)
    model = li.train(docs.select(F.col("doc_id").alias("id"), "lang", "text"))
    assert model.langs == ["aa", "bb", "cy", "gr"]
    assert model.scripts["Greek"] == [3] and model.scripts["Latin"] == [0, 1]
    got = {r["doc_id"]: r for r in li.predict(docs, model).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert all(got[i]["lang_pred"] == rows[i]["lang"] for i in range(200) if i != 5)
    for i in (900, 901, 902):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) == ("und", 0.0, [])
    spans = got[903]["spans"]
    assert [s["lang"] for s in spans] == ["aa", "bb"] and got[903]["lang_pred"] == "bb" and 0.5 < got[903]["score"] < 1
    whole = rows[903]["text"]
    assert whole[spans[0]["start"] : spans[0]["end"]] == whole.partition(".")[0] and spans[1]["end"] == len(whole)
    assert li.predict(docs, model).count() == docs.count()
    assert li.predict(docs.where("false"), model).count() == 0


def test_without_labels_all_is_undetermined(spark):
    docs = documents(spark)
    model = li.train(docs.where("false").select(F.col("doc_id").alias("id"), "lang", "text"))
    assert {r["lang_pred"] for r in li.predict(docs, model).collect()} == {"und"}


def test_word_scores_are_sums_of_trigrams():
    model = li.Model([("x", "gram", "^a$", 3), ("x", "gram", "^ab", 1), ("y", "gram", "ab$", 2), ("x", "script", "Latin", 5), ("y", "script", "Latin", 3)])
    total = {"x": 4 + 0.1 * 4, "y": 2 + 0.1 * 4}
    p = lambda lang, n: np.log((n + 0.1) / total[lang])
    assert np.allclose(model.word_scores(["AB"]), [[p("x", 1) + p("x", 0), p("y", 0) + p("y", 2)]], atol=1e-5)


def test_held_out_accuracy_on_the_given_documents(spark):
    import zlib

    path = "/root/testdata/sf0.01"
    got = op6_language_id(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert spark.range(1).select(held_out(F.lit(None).cast("long"))).first()[0] is False
