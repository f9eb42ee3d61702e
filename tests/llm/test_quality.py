import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest

from hushframe.llm import kneser_ney as kn


def brute_model(texts, order):
    """log p(character | context) of one language, by the textbook formulas."""
    raw = Counter()
    for text in texts:
        for word in kn.marked_words(text):
            whole = word + kn._END
            for i in range(len(whole)):
                for k in range(1, order + 1):
                    if i + k <= len(whole):
                        raw[whole[i : i + k]] += 1
    marks = (kn._BEGIN, kn._BEGIN_SENTENCE)
    left = defaultdict(set)
    for g in raw:
        left[g[1:]].add(g[0])
    a = {g: c if len(g) == order or g[0] in marks else len(left[g]) for g, c in raw.items() if not (len(g) == 1 and g[0] in marks)}
    d = {}
    for k in range(1, order + 1):
        d[k] = kn._discounts(Counter(c for g, c in a.items() if len(g) == k))
    cut = lambda g: d[len(g)][min(a[g], 3) - 1]
    children = defaultdict(list)
    for g in a:
        children[g[:-1]].append(g)
    size = sum(len(g) == 1 for g in a) + 1

    def p(context, c):
        context = context[max(0, len(context) - order + 1) :]
        below = p(context[1:], c) if context else 1 / size
        if context not in children:
            return below
        total = sum(a[g] for g in children[context])
        gamma = sum(cut(g) for g in children[context]) / total
        own = (a[context + c] - cut(context + c)) / total if context + c in a else 0.0
        return own + gamma * below

    return p, {g for g in a if len(g) == 1}


def texts_of(seed, n=60):
    rng = random.Random(seed)
    parts = ["th", "an", "er", "ou", "ß", "ing", "a"]
    return [" ".join("".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 3]))) + rng.choice(["", "", ".", ","]) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("block_rows", [4_000_000, 300])
def test_word_scores_equal_brute_force(spark, block_rows):
    trained = texts_of(1)
    folder = kn.train(spark.createDataFrame([("xx", t) for t in trained], "lang string, text string"), order=4, block_rows=block_rows)
    blocks = kn.Blocks(folder)
    p, alphabet = brute_model(trained, 4)
    words = sorted({w for t in texts_of(2) + trained + ["qqq thq", "!", "zan.", "a" * 150] for w in kn.marked_words(t)})
    got = kn.word_scores(words, "xx", blocks, 4)
    for word, score in zip(words, got):
        whole = word + kn._END
        assert score == pytest.approx(sum(math.log(p(whole[:j], whole[j])) for j in range(1, len(whole))), rel=1e-4)
    # it is a distribution: the alphabet and one unseen character sum up to 1
    for context in (kn._BEGIN, kn._BEGIN + "th", "an", "ßa", "never", ""):
        assert sum(p(context, c) for c in alphabet) + p(context, "￿") == pytest.approx(1)
    assert (len(blocks.numbers) > 1) == (block_rows == 300)
    # an unknown language uses the model of all languages, here of the same text
    assert np.allclose(kn.word_scores(words, "other", blocks, 4), got)


def test_words_carry_their_mark_and_long_ones_are_cut():
    s, m = kn._BEGIN_SENTENCE, kn._BEGIN
    assert kn.marked_words("One two. Three\n four\t,\n\n") == [s + "One", m + "two.", s + "Three", s + "four", m + ","]
    assert kn.marked_words("") == kn.marked_words(" \n") == []
    long = kn.marked_words("x" * 150)
    assert "".join(w[1:] for w in long) == "x" * 150 and max(map(len, long)) <= 65


def documents(spark):
    clean, rng = texts_of(3, 200), random.Random(3)
    rows = [(i, t * 3, "xx" if i % 2 else "yy", i) for i, t in enumerate(clean)]
    for i in range(20):
        rows.append((1000 + i, " ".join(rng.choice(["ZQ!!", "%%%$", "|", "WW##"]) for _ in range(40)), "xx", 0))
    rows += [(2000, None, "xx", 0), (2001, "", None, 0), (2002, "thaning er an", None, 0), (None, clean[0] * 3, "xx", 0), (5, clean[5] * 3, "zz", 0), (2003, "than " * 100_000, "xx", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity int")


def test_junk_is_rejected_and_clean_text_stays(spark):
    docs = documents(spark)
    trusted = spark.createDataFrame([(i,) for i in range(0, 200, 3)] + [(None,), (3,)], "doc_id long")
    got = kn.judge(docs, trusted).collect()
    assert len(got) == docs.count()
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    assert not any(r["kept"] for i in range(1000, 1020) for r in by_id[i])
    assert sum(r["kept"] for i in range(200) for r in by_id[i]) >= 198
    assert by_id[2000][0]["perplexity"] is None and by_id[2000][0]["kept"] and by_id[2001][0]["kept"]
    kept = kn.drop(docs, trusted)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in got if r["kept"]), key=str)


def test_without_trusted_text_or_documents(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long")
    assert kn.judge(docs, none).count() == docs.count()
    assert kn.judge(docs.where("false"), none).count() == 0
    assert kn.drop(docs.where("false"), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def shares(spark, copies, junk, others=()):
    """300 clean documents of "xx", a third of them trusted, copies of one of them, junk, and more rows."""
    rng = random.Random(6)
    rows = [(i, t * 2, "xx") for i, t in enumerate(texts_of(7, 300))]
    rows += [(10_000 + i, rows[1][1], "xx") for i in range(copies)]
    rows += [(20_000 + i, " ".join(rng.choice(["ZQ!!", "%%%$", "|", "WW##"]) for _ in range(rng.randrange(30, 60))), "xx") for i in range(junk)]
    docs = spark.createDataFrame(rows + list(others), "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")
    return {r["doc_id"]: r for r in kn.judge(docs, trusted).collect()}


def test_copies_over_half_of_a_language_move_no_limit(spark):
    plain, copied = shares(spark, 0, 0), shares(spark, 900, 0, [(30_000, "than er an", "one"), (30_001, "zan th", None)])
    assert all(copied[i]["most"] == pytest.approx(plain[i]["most"]) for i in range(300))
    assert sum(copied[i]["kept"] for i in range(300)) >= 297
    # languages of one row
    assert copied[30_000]["kept"] and copied[30_001]["kept"]


def test_copies_in_a_language_without_trusted_text(spark):
    rows = [(40_000 + i, t * 2, "yy") for i, t in enumerate(texts_of(8, 80))]
    rows += [(50_000 + i, rows[3][1], "yy") for i in range(300)]
    got = shares(spark, 0, 0, rows)
    assert sum(got[40_000 + i]["kept"] for i in range(80)) >= 78


def test_a_large_share_of_junk_moves_no_limit(spark):
    plain, full = shares(spark, 0, 0), shares(spark, 0, 200)
    assert all(full[i]["most"] == pytest.approx(plain[i]["most"]) for i in range(300))
    assert not any(full[20_000 + i]["kept"] for i in range(200))


def brute_running_model(texts, order):
    """log p(character | context) over running text, by the textbook formulas."""
    raw, left, children = Counter(), defaultdict(set), defaultdict(list)
    for text in texts:
        for context, c in predictions(text):
            for k in range(1, order + 1):
                if k <= len(context) + 1:
                    raw[(context + c)[-k:]] += 1
    for g in raw:
        left[g[1:]].add(g[0])
        children[g[:-1]].append(g)
    a = {g: n if len(g) == order or g[0] == kn._BEGIN_TEXT else len(left[g]) for g, n in raw.items()}
    d = {k: kn._discounts(Counter(n for g, n in a.items() if len(g) == k)) for k in range(1, order + 1)}
    cut = lambda g: d[len(g)][min(a[g], 3) - 1]
    size = sum(len(g) == 1 for g in a) + 1

    def p(context, c):
        context = context[max(0, len(context) - order + 1) :]
        below = p(context[1:], c) if context else 1 / size
        if context not in children:
            return below
        total = sum(a[g] for g in children[context])
        own = (a[context + c] - cut(context + c)) / total if context + c in a else 0.0
        return own + sum(cut(g) for g in children[context]) / total * below

    return p


def predictions(text):
    """Each predicted character after all that stands before it."""
    before = kn._BEGIN_TEXT
    for word in kn.marked_words(text):
        before += word[0]
        for c in word[1:] + kn._END:
            yield before, c
            before += c if c != kn._END else ""


@pytest.mark.parametrize("block_rows", [4_000_000, 300])
def test_contexts_go_over_word_boundaries(spark, block_rows):
    trained = texts_of(1) + ["a b cd a b cd."]
    folder = kn.train(spark.createDataFrame([("xx", t) for t in trained], "lang string, text string"), block_rows=block_rows, across=True)
    p = brute_running_model(trained, kn.ORDER)
    texts = texts_of(2, 20) + ["a", "a b c d e", "thaning " * 9, "a" * 150 + " b", "qq thq\x02\x03x. an"]
    got, chars = kn.Scorer(folder, kn.ORDER).score(["xx"] * len(texts), texts)
    for text, perplexity, n in zip(texts, got, chars):
        logs = [math.log(p(context, c)) for context, c in predictions(text.translate(kn._MARKS))]
        assert len(logs) == n
        assert math.log(perplexity) == pytest.approx(-sum(logs) / n, rel=1e-4)


def test_order_and_repetition_of_words_count(spark):
    turns = ["ab cd ef gh " * n for n in range(20, 180)]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(turns)] + [(1000, "ab " * 80, "xx"), (1001, "ab gh ef cd " * 20, "xx")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in kn.judge(docs, spark.createDataFrame([(i,) for i in range(160)], "doc_id long")).collect()}
    assert all(got[i]["kept"] for i in range(160))
    assert not got[1000]["kept"] and not got[1001]["kept"]


def test_what_is_remembered_changes_no_score(spark):
    trained = texts_of(1)
    rows = [(lang, t) for lang, part in (("xx", trained[:30]), ("yy", trained[30:])) for t in part]
    folder = kn.train(spark.createDataFrame(rows, "lang string, text string"), block_rows=300, across=True)
    texts = texts_of(2, 40) + ["", "a", "a b c d e", "x" * 150 + " b", "\x00 \x00a\x02 th"]
    langs = ["xx", "yy", None] * 15
    first = kn.Scorer(folder, kn.ORDER).score(langs, texts)
    # a table of two n-grams, texts one by one and again
    small = kn.Scorer(folder, kn.ORDER, bits=1)
    for _ in range(2):
        assert [small.score([lang], [text]) for lang, text in zip(langs, texts)] == [([p], [n]) for p, n in zip(*first)]
    assert len(small.recent.keys) == 2
    # each block is read once for all languages of the texts
    blocks, read = kn.Blocks(folder), []
    counting = kn.Scorer(folder, kn.ORDER)
    counting.blocks.get = lambda number: read.append(number) or blocks.get(number)
    counting.score(langs, texts)
    assert len(read) == len(set(read)) > 1


def test_a_block_is_opened_once_however_many_texts_are_scored(spark, monkeypatch):
    trained = texts_of(1)
    folder = kn.train(spark.createDataFrame([("xx", t) for t in trained], "lang string, text string"), block_rows=300, across=True)
    opened, block = [], kn.Block
    monkeypatch.setattr(kn, "Block", lambda folder, number, *rest: opened.append(number) or block(folder, number, *rest))
    scorer = kn.Scorer(folder, kn.ORDER, bits=1)
    got = [scorer.score(["xx"], [t]) for t in texts_of(2, 30) + trained]
    assert len(opened) == len(set(opened)) > 1
    # a store that can't be mapped is copied
    monkeypatch.setattr(kn, "shared_files", lambda folder: (pafs.SubTreeFileSystem("/", pafs.LocalFileSystem()), folder.removeprefix("file://")))
    far = kn.Scorer(folder, kn.ORDER)
    assert [far.score(["xx"], [t]) for t in texts_of(2, 30) + trained] == got
