import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import divergence, term_counts

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [m.decode() for m in TERM.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))]


def brute(rows, least, most):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        key = (lang or "", source or "")
        groups.add(key)
        found = Counter(terms_of(text))
        docs[key[0]].update(found.keys())
        counts[key].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        of_lang = Counter()
        for g in groups:
            if g[0] == lang:
                of_lang.update(counts[g])

        def chance(count):
            size = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // size for t in kept}

        p = {g: chance(counts[g]) for g in groups if g[0] == lang}
        q = chance(of_lang)
        for g in p:
            pairs = [(sum((p[g][t] - p[h][t]) ** 2 // p[h][t] for t in kept), h[1]) for h in p if h != g]
            terms = [((p[g][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[g][t] > 0 and p[g][t] > q[t]]
            for part, found, end in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(*g, part, item, value, rank) for rank, (value, item) in enumerate(found[:end], 1)]
    return sorted(out)


def check(spark, rows, least=3, most=200):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, TERM int, n string").repartition(4)
    got = divergence.audit(frame, least, most).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least, most)


LONG = "äöü" * 40 + "x"


def sample():
    draw = np.random.default_rng(5)
    vocabulary = ["the", "The", "a", "eightbyt", "ninebytes", "sixteenbytesword", "seventeenbytesabc", LONG, LONG + "y", "日本語", "über", "Ünder", "x" * 5000]
    vocabulary += [f"{a}{b}" for a, b in product("abcdefgh", "klmnopqr")]
    rows = []
    for i in range(150):
        words = [vocabulary[int(len(vocabulary) * draw.random() ** 2)] for _ in range(int(draw.integers(0, 60)))]
        rows.append((("en", "de", None, "")[i % 4], ("s0", "s1", "s2", None, "s0", "s0")[i % 6], " 1-".join(words)))
    rows += [("en", "s0", "the the hot")] * 40  # copies
    rows += [("xx", "a", None), ("xx", "b", "only once"), ("xx", "c", ""), ("yy", "solo", "one two one"), ("yy", "solo", "one"), ("yy", "solo", "one")]
    rows += [("en", "s1", "the hot " * 30_000), ("de", "only numbers", "12 34 \x00 _ ~"), ("de", "s1", None)]
    return rows


def test_equals_brute_force(spark):
    check(spark, sample())
    check(spark, sample(), least=1, most=3)


def test_pieces_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 300)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        check(spark, sample(), least=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_or_no_rows(spark):
    for rows in ([("en", "s", None)], [("en", "s", "one one one")], [("en", "s", "b a")] * 3, [(None, None, None), ("", "t", "a a"), (None, "", "a")]):
        check(spark, rows)
    frame = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(frame).count() == 0


def test_probabilities_are_exact_for_large_counts(spark):
    for n, size in ((0, 3), (10**12, 10**12 + 7), (9 * 10**13 // 2, 9 * 10**13), (0, 10**10), (76543210987, 90000000000001)):
        expected = 1 + 10**9 * (n + 1) // size
        assert spark.sql(f"select {divergence._p(f'{n}L', f'{size}L')}").first()[0] == expected
        assert divergence._p_numpy(np.array([n]), np.array([size])).tolist() == [expected]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text(alphabet="aAbz 1é日\n\x7f@[`{", max_size=60)), max_size=12))
def test_counts_equal_a_counter(rows):
    rows.sort(key=lambda r: r[0])
    expected, docs = Counter(), Counter()
    for group, text in rows:
        expected.update((group, t) for t in terms_of(text))
        docs.update((group, t) for t in set(terms_of(text)))
    group, term, n, with_it = term_counts.count([t.encode() for _, t in rows], np.array([g for g, _ in rows], np.int64))
    keys = list(zip(group.tolist(), term.to_pylist()))
    assert dict(zip(keys, n.tolist())) == expected and dict(zip(keys, with_it.tolist())) == docs and len(keys) == len(expected)


def test_words_sort_as_their_bytes():
    names = [b"a", b"aa", b"ab", b"b", b"zzzzzzzz", b"zzzzzzzzz", b"zzzzzzzzza", "ü".encode()]
    joined = np.frombuffer(b"".join(names) + bytes(24), np.uint8)
    lengths = np.array([len(x) for x in names])
    starts = np.cumsum(lengths) - lengths
    pair = [term_counts.words(joined, starts + at, lengths - at) for at in (0, 8)]
    assert [names[i] for i in term_counts.radix_order(*pair)] == sorted(names)
