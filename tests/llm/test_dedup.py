import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hushframe.llm import exact_dedup, graph, simhash

SCHEMA = "doc_id long, text string, keep_id string, DOC_ID_2 int"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "x", i) for i, t in enumerate(texts)], SCHEMA)


def brute_fingerprint(text, words=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                parts.append(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return [least[find(i)] for i in range(len(ids))]


def test_exact_dedup_flags(spark):
    texts = ["a  b", "a b", "a\tb", None, "", " ", "\x0b", "a b", "A b", "x" * 200_000, "x" * 200_000, "z"] * 2 + ["solo"]
    got = {r["doc_id"]: r for r in exact_dedup.flag(frame(spark, texts)).collect()}
    import hashlib
    import re

    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(normal):
        group = [j for j, u in enumerate(normal) if u == t]
        assert got[i].asDict() == {
            "doc_id": i, "keep_id": group[0], "group_size": len(group), "kept": i == group[0], "text_sha256": hashlib.sha256(t.encode()).hexdigest(),
        }
    assert len(got) == len(texts)


def test_exact_dedup_drop_keeps_one_row_with_all_columns(spark):
    rows = [(1, "a b", "k", 1), (1, "a  b", "k", 2), (2, "a b", "k", 3), (None, "n", "k", 4), (None, "n", "k", 5), (3, None, "k", 6), (4, "", None, 7), (5, "only", "k", 8)]
    kept = exact_dedup.drop(spark.createDataFrame(rows, "doc_id long, text string, digest string, again int"))
    assert kept.columns == ["doc_id", "text", "digest", "again"]
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 5]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.drop(empty).count() == 0 and exact_dedup.flag(empty).count() == 0


def test_exact_dedup_plan_has_no_python(spark):
    plan = exact_dedup.flag(frame(spark, ["a", "b", "a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_filter_lets_most_single_rows_pass(spark):
    marks = spark.range(20_000).select(F.col("id").alias("ident"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    doubled = marks.unionByName(marks.where("id < 100").select((F.col("ident") + 50_000).alias("ident"), "digest"))
    probed = exact_dedup._probe(doubled, doubled, "digest")
    assert probed.where("again and ident < 100").count() == 100
    assert probed.where("again").count() < 1_500


@pytest.mark.parametrize("text", ["", None, "one", "A b C", "Grüße ÄÖ aus dem x\x1fy z", "a b c d e f g a b c d " * 50])
def test_fingerprint_is_the_brute_force_one(text):
    assert simhash.fingerprint((text or "").encode(), 4) == brute_fingerprint(text)


def near_texts(seed=1):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts + ["", None, "  ", "word", "word"]


@pytest.mark.parametrize("crowd", [2048, 3])
def test_components_equal_brute_force(spark, crowd):
    texts = near_texts()
    ids = [1000 - i for i in range(len(texts))]
    ids[5] = None
    docs = spark.createDataFrame([(d, t, 1) for d, t in zip(ids, texts)], "doc_id long, text string, component_id int")
    fps = [brute_fingerprint(t) for t in texts]
    expected = sorted(zip(ids, [f"{f:016x}" for f in fps], brute_components(ids, fps)), key=str)
    got = sorted((tuple(r) for r in simhash.components(docs, crowd=crowd).collect()), key=str)
    assert got == expected
    kept = [r["doc_id"] for r in simhash.drop(docs).collect()]
    assert set(kept) == {c for _, _, c in expected} | {None}


def test_components_of_an_empty_table(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_finds_all_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.int64)
    more = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, k, replace=False)) for b in base[:100] for k in (1, 3, 4, 5)]
    values = sorted({int(x) for x in base} | set(more))
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {tuple(r) for r in simhash.links_within(fps, 4).collect()}
    expected = {(a, b) for a in values for b in values if a > b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    assert got == expected


def test_thresholds_sum_up_and_grow_uneven(spark):
    rng = np.random.default_rng(5)
    bits = rng.random((5000, 64)) < 0.5
    bits[:, 1] = bits[:, 0]
    x = bits.astype(float)
    for n in (10**3, 10**6, 10**9):
        plan = simhash.plan_index(x.T @ x * n / 5000, n, 4)
        assert sum(t + 1 for _, t in plan) == 5
        assert sorted(b for g, _ in plan for b in g) == list(range(64)) or any(t < 0 for _, t in plan)
    assert any(0 in g and 1 in g for g in simhash.correlated_groups(x.T @ x, 5000, 5))
    assert max(t for _, t in plan) > 0


def test_smallest_reachable_on_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 200)] + [(300, 300), (-5, 7000)]
    got = {r["node"]: r["root"] for r in graph.smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 200)}, -5: -5, 7000: -5}


def test_drop_keeps_a_document_of_each_group_when_ids_repeat(spark):
    rng = random.Random(21)
    a, b = (" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta"]) + str(rng.randrange(50)) for _ in range(80)) for _ in range(2))
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.drop(docs).collect())) == sorted([(3, a), (5, b)])
