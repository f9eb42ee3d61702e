import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from hushframe.llm import kneser_ney as kn
from hushframe.llm.common import SLICE_BYTES
from test_archives_and_tiles import brute_pairs
from test_dedup import brute_components, brute_fingerprint
from test_quality import brute_running_model, predictions

public_tokenizers = pytest.importorskip("public_tokenizers")


def fixture(spark, folder):
    rng = random.Random(12)
    parts = ["th", "an", "er", "ou", "ing", "a", "st"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.choice([2, 3, 4])))
    text = lambda n: " ".join(word() + rng.choice(["", "", "", "."]) for _ in range(n))
    items = [text(20) for _ in range(5)]
    texts = [text(rng.choice([30, 60, 120])) for _ in range(70)]
    texts += [t.replace(" ", "  ") for t in texts[:6]]  # equal but for white space
    for t in texts[10:16]:  # near copies
        words = t.split()
        words[-1] = word()
        texts.append(" ".join(words))
    texts += [f"{text(15)} {item} {text(15)}" for item in items]
    texts += [" ".join(w.upper() + "!!" for w in text(40).split()) for _ in range(6)] + [" ".join(w + "%%%" for w in text(40).split()) for _ in range(4)]
    texts += [None, "", " ", texts[3], text(6000)]
    own = len(texts)
    texts += [text(25) for _ in range(130)]  # enough trusted texts of "xx" to set its limit; "yy" has few
    rows = [(i, t, "xx" if i % 3 or i >= own else "yy", "s", len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, 0) for i in [*range(0, 70, 2), *range(own, len(texts))]] + [(1, 0, 0), (5, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def brute_quality(docs, trusted):
    """The running-text model of trusted texts, and limits from those set apart where a language has enough of them."""
    known = [r for r in docs if r["doc_id"] in trusted]
    in_quarter = lambda r: xxhash.xxh64((r["text"] or "").encode(), seed=42).intdigest() % 4 == 0
    apart_texts = {lang: {r["text"] for r in known if r["lang"] == lang and in_quarter(r)} for lang in {r["lang"] for r in docs}}
    able = {lang for lang, texts in apart_texts.items() if len(texts) >= kn.LEAST_APART}
    assert able and set(apart_texts) - able  # the fixture has both kinds
    limits, logs = {}, {}
    for lang in apart_texts:
        own = [r for r in docs if r["lang"] == lang]
        apart = [r for r in known if r["lang"] == lang and lang in able and in_quarter(r)]
        p = brute_running_model([r["text"] or "" for r in known if r["lang"] == lang and not (lang in able and in_quarter(r))], kn.ORDER)

        def score(text):
            found = [p(context, c) for context, c in predictions(text or "")]
            return (-sum(map(math.log, found)) / len(found), len(found)) if found else None

        logs |= {r["doc_id"]: score(r["text"]) for r in own}
        based = {(round(x[0], 6), x[1]) for x in (score(r["text"]) for r in (apart or own)) if x}
        rank = lambda values, q: sorted(values)[max(1, math.ceil(q * len(values))) - 1]
        low, high = (rank([x for x, _ in based], q) for q in (0.25, 0.75))
        limits[lang] = high, max(high - low, kn.LEAST_SPREAD), rank([n for _, n in based], 0.5)
    kept = []
    for r in docs:
        upper, spread, median = limits[r["lang"]]
        found = logs[r["doc_id"]]
        if found is None or found[0] <= upper + kn.FENCE * spread * max(1, math.sqrt(median / found[1])) + 1e-6:
            kept.append(r)
    return kept


def brute_stages(docs, items, trusted):
    docs = brute_quality(docs, trusted)
    yield docs
    first = {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        first.setdefault(" ".join(x for x in ("x" + (r["text"] or "") + "x").split()), r)
    docs = list(first.values())
    yield docs
    roots = brute_components([r["doc_id"] for r in docs], [brute_fingerprint(r["text"]) for r in docs])
    docs = [r for r, root in zip(docs, roots) if r["doc_id"] == root]
    yield docs
    bad = {d for d, _, _ in brute_pairs(docs, items, 5, 0.6)}
    yield [r for r in docs if r["doc_id"] not in bad]


def test_stages_equal_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    fixture(spark, folder)
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    first = read("documents")
    trusted = {r["doc_id"] for r in read("labels").collect() if r["quality"] == 1 and r["toxic"] == 0}
    docs, before = first, first.count()
    wanted = brute_stages(first.collect(), read("benchmark").collect(), trusted)
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], wanted):
        stage(spark, docs, folder).write.parquet(f"{folder}/after-{name}")
        docs = spark.read.parquet(f"{folder}/after-{name}")
        assert docs.columns == first.columns
        assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r["doc_id"] for r in expected), name
        assert len(expected) < before  # each stage drops something
        before = len(expected)
    kept = {r["doc_id"] for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p["doc_id"] for p in pieces} == kept
    total = defaultdict(int)
    for p in pieces:
        total[p["doc_id"]] += p["length"]
        assert len(p["ids"]) == 4 * p["length"]
    assert all(total[p["doc_id"]] == p["doc_tokens"] for p in pieces)
    assert np.sum(list(total.values())) > 6000


def test_empty_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    fixture(spark, folder)
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_stages_hand_bounded_batches_to_tasks(spark, tmp_path):
    """10,000 rows of long texts would reach each task at once otherwise, and stand whole in the worker's memory."""
    folder = f"file://{tmp_path}/in"
    fixture(spark, folder)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(limit, None)
    spark.conf.unset(limit)
    try:
        docs = spark.range(2000, numPartitions=1).selectExpr("id as doc_id", "repeat('x', 5000) as text")
        sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
        for _, stage in corpus_pipeline.STAGES[2:]:
            stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 2 * SLICE_BYTES
            spark.conf.unset(limit)
        spark.conf.set(limit, "123456")  # a limit of the session's own stays
        corpus_pipeline.packed(spark, docs, folder)
        assert spark.conf.get(limit) == "123456"
    finally:
        spark.conf.unset(limit) if own is None else spark.conf.set(limit, own)
