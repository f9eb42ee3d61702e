import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe.llm import packing, token_files
from hushframe.llm.huffman import CHECKPOINT, Code, code_lengths
from hushframe.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
SIGNS = ["a", "B", "'s", "é", "1", "中", "́", "!", " ", "\n", "\t", "  ", "\x1c", " ", "Ǆ", "ﬁ", "İ", "_", "it's", "<|endoftext|>"]


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_the_whole_text(name):
    encoder = Encoder(public_tokenizers.path(name), 2, most=3000)
    rng = random.Random(4)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += [" ".join("".join(rng.choice(SIGNS[:8]) for _ in range(rng.randrange(1, 5))) for _ in range(9)) for _ in range(4000)]
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        ids, n = encoder.encode(part)
        expected = [[*e.ids, 2] for e in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == expected
    assert len(encoder.known) < 6000
    assert [len(x) for x in encoder.encode([])] == [0, 0]


def kraft(lengths):
    return sum(2.0 ** -int(x) for x in lengths if x)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=60))
def test_code_lengths_are_optimal(counts):
    import heapq

    lengths = code_lengths(np.array(counts))
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        best += both
        heapq.heappush(heap, both)
    if sum(c > 0 for c in counts) > 1:
        assert kraft(lengths) == 1
        if max(lengths) < 16:
            assert sum(c * int(x) for c, x in zip(counts, lengths)) == best
    assert all((x > 0) == (c > 0) for c, x in zip(counts, lengths))


def test_lengths_stay_within_the_limit():
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(sum(fibonacci[-2:]))
    lengths = code_lengths(np.array(fibonacci))
    assert lengths.max() == 16 and kraft(lengths) == 1
    assert code_lengths(np.ones(70_000, int)).max() == 17


@pytest.mark.parametrize("n", [0, 1, 5, CHECKPOINT, CHECKPOINT + 1, 20_000])
def test_blocks_decode_as_encoded(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 5000
    code = Code(code_lengths(np.bincount(ids, minlength=5001)))
    packed, offsets = code.encode(ids)
    assert (code.decode(packed, offsets, n) == ids).all()
    if n > CHECKPOINT:  # from a checkpoint on
        assert (code.decode(packed, offsets[1:], n - CHECKPOINT) == ids[CHECKPOINT:]).all()


def documents(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "tion", "Größe", "x.", "\n", "?"]) for _ in range(rng.choice([1, 40, 900]))) for _ in range(60)]
    texts += [None, "", "same", "same", "long word " * 40_000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3], ids[7] = None, ids[8]
    return spark.createDataFrame([(d, t, "x") for d, t in zip(ids, texts)], "doc_id long, text string, start string").repartition(5)


def whole(name, text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, tmp_path):
    docs = documents(spark)
    token_files.write(docs, f"file://{tmp_path}/t", public_tokenizers.path(FILES[0]))
    got = token_files.read(spark, f"file://{tmp_path}/t").select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    got = sorted((tuple(r) for r in got), key=lambda r: r[1])
    rows = docs.collect()
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in got) == sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(e := whole(FILES[0], r["text"])), crc(e)) for r in rows)
    order = [r[0] if r[0] is not None else -1 for r in got]
    assert order == sorted(order)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert any(f.endswith(".ids") for f in os.listdir(tmp_path / "t"))


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/t", public_tokenizers.path(FILES[0]))
    assert token_files.read(spark, f"file://{tmp_path}/t").count() == 0


def test_packing_covers_each_id_once(spark):
    docs = documents(spark)
    pieces = packing.pack_documents(docs, public_tokenizers.path(FILES[1])).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    rows = docs.collect()
    for r in rows:
        if sum(x["doc_id"] == r["doc_id"] for x in rows) == 1:
            own = sorted(by_doc[r["doc_id"]], key=lambda p: p["start"])
            expected = whole(FILES[1], r["text"])
            assert b"".join(bytes(p["ids"]) for p in own) == np.array(expected, "<u4").tobytes()
            assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
            assert {p["doc_tokens"] for p in own} == {len(expected)}
    for spans in by_sequence.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist()
        total = sum(n for _, n in spans)
        assert total == 4096 or total & (total - 1) == 0 and total < 4096
    assert packing.pack_documents(docs.where("false"), public_tokenizers.path(FILES[1])).count() == 0


def test_pieces_go_to_the_cheapest_sequence_with_room():
    pieces = packing.pack(np.array([4000, 96, 2000, 2000, 96]), 4096, 1.0, 1.0)
    assert pieces[:3] == [(0, 0, 4000, 0, 0), (2, 0, 2000, 1, 0), (3, 0, 2000, 1, 2000)]
    lengths = np.random.default_rng(2).integers(1, 900, 4000)
    cost = np.zeros(len(packing.capacities(int(lengths.sum()), 4096)))
    for _, _, n, to, _ in packing.pack(lengths, 4096, 1.0, 1 / 2048):
        cost[to] += n + n * n / 2048
    full = cost[: int(lengths.sum()) // 4096]
    assert full.max() < 1.25 * full.mean()


@pytest.mark.parametrize("name", FILES)
def test_added_tokens_get_their_own_id(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    fresh = Tokenizer.from_file(path)
    end = fresh.token_to_id("<|endoftext|>")
    texts = ["<|endoftext|>", "one two<|endoftext|>three", "a <|endoftext|> b\nc", "<|startoftext|>x <|ENDOFTEXT|>", "<|endof text|>", "plain words <| here"]
    ids, n = Encoder(path, 2, most=3000).encode(texts * 2)
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [[*e.ids, 2] for e in fresh.encode_batch(texts * 2, add_special_tokens=False)]
    assert got[0] == [end, 2] and all(end in x for x in got[:3])


def test_packing_does_not_depend_on_batches_or_caches(spark, monkeypatch):
    from hushframe.llm import common

    docs = documents(spark).coalesce(1)
    path = public_tokenizers.path(FILES[1])

    def packed(**more):
        return [tuple(r) for r in packing.pack_documents(docs, path, group=3000, length=512, **more).collect()]

    first = packed()
    sequences = {}
    for p in first:
        sequences.setdefault(p[4], []).append(p[2])
    assert len({s for s, own in sequences.items() if sum(own) < 512}) > 3  # several groups
    monkeypatch.setattr(common.slices, "__defaults__", (500,))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert packed(pieces=50) == first
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packing_hands_groups_on_in_parts(spark, monkeypatch):
    """A group's ids are not made once more as a whole; parts and slices of any size give the same pieces."""
    docs = documents(spark).coalesce(1)
    path = public_tokenizers.path(FILES[1])

    def packed():
        return [tuple(r) for r in packing.pack_documents(docs, path, group=3000, length=512).collect()]

    first = packed()
    monkeypatch.setattr(packing, "_OUT_AT_ONCE", 700)
    monkeypatch.setattr(packing, "_ENCODED_AT_ONCE", 500)
    assert packed() == first
    n = np.array([512] * 9 + [3])
    parts = list(packing._packed([pa.array(range(10))], [n], np.arange(n.sum(), dtype="<u4"), 512, 1.0, 1 / 2048, 0))
    assert len(parts) > 3 and max(sum(p.column("length").to_pylist()) for p in parts) <= 700 + 512
    pieces = [p for part in parts for p in part.to_pylist()]
    at = sorted((512 * p["doc_id"] + p["start"], p["length"], p["ids"]) for p in pieces)
    assert sum(length for _, length, _ in at) == n.sum()
    assert b"".join(ids for *_, ids in at) == np.arange(n.sum(), dtype="<u4").tobytes()
