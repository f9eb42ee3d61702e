import gzip
import hashlib
import json
import random
import re

import numpy as np
import pytest

from hushframe.llm import decontaminate, warc


def pages(spark):
    rng = random.Random(5)
    bodies = ["<p>" + "".join(rng.choice("abcé \n") for _ in range(n)) for n in (40, 150, 300, 99, 500)]
    html = [bodies[i % 5] for i in range(23)] + [None, "", "x" * 3_000_000, "a" * 96 + "é" * 2, "b" * 100, "b" * 100]
    rows = [(1000 - i, f"http://h/{i}\r\nX: y" if i % 7 == 0 else None if i == 3 else f"http://h/{i}", h, "z") for i, h in enumerate(html)]
    rows += [(None, "http://n", "b" * 100, "z"), (5, "http://twice", bodies[4], "z"), (5, "http://twice", bodies[4], "z")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")


def expected_record(rows, r):
    payload = (r["html"] or "").encode()
    same = [x["page_id"] for x in rows if (x["html"] or "").encode() == payload and x["page_id"] is not None]
    first = min(same) if same and len(payload) >= 100 else None
    refers = first if first is not None and r["page_id"] != first else None
    return (r["page_id"], len(payload), hashlib.sha256(payload).hexdigest(), "response" if refers is None else "revisit", refers)


def test_archive_round_trip(spark, tmp_path):
    table = pages(spark).repartition(3)
    folder = f"file://{tmp_path}/a"
    got = warc.archive(table, folder).collect()
    rows = table.collect()
    wanted = sorted((expected_record(rows, r) for r in rows), key=str)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == wanted
    by_id = {r["page_id"]: (r["html"] or "").encode() for r in rows}
    assert all(bytes(r["payload"]) == by_id[r["page_id"]] for r in got if r["record_type"] == "response")
    assert sorted(map(str, (r["page_id"] for r in warc.reread(spark, folder).collect()))) == sorted(str(r["page_id"]) for r in rows)
    mono = list((tmp_path / "a/mono").glob("mono-*.warc.gz"))
    for path in (tmp_path / "a/members").glob("part-*.warc.gz"):
        data = path.read_bytes()
        entries = [json.loads(x) for x in open(f"{path}.idx")]
        assert [e["offset"] for e in entries] == np.cumsum([0, *(e["length"] for e in entries)])[:-1].tolist()
        for e in entries:  # each member opens by itself
            assert gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n")
        source = next(m for m in mono if m.name[:11] == path.name.replace("part", "mono")[:11])
        assert gzip.decompress(data) == gzip.decompress(source.read_bytes())
        assert source.read_bytes().count(b"\x1f\x8b\x08") <= data.count(b"\x1f\x8b\x08")


def test_archive_of_an_empty_table(spark, tmp_path):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/a").count() == 0


def test_damaged_records_are_refused():
    data = warc.record(1, "u", b"x" * 10, hashlib.sha256(b"x" * 10).hexdigest(), None)
    import io

    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"junk" + data)))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(data[:-2] + b"zz")))


def brute_tiles(test, doc, least):
    """Greedy string tiling by comparing all places."""
    marked_t, marked_d, total = [False] * len(test), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(test)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(test) and j + n < len(doc) and test[i + n] == doc[j + n] and not marked_t[i + n] and not marked_d[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return total
        n, i, j = best
        for k in range(n):
            marked_t[i + k] = marked_d[j + k] = True
        total.append(n)


def test_tiles_equal_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        test = [rng.randrange(1, 6) for _ in range(rng.randrange(3, 40))]
        doc = [rng.randrange(6) for _ in range(rng.randrange(3, 40))]
        if rng.random() < 0.6:
            a, b = sorted((rng.randrange(len(test)), rng.randrange(len(test))))
            doc[len(doc) // 2 : len(doc) // 2] = test[a:b] + [0] + test[:a]
        tiles = decontaminate.greedy_tiles(np.array(test), np.array(doc), 3)
        for i, j, n in tiles:
            assert test[i : i + n] == doc[j : j + n]
        assert len({i + k for i, _, n in tiles for k in range(n)}) == len({j + k for _, j, n in tiles for k in range(n)}) == sum(n for *_, n in tiles)
        # equal lengths may be placed either way, so the longest tile and the order of lengths are compared
        brute = brute_tiles(test, doc, 3)
        assert [n for *_, n in tiles][:1] == brute[:1]
        assert [n for *_, n in tiles] == sorted((n for *_, n in tiles), reverse=True)


def fixture(spark):
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(400)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([14, 30, 60]))) for _ in range(25)] + ["too short", None, ""]
    docs = []
    for i in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([0, 50, 400]))]
        item = (items[i % 25]).split()
        kind = i % 6
        if kind == 0:
            body += item
        elif kind == 1:
            half = len(item) // 2
            body = item[half:] + body + item[:half]  # reordered
        elif kind == 2:
            body += item[: len(item) // 3]  # too little
        elif kind == 3:
            body += [w.upper() + "," for w in item]
        docs.append((i, " ".join(body), i))
    docs += [(None, items[0], 1), (900, None, 1), (901, "", 1), (902, items[1] + " tail " * 100_000, 1), (903, items[2], 1), (903, items[2], 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, ITEM_ID int"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def brute_pairs(docs, items, least, threshold):
    found = []
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    for d in docs:
        words = split(d["text"])
        seeds = {tuple(words[i : i + least]) for i in range(len(words))}
        for item in items:
            test = split(item["text"])
            if len(test) >= least and any(tuple(test[i : i + least]) in seeds for i in range(len(test) - least + 1)):
                near = {j + k for j in range(len(words)) for k in range(least) if tuple(words[j : j + least]) in {tuple(test[i : i + least]) for i in range(len(test) - least + 1)}}
                kept = [w if j in near else "" for j, w in enumerate(words)]
                n = sum(brute_tiles(test, [w for j, w in enumerate(kept) if w or (j and kept[j - 1])], least))
                if n >= threshold * len(test):
                    found.append((d["doc_id"], item["item_id"], n))
    return found


def test_contaminated_pairs_equal_brute_force(spark, monkeypatch):
    docs, items = fixture(spark)
    expected = sorted(brute_pairs(docs.collect(), items.collect(), 5, 0.6), key=str)
    got = sorted(((r["doc_id"], r["item_id"], r["matched_words"]) for r in decontaminate.find(docs, items).collect()), key=str)
    assert got == expected and len({d for d, *_ in got}) > 60
    kept = decontaminate.drop(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in docs.collect() if r["doc_id"] not in {d for d, *_ in got}), key=str)
    monkeypatch.setattr(decontaminate, "_BLOCK_BYTES", 1500)  # several blocks find the same
    assert sorted(((r["doc_id"], r["item_id"], r["matched_words"]) for r in decontaminate.find(docs, items).collect()), key=str) == expected
    assert decontaminate.drop(docs, items).count() == kept.count()


def test_decontaminate_empty_tables(spark):
    docs, items = fixture(spark)
    assert decontaminate.find(docs, items.where("false")).count() == 0
    assert decontaminate.drop(docs, items.where("false")).count() == docs.count()
    assert decontaminate.find(docs.where("false"), items).count() == 0
