import math

import numpy as np
import pytest

from hushframe.llm import grids, negatives, topk

IS_QUERY = "id % 100 = 0"
NAN, INF = float("nan"), float("inf")


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def whole(vector, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))  # a missing component counts as zero


def last(ident):
    return (ident is None, ident or 0)


def brute_search(rows, k, scale):
    kept = [(ident, whole(v, scale)) for ident, v in rows if usable(v)]
    out = []
    for i, (ident, vector) in enumerate(kept):
        if ident is None or ident % 100:
            continue
        scored = sorted(((-dot(vector, w), last(other), other) for j, (other, w) in enumerate(kept) if j != i))
        out += [(ident, rank, other, -score) for rank, (score, _, other) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def brute_mine(rows, k, n, low, high, scale):
    kept = [(ident, label, whole(v, scale)) for ident, label, v in rows if usable(v) and label is not None]
    out = []
    for i, (ident, label, vector) in enumerate(kept):
        if ident is None or ident % 100:
            continue
        scored = [(-dot(vector, w), last(other), other, mark) for j, (other, mark, w) in enumerate(kept) if j != i]
        scored.sort(key=lambda x: x[:2])
        for x in [x for x in scored if x[3] == label][:k]:
            found = [y for y in scored if y[3] != label and low * -x[0] <= -100 * y[0] <= high * -x[0]][:n]
            out += [(ident, x[2], rank, y[2], -x[0], -y[0]) for rank, y in enumerate(found, 1)]
    return sorted(out, key=str)


def table(count, seed=3, width=12):
    draw = np.random.default_rng(seed)
    rows = [(i, int(draw.integers(4)), [float(x) for x in draw.normal(size=width).astype(np.float32)]) for i in range(count)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(30)]  # copies: ties
    rows += [(1100, 1, rows[0][2]), (200, 2, rows[200][2]), (200, None, rows[5][2]), (None, 3, rows[7][2]), (None, 3, rows[7][2])]
    rows += [(1200, 1, None), (1300, 1, []), (1400, 0, [0.0] * width), (1500, 2, [None, 1.0]), (1600, 2, [NAN]), (1700, 1, [INF, 1.0])]
    rows += [(1800, 0, [1.0, -2.0, 0.001]), (1900, 3, [0.5] * (width + 3)), (-100, 1, [-1.0] * width)]
    return rows


SCHEMA = "vec_id long, label int, embedding array<float>, ID string, Vector string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", "y", 1) for i, label, v in rows], SCHEMA).repartition(3)


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(grids, "LANE", 64)
    monkeypatch.setattr(grids, "GROUP", 4)


def test_top_k_equals_brute_force(spark, small_cells):
    rows = table(320)
    for k, scale in ((10, 1024), (3, 2), (1000, 1024)):
        got = topk.search(frame(spark, rows), IS_QUERY, k, scale).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_search([(i, v) for i, _, v in rows], k, scale)


def test_top_k_of_few_or_no_rows(spark):
    assert topk.search(frame(spark, []), IS_QUERY).count() == 0
    assert topk.search(frame(spark, [(1, 0, [1.0])]), IS_QUERY).count() == 0
    assert topk.search(frame(spark, [(100, 0, [1.0])]), IS_QUERY).count() == 0
    got = topk.search(frame(spark, [(100, 0, [1.0]), (7, 0, [-1.5])]), IS_QUERY, 10, 1024).collect()
    assert [tuple(r) for r in got] == [(100, 1, 7, -1536 * 1024)]


def test_scores_beyond_float64_are_exact(spark):
    rows = [(100, 0, [3001.5, 8191.25]), (1, 0, [1000003.0, 7.0]), (2, 0, [1000003.0, 7.0009765625])]
    got = topk.search(frame(spark, rows), IS_QUERY, 10, 1024).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_search([(i, v) for i, _, v in rows], 10, 1024)
    with pytest.raises(Exception, match="too large"):
        topk.search(frame(spark, [(100, 0, [3e38]), (1, 0, [1.0])]), IS_QUERY).collect()


def test_postings_keep_long_lists_whole():
    lane = np.array([[1, 0, 3], [2, 0, 0], [4, 5, 0]])
    lists = topk.postings(lane)
    assert lists[0][0] == slice(None) and lists[1][0].tolist() == [2] and lists[2][0].tolist() == [0]
    scores, work = np.empty(3, np.int64), np.empty(3, np.int64)
    topk.accumulate(np.array([2, -1, 0]), lists, scores, work)
    assert scores.tolist() == [2, 4, 3]


def test_best_breaks_ties_by_place():
    scores = np.array([5, 9, 5, 5, 9, 1])
    assert topk.best(scores, 3).tolist() == [1, 4, 0]
    assert topk.best(scores, 9).tolist() == [1, 4, 0, 2, 3, 5]


def test_hard_negatives_equal_brute_force(spark, small_cells):
    rows = table(320)
    for k, n, low, high, scale in ((5, 10, 30, 90, 256), (2, 3, -50, 100, 8), (400, 500, 30, 90, 256)):
        got = negatives.mine(frame(spark, rows), IS_QUERY, k, n, low, high, scale).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_mine(rows, k, n, low, high, scale)


def test_hard_negatives_of_few_or_no_rows(spark):
    for rows in ([], [(100, 0, [1.0])], [(100, 0, [1.0]), (1, 1, [0.5])], [(100, 0, [1.0]), (1, 0, [0.5])], [(1, 0, [1.0])]):
        assert negatives.mine(frame(spark, rows), IS_QUERY).count() == 0
    got = negatives.mine(frame(spark, [(100, 0, [1.0]), (1, 0, [0.5]), (2, 7, [0.45]), (3, 7, [0.4501])]), IS_QUERY).collect()
    assert [tuple(r) for r in got] == [(100, 1, 1, 2, 256 * 128, 256 * 115), (100, 1, 2, 3, 256 * 128, 256 * 115)]


def test_products_in_residues_are_exact():
    draw = np.random.default_rng(1)
    for width, size in ((1, 5), (64, 300), (2500, 90), (700, 200_000)):
        lane, asked = draw.integers(-size, size, (40, width)), draw.integers(-size, size, (7, width))
        lane[0], asked[0], asked[1] = size, size, -size
        primes = negatives.primes_for(lane, asked)
        assert (negatives.Products(lane, primes).of(asked) == asked @ lane.T).all()
    assert negatives._span(251) * (251 // 2) ** 2 < 2**24
    with pytest.raises(OverflowError):
        negatives.primes_for(np.array([[2**31]]), np.array([[2**31]]))


def test_cells_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(grids, "LANE", 50)
    monkeypatch.setattr(grids, "GROUP", 8)
    rows = topk.numbered(frame(spark, [(100, 1, [1.0])] * 400 + [(7, 1, [1.0])] * 200), 1, "vec_id", "embedding")
    import pyarrow as pa

    schema = pa.schema([("rows", pa.int64()), ("queries", pa.int64())])
    asked = rows.where(IS_QUERY)

    def sizes(a, b):
        return pa.table([[a.num_rows], [b.num_rows]], schema=schema)

    got = grids.in_cells(rows, asked, 600, 400, sizes, schema).collect()
    assert len(got) == 12 * 50 and max(r["rows"] for r in got) <= 54 and max(r["queries"] for r in got) <= 12
