import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import exact_search, hard_negatives, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, shard long, pos int, id string, best int, range int, wanted string"
END = 2**63 - 1


def scaled(vector, scale):
    """Components as 64-bit whole numbers, or None if the vector takes no part."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [max(-END - 1, min(END, math.floor(y))) if math.isfinite(y := x * scale) else (END if y > 0 else -END - 1) for x in vector]


def product(a, b):
    return max(-END, min(END, sum(x * y for x, y in zip(a, b))))  # noqa: B905  a shorter vector is filled up with zeros


def first(rows, k):
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]


def nearest(rows, k, scale, step):
    use = [(i, scaled(v, scale)) for i, v, _ in rows]
    use = [(i, v) for i, v in use if v is not None]
    out = []
    for n, (i, v) in enumerate(use):
        if i is not None and i % step == 0:
            found = first([(product(v, w), j) for m, (j, w) in enumerate(use) if m != n], k)
            out += [(i, rank, j, score) for rank, (score, j) in enumerate(found, 1)]
    return out


def mined(rows, scale, step, positives=5, negatives=10, low=30, high=90):
    use = [(i, scaled(v, scale), c) for i, v, c in rows]
    use = [x for x in use if x[1] is not None and x[2] is not None]
    out = []
    for n, (i, v, c) in enumerate(use):
        if i is None or i % step:
            continue
        others = [(product(v, w), j, d) for m, (j, w, d) in enumerate(use) if m != n]
        for ps, p in first([(s, j) for s, j, d in others if d == c], positives):
            inside = [(s, j) for s, j, d in others if d != c and low * ps <= 100 * s <= high * ps]
            out += [(i, p, rank, j, ps, s) for rank, (s, j) in enumerate(first(inside, negatives), 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, -1, -2, "x", -3, -4, None) for i, v, c in rows], SCHEMA).repartition(3)


def rows_of(kind):
    rnd = np.random.default_rng(5)
    if kind == "plain":
        return [(i, [float(x) for x in rnd.normal(size=12) / 3], int(rnd.integers(3))) for i in range(300)]
    if kind == "ties":  # few different vectors, a hot one, repeated rows and ids, no ids
        rows = [(int(i), [float(x) for x in rnd.integers(-1, 2, size=3)], int(i % 3)) for i in rnd.permutation(260)]
        return rows + [(500 + i, [1.0, 1.0, 0.0], 1) for i in range(150)] + [(20, [1.0, 0.0, 1.0], 0)] * 4 + [(None, [1.0, 1.0, 1.0], 2)] * 3 + [(-40, [0.5, 0.5, 0.5], -1)]
    if kind == "odd":  # lengths differ; nulls and what is not finite
        rows = [(i, [float(x) for x in rnd.normal(size=i % 5)], i % 2) for i in range(80)]
        return rows + [(100, None, 1), (120, [1.0, None], 1), (140, [float("nan")], 1), (160, [1.0, float("inf")], 0), (180, [1.0, 2.0], None), (200, [], 1), (220, [1e-300, -0.0], 0)]
    if kind == "large":  # beyond double precision, and beyond 64 bits
        rows = [(i, [float(x) * 10.0 ** (i % 24) for x in rnd.normal(size=4)], i % 2) for i in range(60)]
        return rows + [(100 + i, [1e300, -1e300, 1.0, float(i)], i % 2) for i in range(6)]
    return []


KINDS = ["plain", "ties", "odd", "large", "none"]


@pytest.mark.parametrize("kind", KINDS)
def test_exact_top_k_against_brute_force(spark, kind):
    rows = rows_of(kind)
    got = exact_search.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=40).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, nearest(rows, 20, 64, 20)))
    assert kind == "none" or got


@pytest.mark.parametrize("kind", KINDS)
def test_hard_negatives_against_brute_force(spark, kind):
    rows = rows_of(kind)
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, shard_rows=40).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, mined(rows, 256, 10)))
    assert kind == "none" or got


def test_many_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "RANGE", 2)
    rows = rows_of("ties")
    frame = table(spark, rows)
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    got = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0, low=100, high=30, shard_rows=12).collect()  # the other way round: for negative scores
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, mined(rows, 256, 10, low=100, high=30)))
    got = exact_search.top_k(frame, F.col("vec_id") % 20 == 0, k=3, shard_rows=8).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, nearest(rows, 3, 64, 20)))


def test_alone_and_fewer_than_k(spark):
    assert exact_search.top_k(table(spark, [(0, [1.0], 1)]), F.col("vec_id") == 0).collect() == []
    got = exact_search.top_k(table(spark, [(0, [1.0], 1), (7, [2.0], 1)]), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 7, 64 * 128)]
    assert hard_negatives.mine(table(spark, [(0, [1.0], 1), (7, [2.0], 2)]), F.col("vec_id") == 0).collect() == []


def searched(matrix, labels, wanted, wanted_labels, low, high, k, same):
    order, centers, radii = vectors.ball_tree(matrix)
    row = {"shard": 0, "ids": [int(i) for i in order], "labels": [int(c) for c in labels[order]], "width": matrix.shape[1], "most": vectors.size_of(matrix), "kind": "int64"}
    row |= {"matrix": matrix[order].tobytes(), "centers": centers.tobytes(), "radii": radii, "wanted": None}
    search = hard_negatives.Search(vectors.Shards(pa.Table.from_pylist([row])), wanted, wanted_labels, low, high, k, same)
    search.over(0, np.full(len(wanted), -1), np.zeros(len(wanted), int))
    return search


def test_trees_leave_out_what_cannot_count():
    rnd = np.random.default_rng(1)
    centers = rnd.integers(-400, 400, (40, 8))
    matrix = (centers[rnd.integers(0, 40, 4000)] + rnd.integers(-9, 10, (4000, 8))).astype(np.int64)
    labels, wanted, own = rnd.integers(0, 4, 4000), matrix[:30], rnd.integers(0, 4, 30)
    for same, low, high in ((True, np.full(30, 1 - 2**63), np.full(30, END)), (False, np.full(30, 60_000), np.full(30, 90_000))):
        search = searched(matrix, labels, wanted, own, low, high, 5, same)
        scores = wanted @ matrix.T
        fits = ((labels[None] == own[:, None]) == same) & (scores >= low[:, None]) & (scores <= high[:, None])
        want = [sorted((-s, i) for i, s in enumerate(scores[q]) if fits[q, i])[:5] for q in range(30)]
        got = [[(-int(s), int(search.shards.ids[r])) for s, r in zip(search.scores[q], search.ranks[q], strict=True) if s != vectors.NONE] for q in range(30)]
        assert got == [[(int(a), b) for a, b in w] for w in want]
    one = searched(matrix, labels, wanted[:1], own[:1], np.full(1, 1 - 2**63), np.full(1, END), 5, True)
    assert one.seen < one.leaves / 4
    none = searched(matrix, np.zeros(4000, int), wanted, np.zeros(30, int), np.full(30, 1 - 2**63), np.full(30, END), 5, False)
    assert none.seen == 0


def test_balls_hold_their_rows():
    rnd = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 500):
        matrix = rnd.integers(-1000, 1000, (n, 5))
        order, centers, radii = vectors.ball_tree(matrix)
        assert sorted(order) == list(range(n))
        node = 0
        for level in range(vectors.levels_of(n) + 1):
            at = vectors.edges(n, level)
            for low, high in zip(at, at[1:], strict=False):
                assert high - low <= 64 or level < vectors.levels_of(n)
                assert (((matrix[order[low:high]] - centers[node]) ** 2).sum(axis=1) <= radii[node] ** 2).all()
                node += 1
        assert node == len(radii)
