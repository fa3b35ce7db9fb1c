import random
import re

import numpy as np
import pytest

from quillmill.llm import near_dedup as N
from quillmill.llm.components import connected_components
from tests_support import words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute(docs, n, percent):
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def corpus(seed):
    rnd = random.Random(seed)
    texts = [None, "", "  \n", "one", "One", "two words", "two words", "É È é", "é è é"]
    for g in range(6):
        base = words(rnd.randint(30, 90), seed * 100 + g)
        texts.append(" ".join(base))
        chain = base
        for _ in range(8):  # a chain in which each is near the one before
            chain = chain[2:] + words(2, rnd.random())
            texts.append(" ".join(chain).upper() if rnd.random() < 0.2 else "\t".join(chain))
        for _ in range(8):  # copies with edits here and there
            edit = list(base)
            for _ in range(rnd.randint(0, 4)):
                edit[rnd.randrange(len(edit))] = "edit" + str(rnd.randint(0, 99))
            texts.append(" ".join(edit))
    texts += [" ".join(words(4000, 9))] * 3
    return list(enumerate(texts))


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, make_docs, n, percent):
    docs = corpus(n)
    rows = N.near_duplicates(make_docs([t for _, t in docs], [i for i, _ in docs]), n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == brute(docs, n, percent)


def test_blocks_of_hot_buckets(spark, make_docs, monkeypatch):
    """Small limits send the same corpus through many blocks and parts."""
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "GROUP", 2)
    docs = corpus(11)
    rows = N.near_duplicates(make_docs([t for _, t in docs], [i for i, _ in docs]), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == brute(docs, 3, 85)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 100, 5000):
        s = rng.integers(0, 2**63, size).astype(np.uint64)
        sketch = N.fast_sketch(s)
        assert (sketch != np.iinfo(np.uint64).max).all() and (sketch == N.fast_sketch(s[::-1])).all()
    common = rng.integers(0, 2**63, 800).astype(np.uint64)
    a, b = (np.concatenate([common, rng.integers(0, 2**63, 100).astype(np.uint64)]) for _ in range(2))
    assert abs((N.fast_sketch(a) == N.fast_sketch(b)).mean() - 0.8) < 0.08


def test_forced_rounds_fill_what_chance_leaves(monkeypatch):
    s = np.array([5], np.uint64)
    sketch = N.fast_sketch(s)
    assert (sketch >> np.uint64(32) >= N.K).any() and (sketch >> np.uint64(32) < 2 * N.K).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 7, 8, 9)} == {1} and got[21] == 20 and {got[100 + i] for i in range(41)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_repeated_rows_null_ids_and_no_rows(spark, make_docs):
    text = " ".join(words(40, 1))
    rows = N.near_duplicates(make_docs([text, text, text, "other thing here"], [4, 4, None, 6])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows)[:2] == [("4", "4"), ("4", "4")] and len(rows) == 4
    assert N.near_duplicates(make_docs([])).collect() == []
    kept = N.drop_near_duplicates(make_docs([text, text + " more", "unrelated words stand here alone"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2] and kept.columns[-1] == "text_crc32"


def test_rows_with_equal_or_null_ids_are_linked_by_their_own_texts(spark, make_docs):
    a, b, c = (" ".join(words(40, i)) for i in (1, 2, 3))
    near = a + " more"
    rows = N.near_duplicates(make_docs([a, b, near, c, c, a], [5, 5, 2, None, None, None])).collect()
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows)
    assert got == [("2", "2", True), ("5", "2", False), ("5", "5", True), ("None", "2", False), ("None", "None", True), ("None", "None", True)]


def test_one_row_of_each_component_stays(spark, make_docs):
    """Repeated rows, null ids and extra columns with the operator's own names; rows without words all stay."""
    a, b = (" ".join(words(40, i)) for i in (1, 2))
    docs = make_docs([a, a, a + " x", a, b, b, None, "", "solo text here"], [1, 1, 0, None, None, None, 7, 7, None])
    for name in ("doc", "none", "body", "component", "near doc", "digest", "id"):
        docs = docs.withColumn(name, N.F.lit(name))
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("0", a + " x"), ("None", b), ("7", ""), ("7", ""), ("None", "solo text here")])
