import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillmill.llm import suffix_dedup as S


def brute(docs, length):
    seen = Counter(b[i : i + length] for _, b in docs for i in range(len(b) - length + 1))
    out = []
    for d, b in docs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    text = lambda k, letters="abcde ": "".join(rnd.choices(letters, k=k))
    shared = [text(rnd.randint(20, 160)) for _ in range(6)]
    docs = [text(rnd.randint(0, 120)) + "".join(rnd.choice(shared) + text(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 4))) for _ in range(n)]
    docs += [docs[3], docs[3], docs[5][:-1] + "é", "a" * 200, "ab" * 150, "", None, "日本語" * 40, text(5000)]
    hot = text(34)
    return docs + [text(9) + hot + text(9) for _ in range(40)]


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"pairs": 2}), (3, {"pairs": 2, "wide": 8, "shard_bytes": 700})])
def test_against_brute_force(spark, make_docs, seed, limits):
    texts = corpus(seed)
    shape = S.Shape(length=40, window=8, gram=4)
    rows = S.remove_repeats(make_docs(texts), shape, **({"shard_bytes": 1500} | limits)).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in rows), key=str)
    assert got == brute([(i, (t or "").encode()) for i, t in enumerate(texts)], 40)


def test_repeated_rows_null_ids_and_no_rows(spark, make_docs):
    rows = S.remove_repeats(make_docs(["q" * 10 + "0123456789" * 60] * 2 + [None], [None, 4, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in rows) == [("4", 610), ("None", 0), ("None", 610)]
    assert S.remove_repeats(make_docs([])).collect() == []


def test_every_window_holds_an_anchor():
    shape = S.Shape(length=40, window=8, gram=4)
    raw, at = S.text_bytes(pa.array(["abcabcabd" * 30, "", "zz", "x" * 100]))
    anchors = S.find_anchors(raw, at, shape)
    for a, b in zip(at[:-1], at[1:], strict=True):
        for p in range(a, b - shape.window - shape.gram + 2):
            assert ((anchors >= p) & (anchors < p + shape.window)).any()


def test_suffix_order():
    phrases = np.random.default_rng(5).integers(0, 3, 300).astype(np.uint64)
    order = S.sort_suffixes(phrases, 300)
    assert order.tolist() == sorted(range(300), key=lambda i: phrases[i:].tolist())
