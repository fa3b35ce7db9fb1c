import random
import re
from collections import Counter

from quillmill.llm import decontaminate as D
from tests_support import words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def brute(docs, items, threshold=0.8, n=5):
    out = {}
    for d, text in docs:
        w = split(text)
        for item, body in items:
            size = len(split(body))
            if not size:
                continue
            k = min(n, size)
            gold = Counter(tuple(split(body)[i : i + k]) for i in range(size - k + 1))
            for p in range(len(w) - size + 1):
                window = Counter(tuple(w[p + i : p + i + k]) for i in range(size - k + 1))
                both = sum((window & gold).values())
                similarity = both / (2 * (size - k + 1) - both)
                if similarity >= threshold:
                    best = out.setdefault((d, item), [similarity, p, 0])
                    best[2] += 1
                    if similarity > best[0]:
                        best[:2] = similarity, p
    return out


def test_against_brute_force(spark, make_docs):
    rnd = random.Random(4)
    items = [(i, " ".join(words(rnd.randint(12, 60), i))) for i in range(12)] + [(90, "tiny item"), (91, "one"), (92, ""), (93, None), (94, " ".join(["rep"] * 30))]
    docs = []
    for i in range(80):
        body = words(rnd.randint(0, 80), 1000 + i)
        if i % 3 == 0:
            passage = split(items[i % 12][1])
            for _ in range(rnd.randint(0, 2)):
                passage[rnd.randrange(len(passage))] = "changed"
            at = rnd.randint(0, len(body))
            body = body[:at] + passage + body[at:]
        docs.append((i, (" " if i % 2 else "\n").join(body).upper() if i % 5 == 0 else " ".join(body)))
    docs += [(200, None), (201, ""), (202, "a tiny item here"), (203, "one"), (204, " ".join(["rep"] * 300)), (205, " ".join(words(30000, 77)) + " " + items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): [r["similarity"], r["first_word"], r["n_windows"]] for r in D.contaminated(make_docs([t for _, t in docs], [i for i, _ in docs]), bench).collect()}
    assert got == brute(docs, items)
    kept = D.drop_contaminated(make_docs([t for _, t in docs], [i for i, _ in docs]), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {d for d, _ in got}


def test_block_tables_miss_nothing_within_the_radius_and_reject_most_items():
    import numpy as np

    rng = np.random.default_rng(1)
    (g,) = D._items([(i, rng.integers(0, 2**63, 30).astype(np.uint64)) for i in range(200)], 5)
    near = []
    for k in range(20):
        for distance in [D.RADIUS] * 30 + list(range(0, D.RADIUS, 3)):
            bits = np.zeros(D.BITS, np.uint8)
            bits[rng.choice(D.BITS, distance, replace=False)] = 1
            near.append((k, g.prints[k] ^ np.packbits(bits)))
    window, item = g.candidates(np.array([p for _, p in near]))
    found = set(zip(window.tolist(), item.tolist(), strict=True))
    assert all((w, k) in found for w, (k, _) in enumerate(near))
    others = D.window_simhashes(rng.integers(0, 2**63, 2000).astype(np.uint64), g.shingles)
    assert len(g.candidates(others)[0]) / (len(others) * len(g.ids)) < 0.05


def test_items_in_parts(spark, make_docs, monkeypatch):
    items = [(i, " ".join(words(20, i))) for i in range(9)]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    docs = make_docs([f"before {t} after" for _, t in items] + ["clean words only", None], [*range(9), 3, None])
    whole = sorted(D.contaminated(docs, bench).collect())
    monkeypatch.setattr(D, "PART_WORDS", 40)
    assert sorted(D.contaminated(docs, bench).collect()) == whole and len(whole) == 9
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in D.drop_contaminated(docs, bench).collect()) == [(0, ""), (3, "clean words only")]


def test_time_a_document_does_not_grow_with_the_items():
    """Work is done for the sizes that share a shingle with the document, not for all items."""
    import numpy as np

    rng = np.random.default_rng(2)
    visited = []
    for n in (200, 10_000):
        groups = D._items([(i, rng.integers(0, 2**63, 15 + i % 45).astype(np.uint64)) for i in range(n)], 5)
        index = D.Index(groups, 5)
        mine = np.fromiter(groups[3].counts[0], np.uint64)
        visited.append([k for k, _ in index.by_group(mine)])
    assert visited == [[3], [3]]


def test_no_rows(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminated(make_docs(["a b c d e f"]), none).collect() == []
    assert D.contaminated(make_docs([]), some).collect() == []
    assert [r["similarity"] for r in D.contaminated(make_docs(["x a b c d e f y"], [None]), some).collect()] == [1.0]


def brute_short(docs, items, threshold=0.8, n=5):
    """Documents of fewer words than the item: the whole document is its one window."""
    out = {}
    for d, text in docs:
        w = split(text)
        for item, body in items:
            g = split(body)
            k = min(n, len(g))
            if len(w) < len(g):
                mine, gold = (Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (w, g))
                both = sum((mine & gold).values())
                similarity = both / (sum(mine.values()) + sum(gold.values()) - both)
                if similarity >= threshold:
                    out[d, item] = [similarity, 0, 1]
    return out


def test_documents_shorter_than_the_item(spark, make_docs):
    items = [(i, " ".join(words(n, i))) for i, n in enumerate([60, 60, 30, 14, 9, 5, 4, 1])] + [(90, " ".join(["rep"] * 40)), (91, " ".join(words(60, 0))), (0, " ".join(words(59, 0)))]
    texts = [None, "", " ".join(["rep"] * 36), " ".join(["rep"] * 35), " ".join(["rep"] * 4)]
    for _, body in items:
        w = split(body)
        texts += [" ".join(x) for x in (w[:-1], w[1:], w[: len(w) // 2] + w[len(w) // 2 + 1 :], w[:-12], w[:-11], w[:-2], ["new", *w[2:]], w[: len(w) // 2])]
    docs = list(enumerate(texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contaminated(make_docs(texts), bench).collect()
    got = {(r["doc_id"], r["item_id"]): [r["similarity"], r["first_word"], r["n_windows"]] for r in rows}
    assert len(got) == len(rows)
    want = brute(docs, [x for x in items if x[0]])
    for key, x in brute_short(docs, [x for x in items if x[0]]).items():
        want.setdefault(key, x)
    assert {k: x for k, x in got.items() if k[1]} == want
    assert got[5, 0][0] == 1.0 and got[5, 91][0] == 55 / 56 and got[7, 91][0] == 51 / 60
    assert {r["doc_id"] for r in D.drop_contaminated(make_docs(texts), bench).collect()}.isdisjoint(d for d, _ in got)


def test_rows_with_a_null_id_are_judged_by_their_text(spark, make_docs):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    kept = D.drop_contaminated(make_docs(["x a b c d e f y", "clean text", None, "x a b c d e f y", "other"], [None, None, None, 4, 5]), items)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (0, "clean text"), (5, "other")]
