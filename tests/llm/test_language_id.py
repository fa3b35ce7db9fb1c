import zlib

import numpy as np

from quillmill.llm import language_id as L
from tests_support import words

TEXTS = {"aa": "abcdefg", "bb": "mnopqrs", "cc": "éèüöäß"}


def labelled(make_docs, n=150):
    texts, langs = [], []
    for i in range(n):
        lang = sorted(TEXTS)[i % 3]
        texts.append(" ".join(words(30, i, TEXTS[lang])))
        langs.append(lang)
    texts += [None, "", "123 -- !!", words(30000, 5, TEXTS["aa"])[0] * 20000, texts[0]]
    langs += ["aa", "bb", None, None, None]
    return make_docs(texts, langs=langs), texts, langs


def test_held_out_accuracy_and_edges(spark, make_docs):
    docs, texts, langs = labelled(make_docs)
    rows = {r["doc_id"]: r for r in L.identify(docs).collect()}
    assert len(rows) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(rows[i]["lang_pred"] == langs[i] for i in range(150) if rows[i]["held_out"])
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert [rows[150 + k]["lang_pred"] for k in range(5)] == ["und", "und", "und", "aa", rows[0]["lang_pred"]]
    assert rows[150]["score"] == 0.0
    assert {r["doc_id"] for r in L.drop_undetermined(docs).collect()} == set(range(len(texts))) - {150, 151, 152}


def test_labels_and_ids_are_not_inputs(spark, make_docs):
    docs, texts, langs = labelled(make_docs)
    model = L.fit(*L.training_sample(docs, ~L.held_out()))
    a = {r["doc_id"]: r["lang_pred"] for r in L.predict_language(docs, model).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in L.predict_language(docs.selectExpr("doc_id + 1000 as doc_id", "text"), model).collect()}
    assert {i + 1000: x for i, x in a.items()} == b


def test_accuracy_on_the_documents(spark, data):
    joined = L.query(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in joined]) >= 0.95


def test_few_or_no_labels(spark, make_docs):
    assert [r["lang_pred"] for r in L.identify(make_docs(["abc"], langs=[None])).collect()] == ["und"]
    assert {r["lang_pred"] for r in L.identify(make_docs(["abc"] * 8, langs=["x"] * 8)).collect()} == {"x"}
    assert L.identify(make_docs([])).collect() == []


def test_kernel_counts_common_grams():
    a, b = L.presence(b"abc abd"), L.presence("ABC\n abd".encode())
    assert (a == b).all() and a.sum() > 10


def test_rows_are_dropped_by_their_own_text_only(spark, make_docs):
    texts = ["clean text", None, "other text", "12 34", "more text", ""]
    ids = [None, None, 5, 5, 6, None]
    for langs in (["en"] * 6, [None] * 6):
        kept = L.drop_undetermined(make_docs(texts, ids, langs=langs))
        assert kept.columns == make_docs(texts).columns
        assert sorted((r["text"], r["doc_id"]) for r in kept.collect()) == [("clean text", None), ("more text", 6), ("other text", 5)]


def test_copies_do_not_shrink_the_sample(spark, make_docs):
    texts = [f"text {'abcdefghij'[i % 10]} number {i % 20}" for i in range(4000)]
    got = [r["text"] for r in L.sample_texts(make_docs(texts, langs=["x"] * 4000), L.F.lit(True), per_language=8).collect()]
    assert len(got) == len(set(got)) == 8
    got = [r["text"] for r in L.sample_texts(make_docs(texts, langs=["x"] * 4000), L.F.lit(True), per_language=30).collect()]
    assert sorted(got) == sorted(set(texts))


def test_sample_is_shared_by_all_languages(spark, make_docs, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 60)
    texts = [f"{'abcdefghijkl'[i % 12] * 4} {i} {'abcdefghijkl'[i % 12] * 7}" for i in range(600)]
    langs = ["abcdefghijkl"[i % 12] for i in range(600)]
    found, labels = L.training_sample(make_docs(texts, langs=langs), L.F.lit(True))
    assert found.shape == (60, L.SLOTS // 8) and all(labels.count(x) == 5 for x in set(langs))
    monkeypatch.setattr(L, "LANDMARKS", 2)
    assert L.fit(found, labels).landmarks.shape[1] == 12


FOREIGN = {900: "これは日本語の文章です。" * 20, 901: "Это русский текст", 902: "Αυτό είναι ένα κείμενο"}


def test_stage_keeps_unlearned_languages_unless_asked_to_reject(spark, make_docs):
    docs, texts, _ = labelled(make_docs)
    more = docs.unionByName(make_docs([*FOREIGN.values()], [*FOREIGN], langs=[None] * 3))
    lettered = set(range(len(texts))) - {150, 151, 152}
    assert {r["doc_id"] for r in L.drop_undetermined(more).collect()} == lettered | set(FOREIGN)
    assert {r["doc_id"] for r in L.drop_undetermined(more, reject=0.2).collect()} == lettered


def slots_of(text):
    """The slots of a text's n-grams, one after the other."""
    plain = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()]
    raw = b" " + bytes(c for i, c in enumerate(plain) if c != 32 or i == 0 or plain[i - 1] != 32) + b" "
    out = set()
    for n in range(1, 5):
        for i in range(len(raw) - n + 1):
            out.add((int.from_bytes(raw[i : i + n], "big") + (n << 40)) * int(L._SEEDS[n - 1]) % 2**64 >> 50)
    return out


def test_predictions_against_a_plain_computation(spark, make_docs, monkeypatch):
    """Kernel, landmarks, Nyström features and weighted ridge regression by their definitions, from sets of n-grams."""
    monkeypatch.setattr(L, "LANDMARKS", 12)
    docs, texts, langs = labelled(make_docs, 90)
    sample = [(r["lang"], r["rank"], r["text"]) for r in L.sample_texts(docs, ~L.held_out()).collect() if L.has_letter(r["text"])]
    sample.sort(key=lambda r: (r[1], r[0]))
    names, sets, own = sorted({r[0] for r in sample}), [], []
    for _, _, text in sample:
        found = slots_of(text)
        assert found == set(np.flatnonzero(L.presence(text.encode())).tolist())
        sets.append(found)
    marks, turn = [], {}
    for k, (lang, _, _) in enumerate(sample):
        turn[k] = sum(1 for x in sample[:k] if x[0] == lang)
    marks = [sets[k] for k in sorted(range(len(sample)), key=lambda k: turn[k])[:12]]
    kernel = lambda a, b: len(a & b) / (max(len(a), 1) * max(len(b), 1)) ** 0.5
    power, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vectors @ np.diag(np.maximum(power, 1e-6) ** -0.5) @ vectors.T
    features = lambda s: np.append(np.array([kernel(s, m) for m in marks]) @ root, 1.0)
    x = np.array([features(s) for s in sets])
    weight = np.array([len(sample) / (len(names) * sum(1 for y in sample if y[0] == lang)) for lang, _, _ in sample])
    penalty = np.diag([L.RIDGE * len(sample)] * 12 + [0.0])
    rules = [np.linalg.solve(x.T @ (x * weight[:, None]) + penalty, x.T @ (weight * np.array([1.0 if lang == name else -1.0 for lang, _, _ in sample]))) for name in names]
    for r in L.identify(docs).collect():
        text = texts[r["doc_id"]]
        if not L.has_letter(text):
            own.append(r["lang_pred"])
            continue
        values = np.array([features(slots_of(text)) @ w for w in rules])
        assert r["lang_pred"] == names[int(values.argmax())]
        assert abs(r["score"] - 1 / np.exp(4 * (values - values.max())).sum()) < 2e-3
    assert own == ["und"] * 3
