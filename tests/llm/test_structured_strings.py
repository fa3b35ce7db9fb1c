"""Thue-Morse strings, whose running polynomials modulo 2**64 are equal, are told apart by all operators that hash text."""

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest

from quillmill.llm import decontaminate, near_dedup, suffix_dedup, token_files
from quillmill.llm.words import U, Words, span_hashes, stretch_hashes


def twins(a, b, n=4096):
    one = "".join(b if bin(i).count("1") % 2 else a for i in range(n))
    return one, "".join(b if c == a else a for c in one)


def test_word_and_stretch_hashes():
    import numpy as np

    for n in (3, 8, 9, 16, 255, 256, 257, 1024, 4096):
        words = Words(pa.array([f"{x} {x}" for x in twins("a", "b", n)]))
        h = words.hashes()
        assert h[0] == h[1] != h[2] == h[3]
    for x in (np.array([3 if c == "a" else 5 for c in t], U) for t in [twins("a", "b")[0]]):
        low, count = np.array([0, 2048, 0, 1]), np.array([2048, 2048, 7, 7])
        assert len(set(stretch_hashes(x, low, count).tolist())) == 4
    raw = np.frombuffer(b"abcabcab", np.uint8)
    h = span_hashes(raw, np.array([0, 3, 0, 8]), np.array([3, 6, 2, 8]))[0]
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_token_ids():
    texts = [*twins("a", "b", 1024), *twins("a", "b", 2048)]
    tokenizer = token_files.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ids, at = tokenizer.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_ids_where_hashes_collide(monkeypatch):
    """With a first hash that tells lengths apart only, ids are still right."""
    real = span_hashes
    monkeypatch.setattr(token_files, "span_hashes", lambda raw, s, e, seeds: [(e - s).astype(U), real(raw, s, e, (1,))[0]])
    tokenizer = token_files.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for texts in (["one two three", "six ten four"], ["abc", "abd"], ["abe", "xyz uvw"]):
        ids, at = tokenizer.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.tokenizer.encode(t, add_special_tokens=False).ids


def test_near_duplicates(spark, make_docs):
    texts = [" ".join([x] * 3) for x in twins("a", "b", 1024)] + list(twins("x", "y", 2048))
    rows = near_dedup.near_duplicates(make_docs(texts), 3, 85).collect()
    assert all(r["kept"] for r in rows)


def test_benchmark_items(spark, make_docs):
    one, two = twins("a", "b", 1024)
    items = spark.createDataFrame([(1, " ".join([one] * 9))], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(make_docs([" ".join([x] * 9) for x in (one, two)]), items).collect()] == [0]


def test_repeated_strings(spark, make_docs):
    """The twins of 1,024 letters share stretches; what is removed is what brute force removes, at the contract's length."""
    texts = [*twins("a", "b", 1024), *twins("a", "c", 512), "z" * 399, "z" * 401 + "q"]
    rows = suffix_dedup.remove_repeats(make_docs(texts)).collect()
    assert sorted((r["doc_id"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in rows) == brute(texts)


def brute(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            key = hashlib.blake2b(t[i : i + length], digest_size=12).digest()
            seen[key] = seen.get(key, 0) + 1
    out = []
    for d, t in enumerate(raw):
        gone, end = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if seen[hashlib.blake2b(t[i : i + length], digest_size=12).digest()] > 1:
                for k in range(max(i, end), i + length):
                    gone[k] = 1
                end = i + length
        out.append((d, sum(gone), hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("partitions", [3, 61])
def test_query_against_brute_force(spark, data, tmp_path, partitions):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    spark.createDataFrame(docs).repartition(partitions).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([r["text"] for r in docs])
    got = sorted((r["doc_id"], r["n_removed"], r["kept_sha256"], r["n_bytes"]) for r in suffix_dedup.query(spark, str(tmp_path)).collect())
    assert got == [(docs[k]["doc_id"], n, sha, len((docs[k]["text"] or "").encode())) for k, n, sha in want]
