import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import huffman, token_files
from quillmill.llm.storage import open_filesystem

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = token_files.PieceTokenizer(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aB1.,'! \n\té日 \x1c<|>s")), max_size=30), st.text(max_size=20)), max_size=5))
def test_pieces_give_the_tokenizers_ids(texts):
    ids, at = TOKENIZER.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == TOKENIZER.tokenizer.encode(t or "", add_special_tokens=False).ids


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=60))
def test_lengths_are_optimal_and_round_trip(counts):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts)
    used = lengths[counts > 0].astype(float)
    assert (lengths[counts == 0] == 0).all() and (2.0**-used).sum() <= 1
    if (counts > 0).sum() > 1 and lengths.max() < huffman.MAX_BITS:
        assert int((lengths * counts).sum()) == huffman_cost(counts.tolist())
    ids = np.repeat(np.arange(len(counts)), counts)
    np.random.default_rng(1).shuffle(ids)
    packed, checkpoints = huffman.encode(ids, lengths, huffman.canonical_codes(lengths))
    assert huffman.decode(packed, len(ids), checkpoints, huffman.decoding_table(lengths)).tolist() == ids.tolist()


def test_length_limit():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    lengths = huffman.code_lengths(counts, limit=4)
    assert lengths.max() == 4 and (2.0 ** -lengths.astype(float)).sum() == 1


def test_blocks_decode_alone():
    ids = np.random.default_rng(2).zipf(1.5, 3000) % 50
    lengths = huffman.code_lengths(np.bincount(ids))
    packed, checkpoints = huffman.encode(ids, lengths, huffman.canonical_codes(lengths))
    block = huffman.decode(packed, huffman.BLOCK, checkpoints[3:4], huffman.decoding_table(lengths))
    assert block.tolist() == ids[3 * huffman.BLOCK : 4 * huffman.BLOCK].tolist()


def test_files_against_brute_force(spark, make_docs, monkeypatch):
    texts = ["hello world", None, "", "a\nb  c d", "<|endoftext|>", "hello world", "x" * 3000, "日本語 " * 500]
    ids = [5, 3, 9, None, 1, 5, 2, 7]
    folder, files = token_files.write_token_files(make_docs(texts, ids), PATH)
    got = [tuple(r) for r in token_files.read_token_files(folder, files).collect()]
    start, want = 0, []
    for d, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        code = np.array([*TOKENIZER.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(code), code.tobytes()))
        start += len(code)
    assert sorted(got, key=lambda r: r[1]) == want
    system, base = open_filesystem(folder)
    assert all(f.base_name.endswith(".qtok") for f in system.get_file_info(__import__("pyarrow").fs.FileSelector(base)))


def test_query_and_empty(spark, data, make_docs):
    rows = token_files.query(spark, data).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    start = 0
    for r, d in zip(rows, docs, strict=True):
        code = np.array([*TOKENIZER.tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (d["doc_id"], start, len(code), zlib.crc32(code.tobytes()))
        start += len(code)
    assert token_files.encoded_documents(make_docs([]), PATH).collect() == []


def test_not_a_token_file():
    with pytest.raises(ValueError):
        token_files.unpack_file(b"nope" * 10)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"a1,' \n 　 \u0085  é", "<|endoftext|>", "<|"]), max_size=20).map("".join), max_size=5))
def test_ids_are_those_of_a_fresh_tokenizer(texts):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(PATH)
    texts = [*texts, "a     word", "x<|endoftext|>y", "<|endoftext|>"]
    ids, at = TOKENIZER.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == fresh.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(f"{tmp_path}/other.json")
    ids, _ = token_files.PieceTokenizer(f"{tmp_path}/other.json").encode(pa.array(["one two, three"]))
    assert ids.tolist() == other.encode("one two, three", add_special_tokens=False).ids
