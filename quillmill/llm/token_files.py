"""Token ids of documents in Huffman-coded binary files.

Documents are range-partitioned and sorted by doc_id, so the files in order hold all ids in ascending doc_id order. Each
partition is tokenised once and checkpointed; the ids are counted over all partitions (at most as many counts as the
vocabulary has ids reach the driver); from these global counts comes one canonical, length-limited Huffman code; then
each partition writes one file. A file is decoded by table look-up in independent blocks, each from a bit-offset
checkpoint, so a reader can start at any block.

File: the magic `QTOK`, a length-prefixed JSON header (documents, ids, blocks, bytes), then doc_ids and their null flags,
ids per document, block checkpoints (as int64), code lengths (uint8 for each id of the vocabulary), and packed codes.

Edge cases: null or empty text is the end id alone. Null doc_id sorts first; equal doc_ids are ordered by text; repeated
rows are written each. An empty table gives no file and no row. Very long texts are tokenised whole. Columns other than
the two named are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm import huffman
from quillmill.llm.storage import AtomicFile, cut, keep, new_folder, open_filesystem, tidy
from quillmill.llm.words import SPACE, chunks_of, span_hashes, text_bytes

MAGIC = b"QTOK"
END_ID = 0
#: Most pieces remembered by a task between batches.
REMEMBERED = 1 << 19


ALPHANUMERIC, PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
for code in range(33, 127):
    (ALPHANUMERIC if chr(code).isalnum() else PUNCTUATION)[code] = True


#: UTF-8 bytes of white space beyond ASCII (U+180E was white space in older tables). A run may go on across them.
WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
WIDE_LAST = np.zeros(256, bool)
WIDE_LAST[[w[-1] for w in WIDE_SPACE]] = True


def _after_wide_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of these places follow white space beyond ASCII."""
    out = np.zeros(len(at), bool)
    maybe = np.flatnonzero(WIDE_LAST[raw[at - 1]])
    for i in maybe:
        out[i] = raw[max(0, at[i] - 3) : at[i]].tobytes().endswith(tuple(WIDE_SPACE))
    return out


class PieceTokenizer:
    """Token ids of whole texts, as a fresh tokenizer with the library's defaults gives them, each distinct piece tokenised once.

    The byte-level pre-tokeniser never joins ASCII white space to what stands before it, unless this is white space too,
    nor ASCII punctuation to an ASCII letter or digit before it. A piece begins at each such place, so a text's ids are
    those of its pieces, one after the other. Texts that contain an added token (as `<|endoftext|>`), and all texts of
    tokenizers of any other make, are one piece each.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        byte_level = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        self.cuts = bool(byte_level and not any(made[k] for k in ("normalizer", "truncation", "padding")) and not made["model"].get("dropout"))
        self.added = [t["content"].encode() for t in made["added_tokens"] if t["content"]]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.forget()

    def forget(self) -> None:
        self.known, self.other, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, body: bytes, at: np.ndarray) -> np.ndarray:
        """Texts that must not be cut."""
        if not self.cuts:
            return np.arange(len(at) - 1)
        found = set()
        for token in self.added:
            place = body.find(token)
            while place >= 0:
                found.add(int(np.searchsorted(at, place, side="right")) - 1)
                place = body.find(token, place + 1)
        return np.array(sorted(found), np.int64)

    def encode_whole(self, body: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.tokenizer.encode(body[a:b].decode(), add_special_tokens=False).ids for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.cumsum([0, *map(len, found)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more at the end)."""
        raw, at = text_bytes(texts)
        body = raw.tobytes()
        blank = SPACE[raw]
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[:1] = False
        places = np.flatnonzero(start)
        start[places[_after_wide_space(raw, places)]] = False
        start[1:] |= PUNCTUATION[raw[1:]] & ALPHANUMERIC[raw[:-1]]
        for i in self.whole(body, at):
            start[at[i] : at[i + 1]] = False
        first = at[:-1][at[1:] > at[:-1]]
        start[first] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(raw))
        hashes, others = span_hashes(raw, starts, ends, (0, 1))
        distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self.forget()
        slot = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = slot < len(self.known)
        new[inside] = self.known[slot[inside]] != distinct[inside]
        if new.any():
            pieces = [body[a:b].decode() for a, b in zip(starts[sample[new]], ends[sample[new]], strict=True)]
            if self.cuts:
                found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            else:  # a batch would be padded together
                found = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in pieces]
            size = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
            self.known = np.insert(self.known, slot[new], distinct[new])
            self.other = np.insert(self.other, slot[new], others[sample[new]])
            self.at = np.insert(self.at, slot[new], len(self.ids) + np.cumsum(size) - size)
            self.size = np.insert(self.size, slot[new], size)
            self.ids = np.concatenate([self.ids, ids])
        slot = np.searchsorted(self.known, distinct)[which]
        if (self.other[slot] != others).any():  # two pieces share a hash: nothing is put together from pieces then
            return self.encode_whole(body, at)
        size = self.size[slot]
        ends = np.cumsum(size)
        gather = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[slot] - (ends - size), size)
        of_text = np.r_[0, ends][np.searchsorted(starts, at)]
        return self.ids[gather], of_text


@functools.cache
def _tokenizer(path: str) -> PieceTokenizer:
    """One for all tasks of a Python worker, with the pieces it remembers. Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceTokenizer(path)


_CHUNKS = "numbers binary, nulls binary, sizes binary, ids binary"


def _tokenize(path: str):
    """Documents of a few MB as one row: their numbers, which of these are null, ids of each with the end id, and all ids,
    compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        width = np.uint16 if tokenizer.vocabulary <= 1 << 16 else np.uint32
        packer = zstandard.ZstdCompressor(1)
        for batch in chunks_of(batches, size=2 << 20):
            ids, at = tokenizer.encode(batch.column("text"))
            ends = at[1:] + np.arange(batch.num_rows)
            inner = np.ones(len(ids) + batch.num_rows, bool)
            inner[ends] = False
            whole = np.full(len(inner), END_ID, width)
            whole[inner] = ids
            doc = batch.column("doc_id")
            row = {
                "numbers": np.asarray(doc.fill_null(0)).astype(np.int64).tobytes(),
                "nulls": np.asarray(doc.is_null()).astype(np.uint8).tobytes(),
                "sizes": (np.diff(at) + 1).astype(np.int64).tobytes(),
                "ids": packer.compress(whole.tobytes()),
            }
            yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in row.items()})

    return run


def _count(vocabulary: int, width):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, unpack = np.zeros(vocabulary, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for ids in batch.column("ids"):
                counts += np.bincount(np.frombuffer(unpack.decompress(ids.as_py()), width), minlength=vocabulary)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen.astype(np.int64)), "n": pa.array(counts[seen])})

    return run


def pack_file(numbers: np.ndarray, nulls: np.ndarray, per_doc: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    packed, checkpoints = huffman.encode(ids, lengths, codes)
    header = json.dumps({"docs": len(numbers), "ids": int(len(ids)), "blocks": len(checkpoints), "bytes": len(packed), "vocabulary": len(lengths)}).encode()
    arrays = numbers.astype(np.int64), nulls.astype(np.uint8), per_doc.astype(np.int64), checkpoints.astype(np.int64), lengths.astype(np.uint8)
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *[x.tobytes() for x in arrays], packed])


def unpack_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, ids of each, all ids."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack_from("<I", raw, 4)
    at = 8 + size
    h = json.loads(raw[8:at])

    def take(n: int, kind) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    numbers, nulls = take(h["docs"], np.int64), take(h["docs"], np.uint8)
    per_doc, checkpoints, lengths = take(h["docs"], np.int64), take(h["blocks"], np.int64), take(h["vocabulary"], np.uint8)
    ids = huffman.decode(raw[at : at + h["bytes"]], h["ids"], checkpoints, huffman.decoding_table(lengths))
    return [None if null else int(n) for n, null in zip(numbers, nulls, strict=True)], per_doc, ids


#: Ids after which a partition begins another file, so that a task's memory is bounded.
FILE_IDS = 1 << 20


def _write(folder: str, lengths: np.ndarray, codes: np.ndarray, width):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, unpack = TaskContext.get().partitionId(), 0, zstandard.ZstdDecompressor()
        held: list[list[np.ndarray]] = [[], [], [], []]

        def flush() -> pa.RecordBatch:
            numbers, nulls, per_doc, ids = (np.concatenate(x) for x in held)
            file = AtomicFile(folder, f"ids-{part:06d}-{number:04d}", "qtok")
            file.write(pack_file(numbers, nulls, per_doc, ids, lengths, codes))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "file": [file.close()], "n_ids": pa.array([len(ids)], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                arrays = np.frombuffer(row["numbers"], np.int64), np.frombuffer(row["nulls"], np.uint8), np.frombuffer(row["sizes"], np.int64), np.frombuffer(unpack.decompress(row["ids"]), width)
                for kept, array in zip(held, arrays, strict=True):
                    kept.append(array)
                if sum(map(len, held[3])) >= FILE_IDS:
                    yield flush()
                    held, number = [[], [], [], []], number + 1
        if held[0]:
            yield flush()

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_filesystem(folder)
        for batch in batches:
            for name, base_ids in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    docs, per_doc, ids = unpack_file(stream.read())
                ends = np.cumsum(per_doc)
                whole = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs, pa.int64()),
                    "start": pa.array(base_ids + ends - per_doc),
                    "n_tokens": pa.array(per_doc),
                    "ids": pa.array([whole[4 * (b - n) : 4 * b] for b, n in zip(ends, per_doc, strict=True)], pa.binary()),
                })

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Write the files; their folder, and a row for each file: file, base (ids in all files before it), n_ids."""
    vocabulary = PieceTokenizer(tokenizer_path).vocabulary
    width = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    tokens = cut(ordered.mapInArrow(tidy(_tokenize(tokenizer_path)), _CHUNKS))
    counts = np.zeros(vocabulary, np.int64)
    for row in tokens.mapInArrow(tidy(_count(vocabulary, width)), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    lengths = huffman.code_lengths(counts)
    folder = new_folder(docs.sparkSession, "token-files")
    files = tokens.mapInArrow(tidy(_write(folder, lengths, huffman.canonical_codes(lengths), width)), "part int, number int, file string, n_ids long")
    files = keep(files)  # from here on files are what was written once
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = files.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(parts), F.lit(0)).alias("offset"))
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("within", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(offsets, "part")
    return folder, placed.select("file", (F.col("offset") + F.col("within")).alias("base"), "n_ids")


def read_token_files(folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian, 4 bytes each) of each document, decoded from the files."""
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "file").mapInArrow(tidy(_read(folder)), "doc_id long, start long, n_tokens long, ids binary")


def encoded_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from files written and read back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    folder, files = write_token_files(docs, tokenizer_path)
    return read_token_files(folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark, sf_dir: str) -> DataFrame:
    return encoded_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
