"""Media columns: content-addressed payloads in tar shards.

Each task stores its payloads losslessly as 8-bit greyscale PNG images, 64 samples a row, in one tar shard; a payload that
a task meets again is stored once. A row carries the payload's digest and the shard, offset and length of its stored
form; equal digests in several shards resolve to the first of these places. A shard ends at `SHARD_BYTES`. Metadata columns
are filled by range reads of the first bytes alone (the image header), features by reading the stored bytes back, each once
for each digest. Payloads are not shuffled.

Edge cases: a null or empty text is a payload of 64 zero bytes. Rows with equal texts, repeated rows included, get equal
values. A null doc_id stays null. An empty table gives an empty result. Very long texts are single payloads; a task holds
one at a time. Columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.storage import AtomicFile, cut, new_folder, open_filesystem, read_range, tidy
from quillmill.llm.words import chunks_of

#: Samples a row of the image; payloads are padded to a positive multiple.
WIDTH = 64
#: Stored bytes, and documents, after which a task begins another shard.
SHARD_BYTES, SHARD_ROWS = 256 << 20, 1 << 20
#: Stored bytes that a task reads back, about.
TASK_BYTES = 8 << 20
#: The PNG signature, and the bytes that hold it and the image header.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % WIDTH or (WIDTH if not raw else 0))


def _block(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes, level: int = 6) -> bytes:
    """The payload as an 8-bit greyscale PNG, a row of WIDTH samples for each WIDTH bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # the first byte of a row names its filter: none
    filtered[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _block(b"IHDR", header) + _block(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _block(b"IEND", b"")


def image_header(head: bytes) -> dict:
    """Width, height and depth from the first HEADER_BYTES."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return {"width": width, "height": height, "depth": depth}


def decode_image(stored: bytes) -> bytes:
    about, at, body = image_header(stored), 8, b""
    while at < len(stored):
        (size,) = struct.unpack_from(">I", stored, at)
        if stored[at + 4 : at + 8] == b"IDAT":
            body += stored[at + 8 : at + 8 + size]
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(about["height"], about["width"] + 1)
    return rows[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Features of the samples: mean, deviation, entropy in bits, and mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    return f"mean={x.mean():.3f};std={x.std():.3f};entropy={-(share * np.log2(share)).sum():.4f};step={step:.3f}"


_STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_HEADERS = "digest string, width long, height long, depth long"


def _store(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, place, rows = None, 0, {}, []

        def close() -> pa.RecordBatch:
            nonlocal file, number, place, rows
            file.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            file.close()
            columns = list(zip(*rows, strict=True))
            shard = pa.array([file.name] * len(rows))
            file, number, place, rows = None, number + 1, {}, []
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array(columns[0], pa.int64()),
                "n_bytes": pa.array(columns[1], pa.int64()),
                "digest": pa.array(columns[2]),
                "shard": shard,
                "offset": pa.array(columns[3], pa.int64()),
                "length": pa.array(columns[4], pa.int64()),
            })

        for batch in chunks_of(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                payload = padded(raw)
                key = hashlib.sha256(payload).digest()
                file = file or AtomicFile(folder, f"media-{TaskContext.get().partitionId():06d}-{number:04d}", "tar")
                if key not in place:
                    stored = encode_image(payload)
                    about = tarfile.TarInfo(f"{key.hex()}.png")
                    about.size = len(stored)
                    file.write(about.tobuf(tarfile.USTAR_FORMAT))
                    place[key] = (file.write(stored), len(stored))
                    file.write(b"\0" * (-len(stored) % tarfile.BLOCKSIZE))
                rows.append((doc, len(raw), key.hex(), *place[key]))
                if file.position >= SHARD_BYTES or len(rows) >= SHARD_ROWS:
                    yield close()
        if file:
            yield close()

    return run


def _ranges(folder: str, read) -> object:
    """Apply `read(handle, offset, length)` to the stored form of each digest; shards are opened once for a stretch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_filesystem(folder)
        name, handle = None, None
        for batch in batches:
            found = []
            for digest, shard, offset, length in zip(*[batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")], strict=True):
                if shard != name:
                    if handle:
                        handle.close()
                    name, handle = shard, system.open_input_file(f"{base}/{shard}")
                found.append({"digest": digest} | read(handle, offset, length))
            yield pa.RecordBatch.from_pylist(found) if found else batch.slice(0, 0)
        if handle:
            handle.close()

    return run


def _header(handle, offset: int, length: int) -> dict:
    return image_header(read_range(handle, offset, HEADER_BYTES))


def _features(handle, offset: int, length: int) -> dict:
    stored = read_range(handle, offset, length)
    payload = decode_image(stored)
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-WIDTH:]),
        "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": describe(payload),
    }


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Write the shards; their folder, and a row for each document: doc_id, n_bytes, digest, shard, offset, length."""
    folder = new_folder(docs.sparkSession, "media")
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return folder, cut(slim.mapInArrow(tidy(_store(folder)), _STORED))


def places(rows: DataFrame) -> DataFrame:
    """The one place of each digest, in order of shard and offset, so that a task reads few shards from front to back."""
    first = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    size = rows.agg(F.sum("length")).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    return first.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")


def header_columns(folder: str, placed: DataFrame) -> DataFrame:
    """Metadata columns from header-only range reads, for each digest of `placed`: width, height, depth."""
    return placed.mapInArrow(tidy(_ranges(folder, _header)), _HEADERS)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store all payloads, read them back, and return each document's reference, metadata and features."""
    folder, rows = store_media(docs, key, text)
    placed = cut(places(rows))  # the same few shards a task for both passes
    features = placed.mapInArrow(tidy(_ranges(folder, _features)), _FEATURES)
    return rows.join(features, "digest").join(header_columns(folder, placed), "digest")


def query(spark, sf_dir: str) -> DataFrame:
    out = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth")
