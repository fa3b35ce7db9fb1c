"""Line deduplication.

Lines become 128-bit hashes of their keys. The hashes are range-partitioned by (hash, document), sorted within each
partition by hash, document (largest first) and position, and read as a stream: the first document of a run keeps its
lines, the others lose theirs if the run has enough documents. What comes back is a compressed keep bitmap for each
document; no text is moved. Because the document is part of the range key, the run of a hot line spreads over several
partitions. A run within one batch of the stream is settled at once; only the two runs at a batch's edges may go on
elsewhere, and these few are summed up afterwards.

Edge cases: null or empty text is one empty line, which is kept. Rows that share doc_id and text get the same bitmap and
count as one document; rows that share doc_id only count as one document but each has its own lines. A null doc_id is a
document id smaller than any other. Columns other than the two named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.storage import cut, keep, tidy
from quillmill.llm.words import chunks_of

#: The bytes stripped from both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)

_LINE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("body", pa.int64()), ("at", pa.list_(pa.int32()))])
_FOUND = pa.schema([*_LINE, ("open", pa.bool_())])


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # bytes.lower() leaves all but A-Z alone


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))


def _lines(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of(batches):
            rows: list[tuple] = []
            for doc, body, text in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist(), batch.column("text"), strict=True):
                places: dict[bytes, list[int]] = {}
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for at, line in enumerate(raw.split(b"\n")):
                    if len(line) >= min_length and code_points(key := line_key(line)) >= min_length:
                        places.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                rows += [(digest, doc, body, at) for digest, at in places.items()]
            halves = np.frombuffer(b"".join(r[0] for r in rows), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), *[pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.list_(pa.int32())))]], schema=_LINE
            )

    return run


def _runs(min_docs: int):
    """Stream the sorted lines: of each run within a batch, the lines to drop; of a run that touches a batch's edge, all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            batch = batch.cast(_LINE)
            h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc"))
            new_run = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            starts = np.flatnonzero(new_run)
            run_of = np.cumsum(new_run) - 1
            new_doc = new_run.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            is_open = np.zeros(len(starts), bool)
            is_open[[0, -1]] = True
            drop = (docs >= min_docs)[run_of] & (doc != doc[starts][run_of])
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(is_open[run_of])], schema=_FOUND)
            yield out.filter(pa.array(is_open[run_of] | drop))

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keeps, dropped = [], []
        for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[np.asarray(places or [], np.int64)] = False
            keeps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
            dropped.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "body": batch.column("body"), "n_lines": batch.column("n_lines"), "n_dropped": pa.array(dropped, pa.int64()), "keep": pa.array(keeps, pa.binary())})


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"), F.col(text).alias("text"))


def line_keep_bitmaps(docs: DataFrame, min_length: int = 40, min_docs: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each distinct (doc, body): n_lines, n_dropped and `keep`, a zlib-compressed bitmap with a bit for each line."""
    named = _identified(docs, key, text)
    lines = named.mapInArrow(tidy(_lines(min_length)), "h1 long, h2 long, doc long, body long, at array<int>")
    ordered = lines.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", F.desc("doc"), "body")
    found = cut(ordered.mapInArrow(tidy(_runs(min_docs)), "h1 long, h2 long, doc long, body long, at array<int>, open boolean"))
    runs = found.filter("open").groupBy("h1", "h2", "doc").count().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
    runs = keep(runs.filter(F.col("n_docs") >= min_docs))  # a table, so that the join with a very hot line's rows can be split
    late = found.filter("open").join(runs, ["h1", "h2"]).filter("doc != keeper").select("doc", "body", "at")
    drops = found.filter("not open").select("doc", "body", "at").unionByName(late).groupBy("doc", "body").agg(F.flatten(F.collect_list("at")).alias("places"))
    body = F.coalesce(F.col("text"), F.lit(""))
    sizes = named.select("doc", "body", (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")).dropDuplicates(["doc", "body"])
    return sizes.join(drops, ["doc", "body"], "left").mapInArrow(tidy(_bitmaps), "doc long, body long, n_lines long, n_dropped long, keep binary")


def kept_lines(raw: bytes, bitmap: bytes) -> bytes:
    """The kept lines of a text, joined by newlines."""
    lines = raw.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines)).astype(bool)
    return b"\n".join(line for line, k in zip(lines, keep, strict=True) if k)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks_of(batches):
        texts = []
        for text, dropped, bitmap in zip(batch.column("text"), batch.column("n_dropped").to_pylist(), batch.column("keep"), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            texts.append(kept_lines(raw, bitmap.as_py()) if dropped else raw)
        yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "n_lines": batch.column("n_lines"), "n_dropped": batch.column("n_dropped"), "kept": pa.array(texts, pa.binary())})


def dedup_lines(docs: DataFrame, min_length: int = 40, min_docs: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_lines, n_dropped and the kept text, by applying the bitmaps."""
    bitmaps = line_keep_bitmaps(docs, min_length, min_docs, key, text)
    joined = _identified(docs, key, text).join(bitmaps, ["doc", "body"]).select("doc", "text", "n_lines", "n_dropped", "keep")
    out = joined.mapInArrow(tidy(_kept), "doc long, n_lines long, n_dropped long, kept binary")
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_lines", "n_dropped", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
