"""An approximate vector index: coarse cells, residual codes by sub-vector, and exact re-ranking.

Centers are trained by k-means whose sums are Spark aggregations: a task sums its rows by nearest center, the sums are added up by
(center, dimension), and only the new centers, a few by configuration, reach the driver. Training takes rows whose hashed id
falls below a threshold, about `SAMPLE` of them; every row is indexed. A row is stored in its cell's folder as codes (one byte a sub-vector,
the nearest codeword of the difference to the cell's center) beside its vector.

A search probes the cells nearest to each question. Questions of a cell meet the cell's codes in slices of `SLICE` rows: a
table of products with all codewords makes a row's approximate score a sum of one entry a sub-vector. The `rerank` best of these are
scored exactly. Only their vectors are read; all others are met as codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.vectors import cosine
from quillmill.plans.checkpoints import cut, scratch
from quillmill.registry import query
from quillmill.sources.tables import table

#: Rows to train on, about, and rows of codes that one task meets at once.
SAMPLE, SLICE = 50_000, 100_000
_HASH = 1 << 20


@dataclass
class Model:
    """Cells' centers (cells, dim) and codewords (parts, words, dim / parts)."""

    centers: np.ndarray
    books: np.ndarray


@dataclass
class VectorIndex:
    """rows: cell, slice, id, codes, embedding; slices: the number of slices of each cell."""

    model: Model
    rows: DataFrame
    slices: dict[int, int]


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = np.array(column.to_pylist(), np.float64)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300) if len(rows) else rows.reshape(0, 1)


def nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(axis=1) - 2 * rows @ centers.T).argmin(axis=1)


def _split(rows: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, dim / parts)."""
    return rows.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def _sums(books: np.ndarray, centers: np.ndarray | None):
    """Of a task's rows, the sums by nearest codeword of each part. With `centers`, of the differences to the nearest of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            rows = unit_rows(batch["embedding"])
            if not len(rows):
                continue
            if centers is not None:
                rows = rows - centers[nearest(rows, centers)]
            for p, own in enumerate(_split(rows, len(books))):
                at = nearest(own, books[p])
                np.add.at(total[p], at, own)
                counts[p] += np.bincount(at, minlength=books.shape[1])
        part, word = np.nonzero(counts)
        for low in range(0, len(part), 1000):
            p, w = part[low : low + 1000], word[low : low + 1000]
            yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "word": pa.array(w, pa.int32()), "n": pa.array(counts[p, w]), "total": pa.array(list(total[p, w]), pa.list_(pa.float64()))})

    return run


def k_means(sample: DataFrame, books: np.ndarray, rounds: int, centers: np.ndarray | None = None) -> np.ndarray:
    """Codewords of each part after so many rounds; a codeword without rows stays where it is."""
    for _ in range(rounds):
        sums = sample.mapInArrow(_sums(books, centers), "part int, word int, n long, total array<double>")
        each = sums.select("part", "word", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "word", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        books = books.copy()
        for r in each.collect():  # parts x words x dimensions of a part: as many as the model has numbers
            books[r["part"], r["word"], r["at"]] = r["x"] / r["n"]
    return books


def train(vectors: DataFrame, cells: int, parts: int, words: int, rounds: int = 5, sample: int = SAMPLE) -> Model:
    """Fit on about `sample` rows (id, embedding), by the hash of their ids; no more words than a fourth of the rows."""
    n = vectors.count()
    place = F.pmod(F.xxhash64("id"), F.lit(_HASH))
    chosen = cut(vectors.filter(place < max(1, -(-sample * _HASH // max(n, 1)))).withColumn("place", F.xxhash64("id", F.lit(7))).select("place", "embedding"))
    first = unit_rows(pa.array([r["embedding"] for r in chosen.orderBy("place").limit(max(cells, words)).collect()]))
    cells, words = min(cells, len(first)), max(1, min(words, len(first), chosen.count() // 4))
    centers = k_means(chosen, first[:cells][None], rounds)[0]
    books = _split((first - centers[nearest(first, centers)])[:words], parts)
    return Model(centers, k_means(chosen, np.ascontiguousarray(books), rounds, centers))


def _encoded(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch["embedding"])
            if not len(rows):
                continue
            cell = nearest(rows, model.centers)
            parts = _split(rows - model.centers[cell], len(model.books))
            codes = np.stack([nearest(own, book) for own, book in zip(parts, model.books, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "id": batch["id"], "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "embedding": batch["embedding"]})

    return run


def build(vectors: DataFrame, at: str, cells: int = 16, parts: int = 16, words: int = 64, rounds: int = 5) -> VectorIndex:
    """Train on, and write, the index of vectors (id long, embedding) of one dimension that `parts` divides, below the folder
    `at`. Rows without a vector aren't indexed."""
    if words > 256:
        raise ValueError("a code has one byte: 256 words at most")
    vectors = vectors.filter("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding")
    model = train(vectors, cells, parts, words, rounds)
    stored = vectors.mapInArrow(_encoded(model), f"cell int, id long, codes binary, embedding {vectors.schema['embedding'].dataType.simpleString()}")
    stored.write.partitionBy("cell").parquet(at)
    rows = vectors.sparkSession.read.parquet(at)
    slices = {r["cell"]: -(-r["n"] // SLICE) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    return VectorIndex(model, rows, slices)


def _probed(model: Model, probe: int, slices: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch["embedding"])
            if not len(rows):
                continue
            near = np.argsort(-(rows @ model.centers.T), axis=1, kind="stable")[:, :probe]
            out = [(q, int(c), s, tuple(v)) for q, cells, v in zip(batch["query_id"].to_pylist(), near, rows, strict=True) for c in cells for s in range(slices.get(int(c), 0))]
            if out:
                q, c, s, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "cell": pa.array(c, pa.int32()), "slice": pa.array(s, pa.int32()), "embedding": pa.array(v, pa.list_(pa.float64()))})

    return run


def _scored(model: Model, rerank: int):
    def run(key: tuple, asked: pa.Table, stored: pa.Table) -> pa.Table:
        n = stored.num_rows
        if not asked.num_rows or not n:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})
        codes = np.frombuffer(b"".join(stored["codes"].to_pylist()), np.uint8).reshape(n, -1)
        ids, names, found = stored["id"].to_numpy(), asked["query_id"].to_numpy(), []
        for name, q in zip(names, unit_rows(asked["embedding"]), strict=True):
            products = np.einsum("pwd,pd->pw", model.books, q.reshape(len(model.books), -1))
            score = q @ model.centers[key[0].as_py()] + products[np.arange(len(products)), codes].sum(axis=1)
            best = np.argpartition(-score, rerank - 1)[:rerank] if rerank < n else np.arange(n)
            found.append((np.full(len(best), name), ids[best], score[best]))
        return pa.table({"query_id": np.concatenate([f[0] for f in found]), "id": np.concatenate([f[1] for f in found]), "near": np.concatenate([f[2] for f in found])})

    return run


def search(questions: DataFrame, index: VectorIndex, k: int, probe: int, rerank: int) -> DataFrame:
    """(query_id, id, score, rank): the k best of the `rerank` nearest by codes in the `probe` nearest cells, by exact cosine; ties to the smaller id."""
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter("embedding IS NOT NULL")
    sent = asked.mapInArrow(_probed(index.model, probe, index.slices), "query_id long, cell int, slice int, embedding array<double>")
    many = F.create_map(*[F.lit(x) for kv in index.slices.items() for x in kv]) if index.slices else F.create_map().cast("map<int,int>")
    codes = index.rows.select("cell", F.pmod(F.xxhash64("id"), F.get(F.array(many[F.col("cell")]), F.lit(0))).cast("int").alias("slice"), "id", "codes")
    near = sent.groupBy("cell", "slice").cogroup(codes.groupBy("cell", "slice")).applyInArrow(_scored(index.model, rerank), "query_id long, id long, near double")
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    few = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rerank).select("query_id", "id")
    exact = few.join(index.rows.select("id", F.col("embedding").alias("v")), "id").join(asked, "query_id").select("query_id", "id", cosine(F.col("v"), F.col("embedding")).alias("score"))
    return exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


@query("top2_approximate_top_k")
def approximate_top_k(spark, d):
    """The vectors whose id is divisible by 20 against all; a test measures how many of the exact query's results come back."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = build(vectors, scratch(spark, "vectors"))
    questions = vectors.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    return search(questions, index, 10, probe=16, rerank=100).select("query_id", "id", "rank", F.round("score", 6).alias("score"))
