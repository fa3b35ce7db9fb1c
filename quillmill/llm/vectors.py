"""Integer vectors in shards, and the search of blocks of queries against ranges of shards.

Rows become integer vectors and are packed, where they are read, into shards: one row with the ids, labels and one matrix of
the smallest integer type that holds it. Neither packing nor a hot id or label needs a shuffle, and a shard has at most
`ROWS` rows and `BYTES` bytes. A search deals shards into ranges and queries into blocks; each cell (block, range) is one
cogrouped task that gives a list of the best for each query, and lists are merged in a tree, `ARMS` ranges at a time. So
what a task holds doesn't grow with the table, and the work of any query spreads over all ranges.

Products are exact: in single or double precision where all sums are integers that these hold, otherwise in whole numbers
of any length. Components outside of 64 bits are taken as the nearest bound, and so are scores (of size 2^63 - 1). Shorter
vectors count as filled up with zeros. Rows whose vector is null or has a null or non-finite component take no part.
A null id takes part and comes after all ids of the same score. Repeated rows are rows each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.storage import keep, small_batches, tidy

#: Rows of a shard at most, and bytes of its matrix in double precision.
ROWS, BYTES = 4096, 4 << 20
#: Shards of a range, queries of a block, and queries of one matrix product, at most.
RANGE, BLOCK, TILE = 32, 1 << 16, 512
#: Lists merged by a step of the tree.
ARMS = 16
#: Rows of a leaf of a ball tree at most.
LEAF = 64
#: In place of a score where there is none; scores are larger.
NONE = -(2**63)

_SHARD = pa.schema(
    [("shard", pa.int64()), ("width", pa.int32()), ("most", pa.int64()), ("kind", pa.string()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("wanted", pa.list_(pa.bool_())),
     ("matrix", pa.binary()), ("centers", pa.binary()), ("radii", pa.list_(pa.int64()))]
)
_SHARD_DDL = "shard long, width int, most long, kind string, ids array<long>, labels array<long>, wanted array<boolean>, matrix binary, centers binary, radii array<long>"
ENTRY = pa.struct([("neg", pa.int64()), ("unnamed", pa.bool_()), ("id", pa.int64())])
BEST_DDL = "best array<struct<neg long, unnamed boolean, id long>>"
_QUERY = pa.schema([("shard", pa.int64()), ("pos", pa.int32()), ("id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])


def size_of(matrix: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(matrix.max()), -int(matrix.min())) if matrix.size else 0


def integers(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    x = lambda x: x.cast("double")
    return F.coalesce(F.forall(vector, lambda v: F.coalesce((x(v) > float("-inf")) & (x(v) < float("inf")), F.lit(False))), F.lit(False))


# --- ball trees: level by level, node i of level l covers rows i * n // 2**l to (i + 1) * n // 2**l of the shard


def levels_of(n: int) -> int:
    """The deepest level; its nodes are the leaves."""
    found = 0
    while n > LEAF << found:
        found += 1
    return found


def edges(n: int, level: int) -> list[int]:
    return [i * n >> level for i in range((1 << level) + 1)]


def ball_tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The order of rows in which nodes are stretches, their centers (whole numbers, so that bounds are exact) and radii (rounded up).

    A node is halved along the line between two rows that lie far apart.
    """
    n, order, centers, radii = len(rows), np.arange(len(rows)), [], []
    for level in range(levels_of(n) + 1):
        at = edges(n, level)
        middle = edges(n, level + 1)[1::2]
        for low, high, mid in zip(at, at[1:], middle, strict=False):
            own = rows[order[low:high]]
            center = np.rint(own.mean(axis=0)).astype(np.int64)
            far = ((own - center) ** 2).sum(axis=1)
            most = int(far.max())
            centers.append(center)
            radius = int(np.sqrt(most))
            while radius * radius < most:
                radius += 1
            radii.append(radius)
            if level < levels_of(n):
                one = own[far.argmax()]
                line = (one - own[((own - one) ** 2).sum(axis=1).argmax()]).astype(np.float64)
                order[low:high] = order[low:high][np.argpartition(own @ line, mid - low)]
    return order, np.array(centers, np.int64), radii


def bounds_fit(width: int, one: int, other: int) -> bool:
    """Whether products, their bounds and squares of vectors of such sizes are exact in double precision."""
    return 16 * width * max(one, other) ** 2 < 1 << 52


# --- shards


def _packed(with_trees: bool, most_rows: int):
    def shard_of(part: pa.Table, number: int) -> dict:
        vectors = part["vector"].combine_chunks()
        lengths = np.diff(vectors.offsets.to_numpy())
        width, n = int(lengths.max(initial=0)), len(lengths)
        matrix = np.zeros((n, width), np.int64)
        matrix[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        most, order = size_of(matrix), np.arange(n)
        centers, radii = np.zeros((0, width), np.int64), []
        if with_trees and bounds_fit(width, most, most):
            order, centers, radii = ball_tree(matrix)
        kind = next(k for k in ("int8", "int16", "int32", "int64") if most <= np.iinfo(k).max or k == "int64")
        turned = part.select(["id", "label", "wanted"]).take(pa.array(order))
        return {
            "shard": number, "width": width, "most": min(most, 2**63 - 1), "kind": kind, "ids": turned["id"].to_pylist(), "labels": turned["label"].to_pylist(), "wanted": turned["wanted"].to_pylist(),
            "matrix": matrix[order].astype(kind).tobytes(), "centers": centers.tobytes(), "radii": radii,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made, rest = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while rest.num_rows >= (take := rows_of(rest)):
                yield pa.RecordBatch.from_pylist([shard_of(rest.slice(0, take), first + made)], _SHARD)
                rest, made = rest.slice(take), made + 1
        while rest is not None and rest.num_rows:
            take = rows_of(rest)
            yield pa.RecordBatch.from_pylist([shard_of(rest.slice(0, take), first + made)], _SHARD)
            rest, made = rest.slice(take), made + 1

    def rows_of(table: pa.Table) -> int:
        """Rows for the next shard: fewer where vectors are long."""
        widest = pc.max(pc.list_value_length(table["vector"].slice(0, most_rows))).as_py() or 1
        return max(1, min(most_rows, BYTES // (8 * widest)))

    return run


def pack(rows: DataFrame, with_trees: bool = False, most_rows: int = ROWS) -> DataFrame:
    """A table of shards from rows (id long, label long, wanted boolean, vector array<long>), packed where they are read."""
    small_batches(rows.sparkSession)
    return keep(rows.select("id", "label", "wanted", "vector").mapInArrow(tidy(_packed(with_trees, most_rows)), _SHARD_DDL))


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            matrix = np.frombuffer(row["matrix"], row["kind"]).reshape(len(row["ids"]), row["width"])
            at = [i for i, w in enumerate(row["wanted"]) if w]
            columns = [[row["shard"]] * len(at), at, [row["ids"][i] for i in at], [row["labels"][i] for i in at], [matrix[i].astype("<i8").tobytes() for i in at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _QUERY, strict=True)], schema=_QUERY)


def queries_of(shards: DataFrame) -> DataFrame:
    """The wanted rows, named by their place (shard, pos): shard, pos, id, label, vector (8 bytes a component)."""
    return shards.mapInArrow(tidy(_wanted), "shard long, pos int, id long, label long, vector binary")


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    width = max(map(len, raw), default=0) // 8
    return np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in raw), "<i8").reshape(len(raw), width)


class Shards:
    """A range of shards in a task: rows in the order of ids (nulls last) have ranks, by which ties are settled."""

    def __init__(self, table: pa.Table):
        self.rows = table.sort_by("shard").to_pylist()
        ids = np.concatenate([np.array([0 if i is None else i for i in r["ids"]], np.int64) for r in self.rows])
        unnamed = np.concatenate([np.array([i is None for i in r["ids"]], bool) for r in self.rows])
        order = np.lexsort((ids, unnamed))
        self.ids, self.unnamed = ids[order], unnamed[order]
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        self.ranks = np.split(rank, np.cumsum([len(r["ids"]) for r in self.rows])[:-1])
        self.most = max(r["most"] for r in self.rows)
        self.width = max(r["width"] for r in self.rows)

    def matrix(self, k: int) -> np.ndarray:
        row = self.rows[k]
        return np.frombuffer(row["matrix"], row["kind"]).reshape(len(row["ids"]), row["width"])

    def lists(self, scores: np.ndarray, ranks: np.ndarray) -> pa.Array:
        """The entries (sorted) of each query's best."""
        there = scores != NONE
        at = ranks[there]
        unnamed = self.unnamed[at]
        entries = pa.StructArray.from_arrays([pa.array(-scores[there]), pa.array(unnamed), pa.array(self.ids[at], mask=unnamed)], fields=list(ENTRY))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]), pa.int32()), entries)


def arithmetic(width: int, one: int, other: int) -> str:
    """In which type sums of products of such sizes are exact."""
    bound = width * one * other
    return "float32" if bound < 1 << 24 else "float64" if bound < 1 << 53 else "object"


def products(queries: np.ndarray, rows: np.ndarray, kind: str) -> np.ndarray:
    """All inner products, exact; beyond 64 bits the nearest bound."""
    width = min(queries.shape[1], rows.shape[1])
    found = queries[:, :width].astype(kind, copy=False) @ rows[:, :width].astype(kind, copy=False).T
    if kind == "object":
        if not width:
            return np.zeros(found.shape, np.int64)
        found = np.clip(found, 1 - 2**63, 2**63 - 1)
    return found.astype(np.int64)


def best(scores: np.ndarray, ranks: np.ndarray, k: int, most: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row (NONE: none), sorted, ties by rank. `ranks` are the columns', or each entry's own.

    Score and rank make one key where 64 bits hold it, so that a partial selection finds the k best whatever the ties.
    """
    ranks = np.broadcast_to(ranks, scores.shape)
    k = min(k, scores.shape[1])
    if (most + 1) * total < 1 << 62:
        keys = np.where(scores == NONE, NONE, scores * total - ranks)
        at = np.argpartition(keys, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k :] if k < scores.shape[1] else np.broadcast_to(np.arange(k), scores.shape)
        at = np.take_along_axis(at, np.argsort(-np.maximum(np.take_along_axis(keys, at, 1), NONE + 1), axis=1), 1)
    else:
        at = np.lexsort((ranks, -np.maximum(scores, NONE + 1), scores == NONE), axis=1)[:, :k]
    return np.take_along_axis(scores, at, 1), np.take_along_axis(ranks, at, 1)


# --- cells


def cells(queries: DataFrame, shards: DataFrame, search: Callable, out: str, block: int = BLOCK) -> tuple[DataFrame, int]:
    """`search(queries, shards)`, two tables, for each block of queries and range of shards; and the number of ranges.

    `out` is the schema of its rows. Small tables are cut finer, so that all cores have a cell.
    """
    spark = queries.sparkSession
    n_queries, n_shards, cores = queries.count(), shards.count(), spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n_queries // block))
    ranges = max(1, -(-n_shards // RANGE), min(n_shards, -(-2 * cores // blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = [c for c in queries.columns if c != "vector"]
    left = queries.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")).withColumn("range", every(ranges))
    number = F.shiftright("shard", 32) + F.col("shard").bitwiseAND(F.lit(0xFFFFFFFF))  # consecutive where partitions have a shard each
    right = shards.drop("wanted").withColumn("range", F.pmod(number, F.lit(ranges)).cast("int")).withColumn("block", every(blocks))
    return left.groupBy("block", "range").cogroup(right.groupBy("block", "range")).applyInArrow(search, out), ranges


def merged(lists: DataFrame, key: list[str], k: int, ranges: int) -> DataFrame:
    """The k best of each query over all ranges, merged in a tree: key and `best`."""
    while ranges > 1:
        lists = lists.withColumn("range", F.floor(F.col("range") / ARMS)).groupBy(*key, "range").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        ranges = -(-ranges // ARMS)
    return lists.select(*key, "best")
