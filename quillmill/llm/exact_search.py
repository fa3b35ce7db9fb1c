"""Exact top-k search by inner product.

Vectors become integers and are packed into shards; queries are dealt into blocks. A cell (a block of queries, a range of
shards) multiplies tiles of queries with one shard at a time as matrices, selects the k best of each tile and query partially, and merges them into
the query's running list. The lists of ranges are merged in a tree. Each pair is scored, in blocks; only lists of k move.

Edge cases: see `vectors`. A query's own row (not its repetitions) is left out. With fewer than k other rows all are
returned, in order; a query alone in its table has none. A row with a null id is never a query of `query`, but found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm import vectors
from quillmill.llm.vectors import BEST_DDL, ENTRY, NONE, TILE, Shards, arithmetic, best, integers, pack, products, usable, vectors_of

_KEY = ["shard", "pos", "id"]
_OUT = pa.schema([("shard", pa.int64()), ("pos", pa.int32()), ("id", pa.int64()), ("range", pa.int32()), ("best", pa.list_(ENTRY))])


def _scan(k: int):
    def search(queries: pa.Table, table: pa.Table) -> pa.Table:
        if not queries.num_rows or not table.num_rows:
            return _OUT.empty_table()
        shards, wanted = Shards(table), vectors_of(queries["vector"])
        most, total = vectors.size_of(wanted), len(shards.ids)
        kind = arithmetic(min(shards.width, wanted.shape[1]), most, shards.most)
        limit = min(2**63 - 1, shards.width * most * shards.most)
        wanted = wanted.astype(kind)
        home, place = queries["shard"].to_numpy(), queries["pos"].to_numpy()
        scores, ranks = np.full((len(home), k), NONE), np.zeros((len(home), k), np.int64)
        for number, row in enumerate(shards.rows):
            matrix = shards.matrix(number).astype(kind)
            for low in range(0, len(home), TILE):
                at = slice(low, low + TILE)
                found = products(wanted[at], matrix, kind)
                own = np.flatnonzero(home[at] == row["shard"])
                found[own, place[at][own]] = NONE
                tile = best(found, shards.ranks[number], k, limit, total)
                scores[at], ranks[at] = best(np.hstack([scores[at], tile[0]]), np.hstack([ranks[at], tile[1]]), k, limit, total)
        return queries.select([*_KEY, "range"]).append_column("best", shards.lists(scores, ranks)).cast(_OUT)

    return search


def top_k(frame: DataFrame, is_query: Column, k: int = 20, scale: float = 64, key: str = "vec_id", vector: str = "embedding", shard_rows: int = vectors.ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows nearest to each row for which `is_query` holds, by the inner
    product of floor(scale * component); ties to the smaller id."""
    rows = frame.filter(usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.lit(0).cast("long").alias("label"), F.coalesce(is_query, F.lit(False)).alias("wanted"), integers(F.col(vector), scale).alias("vector")
    )
    shards = pack(rows, most_rows=shard_rows)
    lists, ranges = vectors.cells(vectors.queries_of(shards).drop("label"), shards, _scan(k), f"shard long, pos int, id long, range int, {BEST_DDL}")
    found = vectors.merged(lists, _KEY, k, ranges).select(F.col("id").alias("query_id"), F.posexplode("best").alias("at", "entry"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), F.col("entry.id").alias("vec_id"), (-F.col("entry.neg")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
