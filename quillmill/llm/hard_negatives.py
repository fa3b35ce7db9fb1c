"""Hard-negative mining by branch and bound over ball trees.

Each shard of vectors has a ball tree. For a query, the inner product with a node's center, plus and minus the product of
the query's length and the node's radius, bounds the scores of all its rows above and below. A search asks for the k best
rows of the same or of another label whose score lies in a window. It leaves out nodes that lie outside of the window,
nodes that have only labels that don't count, and nodes that are strictly beneath the k-th best score so far; what is left are leaves,
whose rows are scored as matrices. A first search finds each anchor's positives (same label, no window), a second one the
negatives of each anchor and positive (other labels, a window about the positive's score).

Centers are whole numbers and lengths are rounded up, so the bounds are exact and no row is lost to rounding. Where vectors
are so large that double precision doesn't hold the bounds, nothing is left out and products are computed in whole numbers.

Edge cases: see `vectors`. Rows with a null label take no part. An anchor's own row is no positive of itself, but its repetitions are. An
anchor without positives, a positive with a negative score (its window is empty) and a window without rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm import vectors
from quillmill.llm.storage import cut
from quillmill.llm.vectors import BEST_DDL, ENTRY, NONE, Shards, arithmetic, best, bounds_fit, edges, integers, levels_of, pack, products, size_of, usable, vectors_of

#: Searches of a block at most.
BLOCK = 1 << 13


class Search:
    """Searches of a block over the shards of a range; the running lists go on from shard to shard."""

    def __init__(self, shards: Shards, wanted: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.shards, self.wanted, self.labels, self.low, self.high, self.k, self.same = shards, wanted, labels, low, high, k, same
        most, width = size_of(wanted), max(shards.width, wanted.shape[1])
        self.bounded = bounds_fit(width, most, shards.most)
        self.kind = arithmetic(width, most, shards.most)
        self.limit = min(2**63 - 1, width * most * shards.most)
        self.numbers = wanted.astype(self.kind)
        squares = (wanted.astype(np.float64) ** 2).sum(axis=1) if self.bounded else None
        self.length = np.ceil(np.sqrt(squares)) if self.bounded else None  # at least the true length: squares are exact, and so are roots of squares
        self.scores, self.ranks = np.full((len(wanted), k), NONE), np.zeros((len(wanted), k), np.int64)
        self.seen = self.leaves = 0

    def over(self, number: int, home: np.ndarray, place: np.ndarray) -> None:
        row = self.shards.rows[number]
        n, matrix, labels = len(row["ids"]), self.shards.matrix(number), np.array(row["labels"], np.int64)
        depth = levels_of(n) if self.bounded and row["radii"] else 0
        alive, upper = self._alive(row, labels, depth)
        at = edges(n, depth)
        self.leaves += alive.shape[1]
        rising = np.where(alive, upper, -np.inf).max(axis=0)
        for leaf in np.argsort(-rising, kind="stable"):
            who = np.flatnonzero(alive[:, leaf] & (upper[:, leaf] >= self.scores[:, -1]))
            if not len(who):
                continue
            self.seen += 1
            low, high = at[leaf], at[leaf + 1]
            found = products(self.numbers[who], matrix[low:high], self.kind)
            fits = ((self.labels[who, None] == labels[low:high]) == self.same) & (found >= self.low[who, None]) & (found <= self.high[who, None]) & (found >= self.scores[who, -1:])
            own = np.flatnonzero((home[who] == row["shard"]) & (place[who] >= low) & (place[who] < high))
            fits[own, place[who][own] - low] = False
            some = np.flatnonzero(fits.any(axis=1))
            if len(some):
                who, found = who[some], np.where(fits[some], found[some], NONE)
                ranks = np.broadcast_to(self.shards.ranks[number][low:high], found.shape)
                self.scores[who], self.ranks[who] = best(np.hstack([self.scores[who], found]), np.hstack([self.ranks[who], ranks]), self.k, self.limit, len(self.shards.ids))

    def _alive(self, row: dict, labels: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Which leaves may hold rows for which searches, and the upper bounds there."""
        n = len(labels)
        alive, upper = np.ones((len(self.wanted), 1), bool), np.full((len(self.wanted), 1), np.inf)
        centers = np.frombuffer(row["centers"], np.int64).reshape(-1, row["width"])
        for level in range(depth + 1):
            alive = np.repeat(alive, 2, axis=1) if level else alive
            starts = edges(n, level)[:-1]
            least, most = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
            own = self.labels[:, None]
            alive &= ((least <= own) & (own <= most)) if self.same else ~((least == own) & (own == most))
            if self.bounded and row["radii"]:
                nodes = slice((1 << level) - 1, (2 << level) - 1)
                middle = products(self.wanted, centers[nodes], "float64").astype(np.float64)
                reach = self.length[:, None] * np.array(row["radii"][nodes], np.float64)
                upper = middle + reach
                alive &= (upper >= np.maximum(self.low, self.scores[:, -1])[:, None]) & (middle - reach <= self.high[:, None])
        return alive, np.broadcast_to(upper, alive.shape)


def _searched(k: int, same: bool, low: int, high: int, key: list[str], out: pa.Schema):
    def run(queries: pa.Table, table: pa.Table) -> pa.Table:
        if not queries.num_rows or not table.num_rows:
            return out.empty_table()
        shards = Shards(table)
        least, most = np.full(queries.num_rows, NONE + 1), np.full(queries.num_rows, 2**63 - 1)
        if not same:
            anchored = queries["positive_score"].to_pylist()  # of any length: low percent of it, rounded up, to high percent, rounded down
            bound = lambda x: min(max(x, NONE + 1), 2**63 - 1)
            least, most = (np.array([bound(x) for x in side], np.int64) for side in ([-(-low * s // 100) for s in anchored], [high * s // 100 for s in anchored]))
        search = Search(shards, vectors_of(queries["vector"]), queries["label"].to_numpy(), least, most, k, same)
        home, place = queries["shard"].to_numpy(), queries["pos"].to_numpy()
        for number in range(len(shards.rows)):
            search.over(number, home, place)
        return queries.select([*key, "range"]).append_column("best", shards.lists(search.scores, search.ranks)).cast(out)

    return run


def mine(
    frame: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256,
    key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", shard_rows: int = vectors.ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    For each row for which `is_anchor` holds and each of its first `positives` other rows of the same label, the first
    `negatives` rows of another label whose score is from `low` to `high` percent of the positive's. Scores are inner products of
    floor(scale * component); higher ones come first, ties by smaller id. Labels are integers.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = frame.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("wanted"), F.col(vector).alias("vector"))
    rows = rows.filter(F.col("label").isNotNull() & usable(F.col("vector"))).withColumn("vector", integers(F.col("vector"), scale))
    shards = pack(rows, with_trees=True, most_rows=shard_rows)
    anchors = vectors.queries_of(shards)
    key1, fields = ["shard", "pos", "id", "label"], [("shard", pa.int64()), ("pos", pa.int32()), ("id", pa.int64()), ("label", pa.int64())]
    tail = [("range", pa.int32()), ("best", pa.list_(ENTRY))]
    lists, ranges = vectors.cells(anchors, shards, _searched(positives, True, 0, 0, key1, pa.schema(fields + tail)), f"shard long, pos int, id long, label long, range int, {BEST_DDL}", BLOCK)
    pairs = vectors.merged(lists, key1, positives, ranges).select(*key1, F.posexplode("best").alias("nth", "entry"))
    pairs = cut(pairs.select(*key1, "nth", F.col("entry.id").alias("positive_id"), (-F.col("entry.neg")).alias("positive_score")))
    searches = pairs.filter(F.signum("positive_score") * (high - low) >= 0)  # of the others the window is empty
    searches = searches.join(anchors.select("shard", "pos", "vector"), ["shard", "pos"])
    key2 = [*key1, "nth", "positive_id", "positive_score"]
    fields += [("nth", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]
    lists, ranges = vectors.cells(
        searches, shards, _searched(negatives, False, low, high, key2, pa.schema(fields + tail)), f"shard long, pos int, id long, label long, nth int, positive_id long, positive_score long, range int, {BEST_DDL}", BLOCK
    )
    found = vectors.merged(lists, key2, negatives, ranges).select("id", "positive_id", "positive_score", F.posexplode("best").alias("at", "entry"))
    return found.select(
        F.col("id").alias("anchor_id"), "positive_id", (F.col("at") + 1).alias("rank"), F.col("entry.id").alias("negative_id"), "positive_score", (-F.col("entry.neg")).alias("negative_score")
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 100 == 0, label=label)
