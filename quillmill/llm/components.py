"""Connected components of a links table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.storage import cut


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in `links` (a, b): the smallest id reachable.

    Alternating large-star and small-star steps: in the first each id's larger neighbours are hung on its smallest
    neighbour, in the second its smaller neighbours are. Both keep components, and the number of rounds grows with the
    logarithm of the number of ids. Each round is aggregated by id with map-side combination and cut by a checkpoint.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = pairs
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.join(least, "u")
        if large:
            hung = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            hung = hung.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        return hung.filter("u != v").distinct()

    seen = None
    while True:
        edges = cut(star(star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        seen = now
