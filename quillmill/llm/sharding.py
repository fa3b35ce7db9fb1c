"""Sharding by jump consistent hashing, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.storage import keep


def jump_shard(key: Column, shards: int, *more: int) -> Column:
    """A struct of shard numbers, ``n<count>`` for each shard count given.

    A key walks through ever larger shard numbers: from shard b the next jump goes to floor((b + 1) / u), u uniform in
    (0, 1] and drawn from a hash of the key and the jump's number. The last landing below the shard count is the shard. Since
    the walk doesn't depend on the count, one more shard takes only the keys whose walk lands on it. A walk below n has
    about ln(n) jumps and n at most. A null key is a key like any other.
    """
    counts = [shards, *more]
    draw = lambda jump: (F.shiftrightunsigned(F.xxhash64(key, jump), 33).cast("double") + 1) / float(1 << 31)
    start = F.struct(F.lit(0).cast("long").alias("next"), *[F.lit(0).alias(f"n{n}") for n in counts])

    def jump(state: Column, number: Column) -> Column:
        at = state["next"]
        return F.when(at >= max(counts), state).otherwise(
            F.struct(
                F.floor((at + 1) / draw(number)).alias("next"),
                *[F.when(at < n, at.cast("int")).otherwise(state[f"n{n}"]).alias(f"n{n}") for n in counts],
            )
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(max(counts))), start, jump)


#: Equal rows that one task numbers in a go.
COPIES = 100_000


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows_per_run: int = 100_000) -> DataFrame:
    """Add `size`, `text_crc32`, `shard`, `grown_shard` and a gapless `slot` within the shard; the text itself never moves.

    Rows that are alike are counted first and numbered together, so a row that is repeated very often is one row in every
    exchange. Shards may hold any share of the rows, so slots are numbered in two levels: rows are counted by (shard, run), a
    run being a hash range of about `rows_per_run` rows; the runs' offsets are running sums over those counts, and only
    within a run are rows sorted. Null text: no bytes. Null keys share a shard; repeated rows get slots of their own, and
    those of more than `COPIES` are dealt over tasks.
    """
    where = jump_shard(F.col(key), shards, shards + 1)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = (
        docs.select(F.col(key), F.octet_length(body).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
        .withColumn("size", F.col("size") + 8)
        .groupBy(key, "size", "text_crc32").agg(F.count("*").alias("n"))
        .withColumn("where", where)
        .select(key, "size", "text_crc32", F.col(f"where.n{shards}").alias("shard"), F.col(f"where.n{shards + 1}").alias("grown_shard"), "n")
    )
    counted = keep(slim)
    runs = max(1, counted.count() // rows_per_run)
    counted = counted.withColumn("run", F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(runs)).cast("int"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.groupBy("shard", "run").agg(F.sum("n").alias("rows")).select("shard", "run", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "run").orderBy(key, "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["shard", "run"])
    first = first.select(key, "size", "text_crc32", "shard", (F.col("offset") + F.col("first")).alias("first"), "grown_shard", "n")

    def numbered(rows: DataFrame, low: Column, high: Column) -> DataFrame:
        copy = F.explode(F.sequence(low, high - 1)).alias("copy")
        return rows.select("*", copy).select(key, "size", "text_crc32", "shard", (F.col("first") + F.col("copy")).alias("slot"), "grown_shard")

    zero = F.lit(0).cast("long")
    few = numbered(first.filter(F.col("n") <= COPIES), zero, F.col("n"))
    many = first.filter(F.col("n") > COPIES).withColumn("low", F.explode(F.sequence(zero, F.col("n") - 1, F.lit(COPIES).cast("long"))))
    return few.unionByName(numbered(many.repartition(key, "text_crc32", "low"), F.col("low"), F.least(F.col("low") + COPIES, F.col("n"))))


def query(spark, sf_dir: str) -> DataFrame:
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
