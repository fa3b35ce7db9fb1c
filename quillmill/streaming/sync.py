"""A store of document chunks kept current by a stream of changes: change detection, replacement by partition, replay.

The store is Parquet, partitioned by a hash of the key. A batch of changes reads the buckets of its keys alone, compares hashes,
models and states, and replaces these buckets by dynamic partition overwrite; all others stay untouched. A document that has
changed is replaced with all its chunks, so a shrunken one leaves none behind. One that is no longer published leaves a row without
chunks, so that its bucket is written and the removal isn't lost. Since what is stored decides, a batch that is run again,
whether it had been applied in full or only in some buckets, changes nothing that it has changed already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.plans.checkpoints import bounded, cut, scratch
from quillmill.registry import query
from quillmill.sources.tables import table

BUCKETS = 8
#: A row for each chunk; `gone` rows have none.
STORE = "key long, hash string, model string, version int, gone boolean, chunk_index int, chunk string, bucket int"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, at: str) -> DataFrame:
    """All rows of the store; none before its first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    return spark.read.schema(STORE).parquet(at) if there else spark.createDataFrame([], STORE)


def current(spark: SparkSession, at: str) -> DataFrame:
    """The chunks of documents that are published."""
    return stored(spark, at).filter("NOT gone")


def apply_changes(changes: DataFrame, at: str, chunks_of, buckets: int = BUCKETS) -> DataFrame:
    """Bring the store up to changes (seq, key, text, status, model), of which the last of each key counts. Returns what was
    done: key, action (index, skip, delete).

    Published documents are indexed unless hash and model are the stored ones; others are removed. `chunks_of` cuts a text
    into an array of chunks.
    """
    spark = changes.sparkSession
    newest = Window.partitionBy("key").orderBy(F.desc("seq"))
    last = changes.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")
    wanted = cut(last.withColumn("bucket", bucket_of(F.col("key"), buckets)).withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)))
    touched = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # as many as there are buckets at most
    old = stored(spark, at).filter(F.col("bucket").isin(touched))
    before = old.groupBy("key").agg(F.first("hash").alias("old_hash"), F.first("model").alias("old_model"), F.first("version").alias("old_version"), F.bool_and("gone").alias("was_gone"))
    joined = wanted.join(before, "key", "left")
    there = F.col("was_gone").isNotNull() & ~F.coalesce("was_gone", F.lit(True))
    same = there & F.col("hash").eqNullSafe(F.col("old_hash")) & F.col("model").eqNullSafe(F.col("old_model"))
    action = F.when(F.col("status") == "published", F.when(same, "skip").otherwise("index")).when(there, "delete").otherwise("skip")
    plan = cut(joined.withColumn("action", F.coalesce(action, F.lit("skip"))).withColumn("version", F.coalesce("old_version", F.lit(0)) + F.when(F.col("action") == "index", 1).otherwise(0)))
    changed = plan.filter("action <> 'skip'")
    kept = old.join(bounded(changed.select("key", F.lit(True).alias("_changed"))), "key", "left").filter("_changed IS NULL").select(old.columns)
    chunks = F.when(F.col("action") == "index", chunks_of(F.col("text")))
    fresh = changed.select(
        "key", F.when(F.col("action") == "index", F.col("hash")).alias("hash"), "model", "version", (F.col("action") == "delete").alias("gone"), F.posexplode_outer(chunks).alias("chunk_index", "chunk"), "bucket"
    )
    whole = kept.unionByName(fresh.select(old.columns)).join(F.broadcast(changed.select("bucket").distinct()), "bucket", "left_semi")  # what is written replaces nothing before all of it is there
    whole.select(*[c for c in old.columns if c != "bucket"], "bucket").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(at)
    return plan.select("key", "action")


def sync_available(stream: DataFrame, at: str, state: str, chunks_of) -> list[dict]:
    """Apply all changes of a stream that are there now; what each batch did, by action. A run with the same `state` goes on where the last one ended."""
    done: list[dict] = []

    def put(batch: DataFrame, number: int) -> None:
        counts = apply_changes(batch, at, chunks_of).groupBy("action").agg(F.count("*").alias("n")).collect()
        done.append({"batch": number} | {r["action"]: r["n"] for r in counts})

    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return done


CHANGES = "seq long, key long, text string, status string, model string"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _deliveries(spark, d: str) -> list[DataFrame]:
    """Two deliveries of the documents: at first some are missing and some are drafts; later texts have grown or shrunk, and some are archived."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    first = docs.filter(k % 13 != 0).select(F.lit(1).cast("long").alias("seq"), k.alias("key"), "text", F.when(k % 17 == 0, "draft").otherwise("published").alias("status"), F.lit("m1").alias("model"))
    text = F.when(k % 5 == 0, F.substring_index("text", "\n", 1)).when(k % 7 == 0, F.concat("text", F.lit("\n!"))).otherwise(F.col("text"))
    second = docs.filter(k % 11 != 0).select(F.lit(2).cast("long").alias("seq"), k.alias("key"), text.alias("text"), F.when(k % 19 == 0, "archived").otherwise("published").alias("status"), F.when(k % 23 == 0, "m2").otherwise("m1").alias("model"))
    return [first, second.unionByName(second.filter(k % 3 == 0).withColumn("seq", F.lit(0).cast("long")).withColumn("text", F.lit("stale")))]  # of two of a key the last counts


@query("str4_str5_snk3_streaming_sync", """
  WITH x AS (SELECT doc_id AS key, coalesce(text, '') AS old, doc_id % 13 <> 0 AND doc_id % 17 <> 0 AS was, doc_id % 11 <> 0 AS again, doc_id % 19 = 0 AS archived, doc_id % 23 = 0 AS moved,
    coalesce(CASE WHEN doc_id % 5 = 0 THEN string_split(text, chr(10))[1] WHEN doc_id % 7 = 0 THEN text || chr(10) || '!' ELSE text END, '') AS new FROM documents),
  f AS (SELECT key, CASE WHEN again THEN new ELSE old END AS text, CASE WHEN NOT again THEN 'm1' WHEN moved THEN 'm2' ELSE 'm1' END AS model, CASE WHEN again AND was AND (new <> old OR moved) THEN 2 ELSE 1 END AS version FROM x WHERE (again AND NOT archived) OR (NOT again AND was))
  SELECT key, model, version::INTEGER AS version, chunk_index::INTEGER AS chunk_index, md5(chunk) AS chunk FROM (SELECT *, unnest(string_split(text, chr(10))) AS chunk, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM f)""")
def streaming_sync(spark, d):
    """Two runs of one stream, then its last delivery once more, as after a failure."""
    folder, at, state = (scratch(spark, name) for name in ("changes", "store", "state"))
    deliveries = _deliveries(spark, d)
    for n, delivery in enumerate(deliveries):
        delivery.write.parquet(f"{folder}/delivery={n}")
        sync_available(spark.readStream.schema(CHANGES).parquet(f"{folder}/*"), at, state, lines_of)
    apply_changes(deliveries[-1], at, lines_of)
    return current(spark, at).select("key", "model", "version", "chunk_index", F.md5("chunk").alias("chunk"))
