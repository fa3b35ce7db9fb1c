"""Streaming twins of batch rollups: the same function over a stream and over a table, so that both can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.checkpoints import scratch
from quillmill.registry import query
from quillmill.sources.tables import table

LATE = "1 day"
#: Events of a delivery, which is a batch.
DELIVERY = 1_000_000


def hourly_counts(events: DataFrame) -> DataFrame:
    """Counts and sums by type in hours of event time."""
    return events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of users that end after a gap without events."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def run_available(spark, stream: DataFrame) -> DataFrame:
    """Run an aggregating stream over all that is there now, each row once, and read what it gave: windows are written when
    the watermark has passed them, and their state goes. Each batch has a folder of its own, so a batch that is run again
    replaces only itself."""
    at = scratch(spark, "stream")

    def put(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")

    stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/*")


def deliver(events: DataFrame, at: str, rows: int) -> None:
    """Write events as files in the order of their time, one after the other, of about so many rows each (more where many have one time), so that
    neither a batch that reads one nor the state between batches grows with the table. Events without a time go with the first."""
    spark, staged = events.sparkSession, scratch(events.sparkSession, "staged")
    parts = max(1, -(-events.count() // rows))
    edges = sorted(set(events.agg(F.percentile_approx("ts", [k / parts for k in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    edges = [e for e in edges if not events.filter(F.col("ts") > F.lit(e)).isEmpty()]
    later = [(F.col("ts") > F.lit(e)).cast("int") for e in edges]
    if not edges:
        events.coalesce(1).write.parquet(at)
        return
    events.withColumn("delivery", F.coalesce(sum(later, F.lit(0)), F.lit(0))).write.partitionBy("delivery").parquet(staged)
    for n in range(len(edges) + 1):  # none is empty: each edge is the time of an event, and the last one isn't the latest time
        spark.read.schema(events.schema).parquet(f"{staged}/delivery={n}").coalesce(1).write.mode("append").parquet(at)


def _stream(spark, d: str) -> DataFrame:
    """The events, and after them one without a user or type, later than the watermark's delay, that closes all windows."""
    events, at = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), scratch(spark, "events")
    deliver(events, at, DELIVERY)
    last = events.agg((F.max("ts") + F.expr(f"INTERVAL {LATE}") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(*[F.col("ts") if c == "ts" else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns])
    last.write.mode("append").parquet(at)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(at).withWatermark("ts", LATE)


_HOURS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2"
_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k"""


@query("str_tumbling_batch", _HOURS)
def tumbling_batch(spark, d):
    return hourly_counts(table(spark, d, "events"))


@query("str_sessions_batch", _SESSIONS)
def sessions_batch(spark, d):
    return sessions(table(spark, d, "events"))


@query("str_tumbling_stream", _HOURS)
def tumbling_stream(spark, d):
    """The stream's windows are those of the batch, all of them."""
    return run_available(spark, hourly_counts(_stream(spark, d))).filter("event_type IS NOT NULL")


@query("str_sessions_stream", _SESSIONS)
def sessions_stream(spark, d):
    return run_available(spark, sessions(_stream(spark, d))).filter("user_id IS NOT NULL")
