"""Sessions as state with timers: a session without messages for a while is closed by event time, and a later message opens it again.

Each user's state holds the session's status, its last message's time, and how many messages and re-activations it had. An
event-time timer closes it, with a message of the system's; a second one forgets it after `KEEP`. A message that comes before the
watermark has reached the timer closes the session itself where the gap is long enough, so results don't depend on how
messages fall into batches. Messages older than the watermark are dropped; others that are late count, but turn no clock back.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmill.plans.checkpoints import scratch
from quillmill.registry import query
from quillmill.sources.tables import table

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "status string, last long, messages long, times long, timer long"
OUT = "user_id long, kind string, event_id long, at_ms long, status_before string, reactivates boolean, times long, messages long"


def _row(*values: Any) -> Row:
    return Row(**dict(zip([c.split()[0] for c in OUT.split(", ")], values, strict=True)))


class SessionKeeper(StatefulProcessor):
    """Of rows (user_id, event_id, at_ms): a row for each message with the state it met, and for each closing, whose event_id is -1."""

    def __init__(self, idle: int, keep: int):
        self.idle, self.keep = idle, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def _set_timer(self, old: int | None, new: int | None) -> None:
        if old is not None and old >= 0:
            self.handle.deleteTimer(old)
        if new is not None:
            self.handle.registerTimer(new)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        (user,) = key
        status, last, messages, times, timer = self.state.get() or ("new", -1, 0, 0, -1)  # each call to the state is a message to the JVM
        for row in sorted(rows, key=lambda r: (r["at_ms"], r["event_id"])):
            if status == "active" and row["at_ms"] >= last + self.idle:
                status, messages = "idle_closed", messages + 1
                yield _row(user, "closed", -1, last + self.idle, "active", False, times, messages)
            again = status == "idle_closed"
            times, messages = times + again, messages + 1
            yield _row(user, "message", row["event_id"], row["at_ms"], status, again, times, messages)
            status, last = "active", max(last, row["at_ms"])
        self._set_timer(timer, last + self.idle)
        self.state.update((status, last, messages, times, last + self.idle))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        (user,) = key
        held = self.state.get()
        if held is None:
            return
        status, last, messages, times, timer = held
        if status == "active":
            self._set_timer(None, last + self.idle + self.keep)
            self.state.update(("idle_closed", last, messages + 1, times, last + self.idle + self.keep))
            yield _row(user, "closed", -1, last + self.idle, "active", False, times, messages + 1)
        else:  # closed for long: a later message begins a new session
            self.state.clear()

    def close(self) -> None:
        pass


def session_changes(messages: DataFrame, idle: int, keep: int, delay: str) -> DataFrame:
    """Changes of sessions of a stream (user_id, event_id, ts), milliseconds `idle` and `keep`; `delay` is how late a message may be."""
    timed = messages.withWatermark("ts", delay).select("user_id", "event_id", "ts", F.unix_millis("ts").alias("at_ms"))
    return timed.groupBy("user_id").transformWithState(SessionKeeper(idle, keep), OUT, "Append", "EventTime")


def run_to_end(stream: DataFrame, at: str) -> DataFrame:
    """Append what a stream gives of all that is there now, a folder for each batch, so that a batch that is run again replaces only itself."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)  # timers need it
    try:
        put = lambda frame, batch: frame.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")
        stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/*")


#: Half a day without a message closes a session; it is forgotten after a hundred days.
IDLE, KEEP, DELAY = 12 * 3_600_000, 100 * 86_400_000, "6 hours"
PARTS = 4


@query("str1_str2_session_stream", """
  WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms, lag(epoch_us(ts) // 1000) OVER w AS before, lead(epoch_us(ts) // 1000) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id)),
  g AS (SELECT *, coalesce(at_ms >= before + 43200000, false) AS again, (SELECT epoch_us(max(ts)) // 1000 FROM events) - 21600000 AS mark FROM e),
  n AS (SELECT *, row_number() OVER w AS said, sum(again::INTEGER) OVER w AS times FROM g WINDOW w AS (PARTITION BY user_id ORDER BY at_ms, event_id ROWS UNBOUNDED PRECEDING))
  SELECT user_id, 'message' AS kind, event_id, at_ms, CASE WHEN before IS NULL THEN 'new' WHEN again THEN 'idle_closed' ELSE 'active' END AS status_before, again AS reactivates, times::BIGINT AS times, (said + times)::BIGINT AS messages FROM n
  UNION ALL SELECT user_id, 'closed', -1, at_ms + 43200000, 'active', false, times::BIGINT, (said + times + 1)::BIGINT FROM n WHERE after >= at_ms + 43200000 OR (after IS NULL AND at_ms + 43200000 <= mark)""")
def session_stream(spark, d):
    """The events in some deliveries, one a batch, and the closing of all sessions that are idle when the stream ends."""
    events = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    at = scratch(spark, "sessions")
    if low is not None:
        step = (high - low) / PARTS
        for n in range(PARTS):  # one after the other, so that they are read in this order
            until = F.lit(low + step * (n + 1)) if n + 1 < PARTS else F.lit(high) + F.expr("INTERVAL 1 SECOND")
            events.filter((F.col("ts") >= F.lit(low + step * n)) & (F.col("ts") < until)).coalesce(1).write.mode("append").parquet(f"{at}/events")
    else:
        events.write.parquet(f"{at}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/events")
    return run_to_end(session_changes(stream, IDLE, KEEP, DELAY), at)
