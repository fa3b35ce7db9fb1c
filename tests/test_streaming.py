"""Streams with state: sessions with timers, and the store kept current by changes."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quillmill.streaming import sessions, sync

START = dt.datetime(2024, 1, 1)


def run_sessions(spark, at, batches, idle_h=2, keep_h=10, delay="1 hour"):
    """Rows of each batch (hours, user, event), a file a batch."""
    n = 0
    for rows in batches:
        frame = spark.createDataFrame([(u, e, START + dt.timedelta(hours=h)) for h, u, e in rows], "user_id long, event_id long, ts timestamp")
        frame.coalesce(1).write.mode("append").parquet(f"{at}/events")
        n += 1
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{at}/events")
    changes = sessions.session_changes(stream, int(idle_h * 3_600_000), int(keep_h * 3_600_000), delay)
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    out = sessions.run_to_end(changes, at).collect()
    return sorted(((r["at_ms"] - base) / 3_600_000, r["user_id"], r["kind"], r["event_id"], r["status_before"], r["reactivates"], r["times"], r["messages"]) for r in out)


def test_sessions_close_reopen_and_are_forgotten(spark, tmp_path):
    got = run_sessions(spark, str(tmp_path), [
        [(0, 1, 1), (1, 1, 2), (0, 2, 3)],
        [(4, 3, 4)],  # the watermark passes 3: both are idle for two hours by then
        [(5, 1, 5), (20, 3, 6)],  # 1 comes back; 3 does too, after a gap of its own
        [(40, 9, 7)],  # 2 is forgotten by now
        [(41, 2, 8)],
    ])
    of = lambda u: [r for r in got if r[1] == u]
    assert of(1) == [(0, 1, "message", 1, "new", False, 0, 1), (1, 1, "message", 2, "active", False, 0, 2), (3, 1, "closed", -1, "active", False, 0, 3),
                     (5, 1, "message", 5, "idle_closed", True, 1, 4), (7, 1, "closed", -1, "active", False, 1, 5)]
    assert of(2) == [(0, 2, "message", 3, "new", False, 0, 1), (2, 2, "closed", -1, "active", False, 0, 2), (41, 2, "message", 8, "new", False, 0, 1)]
    assert of(3) == [(4, 3, "message", 4, "new", False, 0, 1), (6, 3, "closed", -1, "active", False, 0, 2), (20, 3, "message", 6, "idle_closed", True, 1, 3), (22, 3, "closed", -1, "active", False, 1, 4)]


def test_late_messages(spark, tmp_path):
    got = run_sessions(spark, str(tmp_path), [[(10, 1, 1)], [(9.5, 1, 2)], [(3, 1, 3)], [(10.2, 1, 4)]])
    messages = [r[3] for r in got if r[2] == "message"]
    assert sorted(messages) == [1, 2, 4]  # 3 is older than the watermark
    assert [r for r in got if r[2] == "closed"] == []  # the late ones have turned no clock back


def changes(spark, rows):
    return spark.createDataFrame(rows, sync.CHANGES)


def content(spark, at):
    return sorted((r["key"], r["version"], r["chunk_index"], r["chunk"]) for r in sync.current(spark, at).collect())


def actions(frame):
    return {r["key"]: r["action"] for r in frame.collect()}


def test_changes_are_applied_once(spark, tmp_path):
    at = str(tmp_path / "store")
    first = changes(spark, [(1, 1, "a\nb\nc", "published", "m"), (1, 2, "x", "published", "m"), (1, 3, "d", "draft", "m"), (0, 1, "old", "published", "m"), (1, 4, None, "published", "m")])
    assert actions(sync.apply_changes(first, at, sync.lines_of)) == {1: "index", 2: "index", 3: "skip", 4: "index"}
    assert content(spark, at) == [(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 1, 2, "c"), (2, 1, 0, "x"), (4, 1, 0, "")]
    assert set(actions(sync.apply_changes(first, at, sync.lines_of)).values()) == {"skip"}
    second = changes(spark, [(2, 1, "a", "published", "m"), (2, 2, "x", "archived", "m"), (2, 4, None, "published", "other")])
    assert actions(sync.apply_changes(second, at, sync.lines_of)) == {1: "index", 2: "delete", 4: "index"}
    want = [(1, 2, 0, "a"), (4, 2, 0, "")]
    assert content(spark, at) == want
    assert set(actions(sync.apply_changes(second, at, sync.lines_of)).values()) == {"skip"} and content(spark, at) == want
    assert actions(sync.apply_changes(changes(spark, [(3, 2, "x", "published", "m")]), at, sync.lines_of)) == {2: "index"}
    assert content(spark, at) == [(1, 2, 0, "a"), (2, 2, 0, "x"), (4, 2, 0, "")]
    assert actions(sync.apply_changes(changes(spark, []), at, sync.lines_of)) == {}


def test_a_batch_applied_in_part_is_completed(spark, tmp_path):
    """As when the job ended after some buckets had been replaced."""
    at, whole = str(tmp_path / "store"), [(1, k, f"text {k}\nline", "published", "m") for k in range(40)]
    sync.apply_changes(changes(spark, whole), at, sync.lines_of)
    batch = [(2, k, f"text {k}", "published" if k % 5 else "archived", "m") for k in range(40)]
    in_first = {r["key"] for r in changes(spark, batch).filter(sync.bucket_of(F.col("key"), sync.BUCKETS) < 3).collect()}
    sync.apply_changes(changes(spark, [r for r in batch if r[1] in in_first]), at, sync.lines_of)
    done = actions(sync.apply_changes(changes(spark, batch), at, sync.lines_of))
    assert {k for k, a in done.items() if a == "skip"} == in_first
    assert content(spark, at) == [(k, 2, 0, f"text {k}") for k in range(40) if k % 5]


def test_only_touched_buckets_are_written(spark, tmp_path):
    at = str(tmp_path / "store")
    sync.apply_changes(changes(spark, [(1, k, str(k), "published", "m") for k in range(60)]), at, sync.lines_of)
    files = lambda: {f"{d}/{f}" for d, _, names in os.walk(at) for f in names if f.endswith(".parquet")}
    before = files()
    sync.apply_changes(changes(spark, [(2, 7, "new", "published", "m")]), at, sync.lines_of)
    assert len({os.path.dirname(f) for f in before ^ files()}) == 1


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    folder, at, state = (str(tmp_path / x) for x in ("in", "store", "state"))
    seen = []
    for n in range(2):
        changes(spark, [(n, k, f"{k} {n}", "published", "m") for k in range(5)]).write.mode("append").parquet(folder)
        seen.append(sync.sync_available(spark.readStream.schema(sync.CHANGES).parquet(folder), at, state, sync.lines_of))
    assert [[b["index"] for b in s] for s in seen] == [[5], [5]] and [b["batch"] for s in seen for b in s] == [0, 1]
    assert {v for _, v, _, _ in content(spark, at)} == {2}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_nothing_and_nulls(spark, tmp_path, rows):
    at = str(tmp_path / "store")
    sync.apply_changes(changes(spark, rows), at, sync.lines_of)
    assert content(spark, at) == []
