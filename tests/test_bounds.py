"""What a task holds and how often it asks doesn't grow with the tables."""

from pyspark.sql import Row

from quillmill.operators import supplementary
from quillmill.streaming import queries, sessions


def test_a_session_stream_reads_bounded_deliveries(spark, data, monkeypatch):
    monkeypatch.setattr(queries, "DELIVERY", 150, raising=False)
    read, events = [], spark.read.parquet(f"{data}/events.parquet").count()
    counted = lambda stream: [read.append(r.numInputRows) for r in stream.recentProgress]
    from pyspark.sql.streaming.query import StreamingQuery

    awaited = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, *a: (awaited(self, *a), counted(self))[0])
    got = sorted(map(tuple, queries.sessions_stream(spark, data).collect()))
    assert got == sorted(map(tuple, queries.sessions_batch(spark, data).collect()))
    assert sum(read) == events + 1 and max(read) < 300


def test_sessions_ask_their_state_once_a_batch():
    class State(dict):
        calls = []

        def exists(self):
            self.calls.append("exists")
            return "v" in self

        def get(self):
            self.calls.append("get")
            return self.get_value()

        def get_value(self):
            return dict.get(self, "v")

        def update(self, value):
            self["v"] = value

    class Handle:
        state = State()

        def getValueState(self, *_):
            return self.state

        def registerTimer(self, at):
            pass

        deleteTimer = registerTimer

    keeper = sessions.SessionKeeper(10, 100)
    keeper.init(Handle())
    out = [list(keeper.handleInputRows((7,), [Row(user_id=7, event_id=k, at_ms=at)], None)) for k, at in enumerate((0, 5, 30))]
    assert [[(r["kind"], r["status_before"]) for r in o] for o in out] == [[("message", "new")], [("message", "active")], [("closed", "active"), ("message", "idle_closed")]]
    assert State.calls == ["get"] * 3


def test_whole_texts_go_to_python_in_small_batches(spark, data):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        assert supplementary.plain_decode(spark, data).count() == 200 and spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)


def test_a_batch_of_changes_stores_the_whole_of_its_buckets_once(spark, tmp_path, monkeypatch):
    from quillmill.streaming import sync

    cuts, cut = [], sync.cut
    monkeypatch.setattr(sync, "cut", lambda frame: cuts.append(frame.columns) or cut(frame))
    for seq, text in ((1, "a\nb"), (2, "c")):
        sync.apply_changes(spark.createDataFrame([(seq, 5, text, "published", "m")], sync.CHANGES), str(tmp_path / "store"), sync.lines_of)
    assert [r["chunk"] for r in sync.current(spark, str(tmp_path / "store")).collect()] == ["c"] and not [c for c in cuts if "chunk" in c]
