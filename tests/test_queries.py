"""Every query against its SQL on the smallest tables, and what SQL can't express against fixed expectations."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill import catalog as registry
from quillmill.operators import graph, incremental, retrieval

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        at = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(str, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, data, duck, name):
    assert rows(registry.QUERIES[name](spark, data).toPandas()) == rows(duck.execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


#: Columns that are the same in all rows by the tables or by what is asked for: the mean over all, tables' even shares, filters, unit length.
MEANT = {
    ("agg10_rating_histogram", "mean"), ("agg13_documents_per_collection", "n"), ("agg17_gen1_merge_entities", "docs"), ("dns2_unit_vectors", "before"), ("dns2_unit_vectors", "after"),
    ("flt1_flt3_flt4_flt6_dynamic_filter", "event_type"), ("joi16_article_hits", "articles"), ("src12_index_load", "dim"), ("sup21_knowledge_bases", "documents"),
}


def test_no_sql_is_idle():
    """Every SQL has rows, and every column of several rows varies, or the comparison with it says little."""
    folder, con = "/root/testdata/sf0.01", duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    idle = []
    for name, sql in sorted(registry.ORACLE_SQL.items()):
        found = con.execute(sql).df()
        same = [c for c in found.columns if len(found) > 1 and found[c].map(str).nunique() == 1 and (name, c) not in MEANT]
        idle += [(name, same)] if same or found.empty else []
    assert idle == []


def test_fusion(spark):
    side = lambda scores: spark.createDataFrame([(1, i, float(s), r + 1) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: -x[1]))], "query_id int, id string, score double, rank int")
    fused = lambda a, b, boosts=None, limit=0: [(r["id"], round(r["score"], 6)) for r in retrieval.fuse(side(a), side(b), boosts, limit).orderBy("rank").collect()]
    assert fused({"a": 0.9, "b": 0.5}, {"a": 0.1, "b": 0.9}) == [("a", 0.55), ("b", 0.45)]
    assert fused({"a": 0.95, "b": 0.10}, {"a": 0.01, "b": 900})[0] == ("a", 0.55)
    assert fused({"x": 0.9, "both": 0.8, "low": 0.1}, {"y": 9.0, "both": 8.0, "low2": 1.0})[0][0] == "both"
    assert fused({"a": 0.5}, {}) == [("a", 0.55)] and fused({"a": 0.5, "b": 0.5}, {}, limit=1) == [("a", 0.55)]
    boosts = spark.createDataFrame([(1, "b", 0.25)], "query_id int, id string, boost double")
    assert fused({"a": 0.9, "b": 0.86, "c": 0.1}, {}, boosts)[0][0] == "b" and fused({"a": 0.9, "b": 0.1}, {"a": 3.0, "b": 1.0}, boosts)[0][0] == "a"


def test_signal_boost(spark):
    frame = spark.createDataFrame([("3-1-10", "제5조", "article", ["3-1-10"], ["제5조"]), ("2-0-1", "제1조", "article", [], []), ("2-0-1", "부칙", "addendum", [], []), ("2-0-1", "제1조", "article", ["3-1-10"], [])], "d string, a string, s string, nd array<string>, na array<string>")
    got = [round(r[0], 6) for r in frame.select(retrieval.signal_boost(*[F.col(c) for c in ("d", "a", "s", "nd", "na")], "2-0-1")).collect()]
    assert got == [0.25, 0.05, 0.0, 0.0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 6), (6, 7), (9, 9)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert (got[3], got[7], got[130]) == (1, 5, 100) and set(got.values()) == {1, 5, 100}


def test_entity_merge_keeps_the_longest_first_description(spark):
    mentions = spark.createDataFrame([(" Big  U", "org", "short", 1, 0, 1), ("big u", "uni", "longer text", 2, 3, 2), ("BIG U", "x", "other tex11", 1, 0, 3)], "name string, kind string, description string, doc long, chunk long, seq long")
    r = graph.merge_entities(mentions).first()
    assert (r["key"], r["kind"], r["description"], r["docs"], r["places"], r["mentions"]) == ("big u", "org", "longer text", 2, 2, 3)
    assert sorted((x["key"], x["doc"], x["chunk"]) for x in graph.entity_places(mentions).collect()) == [("big u", 1, 0), ("big u", 2, 3)]


def test_replacing_leaves_no_ghosts(spark):
    old = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "doc_id long, chunk_index int")
    new = spark.createDataFrame([(1, 0)], "doc_id long, chunk_index int")
    assert sorted(tuple(r) for r in incremental.replace_documents(old, new).collect()) == [(1, 0), (2, 0)]


def test_upsert_and_insert_absent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, incremental.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, incremental.insert_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_bootstrap_from_counts(spark):
    """The interval from counted outcomes is the normal one, and that of redrawing rows one by one, but for chance."""
    from quillmill.functions.statistics import bootstrap
    from quillmill.operators.evaluation import bootstrap_means

    rows = [("a", int(i % 10 < 7)) for i in range(400)] + [("b", 1)] * 5 + [("c", i % 3) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, v int")
    got = {r["g"]: r for r in bootstrap_means(frame, "g", "v", 1000).collect()}
    again = {r["g"]: r for r in bootstrap_means(frame.repartition(7), "g", "v", 1000).collect()}
    assert got == again and (got["b"]["low"], got["b"]["high"]) == (1.0, 1.0)
    for g in ("a", "c"):
        values = [float(v) for n, v in rows if n == g]
        mean = sum(values) / len(values)
        half = 1.96 * (sum((v - mean) ** 2 for v in values) / len(values) ** 2) ** 0.5
        _, low, high = bootstrap(values, 1000)
        assert got[g]["mean"] == pytest.approx(mean) and abs(got[g]["low"] - (mean - half)) < 0.02 and abs(got[g]["high"] - (mean + half)) < 0.02
        assert abs(got[g]["low"] - low) < 0.02 and abs(got[g]["high"] - high) < 0.02


def test_upkeep_refuses_what_does_not_fit(spark):
    from quillmill.operators import upkeep

    points = spark.createDataFrame([(1, [0.0, 1.0])], "position long, embedding array<double>")
    with pytest.raises(ValueError):
        upkeep.checked_dimension(points, 3)
    with pytest.raises(ValueError):
        upkeep.index_load(spark.createDataFrame([(1, "a"), (2, "b")], "position long, text string"), points)
    assert upkeep.checked_dimension(points, 2).count() == 1


def test_names_are_resolved_exactly_or_by_containment(spark):
    from quillmill.operators.relational import resolve_names

    names = spark.createDataFrame([("Big House",), ("House",), ("big",), ("ab",), ("Zed",), ("",)], "name string")
    said = spark.createDataFrame([(" house ",), ("the big house of x",), ("bi",), ("cab",), ("zedd",), ("q",), ("",)], "mention string")
    got = {r["mention"]: r["name"] for r in resolve_names(said, names).collect()}
    assert got == {" house ": "House", "the big house of x": "Big House", "bi": "Big House", "cab": "ab", "zedd": "Zed", "q": None, "": None}


def test_a_name_in_every_mention_makes_no_pairs(spark, monkeypatch):
    """Names and mentions against all pairs, over several automata and slices; some names are one letter long, one is in every mention."""
    import random

    from quillmill.operators import name_matching

    monkeypatch.setattr(name_matching, "PATTERN_LETTERS", 300)
    monkeypatch.setattr(name_matching, "TEXT_LETTERS", 2000)
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choices("abcd", k=n))
    names = ["ab", "a", "AB ", "b", "É"] + [word(rnd.randint(2, 9)) for _ in range(150)]
    mentions = [f"{word(rnd.randint(0, 6))}ab{word(rnd.randint(0, 6))}" for _ in range(200)] + ["é", "zz", " ABCD", "x" * 5000 + "dd"]
    rows = name_matching.resolve_names(spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    fold = lambda t: t.strip(" ").lower()

    def slow(m):
        same = [n for n in names if fold(n) == fold(m)]
        near = [n for n in names if fold(n) in fold(m) or fold(m) in fold(n)]
        return min(same) if same else min(near, key=lambda n: (-len(n), n), default=None)

    assert {r["mention"]: r["name"] for r in rows} == {m: slow(m) for m in mentions}


def test_json_containment(spark):
    from quillmill.functions.containment import json_contains

    doc = '{"a": {"b": [1, {"c": "x", "d": null}]}, "n": 7, "t": "7", "f": 1.50, "yes": true, "a b": 1, "e": []}'
    holds = [{}, {"n": 7}, {"n": 7.0}, {"t": "7"}, {"f": 1.5}, {"yes": True}, {"a b": 1}, {"e": []}, {"a": {"b": [1]}}, {"a": {"b": [{"c": "x"}, 1]}}, {"a": {"b": [{"d": None}]}}, {"a": {}}]
    fails = [{"n": "7"}, {"t": 7}, {"yes": 1}, {"yes": "true"}, {"m": None}, {"a": {"b": [2]}}, {"a": {"b": [{"c": "x", "e": 1}]}}, {"e": [1]}, {"n": []}, [], {"a": {"b": {"c": "x"}}}, {"n": 8}, {"f": 1}]
    frame = spark.createDataFrame([(doc,)], "doc string")
    assert all(frame.select(*[json_contains(F.col("doc"), w).alias(str(i)) for i, w in enumerate(holds)]).first())
    assert not any(frame.select(*[json_contains(F.col("doc"), w).alias(str(i)) for i, w in enumerate(fails)]).first())
    odd = spark.createDataFrame([(None,), ("",), ("no json",), ("[1, 2]",)], "doc string")
    assert [tuple(r) for r in odd.select(json_contains(F.col("doc"), {}), json_contains(F.col("doc"), [2])).collect()] == [(False, False)] * 3 + [(False, True)]


def test_streams_have_all_windows_of_the_batch(spark, data):
    for name in ("tumbling", "sessions"):
        batch, stream = ([tuple(r) for r in registry.QUERIES[f"str_{name}_{kind}"](spark, data).collect()] for kind in ("batch", "stream"))
        assert sorted(batch) == sorted(stream) and len(batch) > 0


def test_scans_are_pruned_and_filters_pushed_down(spark, data):
    plan = registry.QUERIES["flt7_flt9_in_and_contains"](spark, data)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [Or(StringContains(p_type,ECON),StringContains(p_type,PRO)), In(p_size, [1,5,9])" in plan and "p_retailprice" not in plan


@pytest.mark.parametrize("module", ["operators.textual", "operators.supplementary", "operators.graph", "functions.text", "streaming.queries", "catalog"])
def test_modules_import_on_their_own(module):
    """As in a task's Python worker, which imports what it needs first."""
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", f"import quillmill.{module}"], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_scores_of_sources_round_as_sql_does(spark, tmp_path):
    """65450 / 1e6 is 0.06545 as the shortest decimal, but below it in binary."""
    import datetime

    day = datetime.datetime(2020, 1, 1)
    spark.createDataFrame([(1, 1, "O", 65450.0, day, "5-LOW"), (2, 1, "O", 32350.0, day, "5-LOW")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 7, 1, 48350.0)], "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = rows(registry.QUERIES["cnv5_source_payload"](spark, str(tmp_path)).toPandas())
    assert got == rows(con.execute(registry.ORACLE_SQL["cnv5_source_payload"]).df()) and "0.0654;" in got[1][0][1]


def test_store_counts_cover_all_documents(spark, data):
    found = registry.QUERIES["joi20_cross_store_counts"](spark, data).collect()
    for whole in (True, False):
        part = [r for r in found if (r["size"] == "all") == whole]
        assert sum(r["n_docs"] for r in part) == spark.read.parquet(f"{data}/documents.parquet").count()
        assert sum(r["n_labels"] for r in part) == spark.read.parquet(f"{data}/labels.parquet").count()


def test_oracle_contexts_of_shared_and_several_articles(spark, monkeypatch):
    """Questions with the same articles, with several ones, and with none; gold in packs. No exchange carries the gold rows."""
    from quillmill.operators import goldset

    monkeypatch.setattr(goldset, "PACK", 2)
    gold = spark.createDataFrame([(1, 1, "a"), (1, 1, " a"), (2, 1, "a"), (2, 2, "b"), (3, 9, "z"), (4, 2, "b"), (5, 1, None)], "query_id long, doc_id long, article string")
    chunks = spark.createDataFrame([(10, 1, "a "), (14, 1, "a"), (12, 2, "b"), (13, 3, "c"), (11, 1, "a"), (15, 3, None)], "chunk_id long, doc_id long, article string")
    hits = spark.createDataFrame([(q, c, r) for q in (1, 2, 3, 4, 5) for r, c in enumerate([10, 13, 12, 15, 14])], "query_id long, chunk_id long, rank int")
    found = goldset.oracle_context(gold, chunks, hits, top_k=5)
    got = {}
    for r in found.orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["chunk_id"], r["role"][0]))
    assert got == {1: [(1, 10, "g"), (2, 11, "g"), (3, 14, "g"), (4, 13, "d"), (5, 12, "d")], 2: [(1, 10, "g"), (2, 11, "g"), (3, 12, "g"), (4, 14, "g"), (5, 13, "d")], 4: [(1, 12, "g"), (2, 10, "d"), (3, 13, "d"), (4, 15, "d"), (5, 14, "d")]}
    copies = lambda n: (spark.range(n).selectExpr("id AS query_id", "1L AS doc_id", "'a' AS article"), spark.range(400).selectExpr("id AS chunk_id", "1L AS doc_id", "'a' AS article"))
    plan = goldset.oracle_context(*copies(50), hits)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") >= 1 and "Window" not in plan.split("Generate posexplode")[0]


def test_entities_of_lines_with_one_number_are_those_stored_first(spark, tmp_path):
    """Lines that share order and number, in one file and in two; the first line of a brand whose part has no type, and lines without a supplier."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    part = [(i, f"Brand#{i % 3}", None if i == 12 else f"T{i}", "n" * (i % 7)) for i in range(60)]
    lines = [(1 + i // 1500, 2, (i * 7 + 58) % 60, None if i % 50 == 0 else i % 4) for i in range(3000)]
    pq.write_table(pa.table(dict(zip(("p_partkey", "p_brand", "p_type", "p_name"), zip(*part)))), f"{tmp_path}/part.parquet")
    os.mkdir(f"{tmp_path}/lineitem.parquet")
    for n, some in enumerate((lines[:600], lines[600:])):
        pq.write_table(pa.table(dict(zip(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), zip(*some)))), f"{tmp_path}/lineitem.parquet/part-{n}.parquet")
    found = registry.QUERIES["agg17_gen1_merge_entities"](spark, str(tmp_path)).toPandas()
    first = {}
    for _, _, key, _ in lines:
        if part[key][2]:
            first.setdefault(part[key][1].lower(), part[key][2])
    assert dict(zip(found["key"], found["kind"])) == first and first["brand#0"] != "T12"
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet'; CREATE VIEW lineitem AS FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert rows(found) == rows(con.execute(registry.ORACLE_SQL["agg17_gen1_merge_entities"]).df())


def test_oracle_contexts_take_little_room(spark, tmp_path, monkeypatch):
    """Each question's gold chunks in their order, whatever blocks and packs they meet in, an unnamed question's too. The rows of many questions with the
    same long lists are written in under half a byte each, and nothing holds all rows of a block at once."""
    from quillmill.operators import goldset

    gold = spark.range(2000).selectExpr("nullif(id, 5) AS query_id", "id % 8 AS doc_id", "'a' AS article")
    chunks = spark.range(8000).selectExpr("id AS chunk_id", "id * 7 % 8 AS doc_id", "' a' AS article")
    none = spark.createDataFrame([], "query_id long, chunk_id long, rank int")
    found = goldset.oracle_context(gold, chunks, none)
    found.write.parquet(f"{tmp_path}/out")
    n = spark.read.parquet(f"{tmp_path}/out").count()
    assert n == 2000 * 1000 and sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < n / 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode(transform(" in plan  # a lambda keeps it from being compiled together with the join
    monkeypatch.setattr(goldset, "PACK", 64)
    monkeypatch.setattr(goldset, "BLOCK", 3)
    monkeypatch.setattr(goldset, "TASK_ROWS", 5000)
    some = goldset.oracle_context(gold.filter("query_id IS NULL OR query_id < 200"), chunks, none).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))).alias("all")).collect()
    lists = {q: [c for c in range(8000) if c * 7 % 8 == q % 8] for q in range(8)}
    assert {r["query_id"]: [tuple(x) for x in r["all"]] for r in some} == {None if q == 5 else q: list(enumerate(lists[q % 8], 1)) for q in range(200)}
