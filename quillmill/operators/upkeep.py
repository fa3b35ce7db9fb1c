"""Upkeep of stores: sessions, jobs, collections, deletions, uploads, categories, caches, captures and load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import masking, misc, text
from quillmill.functions.identity import uuid5
from quillmill.functions.statistics import kappa
from quillmill.operators.analytics import nearest_ranks
from quillmill.operators.incremental import upsert
from quillmill.operators.relational import ORDERS, page, search_in
from quillmill.plans.checkpoints import scratch
from quillmill.registry import query
from quillmill.sources.tables import table


def one_of(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def close_idle(sessions: DataFrame, now: Column, idle: str) -> tuple[DataFrame, DataFrame]:
    """Sessions (id, status, last, messages) and the messages that this adds: active sessions without activity for `idle` are
    closed, with a system message that counts."""
    due = (F.col("status") == "active") & (F.col("last") < now - F.expr(f"INTERVAL {idle}"))
    marked = sessions.withColumn("due", due)
    closed = marked.select("id", F.when(F.col("due"), "idle_closed").otherwise(F.col("status")).alias("status"), "last", (F.col("messages") + F.col("due").cast("int")).alias("messages"))
    said = marked.filter("due").select(F.col("id").alias("session"), F.lit("system").alias("role"), now.alias("at"))
    return closed, said


@query("str1_idle_sessions", """
  WITH s AS (SELECT user_id AS id, CASE WHEN user_id % 5 = 0 THEN 'ended' ELSE 'active' END AS status, max(ts) AS last, count(*) AS n FROM events GROUP BY 1), d AS (SELECT *, status = 'active' AND last < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR AS due FROM s)
  SELECT 'session' AS kind, id, CASE WHEN due THEN 'idle_closed' ELSE status END AS status, (n + due::INTEGER)::BIGINT AS messages FROM d UNION ALL SELECT 'message', id, 'system', 1 FROM d WHERE due""")
def idle_sessions(spark, d):
    sessions = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last"), F.count("*").alias("messages")).withColumn("status", F.when(F.col("id") % 5 == 0, "ended").otherwise("active"))
    closed, said = close_idle(sessions, F.lit("2024-01-30 12:00:00").cast("timestamp"), "6 HOURS")
    return one_of(closed.select(F.lit("session").alias("kind"), "id", "status", "messages"), said.select(F.lit("message").alias("kind"), F.col("session").alias("id"), F.col("role").alias("status"), F.lit(1).cast("bigint").alias("messages")))


@query("str2_reactivation", """
  WITH g AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  SELECT event_id, CASE WHEN before IS NULL THEN 'new' WHEN ts >= before + INTERVAL 12 HOUR THEN 'idle_closed' ELSE 'active' END AS status_before, coalesce(ts >= before + INTERVAL 12 HOUR, false) AS reactivates,
    sum(CASE WHEN ts >= before + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS times FROM g""")
def reactivation(spark, d):
    """Each message with the state that its session was in: after half a day without one it was closed, and is active again."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, d, "events").withColumn("before", F.lag("ts").over(order))
    late = F.coalesce(F.col("ts") >= F.col("before") + F.expr("INTERVAL 12 HOURS"), F.lit(False))
    state = F.when(F.col("before").isNull(), "new").when(late, "idle_closed").otherwise("active")
    return events.withColumn("late", late).select("event_id", state.alias("status_before"), F.col("late").alias("reactivates"), F.sum(F.col("late").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("times"))


def reap_stale(jobs: DataFrame, documents: DataFrame, now: Column, after: str) -> tuple[DataFrame, DataFrame]:
    """Jobs (job, status, started) that run for longer than `after` have failed, and their documents (doc, job, status) still in
    progress are in error."""
    stale = (F.col("status") == "running") & (F.col("started") < now - F.expr(f"INTERVAL {after}"))
    reaped = jobs.withColumn("reaped", stale).select("job", F.when(F.col("reaped"), "failed").otherwise(F.col("status")).alias("status"), F.when(F.col("reaped"), now).alias("ended"), "reaped")
    hit = documents.join(reaped.filter("reaped").select("job", F.lit(True).alias("hit")), "job", "left")
    status = F.when(F.col("hit").isNotNull() & (F.col("status") == "processing"), "error").otherwise(F.col("status"))
    return reaped.drop("reaped"), hit.select("doc", "job", status.alias("status"))


@query("snk7_str3_reap_stale_jobs", """
  WITH j AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status, o_orderdate AS started FROM orders), s AS (SELECT *, status = 'running' AND started < TIMESTAMP '1998-01-01' - INTERVAL 60 MINUTE AS stale FROM j)
  SELECT 'job' AS kind, job AS key, 0::BIGINT AS sub, CASE WHEN stale THEN 'failed' ELSE status END AS status FROM s
  UNION ALL SELECT 'document', l_orderkey, l_linenumber::BIGINT * 1000000 + l_partkey, CASE WHEN stale AND l_linestatus = 'O' THEN 'error' WHEN l_linestatus = 'O' THEN 'processing' ELSE 'completed' END FROM lineitem LEFT JOIN s ON job = l_orderkey""")
def reap(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "F", "failed").otherwise("completed")
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("started"))
    docs = table(spark, d, "lineitem").select((F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")).alias("doc"), F.col("l_orderkey").alias("job"), F.when(F.col("l_linestatus") == "O", "processing").otherwise("completed").alias("status"))
    reaped, hit = reap_stale(jobs, docs, F.lit("1998-01-01").cast("timestamp"), "60 MINUTES")
    return one_of(reaped.select(F.lit("job").alias("kind"), F.col("job").alias("key"), F.lit(0).cast("bigint").alias("sub"), "status"), hit.select(F.lit("document").alias("kind"), F.col("job").alias("key"), F.col("doc").alias("sub"), "status"))


@query("sup20_review_status", """
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'answered' ELSE 'open' END AS status, CASE WHEN event_id % 3 = 0 THEN 'user' || (event_id % 4) END AS reviewer, CASE WHEN event_id % 3 = 0 THEN '2024-02-01 00:00:00' END AS reviewed FROM events WHERE event_type = 'error'""")
def review_status(spark, d):
    """Unanswered questions with the reviewer's updates put in: status, reviewer and time change together, or not at all."""
    questions = table(spark, d, "events").filter("event_type = 'error'").select("event_id", F.lit("open").alias("status"))
    updates = questions.filter("event_id % 3 = 0").select("event_id", F.lit("answered").alias("new"), F.concat(F.lit("user"), (F.col("event_id") % 4).cast("string")).alias("reviewer"))
    joined = questions.join(updates, "event_id", "left")
    return joined.select("event_id", F.coalesce("new", "status").alias("status"), "reviewer", F.when(F.col("new").isNotNull(), "2024-02-01 00:00:00").alias("reviewed"))


def checked_dimension(points: DataFrame, dimension: int) -> DataFrame:
    """The points, or an error if one has another dimension: a collection takes vectors of one size."""
    wrong = points.filter(F.size("embedding") != dimension).limit(1).count()
    if wrong:
        raise ValueError(f"vectors must have {dimension} dimensions")
    return points


@query("snk4_point_lifecycle", """
  SELECT 'stored' AS step, count(*)::BIGINT AS n FROM embeddings UNION ALL SELECT 'upserted', (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) UNION ALL SELECT 'relabelled', count(*) FROM embeddings WHERE vec_id % 4 = 1
  UNION ALL SELECT 'deleted', (SELECT count(*) FILTER (CASE WHEN vec_id % 4 = 1 THEN 99 ELSE label END <> 2) FROM embeddings) + (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0)""")
def point_lifecycle(spark, d):
    """A collection is filled, changed by an upsert of old and new points, and points are deleted by an equality filter."""
    points = checked_dimension(table(spark, d, "embeddings"), 64).select("vec_id", "label")
    new = one_of(points.filter("vec_id % 4 = 1").withColumn("label", F.lit(99)), points.filter("vec_id % 10 = 0").select((-F.col("vec_id") - 1).alias("vec_id"), F.lit(98).alias("label")))
    after = upsert(points, new, ["vec_id"])
    left = after.filter("label <> 2")
    count = lambda f, step: f.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "n")
    return one_of(count(points, "stored"), count(after, "upserted"), count(after.filter("label = 99"), "relabelled"), count(left, "deleted"))


@query("snk13_cascade_delete", """
  WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
  SELECT 'customer' AS kind, c_custkey AS key, 0::BIGINT AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'order', o_orderkey, o_custkey FROM o UNION ALL SELECT 'lines', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone)) GROUP BY l_orderkey""")
def cascade_delete(spark, d):
    """What is left of parents, children and their children when some parents are deleted."""
    customers, orders, lines = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    gone = customers.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    gone_orders = orders.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    left = lines.join(gone_orders, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = lambda f, kind, key, n: f.select(F.lit(kind).alias("kind"), key.alias("key"), n.alias("n"))
    return one_of(rows(customers.filter("c_acctbal >= 0"), "customer", F.col("c_custkey"), F.lit(0).cast("bigint")), rows(orders.join(gone, "o_custkey", "left_anti"), "order", F.col("o_orderkey"), F.col("o_custkey")), rows(left, "lines", F.col("l_orderkey"), F.col("n")))


@query("msk4_rule_preview", r"""
  SELECT 'mail' AS rule, true AS valid, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::BIGINT AS changed FROM documents UNION ALL SELECT 'digits', true, count(*) FILTER (regexp_matches(text, '\d{6}-?\d{7}')) FROM documents
  UNION ALL SELECT 'broken', false, 0 UNION ALL SELECT 'empty', false, 0""")
def rule_preview(spark, d):
    """Rules are checked before they are used, and each valid one is shown with how many texts it would change."""
    rules = {"mail": (masking.MASKING_RULES[2][1], "partial"), "digits": (masking.MASKING_RULES[3][1], "full"), "broken": ("([a-z", "full"), "empty": ("x*", "full")}
    valid = {name: masking.usable_pattern(pattern) for name, (pattern, _) in rules.items()}
    docs = table(spark, d, "documents")
    changed = [F.count_if(masking.apply_rules(F.col("text"), [(name, *rules[name], "****")]) != F.col("text")).alias(name) if ok else F.lit(0).cast("bigint").alias(name) for name, ok in valid.items()]
    shown = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(ok).alias("valid"), F.col(name).alias("changed")) for name, ok in valid.items()])
    return docs.agg(*changed).select(F.inline(shown))


@query("src6_table_cache", "SELECT p_brand AS table_id, count(*)::BIGINT + 1 AS n_rows, (2 * count(*) + 2 - count(*) FILTER (p_size % 5 = 0))::BIGINT AS filled, md5(string_agg(p_name || '|' || CASE WHEN p_size % 5 = 0 THEN '' ELSE p_size::VARCHAR END, ';' ORDER BY p_partkey)) AS cells FROM part GROUP BY 1")
def table_cache(spark, d):
    """Tables kept as JSON, one file for all, read back with a schema: rows of cells, ragged ones too."""
    at = scratch(spark, "tables")
    cell = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_size").cast("string"))
    grouped = table(spark, d, "part").groupBy(F.col("p_brand").alias("table_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.array("p_name", cell).alias("cells")))).alias("r"))
    grouped.select("table_id", F.concat(F.array(F.array(F.lit("name"), F.lit("size"))), F.transform("r", lambda x: x["cells"])).alias("rows")).write.json(at)
    read = spark.read.schema("table_id string, rows array<array<string>>").json(at)
    cells = F.array_join(F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r: F.array_join(r, "|")), ";")
    return read.select("table_id", F.size("rows").cast("bigint").alias("n_rows"), F.size(F.filter(F.flatten("rows"), lambda c: c != "")).cast("bigint").alias("filled"), F.md5(cells).alias("cells"))


def index_load(chunks: DataFrame, vectors: DataFrame, key: str = "position") -> DataFrame:
    """Chunks with their vectors by position; an error if there isn't one vector for each chunk."""
    joined = chunks.join(vectors, key)
    counts = [f.count() for f in (chunks, vectors, joined)]
    if len(set(counts)) > 1:
        raise ValueError(f"{counts[0]} chunks, {counts[1]} vectors, {counts[2]} of them at the same position")
    return joined


@query("src12_index_load", "SELECT vec_id AS position, label, len(embedding)::INTEGER AS dim FROM embeddings")
def index_load_query(spark, d):
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "position")
    return index_load(vectors.select("position", "label"), vectors.select("position", "embedding")).select("position", "label", F.size("embedding").alias("dim"))


@query("sup4_pages", """
  SELECT 'orders' AS list, o_orderkey AS id FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20) UNION ALL SELECT 'customers', c_custkey FROM (SELECT c_custkey FROM customer WHERE contains(lower(c_name), '1') AND c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 10 OFFSET 20)
  UNION ALL SELECT 'events', event_id FROM (SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 50) UNION ALL SELECT 'parts', p_partkey FROM (SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3) ORDER BY p_partkey DESC LIMIT 15 OFFSET 15)
  UNION ALL SELECT 'suppliers', s_suppkey FROM supplier WHERE s_nationkey < 5""")
def pages(spark, d):
    """Five filtered lists, a page of each in its own order; the last is unpaged."""
    listed = lambda f, name, c: f.select(F.lit(name).alias("list"), F.col(c).alias("id"))
    orders = page(table(spark, d, "orders").filter("o_orderstatus = 'F'"), ORDERS["created_desc"]({"created": "o_orderdate", "id": "o_orderkey"}), 2, 20)
    customers = page(table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").filter(search_in("1", F.col("c_name"))), ORDERS["id_asc"]({"id": "c_custkey"}), 3, 10)
    clicks = table(spark, d, "events").filter("event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
    events = page(clicks, ORDERS["created_asc"]({"created": "ts", "id": "event_id"}), 1, 50)
    parts = page(table(spark, d, "part").filter(F.col("p_size").isin(1, 2, 3)), ORDERS["id_desc"]({"id": "p_partkey"}), 2, 15)
    suppliers = page(table(spark, d, "supplier").filter("s_nationkey < 5"), ORDERS["id_asc"]({"id": "s_suppkey"}), 1, 0)
    return one_of(listed(orders, "orders", "o_orderkey"), listed(customers, "customers", "c_custkey"), listed(events, "events", "event_id"), listed(parts, "parts", "p_partkey"), listed(suppliers, "suppliers", "s_suppkey"))


def upload(documents: DataFrame, store: DataFrame, size: int = 500, overlap: int = 50) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, pages) into a store of points (point_id, doc_id, chunk_index, page, chunk), and each document's outcome.
    Pages are cut into windows, chunks are numbered through all pages, and all points of a document replace the old ones."""
    cut = documents.select("doc_id", F.posexplode("pages").alias("page", "body")).select("doc_id", "page", F.posexplode(text.window_pieces(F.col("body"), size, overlap)).alias("at", "chunk"))
    order = Window.partitionBy("doc_id").orderBy("page", "at")
    numbered = cut.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), (F.col("page") + 1).alias("page"), "chunk")
    points = numbered.withColumn("point_id", uuid5(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))).select(store.columns)
    stored = store.join(documents.select("doc_id"), "doc_id", "left_anti").unionByName(points)
    counts = documents.select("doc_id").join(points.groupBy("doc_id").agg(F.count("*").alias("chunks")), "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return stored, counts.withColumn("status", F.when(F.col("chunks") > 0, "completed").otherwise("error"))


@query("sup6_upload_pipeline", """
  WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents), w AS (SELECT doc_id, page, i, trim(substr(body, i * 450 + 1, 500), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS chunk
    FROM (SELECT *, unnest(range(0, greatest(0, ceil((length(body) - 500) / 450))::BIGINT + 1)) AS i FROM p))
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1)::INTEGER AS chunk_index, page::INTEGER AS page, md5(chunk) AS chunk FROM w WHERE chunk <> '' UNION ALL SELECT -n_nationkey - 1, 0, 1, n_name FROM nation""")
def upload_pipeline(spark, d):
    """A store that has other documents, and chunks of the same documents that are replaced."""
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("pages"))
    old = table(spark, d, "nation").select(F.col("n_name").alias("point_id"), (-F.col("n_nationkey") - 1).cast("bigint").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("page"), F.col("n_name").alias("chunk"))
    stale = docs.select(F.col("doc_id").cast("string").alias("point_id"), "doc_id", F.lit(7).alias("chunk_index"), F.lit(9).alias("page"), F.lit("stale").alias("chunk"))
    stored, _ = upload(docs, old.unionByName(stale))
    return stored.select("doc_id", "chunk_index", "page", F.when(F.col("doc_id") < 0, F.col("chunk")).otherwise(F.md5("chunk")).alias("chunk"))


def guard_updates(categories: DataFrame, updates: DataFrame) -> DataFrame:
    """(id, outcome) of updates (id, new_code, new_parent) to categories (id, code): a code must be nobody else's, a parent must
    exist and be another."""
    taken = categories.select(F.col("code").alias("new_code"), F.col("id").alias("owner"))
    joined = updates.join(categories.select("id", F.lit(True).alias("known")), "id", "left").join(taken, "new_code", "left")
    joined = joined.join(categories.select(F.col("id").alias("new_parent"), F.lit(True).alias("parent")), "new_parent", "left")
    conflict = F.col("owner").isNotNull() & (F.col("owner") != F.col("id"))
    return joined.select("id", F.when(F.col("known").isNull(), "not_found").when(conflict, "conflict").when(F.col("new_parent") == F.col("id"), "own_parent").when(F.col("new_parent").isNotNull() & F.col("parent").isNull(), "no_parent").otherwise("updated").alias("outcome"))


@query("sup8_update_guards", """
  WITH u AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'NATION_' || (n_nationkey + 1) WHEN n_nationkey % 5 = 1 THEN n_name ELSE 'NEW' || n_nationkey END AS new_code, CASE n_nationkey % 4 WHEN 0 THEN n_nationkey WHEN 1 THEN 999 WHEN 2 THEN 3 END AS new_parent FROM nation UNION ALL SELECT 500, 'X', NULL)
  SELECT id::INTEGER AS id, CASE WHEN id = 500 THEN 'not_found' WHEN EXISTS (SELECT 1 FROM nation WHERE n_name = new_code AND n_nationkey <> id) THEN 'conflict' WHEN new_parent = id THEN 'own_parent' WHEN new_parent IS NOT NULL AND new_parent NOT IN (SELECT n_nationkey FROM nation) THEN 'no_parent' ELSE 'updated' END AS outcome FROM u""")
def update_guards(spark, d):
    nation, k = table(spark, d, "nation"), F.col("n_nationkey")
    code = F.when(k % 5 == 0, F.concat(F.lit("NATION_"), (k + 1).cast("string"))).when(k % 5 == 1, F.col("n_name")).otherwise(F.concat(F.lit("NEW"), k.cast("string")))
    updates = nation.select(k.alias("id"), code.alias("new_code"), F.when(k % 4 == 0, k).when(k % 4 == 1, 999).when(k % 4 == 2, 3).alias("new_parent"))
    updates = updates.unionByName(spark.createDataFrame([(500, "X", None)], "id int, new_code string, new_parent int"))
    return guard_updates(nation.select(k.alias("id"), F.col("n_name").alias("code")), updates)


@query("sup15_arm_tables", """
  WITH x AS (SELECT source, lang, doc_id, quality, toxic FROM labels JOIN documents USING (doc_id)), c AS (SELECT source, lang, count(*) AS n, count(*) FILTER (quality = 0) AS failed FROM x GROUP BY 1, 2)
  SELECT 'arm' AS kind, source AS a, 'quality' AS b, round(avg(quality), 6) AS v FROM x GROUP BY source UNION ALL SELECT 'arm', source, 'clean', round(avg(1 - toxic), 6) FROM x GROUP BY source
  UNION ALL SELECT 'worst', source, lang, failed FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY failed DESC, lang) <= 2 UNION ALL SELECT 'defect', doc_id::VARCHAR, source, 1 FROM (SELECT * FROM x WHERE quality = 0 AND toxic = 1 ORDER BY doc_id LIMIT 20)""")
def arm_tables(spark, d):
    """Rates of each arm by source, the two classes with most failures, and the first twenty defects: the list's own limit."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    rates = x.groupBy("source").agg(F.avg("quality").alias("quality"), F.avg(1 - F.col("toxic")).alias("clean"))
    row = lambda f, kind, a, b, v: f.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), v.cast("double").alias("v"))
    arms = [row(rates, "arm", F.col("source"), F.lit(arm), F.round(arm, 6)) for arm in ("quality", "clean")]
    counts = x.groupBy("source", "lang").agg(F.count_if(F.col("quality") == 0).alias("failed")).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("failed"), "lang"))).filter("place <= 2")
    defects = x.filter("quality = 0 AND toxic = 1").orderBy("doc_id").limit(20)
    return one_of(*arms, row(counts, "worst", F.col("source"), F.col("lang"), F.col("failed")), row(defects, "defect", F.col("doc_id").cast("string"), F.col("source"), F.lit(1)))


@query("sup16_report", """
  WITH x AS (SELECT source, lang = 'de' AS control, lang, quality AS now, 1 - toxic AS base FROM labels JOIN documents USING (doc_id))
  SELECT coalesce(source, '*') AS source, count(*) FILTER (NOT control)::BIGINT AS n, count(*) FILTER (control)::BIGINT AS controls, round(avg(now) FILTER (NOT control), 6) AS rate, round(avg(now) FILTER (NOT control) - avg(base) FILTER (NOT control), 6) AS delta, count(*) FILTER (NOT control AND base = 1 AND now = 0)::BIGINT AS regressed,
    count(*) FILTER (NOT control AND base = 0 AND now = 1)::BIGINT AS improved, round(avg(now) FILTER (lang = 'en'), 6) AS en, round(avg(now) FILTER (lang = 'es'), 6) AS es, round(avg(now) FILTER (lang = 'fr'), 6) AS fr FROM x GROUP BY GROUPING SETS ((source), ())""")
def report(spark, d):
    """A run against its baseline by source and over all, control questions apart, with a matrix of classes."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").select("source", "lang", F.col("quality").alias("now"), (1 - F.col("toxic")).alias("base"))
    mine, control = F.col("lang") != "de", F.col("lang") == "de"
    rate = lambda c, when: F.avg(F.when(when, F.col(c)))
    pairs = lambda a, b: F.count_if(mine & (F.col("base") == a) & (F.col("now") == b))
    rows = x.groupingSets([["source"], []], "source").agg(
        F.count_if(mine).alias("n"), F.count_if(control).alias("controls"), F.round(rate("now", mine), 6).alias("rate"), F.round(rate("now", mine) - rate("base", mine), 6).alias("delta"),
        pairs(1, 0).alias("regressed"), pairs(0, 1).alias("improved"), *[F.round(rate("now", F.col("lang") == c), 6).alias(c) for c in ("en", "es", "fr")],
    )
    return rows.withColumn("source", F.coalesce("source", F.lit("*")))


VERDICTS = ["correct", "partial", "wrong"]


def cached_verdicts(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, verdict) of the keys that have a valid cached verdict (key, body as JSON); broken or unknown ones count as missing."""
    parsed = cache.select("key", F.from_json("body", "verdict string")["verdict"].alias("verdict")).filter(F.col("verdict").isin(VERDICTS)).dropDuplicates(["key"])
    return keys.join(parsed, "key", "left")


@query("sup18_verdict_cache", """
  WITH k AS (SELECT d.doc_id, l.quality, l.toxic, d.doc_id % 5 = 0 AS broken FROM documents d LEFT JOIN labels l USING (doc_id)), h AS (SELECT *, quality IS NOT NULL AND NOT broken AND doc_id % 7 <> 0 AS hit FROM k),
  t AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS agreed, sum(quality) AS a, sum(1 - toxic) AS b FROM h WHERE hit)
  SELECT (SELECT count(*) FROM h WHERE hit)::BIGINT AS hits, (SELECT count(*) FROM h WHERE NOT hit)::BIGINT AS misses, (SELECT count(*) FROM h WHERE NOT hit)::BIGINT AS audited, round(((agreed + n - a - b + agreed) / n - ((a/n)*(b/n) + (1-a/n)*(1-b/n))) / (1 - ((a/n)*(b/n) + (1-a/n)*(1-b/n))), 6) AS kappa,
    ((agreed + n - a - b + agreed) / n - ((a/n)*(b/n) + (1-a/n)*(1-b/n))) / (1 - ((a/n)*(b/n) + (1-a/n)*(1-b/n))) >= 0.8 AS accepted FROM t""")
def verdict_cache(spark, d):
    """Cached verdicts are used where they are valid; each other key is judged anew and noted in an audit table, to which calls
    are appended; the judge is accepted if it agrees with people beyond chance."""
    labels = table(spark, d, "labels")
    body = F.when(F.col("doc_id") % 5 == 0, '{"verdict": "corr').when(F.col("doc_id") % 7 == 0, '{"verdict": "maybe"}').otherwise(F.to_json(F.struct(F.when(F.col("quality") == 1, "correct").otherwise("wrong").alias("verdict"))))
    known = cached_verdicts(table(spark, d, "documents").select(F.col("doc_id").alias("key")), labels.select(F.col("doc_id").alias("key"), body.alias("body")))
    at = scratch(spark, "audit")
    calls = known.filter("verdict IS NULL").select("key", F.lit("judge").alias("by"))
    for part in (0, 1):  # two runs, each appends its calls
        calls.filter(F.pmod(F.xxhash64("key"), F.lit(2)) == part).write.mode("append").parquet(at)
    audited = spark.read.schema("key long, by string").parquet(at).agg(F.count("*").alias("audited"))
    people = labels.select(F.col("doc_id").alias("key"), (1 - F.col("toxic")).alias("human"))
    both = known.filter("verdict IS NOT NULL").join(people, "key").withColumn("machine", (F.col("verdict") == "correct").cast("int"))
    sums = both.agg(F.count_if((F.col("machine") == 1) & (F.col("human") == 1)).alias("both"), F.sum("machine").alias("a"), F.sum("human").alias("b"), F.count("*").alias("n"))
    k = kappa(F.col("both"), F.col("a"), F.col("b"), F.col("n"))
    counts = known.agg(F.count("verdict").alias("hits"), F.count_if(F.col("verdict").isNull()).alias("misses"))
    return counts.crossJoin(audited).crossJoin(sums.select(F.round(k, 6).alias("kappa"), (k >= 0.8).alias("accepted")))  # one row each


@query("sup21_knowledge_bases", """
  WITH d AS (SELECT source, count(*) AS documents, sum(ceil(length(text) / 500)) AS chunks FROM documents GROUP BY 1), j AS (SELECT 'src' || (o_custkey % 24) AS source, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last, count(*) FILTER (o_orderstatus = 'F') AS errors FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1)
  SELECT d.source, documents::BIGINT AS documents, chunks::BIGINT AS chunks, CASE WHEN last = 'P' THEN 'running' WHEN last = 'F' THEN 'failed' WHEN errors > 0 THEN 'partial' WHEN last IS NULL THEN 'none' ELSE 'ready' END AS status, last IS NOT NULL AS synced FROM d LEFT JOIN j USING (source)""")
def knowledge_bases(spark, d):
    """The list of knowledge bases: counts of documents and chunks, the state that the latest job leaves it in."""
    docs = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.ceil(F.length("text") / 500)).alias("chunks"))
    jobs = table(spark, d, "orders").filter("o_custkey % 4 <> 0").groupBy(F.concat(F.lit("src"), (F.col("o_custkey") % 24).cast("string")).alias("source"))
    jobs = jobs.agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last"), F.count_if(F.col("o_orderstatus") == "F").alias("errors"))
    status = F.when(F.col("last") == "P", "running").when(F.col("last") == "F", "failed").when(F.col("errors") > 0, "partial").when(F.col("last").isNull(), "none").otherwise("ready")
    return docs.join(jobs, "source", "left").select("source", "documents", "chunks", status.alias("status"), F.col("last").isNotNull().alias("synced"))


@query("sup21_logs", """
  SELECT o_custkey, o_orderkey, 'job' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_custkey % 2 = 0) WHERE rn <= 100
  UNION ALL SELECT o_custkey, o_orderkey, 'document' FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_custkey % 2 = 1 AND o_orderstatus = 'F') WHERE rn <= 100""")
def logs(spark, d):
    """The latest hundred logs of each source, from its jobs, or from its failed documents where it has no jobs."""
    recent = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    orders = table(spark, d, "orders")
    side = lambda f, origin: f.withColumn("rn", recent).filter("rn <= 100").select("o_custkey", "o_orderkey", F.lit(origin).alias("origin"))
    return one_of(side(orders.filter("o_custkey % 2 = 0"), "job"), side(orders.filter("o_custkey % 2 = 1 AND o_orderstatus = 'F'"), "document"))


def config_capture(files: DataFrame, allowed: dict[str, str], constants: dict[str, str], before: DataFrame, containers: list[str]) -> DataFrame:
    """(path, key, value) of configuration files (path, content): a digest of each, the allow-listed scalars of `key: value` and
    `KEY=value` lines after redaction (mode by key), named constants by their patterns, and whether a file is new or changed
    against (path, digest) before."""
    row = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    digest = F.sha2("content", 256)
    with_old = files.join(before.select("path", F.col("digest").alias("old")), "path", "left")
    state = F.when(F.col("old").isNull(), "untracked").when(F.col("old") != digest, "modified").otherwise("clean")
    line = r"^\s*([A-Za-z_][A-Za-z0-9_.]*)\s*[:=]\s*\"?([^\"\n]*?)\"?\s*$"
    scalar = F.transform(F.filter(F.split("content", "\n"), lambda x: x.rlike(line) & ~F.ltrim(x).startswith("#")), lambda x: row(F.regexp_extract(x, line, 1), F.regexp_extract(x, line, 2)))
    modes = F.create_map(*[F.lit(v) for kv in allowed.items() for v in kv])
    listed = F.filter(scalar, lambda s: F.map_contains_key(modes, s["key"]))
    shown = F.transform(listed, lambda s: row(s["key"], misc.redact(F.element_at(modes, s["key"]), s["value"], containers)))
    named = [F.when(F.col("content").rlike(p), F.array(row(F.lit(name), F.regexp_extract("content", p, 1)))).otherwise(F.array().cast("array<struct<key:string,value:string>>")) for name, p in constants.items()]
    return with_old.select("path", F.inline(F.concat(F.array(row(F.lit("sha256"), digest), row(F.lit("state"), state)), shown, *named)))


@query("sup26_config_capture", """
  WITH f AS (SELECT 'conf/' || p_partkey || '.yaml' AS path, p_partkey AS k, 'VERSION = "' || p_size || '.' || (p_partkey % 10) || '"' || chr(10) || '# host: hidden' || chr(10) || 'host: http://' || CASE p_partkey % 4 WHEN 0 THEN 'db' WHEN 1 THEN 'localhost' WHEN 2 THEN '10.1.2.3' ELSE 'x.example.org' END || ':80' || chr(10) || 'token=' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END || chr(10) || 'workers: ' || p_size || chr(10) || 'other: 1' AS content FROM part)
  SELECT path, 'sha256' AS key, sha256(content) AS value FROM f UNION ALL SELECT path, 'state', CASE WHEN k % 5 = 0 THEN 'untracked' WHEN k % 5 = 1 THEN 'modified' ELSE 'clean' END FROM f UNION ALL SELECT path, 'host', 'http://' || CASE k % 4 WHEN 0 THEN 'container:db' WHEN 1 THEN 'localhost' WHEN 2 THEN 'private-ip' ELSE 'public-host' END FROM f
  UNION ALL SELECT path, 'token', CASE WHEN k % 3 = 0 THEN 'unset' ELSE 'set' END FROM f UNION ALL SELECT path, 'workers', p_size::VARCHAR FROM f JOIN part ON p_partkey = k UNION ALL SELECT path, 'version', p_size || '.' || (k % 10) FROM f JOIN part ON p_partkey = k""")
def capture(spark, d):
    k = F.col("p_partkey")
    host = F.element_at(F.array(F.lit("db"), F.lit("localhost"), F.lit("10.1.2.3"), F.lit("x.example.org")), (k % 4 + 1).cast("int"))
    content = F.concat(F.lit('VERSION = "'), F.col("p_size").cast("string"), F.lit("."), (k % 10).cast("string"), F.lit('"\n# host: hidden\nhost: http://'), host, F.lit(":80\ntoken="), F.when(k % 3 == 0, "").otherwise(F.col("p_brand")), F.lit("\nworkers: "), F.col("p_size").cast("string"), F.lit("\nother: 1"))
    files = table(spark, d, "part").select(F.concat(F.lit("conf/"), k.cast("string"), F.lit(".yaml")).alias("path"), content.alias("content"), k.alias("k"))
    before = files.filter("k % 5 <> 0").select("path", F.sha2(F.when(F.col("k") % 5 == 1, "old").otherwise(F.col("content")), 256).alias("digest"))
    return config_capture(files.drop("k"), {"host": "shape", "token": "presence", "workers": "plain"}, {"version": r'(?m)^VERSION\s*=\s*"([^"]+)"'}, before, ["db"])


@query("sup28_load_waves", """
  WITH r AS (SELECT event_type AS wave, user_id, event_id, value, value <= 40 AS ok, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events),
  t AS (SELECT wave, CASE WHEN (n - 1) % 4 = 0 THEN 1 ELSE 2 END AS later, ok, value / 10 AS ttft, value AS total, 1 + event_id % 50 AS tokens FROM r), g AS (SELECT wave || '/' || later AS wave, count(*) AS requests, count(*) FILTER (ok) AS n, list_sort(list(ttft) FILTER (ok)) AS v, sum(tokens) FILTER (ok) AS tokens FROM t GROUP BY 1)
  SELECT wave, requests::BIGINT AS requests, n::BIGINT AS ok, v[CAST(round_even((n - 1) * 50 / 100.0, 0) AS INTEGER) + 1] AS p50, v[CAST(round_even((n - 1) * 90 / 100.0, 0) AS INTEGER) + 1] AS p90, tokens::BIGINT AS tokens FROM g WHERE n > 0""")
def load_waves(spark, d):
    """Requests of a load test's waves: each user's requests form sessions of four turns, the first without history; first and later
    turns are summed up apart, failed requests counted but not timed."""
    order = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    requests = table(spark, d, "events").withColumn("turn", (F.row_number().over(order) - 1) % 4 + 1)
    rows = requests.select(F.concat("event_type", F.lit("/"), F.when(F.col("turn") == 1, "1").otherwise("2")).alias("wave"), (F.col("value") <= 40).alias("ok"), (F.col("value") / 10).alias("ttft"), (1 + F.col("event_id") % 50).alias("tokens"))
    timed = rows.filter("ok")
    about = rows.groupBy("wave").agg(F.count("*").alias("requests"), F.count_if("ok").alias("ok"), F.sum(F.when(F.col("ok"), F.col("tokens"))).alias("tokens"))
    return about.join(nearest_ranks(timed, "wave", "ttft", {"p50": 50, "p90": 90}).select("wave", "p50", "p90"), "wave").select("wave", "requests", "ok", "p50", "p90", "tokens")


@query("scr11_article_parts", """
  WITH b AS (SELECT o_orderkey, o_orderpriority AS title, o_orderkey % 6 AS n, o_clerk_words AS words FROM (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(o_orderpriority || ' ' || o_orderstatus), '[a-z]{2,}'), lambda x: true)) AS o_clerk_words FROM orders))
  SELECT o_orderkey, title, n::INTEGER AS clauses, CASE WHEN n > 0 THEN '①' || ' item ' || (o_orderkey % 10) ELSE '' END AS first, array_to_string(list_sort(words), ',') AS keywords FROM b""")
def article_parts(spark, d):
    """An article's title, its clauses, and words that could serve to find it."""
    k = F.col("o_orderkey")
    marks = F.array(*[F.lit(m) for m in "①②③④⑤⑥"])
    clauses = F.transform(F.slice(marks, F.lit(1), (k % 6).cast("int")), lambda m, i: F.concat(m, F.lit(" item "), ((k + i) % 10).cast("string")))
    block = F.concat(F.lit("제"), k.cast("string"), F.lit("조의2("), "o_orderpriority", F.lit(")\n"), F.array_join(clauses, " "))
    rows = table(spark, d, "orders").select("o_orderkey", block.alias("block"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("said"))
    parts = F.filter(F.transform(F.split("block", r"(?=[①-⑳])"), text.stripped), lambda c: c.rlike(r"^[①-⑳]"))
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("said"), F.lit(r"[a-z]{2,}"), F.lit(0))))
    return rows.select("o_orderkey", F.regexp_extract("block", r"^제\d+조(?:의\d+)?\s*\(([^)]+)\)", 1).alias("title"), F.size(parts).alias("clauses"), F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("first"), F.array_join(words, ",").alias("keywords"))
