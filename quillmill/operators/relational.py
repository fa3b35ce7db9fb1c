"""Filters, joins, set operations, ordering and paging."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.containment import json_contains
from quillmill.operators.name_matching import resolve_names
from quillmill.registry import query
from quillmill.sources.tables import table


def all_of(conditions: list[Column]) -> Column:
    """The conjunction of conditions; without any, everything passes."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_value(column: Column, values: list[str], contains: bool = False) -> Column:
    """Whether the column equals, or contains, one of the values."""
    if not contains:
        return column.isin(values)
    return reduce(lambda a, b: a | b, [column.contains(v) for v in values], F.lit(False))


def equality_filter(columns: dict[str, Column], wanted: dict) -> Column:
    """Equality on known columns; other keys are looked up in the JSON column `metadata`. None is skipped."""
    found = []
    for name, value in wanted.items():
        if value is None:
            continue
        column = columns.get(name)
        if column is None:
            found.append(json_contains(columns["metadata"], {name: value}))
        else:
            found.append(column == value)
    return all_of(found)


def access_scope(scope: Column, user: str, groups: list[str], admin: bool = False) -> Column:
    """Rows without a scope are open; others are for one user or one group. Administrators see all."""
    if admin:
        return F.lit(True)
    return scope.isNull() | scope.isin([f"user:{user}", *[f"group:{g}" for g in groups]])


def search_in(text: str, *columns: Column) -> Column:
    """Case-insensitive containment in any of the columns."""
    return reduce(lambda a, b: a | b, [F.lower(c).contains(text.lower()) for c in columns])


ORDERS = {
    "created_asc": lambda c: [F.col(c["created"]).asc(), F.col(c["id"]).asc()],
    "created_desc": lambda c: [F.col(c["created"]).desc(), F.col(c["id"]).asc()],
    "id_asc": lambda c: [F.col(c["id"]).asc()],
    "id_desc": lambda c: [F.col(c["id"]).desc()],
}


def page(frame: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The page with this number, from 1; size 0 is everything."""
    ordered = frame.orderBy(*order)
    return ordered if size == 0 else ordered.offset((number - 1) * size).limit(size)


@query("flt1_flt3_flt4_flt6_dynamic_filter", """
  SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') = '7'""")
def dynamic_filter(spark, d):
    events = table(spark, d, "events").withColumnRenamed("props", "metadata")
    return events.filter(equality_filter({"event_type": F.col("event_type"), "metadata": F.col("metadata")}, {"event_type": "click", "k": 7, "user": None})).select("event_id", "event_type", "value")


# Events as nested JSON; every other one has its number as text.
_NESTED = """(SELECT event_id, '{"type": "' || event_type || '", "flag": ' || CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'null' ELSE '1' END || ', "tags": [' || k || ', {"t": "' || event_type || '", "n": [' || (event_id % 4) || ', 2.5]}], "props": {"k": ' || CASE WHEN event_id % 2 = 0 THEN k ELSE '"' || k || '"' END || '}}' AS doc
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events))"""
WANTED = {
    "number": {"props": {"k": 7}}, "text": {"props": {"k": "7"}}, "either": {"tags": [7]}, "nested": {"type": "click", "tags": [{"t": "click", "n": [3]}]}, "true": {"flag": True}, "null": {"flag": None},
    "one": {"flag": 1}, "decimal": {"tags": [{"n": [2.5, 0]}]}, "any": {"tags": [], "props": {}}, "missing": {"props": {"j": 1}},
}


@query("flt3_jsn1_containment", f"SELECT event_id, array_to_string(list_filter([{', '.join(f"CASE WHEN json_contains(doc, '{json.dumps(w)}') THEN '{n}' END" for n, w in WANTED.items())}], lambda x: x IS NOT NULL), ',') AS contains FROM {_NESTED}")
def containment(spark, d):
    """Which of ten patterns each event's JSON contains: nested objects, lists of objects, numbers unlike texts."""
    events, k = table(spark, d, "events"), F.get_json_object("props", "$.k")
    n = F.col("event_id")
    flag = F.when(n % 3 == 0, "true").when(n % 3 == 1, "null").otherwise("1")
    number = F.when(n % 2 == 0, k).otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    doc = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "flag": '), flag, F.lit(', "tags": ['), k, F.lit(', {"t": "'), "event_type", F.lit('", "n": ['), (n % 4).cast("string"), F.lit(', 2.5]}], "props": {"k": '), number, F.lit("}}"))
    found = F.concat_ws(",", *[F.when(json_contains(F.col("doc"), w), name) for name, w in WANTED.items()])
    return events.select("event_id", doc.alias("doc")).select("event_id", found.alias("contains"))


@query("flt2_sup5_payload_merge", """
  SELECT event_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id FROM events""")
def payload_merge(spark, d):
    """The residual map first, named columns over it; of the map only other keys remain."""
    rest = F.from_json("props", "map<string,string>")
    merged = F.map_concat(F.map_filter(rest, lambda k, _: ~k.isin("kind")), F.create_map(F.lit("kind"), F.col("event_type")))
    return table(spark, d, "events").select("event_id", merged.alias("m"), "user_id").select("event_id", F.col("m.kind").alias("kind"), F.col("m.k").cast("bigint").alias("k"), "user_id")


@query("flt7_flt9_in_and_contains", """
  SELECT p_partkey, p_name, p_brand FROM part WHERE (contains(p_type, 'ECON') OR contains(p_type, 'PRO')) AND p_size IN (1, 5, 9)
    AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_partkey IS NOT NULL)""")
def in_and_contains(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, d, "part").filter(any_value(F.col("p_type"), ["ECON", "PRO"], contains=True) & any_value(F.col("p_size"), [1, 5, 9]))
    return parts.join(used, "p_partkey", "left_anti").select("p_partkey", "p_name", "p_brand")


@query("flt8_sup4_search_page", """
  SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '00') OR contains(lower(c_mktsegment), 'auto')
  ORDER BY c_custkey DESC LIMIT 20 OFFSET 20""")
def search_page(spark, d):
    hits = table(spark, d, "customer").filter(search_in("AUTO", F.col("c_mktsegment")) | search_in("00", F.col("c_name")))
    return page(hits, ORDERS["id_desc"]({"id": "c_custkey"}), 2, 20).select("c_custkey", "c_name", "c_mktsegment")


_SCOPE = "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'group:' || lower(c_mktsegment) ELSE 'user:u' || (c_custkey % 7) END"


@query("flt10_flt11_access_scope", f"SELECT c_custkey, {_SCOPE} AS scope FROM customer WHERE ({_SCOPE}) IS NULL OR ({_SCOPE}) IN ('user:u3', 'group:building', 'group:machinery')")
def access(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr(_SCOPE).alias("scope")).filter(access_scope(F.col("scope"), "u3", ["building", "machinery"]))


@query("flt15_threshold_after_limit", """
  SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) WHERE o_totalprice >= 400000""")
def threshold_after_limit(spark, d):
    """The limit comes first, so fewer than 50 rows may pass."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).filter("o_totalprice >= 400000")


@query("flt17_keyword_snippets", """
  SELECT doc_id, length(text)::BIGINT AS size, substr(text, greatest(1, strpos(text, 'the') - 45), 140) AS snippet FROM documents WHERE contains(text, 'the')""")
def keyword_snippets(spark, d):
    at = F.instr("text", "the")
    start = F.greatest(F.lit(1), at - 45)
    return table(spark, d, "documents").filter(F.col("text").contains("the")).select("doc_id", F.length("text").cast("bigint").alias("size"), F.substring("text", start, F.lit(140)).alias("snippet"))


@query("flt19_flt20_cnv10_upload_checks", r"""
  SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)) AS host, length(html)::BIGINT AS size,
         length(html) > 0 AND length(html) <= 8000 AND NOT contains(url, '..') AND starts_with(url, 'http') AS accepted FROM pages""")
def upload_checks(spark, d):
    size = F.length("html")
    fine = (size > 0) & (size <= 8000) & ~F.col("url").contains("..") & F.col("url").startswith("http")
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)).alias("host"), size.cast("bigint").alias("size"), fine.alias("accepted"))


@query("joi1_joi2_left_join_with_predicate", """
  SELECT o_orderkey, c_name, o_orderstatus FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def left_join_with_predicate(spark, d):
    """A predicate on the right side makes the left join an inner one; Catalyst sees that by itself."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.filter("c_mktsegment = 'BUILDING'").select("o_orderkey", "c_name", "o_orderstatus")


@query("joi3_joi4_joi6_three_way_rollup", """
  WITH q AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), f AS (SELECT user_id, count(*) AS n, avg(value) AS mean FROM events WHERE event_type = 'purchase' GROUP BY 1),
       s AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1 ORDER BY last DESC, user_id LIMIT 30)
  SELECT s.user_id, s.n::BIGINT AS sessions, coalesce(q.n, 0)::BIGINT AS questions, coalesce(f.n, 0)::BIGINT AS ratings, round(f.mean, 2) AS mean_rating
  FROM s LEFT JOIN q USING (user_id) LEFT JOIN f USING (user_id)""")
def three_way_rollup(spark, d):
    events = table(spark, d, "events")
    listed = events.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("ts").alias("last")).orderBy(F.desc("last"), "user_id").limit(30)
    asked = events.filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("questions"))
    rated = events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("ratings"), F.round(F.avg("value"), 2).alias("mean_rating"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return listed.join(asked, "user_id", "left").join(rated, "user_id", "left").select("user_id", "sessions", zero("questions"), zero("ratings"), "mean_rating")


@query("joi8_anti_join", "SELECT doc_id, source FROM documents d WHERE n_chars > 200 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(spark, d):
    return table(spark, d, "documents").filter("n_chars > 200").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("joi9_set1_set2_coverage", """
  SELECT count(*)::BIGINT AS total, count(l.doc_id)::BIGINT AS covered, count(*) FILTER (l.doc_id IS NULL)::BIGINT AS missing,
         round(count(l.doc_id) / count(*), 4) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def coverage(spark, d):
    done = table(spark, d, "labels").select("doc_id").distinct().withColumn("done", F.lit(True))
    joined = table(spark, d, "documents").select("doc_id").join(done, "doc_id", "left")
    return joined.agg(F.count("*").alias("total"), F.count("done").alias("covered"), F.count_if(F.col("done").isNull()).alias("missing"), F.round(F.count("done") / F.count("*"), 4).alias("coverage"))


@query("joi13_fuzzy_resolution", """
  WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 7 = 0 UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 2) FROM part WHERE p_size < 10 AND split_part(p_type, ' ', 2) <> ''),
  m AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN ' ' || upper(p_name) WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN p_type ELSE 'the ' || p_brand || ' line' END AS mention FROM part),
  h AS (SELECT mention, name, row_number() OVER (PARTITION BY mention ORDER BY lower(trim(mention)) <> lower(trim(name)), length(name) DESC, name) AS rn
    FROM m JOIN n ON contains(lower(trim(mention)), lower(trim(name))) OR contains(lower(trim(name)), lower(trim(mention))))
  SELECT m.mention, h.name FROM m LEFT JOIN h ON h.mention = m.mention AND rn = 1""")
def fuzzy_resolution(spark, d):
    """Mentions in other spellings, shorter and longer ones, against names of parts, brands and types."""
    part = table(spark, d, "part")
    names = part.filter("p_partkey % 7 = 0").select(F.col("p_name").alias("name")).unionByName(part.select(F.col("p_brand").alias("name"))).unionByName(part.filter("p_size < 10").select(F.split_part("p_type", F.lit(" "), F.lit(2)).alias("name")))
    k = F.col("p_partkey") % 4
    mention = F.when(k == 0, F.concat(F.lit(" "), F.upper("p_name"))).when(k == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).when(k == 2, F.col("p_type")).otherwise(F.concat(F.lit("the "), "p_brand", F.lit(" line")))
    return resolve_names(part.select(mention.alias("mention")), names)


@query("joi14_zip_explode_join", """
  WITH e AS (SELECT l_suppkey AS entity, l_orderkey AS document, l_linenumber AS chunk, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem)
  SELECT entity, document, chunk, o_orderstatus FROM e JOIN orders ON o_orderkey = document WHERE rn <= 10""")
def zip_explode_join(spark, d):
    """An entity's first ten (document, chunk) pairs. The pairs are kept together as structs, so they can't get out of step."""
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), "l_orderkey", "l_linenumber")
    first = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("entity").orderBy("l_orderkey", "l_linenumber"))).filter("rn <= 10")
    grouped = first.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("at"))
    each = grouped.select("entity", F.inline("at")).select("entity", F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("chunk"))
    return each.join(table(spark, d, "orders"), F.col("document") == F.col("o_orderkey")).select("entity", "document", "chunk", "o_orderstatus")


@query("joi15_paired_join", """
  SELECT count(*)::BIGINT AS pairs, count(*) FILTER (quality = 1 AND toxic = 0)::BIGINT AS only_a, count(*) FILTER (quality = 0 AND toxic = 1)::BIGINT AS only_b,
         (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS unpaired FROM labels""")
def paired_join(spark, d):
    a = table(spark, d, "labels").select("doc_id", F.col("quality").alias("a"))
    b = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("b"))
    both = a.join(b, "doc_id").agg(F.count("*").alias("pairs"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"))
    rest = table(spark, d, "documents").join(a, "doc_id", "left_anti").agg(F.count("*").alias("unpaired"))
    return both.crossJoin(rest)  # one row each


DRIFT = """
  WITH a AS (SELECT 'order.' || o_orderpriority || '.' || o_custkey AS path, CAST(floor(max(o_totalprice)) AS BIGINT) AS v FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1),
       b AS (SELECT 'order.' || o_orderpriority || '.' || o_custkey AS path, CAST(floor(max(o_totalprice)) AS BIGINT) AS v FROM orders WHERE o_custkey % 3 <> 1 GROUP BY 1),
       rules(rule) AS (VALUES ('order.1-URGENT'), ('order.5-LOW')), d AS (SELECT coalesce(a.path, b.path) AS path, a.v AS dev, b.v AS prod FROM a FULL JOIN b ON a.path = b.path)
  SELECT path, coalesce(dev, -1) AS dev, coalesce(prod, -1) AS prod, CASE WHEN dev IS NOT DISTINCT FROM prod THEN CASE WHEN rule IS NULL THEN 'SAME' ELSE 'STALE-RULE' END WHEN rule IS NULL THEN 'DRIFT' ELSE 'EXPECTED' END AS verdict
  FROM d LEFT JOIN rules ON path = rule OR starts_with(path, rule || '.')"""


@query("joi19_drf1_config_diff", DRIFT)
def config_diff(spark, d):
    """Paths of two states side by side; a side may miss. A rule holds for its path and all below it; the longest rule wins.

    Each path is joined with its own prefixes, so the rules are met by equality.
    """
    orders = table(spark, d, "orders").select(F.concat(F.lit("order."), "o_orderpriority", F.lit("."), F.col("o_custkey").cast("string")).alias("path"), "o_custkey", "o_totalprice")
    side = lambda skip, name: orders.filter(f"o_custkey % 3 <> {skip}").groupBy("path").agg(F.floor(F.max("o_totalprice")).alias(name))
    both = side(0, "dev").join(side(1, "prod"), "path", "full")
    rules = spark.createDataFrame([("order.1-URGENT",), ("order.5-LOW",)], "rule string")
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    ruled = both.select("path", F.explode(prefixes).alias("rule")).join(F.broadcast(rules), "rule").groupBy("path").agg(F.max_by("rule", F.length("rule")).alias("rule"))
    same = F.col("dev").eqNullSafe(F.col("prod"))
    verdict = F.when(same, F.when(F.col("rule").isNull(), "SAME").otherwise("STALE-RULE")).when(F.col("rule").isNull(), "DRIFT").otherwise("EXPECTED")
    return both.join(ruled, "path", "left").select("path", F.coalesce("dev", F.lit(-1)).alias("dev"), F.coalesce("prod", F.lit(-1)).alias("prod"), verdict.alias("verdict"))


@query("joi20_cross_store_counts", """
  WITH d AS (SELECT doc_id, source, unnest(['all', coalesce((n_chars // 1000)::VARCHAR, 'unknown')]) AS size FROM documents)
  SELECT l.source, l.size, n_docs::BIGINT AS n_docs, coalesce(n_labels, 0)::BIGINT AS n_labels, n_docs = coalesce(n_labels, 0) AS equal
  FROM (SELECT source, size, count(*) AS n_docs FROM d GROUP BY 1, 2) l LEFT JOIN (SELECT source, size, count(*) AS n_labels FROM d JOIN labels USING (doc_id) GROUP BY 1, 2) r ON l.source = r.source AND l.size = r.size""")
def cross_store_counts(spark, d):
    """Of each source, as a whole and by thousands of characters, how many documents one store holds beside how many labels the other one does."""
    size = F.explode(F.array(F.lit("all"), F.coalesce(F.floor(F.col("n_chars") / 1000).cast("string"), F.lit("unknown"))))
    docs = table(spark, d, "documents").select("doc_id", "source", size.alias("size"))
    left = docs.groupBy("source", "size").agg(F.count("*").alias("n_docs"))
    right = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").groupBy("source", "size").agg(F.count("*").alias("n_labels"))
    joined = left.join(right, ["source", "size"], "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0)).cast("bigint"))
    return joined.select("source", "size", "n_docs", "n_labels", (F.col("n_docs") == F.col("n_labels")).alias("equal"))


@query("joi20_self_search", """
  WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)
  SELECT (SELECT count(*) FROM embeddings)::BIGINT AS stored, (SELECT count(*) FROM documents)::BIGINT AS expected, count(*)::BIGINT AS searched, count(*) FILTER (id = query_id)::BIGINT AS found FROM s WHERE rank <= 5 AND (id = query_id OR rank = 5 AND query_id NOT IN (SELECT query_id FROM s WHERE rank <= 5 AND id = query_id))""")
def self_search(spark, d):
    """Both stores' counts, and how many of the searched vectors are among their own five nearest."""
    from quillmill.operators.retrieval import dense_top_k

    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    own = dense_top_k(asked, vectors, 5).groupBy("query_id").agg(F.bool_or(F.col("id") == F.col("query_id")).alias("own")).agg(F.count("*").alias("searched"), F.count_if("own").alias("found"))
    counts = vectors.agg(F.count("*").alias("stored")).crossJoin(table(spark, d, "documents").agg(F.count("*").alias("expected")))
    return counts.crossJoin(own)  # one row each


@query("agg34_drift_totals", f"SELECT verdict, count(*)::BIGINT AS n FROM ({DRIFT}) GROUP BY verdict")
def drift_totals(spark, d):
    return config_diff(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query("set1_set2_set3_set4_sets", """
  SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings))::BIGINT AS difference,
         (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings))::BIGINT AS intersection,
         (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings))::BIGINT AS either,
         NOT EXISTS (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) AS subset""")
def sets(spark, d):
    docs, vectors = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    tagged = docs.select("id", F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).unionByName(vectors.select("id", F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("c")))
    tagged = tagged.unionByName(table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("c")))
    each = tagged.groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("c").alias("c"))  # all four in one pass
    return each.agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("difference"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("intersection"),
        F.count_if((F.col("a") == 1) | (F.col("b") == 1)).alias("either"),
        (F.count_if((F.col("c") == 1) & (F.col("a") == 0)) == 0).alias("subset"),
    )


@query("top8_top9_paging", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def paging(spark, d):
    return page(table(spark, d, "orders"), ORDERS["created_desc"]({"created": "o_orderdate", "id": "o_orderkey"}), 3, 25).select("o_orderkey", "o_orderstatus")


TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]


@query("src17_schema_fingerprint", f"""
  WITH c AS (SELECT table_name || '.' || column_name || ':' || CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(data_type) END AS entry
    FROM information_schema.columns WHERE table_name IN ({", ".join(repr(t) for t in TABLES)}))
  SELECT count(*)::BIGINT AS columns, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS fingerprint FROM c""")
def schema_fingerprint(spark, d):
    """A digest of all `table.column:type` lines in order: it changes exactly when a schema does."""
    rows = [(f"{n}.{c}:{t}",) for n in TABLES for c, t in table(spark, d, n).dtypes]
    return spark.createDataFrame(rows, "entry string").agg(F.count("*").alias("columns"), F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), "\n"), 256).alias("fingerprint"))
