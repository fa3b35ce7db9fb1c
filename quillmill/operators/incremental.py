"""Incremental ingestion: hashes, skipping, merging, deleting, versions and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.identity import NAMESPACE, source_hash, uuid5
from quillmill.registry import query
from quillmill.sources.tables import table


def keep_latest(rows: DataFrame, key: list[str], *order) -> DataFrame:
    """One row for each key, the first in order: an upsert's outcome over the union of old and new rows."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key is not there yet are added."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").dropDuplicates(key))


def replace_documents(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents in `new` are replaced, so none are left over where a document has shrunk."""
    return chunks.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def plan_sync(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """What to do with each key: `skip` if hash, model and status agree, else `index`; `delete` what is no longer wanted."""
    s, w = stored.alias("s"), wanted.alias("w")
    joined = w.join(s, "key", "full")
    same = (F.col("s.hash") == F.col("w.hash")) & (F.col("s.model") == F.col("w.model")) & (F.col("s.status") == "completed") & (F.col("s.chunks") > 0)
    return joined.select("key", F.when(F.col("w.hash").isNull(), "delete").when(F.coalesce(same, F.lit(False)), "skip").otherwise("index").alias("action"))


def _versions(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored documents, and what they are now: one in seven changed, one in eleven gone, some new."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    stored = docs.filter("key % 13 <> 0").select("key", F.sha2("text", 256).alias("hash"), F.lit("m1").alias("model"), F.when(F.col("key") % 17 == 0, "error").otherwise("completed").alias("status"), F.lit(1).alias("chunks"))
    wanted = docs.filter("key % 11 <> 0").select("key", F.sha2(F.when(F.col("key") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"), F.lit("m1").alias("model"))
    return stored, wanted


_SYNC = """SELECT doc_id AS key, CASE WHEN doc_id % 11 = 0 THEN 'delete' WHEN doc_id % 13 = 0 OR doc_id % 7 = 0 OR doc_id % 17 = 0 THEN 'index' ELSE 'skip' END AS action
  FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 13 <> 0"""


@query("str4_str5_txt16_plan_sync", _SYNC)
def sync_plan(spark, d):
    return plan_sync(*_versions(spark, d))


@query("agg32_str5_sync_totals", f"SELECT action, count(*)::BIGINT AS n FROM ({_SYNC}) GROUP BY action")
def sync_totals(spark, d):
    return plan_sync(*_versions(spark, d)).groupBy("action").agg(F.count("*").alias("n"))


@query("snk1_upsert", """
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey > 0""")
def upsert_query(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    changed = orders.filter("o_orderkey % 5 = 0").withColumn("status", F.lit("X"))
    added = orders.filter("o_orderkey % 50 = 0 AND o_orderkey > 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("status"))
    return upsert(orders, changed.unionByName(added), ["o_orderkey"])


@query("snk2_snk3_replace_document", """
  WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS chunk_index FROM documents)
  SELECT doc_id, chunk_index::INTEGER AS chunk_index, md5(line) AS chunk FROM c WHERE doc_id % 4 <> 0 OR chunk_index < 2""")
def replace_document(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line")).select("doc_id", "chunk_index", F.md5("line").alias("chunk"))
    return replace_documents(chunks, chunks.filter("doc_id % 4 = 0 AND chunk_index < 2"))


@query("snk6_insert_absent", "SELECT c_custkey AS key FROM customer UNION SELECT o_custkey FROM orders UNION SELECT o_custkey + 1000000 FROM orders WHERE o_orderkey % 100 = 0")
def insert_absent_query(spark, d):
    orders = table(spark, d, "orders")
    new = orders.select(F.col("o_custkey").alias("key")).unionByName(orders.filter("o_orderkey % 100 = 0").select((F.col("o_custkey") + 1000000).alias("key")))
    return insert_absent(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), new, ["key"])


@query("snk9_keep_latest", """
  SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def feedback_upsert(spark, d):
    return keep_latest(table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "value")


@query("snk10_win12_version_history", """
  WITH v AS (SELECT o_custkey, o_orderstatus AS content, o_orderkey, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
  SELECT o_custkey, content, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS version FROM v WHERE before IS DISTINCT FROM content""")
def version_history(spark, d):
    """A version for each change of content; the same content again is no version."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    changes = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("content"), F.lag("o_orderstatus").over(w).alias("before"))
    return changes.filter(~F.col("before").eqNullSafe(F.col("content"))).select("o_custkey", "content", F.row_number().over(w).alias("version"))


@query("snk11_jsn1_json_packing", """
  SELECT c_custkey, CAST(json_extract_string(j, '$.segment') AS VARCHAR) AS segment, CAST(json_extract_string(j, '$.nation') AS INTEGER) AS nation
  FROM (SELECT c_custkey, json_object('segment', c_mktsegment, 'nation', c_nationkey) AS j FROM customer)""")
def json_packing(spark, d):
    packed = table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))).alias("j"))
    return packed.select("c_custkey", F.from_json("j", "segment string, nation int").alias("x")).select("c_custkey", "x.*")


@query("snk12_value_remap", "SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c_nationkey = n_nationkey")
def value_remap(spark, d):
    names = table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(names, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("nation"))


_UUID = lambda name: f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT sha1(unhex('{NAMESPACE.hex}') || encode({name})) AS h))"""


@query("txt15_deterministic_ids", f"""SELECT doc_id, {_UUID("source || '/' || doc_id")} AS source_id, {_UUID("source || '/' || doc_id || '#0'")} AS point_id FROM documents""")
def deterministic_ids(spark, d):
    """Name-based ids; tests compare them with the standard library's too."""
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"))
    return docs.select("doc_id", uuid5(F.col("name")).alias("source_id"), uuid5(F.concat(F.col("name"), F.lit("#0"))).alias("point_id"))


@query("txt16_source_hash", """
  SELECT doc_id, sha256('v1'::BLOB || coalesce(unhex((SELECT string_agg('00' || hex(x), '' ORDER BY i) FROM (SELECT unnest(parts) AS x, unnest(range(len(parts))) AS i))), ''::BLOB)) AS hash, len(parts)::INTEGER AS parts
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)""")
def source_hashes(spark, d):
    """One digest of all of a source's parts and the version of what reads them; a byte of zero stands before each part."""
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", source_hash("v1", lines).alias("hash"), F.size(lines).alias("parts"))


@query("str7_sup7_stale_marks", """
  SELECT l_orderkey, l_linenumber, l_quantity > 25 AND l_tax > 0.04 AS stale, CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END::INTEGER AS version FROM lineitem""")
def stale_marks(spark, d):
    """A changed text makes its index stale; the version grows only with a change."""
    changed = F.col("l_quantity") > 25
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (changed & (F.col("l_tax") > 0.04)).alias("stale"), F.when(changed, 2).otherwise(1).alias("version"))


@query("sup10_manifest_rebuild", "SELECT count(*) FILTER (a.key IS NULL)::BIGINT AS added, count(*) FILTER (b.key IS NULL)::BIGINT AS removed, count(*) FILTER (a.m <> b.m)::BIGINT AS changed FROM (SELECT doc_id AS key, n_chars AS m FROM documents WHERE doc_id % 9 <> 0) a FULL JOIN (SELECT doc_id AS key, n_chars + CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS m FROM documents WHERE doc_id % 10 <> 0) b ON a.key = b.key")
def manifest(spark, d):
    docs = table(spark, d, "documents")
    a = docs.filter("doc_id % 9 <> 0").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("m")).alias("a")
    b = docs.filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("key"), (F.col("n_chars") + F.when(F.col("doc_id") % 8 == 0, 1).otherwise(0)).alias("m")).alias("b")
    joined = a.join(b, F.col("a.key") == F.col("b.key"), "full")
    return joined.agg(F.count_if(F.col("a.key").isNull()).alias("added"), F.count_if(F.col("b.key").isNull()).alias("removed"), F.count_if(F.col("a.m") != F.col("b.m")).alias("changed"))
