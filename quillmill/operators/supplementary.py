"""Further operators: facts, files, redaction, scoring of facts, lists and guards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import facts, misc, text
from quillmill.functions.dates import effective_date
from quillmill.functions.lexical import tokens
from quillmill.functions.statistics import wilson
from quillmill.operators.textual import _ADDENDA, _REVISED, pick, regulations
from quillmill.plans.checkpoints import cut, small_batches
from quillmill.registry import query
from quillmill.sources import docx
from quillmill.sources.files import file_manifest, manifest_changes, read_json_lines, route_of, scan_directory, scratch, write_files, write_json_lines
from quillmill.sources.tables import table


#: Folders over which many files are dealt.
SHELVES = 256


def addenda_of(regs: DataFrame) -> DataFrame:
    """(doc_id, order_no, header_date, enforced_from, retroactive): addenda in order of their place, through all addendum blocks
    of a document."""
    blocks = F.filter(text.sections(F.col("text")), lambda b: text.section_kind(b) == "addendum")
    found = regs.select("doc_id", F.posexplode(F.flatten(F.transform(blocks, facts.addenda))).alias("i", "a"))
    return found.select("doc_id", (F.col("i") + 1).alias("order_no"), "a.header_date", "a.enforced_from", "a.retroactive")


@query("dat5_win7_addenda", f"SELECT doc_id, i::INTEGER AS order_no, header AS header_date, enforced AS enforced_from, retro AS retroactive FROM {_ADDENDA}")
def addenda(spark, d):
    return addenda_of(regulations(spark, d))


@query("agg30_date_selftest", f"""
  WITH a AS (SELECT doc_id, count(*) AS n, arg_max(enforced, i) AS last FROM {_ADDENDA} GROUP BY 1), f AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN make_date((2012 + doc_id % 3)::INTEGER, ((doc_id + doc_id % 3 + 1) % 12 + 1)::INTEGER, ((doc_id * 3 + doc_id % 3 + 1) % 28 + 1)::INTEGER)::VARCHAR WHEN doc_id % 14 BETWEEN 1 AND 12 THEN '2020-' || lpad((doc_id % 14)::VARCHAR, 2, '0') || '-01' END AS file_date FROM documents)
  SELECT count(*)::BIGINT AS docs, count(*) FILTER (file_date IS NOT NULL)::BIGINT AS comparable, round(avg(CASE WHEN file_date = last THEN 1.0 ELSE 0.0 END) FILTER (file_date IS NOT NULL), 6) AS agreement, round(avg(n), 6) AS mean_addenda, max(n)::BIGINT AS most_addenda FROM a JOIN f USING (doc_id)""")
def date_selftest(spark, d):
    """How often the file name's date is the last addendum's, and how many addenda documents have. One file in four is named after its last addendum."""
    k = F.col("doc_id")
    named = F.format_string("규정(시행%d.%d.%d.).hwp", 2012 + k % 3, (k + k % 3 + 1) % 12 + 1, (k * 3 + k % 3 + 1) % 28 + 1)
    regs = regulations(spark, d).withColumn("file_name", F.when(k % 4 == 0, named).otherwise(F.col("file_name")))
    last = addenda_of(regs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max_by(F.coalesce("enforced_from", "header_date"), "order_no").alias("last"))
    joined = regs.select("doc_id", effective_date(F.col("file_name")).alias("file_date")).join(last, "doc_id")
    same = F.when(F.col("file_date").isNotNull(), (F.col("file_date") == F.col("last")).cast("double"))
    return joined.agg(F.count("*").alias("docs"), F.count("file_date").alias("comparable"), F.round(F.avg(same), 6).alias("agreement"), F.round(F.avg("n"), 6).alias("mean_addenda"), F.max("n").alias("most_addenda"))


@query("dat9_date_answers", f"""
  WITH a AS (SELECT doc_id, arg_max(enforced, i) AS last, arg_min(enforced, i) AS first FROM {_ADDENDA} GROUP BY 1), x AS (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n FROM documents)
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CASE WHEN doc_id % 14 BETWEEN 1 AND 12 THEN '2020-' || lpad((doc_id % 14)::VARCHAR, 2, '0') || '-01' END WHEN 1 THEN last WHEN 2 THEN first
    WHEN 3 THEN CASE WHEN doc_id % 20 < n THEN (SELECT {_REVISED} FROM (SELECT doc_id % 20 + 1 AS i)) END WHEN 4 THEN coalesce((SELECT enforced FROM {_ADDENDA} b WHERE b.doc_id = a.doc_id AND contains(b.block, (2012 + doc_id % 3)::VARCHAR) AND contains(substr(b.block, strpos(b.block, chr(10)) + 1), (2012 + doc_id % 3)::VARCHAR) ORDER BY i LIMIT 1), last) ELSE last END AS answer
  FROM a JOIN x USING (doc_id)""")
def date_answers(spark, d):
    """Questions of six kinds answered from a fact store of one row a document."""
    docs = regulations(spark, d).withColumn("blocks", text.sections(F.col("text")))
    articles = F.filter("blocks", lambda b: text.section_kind(b) == "article")
    added = F.flatten(F.transform(F.filter("blocks", lambda b: text.section_kind(b) == "addendum"), facts.addenda))
    store = docs.withColumns({"file_date": effective_date(F.col("file_name")), "addenda": added})
    store = store.withColumn("by_article", F.map_from_entries(F.transform(articles, lambda b: F.struct(text.section_article(b), facts.revisions(b)))))
    k = F.col("doc_id")
    said = ["현행 시행일은?", "최근 부칙 시행일은?", "최초로 시행된 날은?", "제{i}조가 개정된 날짜는?", "부칙 중 {y}학년도 것은?", "마지막은 언제?"]
    question = F.replace(F.replace(pick(said, k), F.lit("{i}"), (k % 20 + 1).cast("string")), F.lit("{y}"), (2012 + k % 3).cast("string"))
    return store.select("doc_id", facts.answer(question, F.col("file_date"), F.col("addenda"), F.col("by_article")).alias("answer"))


@query("dat13_dat14_loose_dates_and_age", """
  SELECT o_orderkey, o_orderkey % 2 = 0 AS present, round(epoch(TIMESTAMP '2000-01-01' - o_orderdate) / 3600, 4) AS age FROM orders""")
def loose_dates(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy. M. d."), F.lit(" 시행"))).otherwise("없음")
    return table(spark, d, "orders").select("o_orderkey", facts.loosely_present(iso, said).alias("present"), F.round(facts.age_hours(F.col("o_orderdate").cast("timestamp"), F.lit("2000-01-01").cast("timestamp")), 4).alias("age"))


@query("src2_src3_src10_directory_scan")
def directory_scan(spark, d):
    """The table files themselves as a corpus folder; a table of many files is a folder and not listed."""
    return scan_directory(spark, d, "*.parquet").select("name", "size", "reader")


@query("src9_plain_decode", """
  WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN chr(65279) || text WHEN 2 THEN '똠방각하 ' || doc_id WHEN 3 THEN '규정 ' || doc_id ELSE 'café ' || doc_id || ' naïve' END AS text FROM documents)
  SELECT doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS digest FROM t""")
def plain_decode(spark, d):
    """Texts in each of the cascade's encodings in turn, UTF-8 with a mark and without, some with zero bytes. Letters that only
    one of the encodings has make the cascade go on to it."""

    @F.pandas_udf(T.BinaryType())
    def written(ids: pd.Series, texts: pd.Series) -> pd.Series:
        kinds = [lambda i, t: t.encode() + b"\x00", lambda i, t: t.encode("utf-8-sig"), lambda i, t: f"똠방각하 {i}".encode("cp949"), lambda i, t: f"규정 {i}\n".encode("euc-kr"), lambda i, t: f"café {i} naïve".encode("latin-1")]
        return pd.Series([kinds[i % 5](i, t) for i, t in zip(ids, texts, strict=True)])

    small_batches(spark)
    docs = table(spark, d, "documents").select("doc_id", written("doc_id", "text").alias("content"))
    return docs.select("doc_id", F.md5(misc.decoded("content")).alias("digest"))


@query("src11_snk8_json_lines", "SELECT item_id, length(text)::BIGINT AS size, md5(text) AS digest FROM benchmark")
def json_lines(spark, d):
    at = scratch(spark, "lines")
    write_json_lines(table(spark, d, "benchmark"), at)
    return read_json_lines(spark, at, "item_id long, text string").select("item_id", F.length("text").cast("bigint").alias("size"), F.md5("text").alias("digest"))


@query("src14_jsn1_flatten", "SELECT event_id, 'props.k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'type', event_type FROM events UNION ALL SELECT event_id, unnest(['tags[0]', 'tags[1].b', 'tags[1].c[0]', 'tags[2]']), unnest(['1', event_type, 'true', '[]']) FROM events")
def flatten(spark, d):
    document = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "tags": [1, {"b": "'), "event_type", F.lit('", "c": [true]}, []], "props": '), "props", F.lit("}"))
    return table(spark, d, "events").select("event_id", F.explode(misc.flat_paths(document)).alias("path", "value"))


@query("src1_src15_ordered_scan", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS place, md5(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS before FROM conversations")
def ordered_scan(spark, d):
    """Rows of each key in order, one after the other, each with the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(order).alias("place"), F.md5(F.coalesce(F.lag("text").over(order), F.lit(""))).alias("before"))


def in_batches(rows: DataFrame, size: int, *order) -> DataFrame:
    """`batch` and `place` of each row, `size` rows a batch in the given order. Rows are counted by ranges first, so that no one
    task numbers all of them."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = cut(parts.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    number = F.col("_row") + F.col("_from") - 1
    return parts.join(F.broadcast(offsets), "_part").select(*rows.columns, F.floor(number / size).cast("int").alias("batch"), (number % size).cast("int").alias("place"))


@query("src16_batched_scan", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::INTEGER AS batch, ((row_number() OVER (ORDER BY doc_id) - 1) % 100)::INTEGER AS place FROM documents")
def batched_scan(spark, d):
    """Batches of a hundred by offset and limit, in one pass instead of one a batch."""
    return in_batches(table(spark, d, "documents").select("doc_id"), 100, F.col("doc_id"))


@query("lex2_cover_density")
def cover_density(spark, d):
    """An approximation of the cover density rank; tests hold it against cases worked out by hand."""
    docs = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("tokens")).filter(F.array_contains("tokens", "the") & F.array_contains("tokens", "of"))
    return docs.select("doc_id", misc.cover_density_of(["the", "of"])("tokens").alias("rank"))


@query("red1_redaction", r"""
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^([^:/]*://)', 1) || 'public-host' WHEN 1 THEN 'set' ELSE NULL END AS shown FROM pages""")
def redaction(spark, d):
    mode = F.element_at(F.array(F.lit("shape"), F.lit("presence"), F.lit("none")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", misc.redact(mode, F.col("url"), ["db"]).alias("shown"))


@query("flt18_comparable_paths", """
  WITH p AS (SELECT p_brand, p_type || '/' || replace(p_name, ' ', '.') AS path FROM part)
  SELECT p_brand, count(*) FILTER (starts_with(path, 'STANDARD/') AND NOT ends_with(path, '.bolt') AND path <> 'STANDARD/red.gear')::BIGINT AS compared, count(*)::BIGINT AS paths FROM p GROUP BY 1""")
def comparable_paths(spark, d):
    """Types as folders, names as files, endings as suffixes."""
    path = F.concat_ws("/", "p_type", F.replace("p_name", F.lit(" "), F.lit(".")))
    keep = misc.comparable(path, ["STANDARD/"], [".bolt"], ["STANDARD/red.gear"])
    return table(spark, d, "part").groupBy("p_brand").agg(F.count_if(keep).alias("compared"), F.count("*").alias("paths"))


@query("mth3_token_counts", """
  SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN CASE WHEN t > p + c THEN t - p ELSE c END WHEN t >= p + c + r THEN c + r ELSE c END::BIGINT AS output,
    CASE WHEN l_suppkey % 3 = 0 THEN greatest(t - p - c, 0) ELSE r END::BIGINT AS reasoning
  FROM (SELECT *, l_partkey AS p, l_linenumber::BIGINT AS c, (l_suppkey % 3)::BIGINT AS r, l_partkey + l_orderkey % 9 AS t FROM lineitem)""")
def token_counts(spark, d):
    c = misc.token_counts(F.col("l_partkey"), F.lit(0), F.col("l_linenumber").cast("bigint"), F.col("l_suppkey") % 3, F.col("l_partkey") + F.col("l_orderkey") % 9)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c["output"].cast("bigint").alias("output"), c["reasoning"].cast("bigint").alias("reasoning"))


@query("mth7_sample_sizes", """
  WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), x AS (SELECT source, lang, n, round_even(0.95 * n, 0) / n AS p, 1.959963984540054 AS z FROM n)
  SELECT source, lang, n::BIGINT AS n, round(((p + z*z/(2*n)) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low FROM x""")
def sample_sizes(spark, d):
    """For each source and language as a sample, how low the interval of a rate of 0.95 over its documents goes."""
    sizes = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return sizes.select("source", "lang", "n", F.round(wilson(F.bround(0.95 * F.col("n"), 0), F.col("n"))["low"], 6).alias("low"))


@query("jsn2_json_extraction", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1")
def json_extraction(spark, d):
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```"), "props", F.lit("``` done"))).otherwise("nothing")
    return table(spark, d, "events").select("event_id", F.get_json_object(misc.json_object(said), "$.k").alias("k"))


@query("scr13_answer_cleanup", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice::BIGINT::VARCHAR ELSE o_orderstatus END AS answer FROM (SELECT o_orderkey, o_orderstatus, floor(o_totalprice) AS o_totalprice FROM orders)")
def answer_cleanup(spark, d):
    price = F.floor("o_totalprice").cast("string")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<thought>hm\n?</thought>값: "), price, F.lit("\nmore<end_of_turn>"))).otherwise(F.concat("o_orderstatus", F.lit("<eos>")))
    return table(spark, d, "orders").select("o_orderkey", misc.answer_value(misc.clean_answer(raw)).alias("answer"))


@query("scr6_mth9_fact_coverage", """
  SELECT doc_id, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'and') OR contains(lower(text), 'und') THEN 1 ELSE 0 END) / 2 AS coverage, contains(lower(text), 'worthless') AS forbidden
  FROM (SELECT doc_id, regexp_replace(text, '[\\s"''`“”‘’]+', '', 'g') AS text FROM documents)""")
def fact_coverage(spark, d):
    """Share of required facts that an answer has (one of a fact's alternatives is enough), and whether a forbidden one occurs."""
    folded = F.lower(F.regexp_replace("text", r"[\s\"'`“”‘’]+", ""))
    has = lambda *words: text.has_any(folded, list(words)).cast("int")
    return table(spark, d, "documents").select("doc_id", ((has("the") + has("and", "und")) / 2).alias("coverage"), has("worthless").cast("boolean").alias("forbidden"))


@query("cnv9_templates", "SELECT c_custkey, 'Dear ' || c_name || ' of ' || c_mktsegment || ', 2024-05-01 08:00:00' AS letter FROM customer")
def templates(spark, d):
    template = F.lit("Dear {{user_name}} of {{segment}}, {{now}}")
    return table(spark, d, "customer").select("c_custkey", misc.render(template, F.lit("2024-05-01 08:00:00").cast("timestamp"), {"user_name": F.col("c_name"), "segment": F.col("c_mktsegment")}).alias("letter"))


@query("sup1_top7_document_chunks", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS place FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 1000")
def document_chunks(spark, d):
    """The chunks of each document in order, a thousand at most: the limit is the operator's."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", place.alias("place")).filter("place <= 1000")


@query("sup3_scoped_documents", """
  SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def scoped_documents(spark, d):
    allowed = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    hits = table(spark, d, "orders").filter("o_orderstatus = 'O'").join(allowed, "o_custkey", "left_semi").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    return hits.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("sup8_category_guards", "SELECT n_nationkey, NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS deletable FROM nation")
def category_guards(spark, d):
    """A category can go only if nothing refers to it."""
    used = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).unionByName(table(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))).distinct()
    return table(spark, d, "nation").join(used.withColumn("used", F.lit(True)), "n_nationkey", "left").select("n_nationkey", F.col("used").isNull().alias("deletable"))


@query("sup19_numeric_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS place FROM orders")
def numeric_order(spark, d):
    """Dotted ids in the order of their numbers, not of their letters."""
    ids = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("id"))
    key = F.transform(F.split("id", "-"), lambda x: x.cast("bigint"))
    return ids.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(key)).alias("place"))


@query("sup22_batch_results", """
  WITH asked(name) AS (VALUES ('BUILDING'), ('AUTOMOBILE'), ('NOTHING'), ('system')), n AS (SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1)
  SELECT asked.name, CASE WHEN asked.name = 'system' THEN 'protected' WHEN n.n IS NULL THEN 'not_found' ELSE 'deleted' END AS result, coalesce(n.n, 0)::BIGINT AS rows FROM asked LEFT JOIN n USING (name)""")
def batch_results(spark, d):
    asked = spark.createDataFrame([(x,) for x in ("BUILDING", "AUTOMOBILE", "NOTHING", "system")], "name string")
    counts = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("rows"))
    joined = asked.join(counts, "name", "left")
    return joined.select("name", F.when(F.col("name") == "system", "protected").when(F.col("rows").isNull(), "not_found").otherwise("deleted").alias("result"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))


@query("sup27_pipe_lists", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END::INTEGER AS n, p_brand || ',' || p_type || CASE WHEN p_size % 3 = 0 THEN ',' || p_name ELSE '' END AS items FROM part")
def pipe_lists(spark, d):
    raw = F.concat(F.lit(" "), "p_brand", F.lit(" | | "), "p_type", F.lit("|"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("  "), "p_name", F.lit(" |"))).otherwise(""))
    items = F.filter(F.transform(F.split(raw, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "part").select("p_partkey", F.size(items).alias("n"), F.array_join(items, ",").alias("items"))


@query("sup23_top5_rerank", """
  WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice * (1 - l_discount) DESC, l_linenumber) AS rank FROM lineitem)
  SELECT l_orderkey, l_linenumber, rank::INTEGER AS rank FROM r WHERE rank <= 2""")
def rerank(spark, d):
    """Scores of an outside model, given as a column; the best two of each question."""
    score = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc(score), "l_linenumber"))
    return table(spark, d, "lineitem").withColumn("rank", rank).filter("rank <= 2").select("l_orderkey", "l_linenumber", "rank")


@query("txt17_nfc_names", "SELECT doc_id, md5(nfc_normalize(lower(text))) AS name FROM documents")
def nfc_names(spark, d):
    """Names taken apart into letters and marks are composed again."""
    import unicodedata

    @F.pandas_udf(T.StringType())
    def apart(names: pd.Series) -> pd.Series:
        return names.map(lambda n: unicodedata.normalize("NFD", n))

    return table(spark, d, "documents").select("doc_id", F.md5(text.nfc(apart(F.lower("text")))).alias("name"))


@query("dat10_dat12_formats", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d.%m.%y') AS shown FROM orders")
def date_formats(spark, d):
    """Dates in three spellings are read alike; a format of letters is written as one of percent signs."""
    from quillmill.functions.answers import as_date

    @F.pandas_udf(T.StringType())
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(as_date)

    pattern = misc.strftime_format("dd.MM.yy")

    @F.pandas_udf(T.StringType())
    def shown(dates: pd.Series) -> pd.Series:
        return pd.to_datetime(dates).dt.strftime(pattern)

    spelled = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in ("yyyy. M. d.", "yyyyMMdd", "yyyy/MM/dd")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", read(spelled).alias("iso"), shown(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("shown"))


@query("dat7_typed_prefix", f"""
  SELECT doc_id, CASE WHEN doc_id % 14 BETWEEN 1 AND 12 THEN '파일명시행일:2020-' || lpad((doc_id % 14)::VARCHAR, 2, '0') || '-01 | ' ELSE '' END || '부칙시행일:' || arg_max(enforced, i) || ' | 부칙순번:' || count(*) || '/' || count(*) || '(최신)' || CASE WHEN arg_max(retro, i) THEN ' | 소급적용포함:예' ELSE '' END AS prefix FROM {_ADDENDA} GROUP BY doc_id""")
def typed_prefix(spark, d):
    """Dates in a chunk's prefix with the part that they play."""
    added = F.flatten(F.transform(F.filter(text.sections(F.col("text")), lambda b: text.section_kind(b) == "addendum"), facts.addenda))
    found = regulations(spark, d).select("doc_id", effective_date(F.col("file_name")).alias("file_date"), added.alias("a"))
    last, n = F.element_at("a", -1), F.size("a").cast("string")
    parts = [F.concat(F.lit("파일명시행일:"), "file_date"), F.concat(F.lit("부칙시행일:"), facts.effective(last)), F.concat(F.lit("부칙순번:"), n, F.lit("/"), n, F.lit("(최신)")), F.when(last["retroactive"], "소급적용포함:예")]
    return found.select("doc_id", F.concat_ws(" | ", *parts).alias("prefix"))


@query("hyb7_side_by_side", """
  SELECT 'vector' AS kind, id FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 5
  UNION ALL SELECT 'graph', p_partkey FROM (SELECT p_partkey FROM part WHERE contains(lower(p_name), 'gear') OR contains(lower(p_type), 'gear') ORDER BY p_retailprice DESC, p_partkey LIMIT 5)""")
def side_by_side(spark, d):
    """Hits of both searches next to each other, not fused."""
    from quillmill.operators.retrieval import dense_top_k

    vectors = table(spark, d, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    dense = dense_top_k(queries, vectors.select(F.col("vec_id").alias("id"), "embedding"), 5)
    named = table(spark, d, "part").filter(text.has_any(F.lower("p_name"), ["gear"]) | text.has_any(F.lower("p_type"), ["gear"])).orderBy(F.desc("p_retailprice"), "p_partkey").limit(5)
    return dense.select(F.lit("vector").alias("kind"), "id").unionByName(named.select(F.lit("graph").alias("kind"), F.col("p_partkey").alias("id")))


@query("gra7_extraction_rows", "SELECT l_orderkey, p_brand AS name, count(*)::BIGINT AS mentions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def extraction_rows(spark, d):
    """Entities that a model found in each chunk, given as arrays, one row each."""
    found = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("kind"))).alias("entities"))
    return found.select("l_orderkey", F.inline("entities")).groupBy("l_orderkey", "name").agg(F.count("*").alias("mentions"))


@query("str6_single_flight", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS running, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'skip' ELSE 'start' END AS decision FROM orders GROUP BY 1")
def single_flight(spark, d):
    """A source with a running job gets no second one."""
    running = F.bool_or(F.col("o_orderstatus") == "P")
    return table(spark, d, "orders").groupBy("o_custkey").agg(running.alias("running")).select("o_custkey", "running", F.when(F.col("running"), "skip").otherwise("start").alias("decision"))


@query("sup2_collection_info", "SELECT label, count(*)::BIGINT AS points, min(len(embedding))::INTEGER AS dim, min(len(embedding)) IN (64, 384, 768, 1024) AS accepted FROM (SELECT label, CASE WHEN label % 3 = 0 AND vec_id % 7 = 0 THEN embedding[1:50] ELSE embedding END AS embedding FROM embeddings) GROUP BY label")
def collection_info(spark, d):
    """Points and least dimension of each collection, and whether that is one that is accepted. Some collections hold vectors that are cut short."""
    short = F.when((F.col("label") % 3 == 0) & (F.col("vec_id") % 7 == 0), F.slice("embedding", 1, 50)).otherwise(F.col("embedding"))
    grouped = table(spark, d, "embeddings").withColumn("embedding", short).groupBy("label").agg(F.count("*").alias("points"), F.min(F.size("embedding")).alias("dim"))
    return grouped.withColumn("accepted", F.col("dim").isin(64, 384, 768, 1024))


@query("sup9_seed_upsert", """
  WITH stored AS (SELECT c_custkey AS code, 'How does ' || c_name || ' pay?' AS question, c_mktsegment AS answer FROM customer WHERE c_nationkey < 20),
  seeds AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS code, c_custkey AS id, 'How does ' || c_name || ' pay?' AS question, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS answer FROM customer WHERE c_nationkey >= 10)
  SELECT s.id AS seed, CASE WHEN coalesce(a.answer, b.answer) IS NULL THEN 'created' WHEN coalesce(a.answer, b.answer) <> s.answer THEN 'updated' ELSE 'skipped' END AS outcome
  FROM seeds s LEFT JOIN stored a ON a.code = s.code LEFT JOIN stored b ON s.code IS NULL AND b.question = s.question""")
def seed_upsert(spark, d):
    """Seeds by code, or where they have none by their exact question: new ones are created, changed ones updated, equal ones skipped."""
    customer, question = table(spark, d, "customer"), F.concat(F.lit("How does "), "c_name", F.lit(" pay?"))
    stored = customer.filter("c_nationkey < 20").select(F.col("c_custkey").alias("code"), question.alias("question"), F.col("c_mktsegment").alias("answer"))
    answer = F.when(F.col("c_acctbal") < 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    seeds = customer.filter("c_nationkey >= 10").select(F.col("c_custkey").alias("seed"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("code"), question.alias("question"), answer.alias("now"))
    by_code = seeds.filter("code IS NOT NULL").join(stored.select("code", "answer"), "code", "left")
    by_question = seeds.filter("code IS NULL").join(stored.select("question", "answer"), "question", "left")
    joined = by_code.select("seed", "now", "answer").unionByName(by_question.select("seed", "now", "answer"))
    return joined.select("seed", F.when(F.col("answer").isNull(), "created").when(F.col("answer") != F.col("now"), "updated").otherwise("skipped").alias("outcome"))


@query("sup13_escalation", """
  WITH i AS (SELECT p_partkey, p_brand || '.png' AS image FROM part WHERE p_partkey % 4 <> 0)
  SELECT l_orderkey, string_agg(image, ',' ORDER BY l_linenumber, image) FILTER (l_linenumber <= 3) AS images, bool_or(l_quantity < 3) OR l_orderkey % 9 = 0 AS escalate FROM lineitem LEFT JOIN i ON p_partkey = l_partkey GROUP BY l_orderkey""")
def escalation(spark, d):
    """A question with the images of its tables; it is passed on if any of its tables is empty, or always where that is set."""
    images = table(spark, d, "part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", F.lit(".png")).alias("image"))
    rows = table(spark, d, "lineitem").join(images, "l_partkey", "left").groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") < 3).alias("any"), F.array_sort(F.collect_list(F.when(F.col("image").isNotNull() & (F.col("l_linenumber") <= 3), F.struct("l_linenumber", "image")))).alias("found"))
    listed = F.when(F.size("found") > 0, F.array_join(F.transform("found", lambda x: x["image"]), ","))
    return rows.select("l_orderkey", listed.alias("images"), (F.col("any") | (F.col("l_orderkey") % 9 == 0)).alias("escalate"))


@query("snk5_sup25_append", "SELECT kind, count(*)::BIGINT AS n FROM (SELECT 'old' AS kind FROM events UNION ALL SELECT 'new' FROM events WHERE event_type = 'error') GROUP BY kind")
def append(spark, d):
    """Rows appended to a table in two writes, read back as one."""
    at = scratch(spark, "append")
    events = table(spark, d, "events")
    events.select("event_id", F.lit("old").alias("kind")).write.mode("append").parquet(at)
    events.filter("event_type = 'error'").select("event_id", F.lit("new").alias("kind")).write.mode("append").parquet(at)
    return spark.read.parquet(at).groupBy("kind").agg(F.count("*").alias("n"))


@query("src8_docx", """
  WITH l AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  t AS (SELECT doc_id, i, lang, source, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
  b AS (SELECT doc_id, i, line AS block FROM t WHERE line <> '' UNION ALL SELECT doc_id, 1.5, '[표 1]' || chr(10) || '| lang | source |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' | ' || source || ' |' FROM t WHERE i = 1)
  SELECT doc_id, count(*)::BIGINT AS blocks, md5(string_agg(block, chr(10) || chr(10) ORDER BY i)) AS content FROM b GROUP BY 1""")
def docx_round_trip(spark, d):
    """Each document as a file of paragraphs, a table after the first of them, written and read back."""
    at, docs = scratch(spark, "docx"), table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path")
    none = F.lit(None).cast("array<array<string>>").alias("cells")
    paragraphs = lines.select(name, (F.col("i") * 2).alias("at"), F.lit("paragraph").alias("kind"), "text", none)
    tables = docs.select(name, F.lit(1).alias("at"), F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"), F.array(F.array(F.lit("lang"), F.lit("source")), F.array("lang", "source")).alias("cells"))
    docx.write_docx(paragraphs.unionByName(tables), at)
    number = F.count_if(F.col("kind") == "table").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    blocks = docx.read_docx(spark, at).withColumn("block", docx.block_text(number))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda b: b["block"]), "\n\n")
    return blocks.groupBy("path").agg(F.count("*").alias("blocks"), F.md5(whole).alias("content")).select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("doc_id"), "blocks", "content")


@query("src2_src3_src10_sup10_manifest", """
  WITH d AS (SELECT doc_id, '규정-' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.docx' WHEN 2 THEN '.odt' ELSE '.txt' END AS name, strlen(coalesce(text, '')) AS size FROM documents)
  SELECT name, CASE WHEN doc_id % 9 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 8 = 0 THEN 'modified' ELSE 'same' END AS change, (size + CASE WHEN doc_id % 8 = 0 AND doc_id % 9 <> 0 AND doc_id % 11 <> 0 THEN 8 ELSE 0 END)::BIGINT AS size,
    CASE doc_id % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'docx' WHEN 2 THEN NULL ELSE 'plain' END AS reader FROM d""")
def manifests(spark, d):
    """A folder of the documents before and after changes: some files are added, rewritten, or hidden; one in ten has a twin whose name
    is spelled with marks apart, and hidden files stand beside them."""
    at, docs, k = scratch(spark, "files"), table(spark, d, "documents"), F.col("doc_id")
    ending = F.when(k % 5 == 0, ".md").when(k % 5 == 1, ".docx").when(k % 5 == 2, ".odt").otherwise(".txt")
    apart = "\u1100\u1172\u110c\u1165\u11bc"  # the same two syllables as separate letters
    shelf = F.format_string("%03d/", F.pmod(F.xxhash64("doc_id"), F.lit(SHELVES)))  # tasks list a folder each
    of = lambda rows, first, body: rows.select(F.concat(shelf, F.lit(f"{first}-"), k.cast("string"), ending).alias("name"), body.alias("content"))
    there, text_of = docs.filter("doc_id % 9 <> 0"), F.coalesce("text", F.lit(""))
    write_files(of(there, "규정", text_of).unionByName(of(there.filter("doc_id % 10 = 0"), apart, text_of)), at)
    write_files(of(there, "._규정", text_of).unionByName(of(there, ".hidden", text_of)), at)
    before = cut(file_manifest(spark, at))
    write_files(of(docs.filter("doc_id % 9 = 0"), "규정", text_of).unionByName(of(there.filter("doc_id % 8 = 0 AND doc_id % 11 <> 0"), "규정", F.concat(text_of, F.lit(" revised")))), at)
    after = file_manifest(spark, at).filter((F.regexp_extract("name", r"-(\d+)\.", 1).cast("bigint") % 11 != 0) | (F.regexp_extract("name", r"-(\d+)\.", 1).cast("bigint") % 9 == 0))  # as if these had been removed
    return manifest_changes(before, after).withColumn("reader", route_of(F.col("name")))
