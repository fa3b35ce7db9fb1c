"""Offline evaluation: scores, intervals, paired tests, routing and failure classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.answers import correct
from quillmill.functions.lexical import tokens
from quillmill.functions.statistics import kappa, mcnemar, wilson
from quillmill.operators.textual import _ASKED, asked
from quillmill.registry import query
from quillmill.sources.tables import table

# Words that point to tables and dates in a question.
TABLE_WORDS = ["별표", "별지", "표에", "표의", "도표", "정원", "수당", "호봉", "봉급", "급여", "지급률", "지급 비율", "감액", "산정", "금액", "얼마", "몇 명", "몇명", "인원", "등급", "구분표"]
DATE_WORDS = ["시행일", "시행 일", "시행된", "개정", "제정", "부칙", "언제", "몇 년", "몇년", "날짜", "일자"]


def lane(question: Column) -> Column:
    """date, table or general, by the number of words found in the question without blanks; dates win ties."""
    bare = F.replace(question, F.lit(" "), F.lit(""))
    hits = lambda words: sum((F.contains(bare, F.lit(w.replace(" ", ""))).cast("int") for w in words), F.lit(0))
    dates, tables = hits(DATE_WORDS), hits(TABLE_WORDS)
    return F.when((dates > 0) & (dates >= tables), "date").when(tables > 0, "table").otherwise("general")


def failure_class(retrieved: Column, oracle: Column, noisy: Column, answered: Column) -> Column:
    """Where an answer was lost. Null is not false: a stage that didn't run takes no blame."""
    no = lambda c: c.eqNullSafe(F.lit(False))
    return (
        F.when(no(oracle), "gold_defect").when(answered, F.when(no(retrieved), "lucky_pass").otherwise("ok")).when(no(retrieved), "retrieval_miss")
        .when(answered.isNull(), "not_evaluated").when(no(noisy), "selection_miss").when(noisy, "ranking_miss").otherwise("generation_miss")
    )


@query("agg23_agg24_mth4_wilson_summary", """
  WITH g AS (SELECT coalesce(source, '*') AS source, sum(quality) AS x, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((source), ())), z AS (SELECT *, x / n AS p, 1.959963984540054 AS z FROM g)
  SELECT source, n::BIGINT AS n, round(p, 4) AS rate, round(greatest(0, ((p + z*z/(2*n)) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 4) AS low, round(least(1, ((p + z*z/(2*n)) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 4) AS high FROM z""")
def wilson_summary(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    sums = joined.groupingSets([["source"], []], "source").agg(F.sum("quality").alias("x"), F.count("*").alias("n"))
    w = sums.withColumn("w", wilson(F.col("x"), F.col("n")))
    return w.select(F.coalesce("source", F.lit("*")).alias("source"), "n", *[F.round(f"w.{c}", 4).alias(c) for c in ("rate", "low", "high")])


@query("mth5_joi15_mcnemar", """
  WITH t AS (SELECT coalesce(source, '*') AS source, count(*) FILTER (quality = 1 AND toxic = 0)::BIGINT AS b, count(*) FILTER (quality = 0 AND toxic = 1)::BIGINT AS c, count(*)::BIGINT AS n FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((source), ())),
  s AS (SELECT source, sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) AS tail FROM (SELECT source, b, c, unnest(range(greatest(b, c), b + c + 1)) AS i FROM t) GROUP BY source)
  SELECT t.source, n, b AS regressed, c AS improved, round(least(1.0, CASE WHEN b + c = 0 THEN 1.0 ELSE 2 * tail END), 6) AS p FROM t JOIN s USING (source)""")
def mcnemar_query(spark, d):
    """The exact p of paired outcomes, for each source and over all."""
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    regressed, improved = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1))
    counts = joined.groupingSets([["source"], []], "source").agg(F.count("*").alias("n"), regressed.alias("regressed"), improved.alias("improved"))
    return counts.select(F.coalesce("source", F.lit("*")).alias("source"), "n", "regressed", "improved", F.round(mcnemar("regressed", "improved"), 6).alias("p"))


def bootstrap_means(outcomes: DataFrame, by: str, value: str, draws: int = 1000, seed: int = 20260812) -> DataFrame:
    """(group, mean, low, high): the mean of each group and the 95 % interval of the means of redrawn samples.

    Outcomes are counted by (group, value) first. A redrawn sample of n outcomes is a multinomial draw of these counts, so what
    a task handles grows with the distinct values, not with the rows; draws are spread over tasks.
    """
    counted = outcomes.groupBy(by, value).agg(F.count("*").alias("c"))
    grouped = counted.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), "c"))).alias("counts"), F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"))
    each = grouped.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))

    @F.pandas_udf("double")
    def redraw(names: pd.Series, counts: pd.Series, draw: pd.Series) -> pd.Series:
        out = []
        for name, pairs, k in zip(names, counts, draw, strict=True):
            values, c = np.array([p["v"] for p in pairs]), np.array([p["c"] for p in pairs], float)
            source = np.random.default_rng([seed, int(k), *str(name).encode()])
            out.append(float((source.multinomial(int(c.sum()), c / c.sum()) * values).sum() / c.sum()))
        return pd.Series(out)

    means = each.repartition(by, "draw").select(by, "mean", redraw(F.col(by), F.col("counts"), F.col("draw")).alias("m"), "draw")
    ranked = means.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy("m", "draw")))
    low, high = int(0.025 * draws) + 1, int(0.975 * draws)
    return ranked.groupBy(by, "mean").agg(F.max(F.when(F.col("at") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("at") == high, F.col("m"))).alias("high"))


@query("mth6_bootstrap_interval")
def bootstrap_interval(spark, d):
    """Mean quality for each source with its interval. Redrawn samples differ by generator; a test holds the interval against
    the normal one and against redrawing rows."""
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("source", "quality")
    return bootstrap_means(joined, "source", "quality")


@query("mth8_kappa", """
  WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS yes, sum(quality) AS a, sum(toxic) AS b, count(*) AS n FROM labels)
  SELECT n::BIGINT AS n, round((((yes + n - a - b + yes) / n) - ((a/n)*(b/n) + (1-a/n)*(1-b/n))) / (1 - ((a/n)*(b/n) + (1-a/n)*(1-b/n))), 6) AS kappa FROM t""")
def kappa_query(spark, d):
    sums = table(spark, d, "labels").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("both"), F.sum("quality").alias("a"), F.sum("toxic").alias("b"), F.count("*").alias("n"))
    return sums.select("n", F.round(kappa(F.col("both"), F.col("a"), F.col("b"), F.col("n")), 6).alias("kappa"))


@query("agg26_confusion_matrix", "SELECT lang AS actual, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS predicted, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2")
def confusion(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("actual"), F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("predicted")).agg(F.count("*").alias("n"))


@query("agg27_failure_pivot", """
  SELECT source, count(*) FILTER (lang = 'en')::BIGINT AS en, count(*) FILTER (lang = 'fr')::BIGINT AS fr, count(*) FILTER (lang = 'de')::BIGINT AS de, count(*) FILTER (lang = 'es')::BIGINT AS es FROM documents GROUP BY 1""")
def failure_pivot(spark, d):
    pivoted = table(spark, d, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1)))
    return pivoted.select("source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("en", "fr", "de", "es")])


_ARMS = "SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN NULL ELSE l_linenumber % 3 = 1 END AS r, l_quantity <> 13 AS oc, CASE WHEN l_tax > 0.06 THEN NULL ELSE l_tax > 0.03 END AS n, CASE WHEN l_discount > 0.08 THEN NULL ELSE l_discount > 0.04 END AS e FROM lineitem"


@query("scr7_failure_classes", f"""
  SELECT CASE WHEN oc IS FALSE THEN 'gold_defect' WHEN e THEN CASE WHEN r IS FALSE THEN 'lucky_pass' ELSE 'ok' END WHEN r IS FALSE THEN 'retrieval_miss' WHEN e IS NULL THEN 'not_evaluated' WHEN n IS FALSE THEN 'selection_miss'
    WHEN n THEN 'ranking_miss' ELSE 'generation_miss' END AS class, count(*)::BIGINT AS n FROM ({_ARMS}) GROUP BY 1""")
def failure_classes(spark, d):
    lines = table(spark, d, "lineitem")
    retrieved = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber") % 3 == 1)
    noisy, answered = F.when(~(F.col("l_tax") > 0.06), F.col("l_tax") > 0.03), F.when(~(F.col("l_discount") > 0.08), F.col("l_discount") > 0.04)
    return lines.groupBy(failure_class(retrieved, F.col("l_quantity") != 13, noisy, answered).alias("class")).agg(F.count("*").alias("n"))


_HITS = lambda words: " + ".join(f"contains(bare, '{w.replace(' ', '')}')::INTEGER" for w in words)


@query("scr8_lane_router", f"""
  WITH q AS (SELECT o_orderkey, replace({_ASKED}, ' ', '') AS bare FROM orders), h AS (SELECT o_orderkey, {_HITS(DATE_WORDS)} AS dates, {_HITS(TABLE_WORDS)} AS tables FROM q)
  SELECT o_orderkey, CASE WHEN dates > 0 AND dates >= tables THEN 'date' WHEN tables > 0 THEN 'table' ELSE 'general' END AS lane FROM h""")
def lane_router(spark, d):
    return table(spark, d, "orders").select("o_orderkey", lane(asked(F.col("o_orderkey"))).alias("lane"))


@query("scr1_scr2_answer_scores", """
  SELECT o_orderkey, ['date', 'number', 'percent', 'list', 'unknown', 'text'][1 + o_orderkey % 6] AS mode, o_custkey % 2 = 0 AS correct FROM orders""")
def answer_scores(spark, d):
    """Six modes, each with right and wrong answers in several spellings, made of the orders' own dates and numbers. The SQL
    says for which rows the answer was made a right one."""
    k, right, n = F.col("o_orderkey"), F.col("o_custkey") % 2 == 0, F.floor("o_totalprice")
    day = F.to_date("o_orderdate")
    said_day = F.when(right, day).otherwise(F.date_add(day, 1 + (k % 300).cast("int")))
    spelled = F.element_at(F.array(*[F.date_format(said_day, f) for f in ("yyyy. M. d.", "yyyyMMdd", "yyyy/MM/dd", "yyyy-MM-dd")]), (F.floor(k / 6) % 4 + 1).cast("int"))
    said_n = F.when(right, n).otherwise(n + 1 + k % 50)
    comma = F.format_number(said_n, 0)
    share, said_share = 1 + F.col("o_custkey") % 90, F.when(right, 1 + F.col("o_custkey") % 90).otherwise(91 + k % 9)
    text = lambda c: c.cast("string")
    cases = {
        "date": (F.date_format(day, "yyyy-MM-dd"), F.concat(spelled, F.lit("부터 시행"))), "number": (text(n), F.concat(F.lit("약 "), F.when(k % 4 < 2, comma).otherwise(text(said_n)), F.lit("명"))),
        "percent": (F.concat(text(share), F.lit("%")), F.concat(text(said_share), F.when(k % 4 < 2, F.lit(" 퍼센트")).otherwise(F.lit("%")))),
        "list": (F.concat_ws(", ", F.col("o_orderstatus"), F.lit("x"), text(n)), F.when(right, F.concat_ws("·", text(n), F.col("o_orderstatus"), F.lit("x"))).otherwise(F.concat_ws("/", F.col("o_orderstatus"), text(n)))),
        "unknown": (F.lit(""), F.when(right, F.concat(F.lit("표에 없으므로 알 수 없습니다 "), text(n))).otherwise(F.concat(text(n), F.lit("원")))),
        "text": (F.concat(F.col("o_orderpriority"), F.lit(" "), text(n)), F.when(right, F.concat(F.lit("답: "), F.lower("o_orderpriority"), text(n))).otherwise(F.concat(F.lit("q"), text(n)))),
    }
    choose = lambda i: F.element_at(F.array(*[c[i] for c in cases.values()]), (k % 6 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(m) for m in cases]), (k % 6 + 1).cast("int")).alias("mode"), choose(0).alias("gold"), choose(1).alias("answer"))
    return rows.select("o_orderkey", "mode", correct("mode", "gold", F.array().cast("array<string>"), "answer").alias("correct"))


@query("agg28_loss_decomposition", f"""
  WITH a AS (SELECT l_returnflag = 'A' AS control, r, oc, n, e FROM ({_ARMS.replace("SELECT l_orderkey,", "SELECT l_returnflag,")})), s AS (SELECT avg(r::INTEGER) AS r, avg(oc::INTEGER) AS oc, avg(n::INTEGER) AS n, avg(e::INTEGER) AS e, count(*) FILTER (e AND NOT r) AS lucky, count(*) AS total FROM a WHERE NOT control)
  SELECT total::BIGINT AS total, round(oc, 6) AS reading_ceiling, round(r, 6) AS retrieved, round(oc - n, 6) AS lost_to_noise, round(n - e, 6) AS lost_to_ranking, round(r - e, 6) AS lost_after_retrieval, lucky::BIGINT AS lucky FROM s""")
def loss_decomposition(spark, d):
    """Rates of the stages, each over the rows in which it ran, what is lost between them, and answers that are right without
    having been retrieved. Control questions don't count."""
    lines = table(spark, d, "lineitem").filter("l_returnflag <> 'A'")
    retrieved, oracle = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber") % 3 == 1), F.col("l_quantity") != 13
    noisy, answered = F.when(~(F.col("l_tax") > 0.06), F.col("l_tax") > 0.03), F.when(~(F.col("l_discount") > 0.08), F.col("l_discount") > 0.04)
    rates = lines.agg(*[F.avg(c.cast("int")).alias(name) for name, c in (("r", retrieved), ("oc", oracle), ("n", noisy), ("e", answered))], F.count_if(answered & ~retrieved).alias("lucky"), F.count("*").alias("total"))
    rounded = lambda c, name: F.round(c, 6).alias(name)
    r, oc, n, e = (F.col(c) for c in ("r", "oc", "n", "e"))
    return rates.select("total", rounded(oc, "reading_ceiling"), rounded(r, "retrieved"), rounded(oc - n, "lost_to_noise"), rounded(n - e, "lost_to_ranking"), rounded(r - e, "lost_after_retrieval"), "lucky")


@query("agg35_gold_revalidation", """
  SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN i.item_id % 7 = 0 THEN 'abstain' WHEN contains(lower(d.text), word) THEN 'body' WHEN contains(lower(h.html), word) THEN 'tables' WHEN i.item_id % 2 = 0 THEN 'needs_tables' ELSE 'missing' END AS status, count(*)::BIGINT AS n
  FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS word FROM benchmark) i LEFT JOIN documents d ON d.doc_id = i.item_id * 3 AND i.item_id % 5 <> 0 LEFT JOIN pages h ON h.page_id = i.item_id WHERE word <> '' GROUP BY 1""")
def gold_revalidation(spark, d):
    """Where each gold fact stands now: in its document's body, in its tables, nowhere yet, or without a document at all."""
    facts = table(spark, d, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("word")).filter("word <> ''")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("at"), F.lower("text").alias("body"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.lower("html").alias("tables"))
    joined = facts.join(docs, (F.col("at") == F.col("item_id") * 3) & (F.col("item_id") % 5 != 0), "left").join(pages, "item_id", "left")
    status = (
        F.when(F.col("at").isNull(), "missing").when(F.col("item_id") % 7 == 0, "abstain").when(F.contains("body", "word"), "body")
        .when(F.coalesce(F.contains("tables", "word"), F.lit(False)), "tables").when(F.col("item_id") % 2 == 0, "needs_tables").otherwise("missing")
    )
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


#: Fixed value: how a table's values are said to be missing.
NO_VALUE = "참조 문서의 표 셀 값이 비어 있어 알 수 없습니다."
CELLS = "[셀요약]"


def table_lane_answers(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, answer) from hits (query_id, rank, section, text): the cell line that shares most words with the question, the
    first of equals; questions (query_id, question, normalize) that are to be abstained from get NO_VALUE where a table is empty
    or no line matches; without any line the first table's text, else the first hit's."""
    asked = questions.select("query_id", "normalize", F.array_distinct(tokens(F.col("question"))).alias("asked"))
    lines = hits.filter(F.contains("text", F.lit(CELLS))).select("query_id", "rank", F.posexplode(F.split(F.regexp_replace("text", r"(?s)^.*?\[셀요약\]", ""), "\n")).alias("at", "line"))
    scored = lines.join(asked, "query_id").withColumn("shared", F.size(F.array_intersect(F.array_distinct(tokens(F.col("line"))), F.col("asked")))).filter("shared > 0")
    best = scored.groupBy("query_id").agg(F.max_by(F.trim("line"), F.struct("shared", -F.col("rank"), -F.col("at"))).alias("best"))
    about = hits.groupBy("query_id").agg(
        F.bool_or(F.contains("text", F.lit("수치 셀이 비어"))).alias("empty"), F.min_by(F.when(F.col("section") == "table", F.substring("text", 1, 400)), F.struct(F.col("section") != "table", "rank")).alias("table"),
        F.min_by(F.substring("text", 1, 400), "rank").alias("first"),
    )
    rows = asked.join(best, "query_id", "left").join(about, "query_id", "left")
    abstains = (F.col("normalize") == "unknown") & (F.coalesce("empty", F.lit(False)) | F.col("best").isNull())
    return rows.select("query_id", F.when(abstains, NO_VALUE).otherwise(F.coalesce("best", "table", "first", F.lit(""))).alias("answer"))


@query("scr9_table_lane_answer", f"""
  WITH p AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE 'number' END AS normalize, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{{L}}\\p{{N}}]+')) AS asked FROM part),
  h AS (SELECT p_partkey, 1 AS rank, 'body' AS section, 'about ' || p_brand AS text FROM part UNION ALL SELECT p_partkey, 2, 'table', CASE p_partkey % 4 WHEN 0 THEN '수치 셀이 비어 있다 ' || p_brand ELSE 'T' || chr(10) || '{CELLS}' || chr(10) || p_brand || '=' || p_size || chr(10) || p_type || '=' || p_retailprice END FROM part WHERE p_partkey % 3 <> 0
    UNION ALL SELECT p_partkey, 3, 'table', '{CELLS}' || chr(10) || p_name || '=' || p_size || chr(10) || split_part(p_name, ' ', 1) || '; 정원=' || p_type FROM part WHERE p_partkey % 7 <> 0),
  l AS (SELECT p_partkey, rank, unnest(string_split(regexp_replace(text, '(?s)^.*?\\[셀요약\\]', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '(?s)^.*?\\[셀요약\\]', ''), chr(10)), 1) AS pos FROM h WHERE contains(text, '{CELLS}')),
  b AS (SELECT p_partkey, trim(line) AS best, row_number() OVER (PARTITION BY p_partkey ORDER BY len(list_intersect(list_distinct(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+')), asked)) DESC, rank, pos) AS rn FROM l JOIN p USING (p_partkey) WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+')), asked)) > 0),
  a AS (SELECT p_partkey, bool_or(contains(text, '수치 셀이 비어')) AS empty, arg_min(text, rank) FILTER (section = 'table') AS first_table, arg_min(text, rank) AS first FROM h GROUP BY 1)
  SELECT p_partkey AS query_id, CASE WHEN normalize = 'unknown' AND (empty OR best IS NULL) THEN '{NO_VALUE}' ELSE coalesce(best, first_table, first) END AS answer FROM p JOIN a USING (p_partkey) LEFT JOIN b ON b.p_partkey = p.p_partkey AND rn = 1""")
def table_lane(spark, d):
    part = table(spark, d, "part")
    k, text = F.col("p_partkey"), lambda *c: F.concat(*c)
    questions = part.select(k.alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("question"), F.when(k % 5 == 0, "unknown").otherwise("number").alias("normalize"))
    eq = lambda a, b: text(F.col(a), F.lit("="), F.col(b).cast("string"))
    second = F.when(k % 4 == 0, text(F.lit("수치 셀이 비어 있다 "), F.col("p_brand"))).otherwise(F.concat_ws("\n", F.lit("T"), F.lit(CELLS), eq("p_brand", "p_size"), eq("p_type", "p_retailprice")))
    third = F.concat_ws("\n", F.lit(CELLS), eq("p_name", "p_size"), text(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("; 정원="), F.col("p_type")))
    hit = lambda rows, rank, section, body: rows.select(k.alias("query_id"), F.lit(rank).alias("rank"), F.lit(section).alias("section"), body.alias("text"))
    hits = hit(part, 1, "body", text(F.lit("about "), F.col("p_brand"))).unionByName(hit(part.filter("p_partkey % 3 <> 0"), 2, "table", second)).unionByName(hit(part.filter("p_partkey % 7 <> 0"), 3, "table", third))
    return table_lane_answers(questions, hits)


def attachment_pages(questions: DataFrame, pages: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, page): of each question's document the pages that most of the attachments named in it are on, most first,
    then in order; the first pages where none is. questions: (query_id, doc, question), pages: (doc, page, text)."""
    asked = questions.select("query_id", "doc", F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit(r"별표\s*(\d+(?:-\d+)?)"), F.lit(1)), lambda x: F.concat(F.lit("별표"), x))).alias("refs"))
    both = asked.join(pages.select("doc", "page", F.replace("text", F.lit(" "), F.lit("")).alias("squashed")), "doc")
    scored = both.withColumn("score", F.size(F.filter("refs", lambda r: F.contains(F.col("squashed"), r))))
    any_hit = F.max("score").over(Window.partitionBy("query_id")) > 0
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page"))
    return scored.withColumn("any", any_hit).withColumn("place", place).filter((F.col("place") <= limit) & (~F.col("any") | (F.col("score") > 0))).select("query_id", "page")


@query("top10_page_selection", """
  WITH p AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, '별표' || (o_orderkey % 7) || ' 및 별표' || (o_orderkey % 3 + 7) AS squashed FROM orders),
  q AS (SELECT c_custkey AS query_id, c_custkey AS doc, list_distinct(['별표' || (c_custkey % 7), '별표' || (c_custkey % 4 + 6)]) AS refs FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, c_custkey, [] FROM customer WHERE c_custkey % 5 = 0),
  s AS (SELECT query_id, page, len(list_filter(refs, lambda r: contains(replace(squashed, ' ', ''), r))) AS score FROM q JOIN p USING (doc)),
  r AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS place FROM s)
  SELECT query_id, page::INTEGER AS page FROM r WHERE place <= 3 AND (best = 0 OR score > 0)""")
def page_selection(spark, d):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    text = lambda a, b: F.concat(F.lit("별표 "), a.cast("string"), F.lit(" 및 별표"), b.cast("string"))
    pages = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), number.alias("page"), text(k % 7, k % 3 + 7).alias("text"))
    question = F.when(c % 5 == 0, "휴학은 언제").otherwise(text(c % 7, c % 4 + 6))
    return attachment_pages(table(spark, d, "customer").select(c.alias("query_id"), c.alias("doc"), question.alias("question")), pages)
