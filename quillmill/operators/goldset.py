"""Gold questions: validation, composition, oracle contexts, failure heuristics, scoring with facts and a judge, judge batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.binding import let
from quillmill.plans.checkpoints import bounded, cut
from quillmill.registry import query
from quillmill.sources.tables import table

# Kinds of questions by the prefix of their ids, logical forms and spellings of answers, reasons for having none,
# and articles that are spread over a whole document.
CATEGORIES = ["HAK", "SUG", "HYU", "JOL", "JAN", "SAE", "IN", "GUK", "BOK", "NEG", "TRIG"]
ANSWER_TYPES = ["exact", "list_all", "list_any", "conditional", "abstain"]
NORMALIZE_TYPES = ["date", "number", "percent", "list", "text", "unknown"]
UNANSWERABLE_REASONS = ["not_in_corpus", "personal_data", "out_of_scope", "time_sensitive"]
UNUSABLE_ARTICLES = ["부칙", "문서메타", ""]
#: Chunks over which an article may be spread before its oracle context grows large.
MAX_CHUNKS = 4
#: Gold chunks of a row, where questions share them, such questions of a row, and about how many rows a task makes of both.
PACK = 1024
BLOCK = 256
TASK_ROWS = 1 << 25


def plain(text: Column) -> Column:
    """Lower case without white space and quotes."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\"'`“”‘’]+", ""))


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def _none(values: Column) -> Column:
    return F.coalesce(F.size(values) <= 0, F.lit(True))


def gold_problems(gold: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """(id, problem, severity) of gold records: `line` is their order. `articles`: (doc_id, article, chunks) that exist.

    Every record is checked on its own; only repeated ids and the articles' existence need other rows.
    """
    prefix, kind, spelling = F.regexp_extract("id", r"^([A-Z]+)", 1), F.col("answer_type"), F.col("normalize")
    abstains = kind == "abstain"
    again = F.row_number().over(Window.partitionBy("id").orderBy("line")) > 1
    docs = F.transform("gold_articles", lambda g: g["doc_id"])
    errors = {
        "id repeated": again, "unknown prefix": ~prefix.isin(CATEGORIES), "category differs from prefix": prefix.isin(CATEGORIES) & ~_blank(F.col("category")) & (F.col("category") != prefix),
        "unknown answer type": ~kind.isin(ANSWER_TYPES), "unknown normalize": ~spelling.isin(NORMALIZE_TYPES), "no question": _blank(F.col("question")),
        "abstaining but not unknown": abstains & (spelling != "unknown"), "unknown but not abstaining": ~abstains & (spelling == "unknown"), "list without facts": (kind == "list_all") & _none(F.col("required_facts")),
        "abstaining with articles": abstains & ~_none(F.col("gold_articles")), "abstaining without reason": abstains & ~F.coalesce(F.col("unanswerable_reason").isin(UNANSWERABLE_REASONS), F.lit(False)),
        "no articles": ~abstains & _none(F.col("gold_articles")), "reason without abstaining": ~abstains & F.col("unanswerable_reason").isNotNull(), "no answer": ~abstains & _blank(F.col("answer")),
        "no document": ~abstains & _blank(F.col("doc_id")), "no keywords": ~abstains & _none(F.col("keywords")),
        "document not among articles": ~abstains & ~_blank(F.col("doc_id")) & ~_none(F.col("gold_articles")) & ~F.array_contains(docs, F.col("doc_id")),
    }
    warnings = {"free form without judge": kind.isin("list_all", "conditional") & ~F.col("judge"), "no spans": ~abstains & _none(F.col("gold_spans"))}
    said = lambda checks, severity: [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("problem"), F.lit(severity).alias("severity"))) for name, c in checks.items()]
    own = gold.withColumn("all", F.array(*said(errors, "error"), *said(warnings, "warning"))).select("id", F.inline(F.filter("all", lambda x: x.isNotNull())))
    each = gold.select("id", F.inline("gold_articles")).select("id", F.col("doc_id").alias("in_doc"), plain(F.col("article")).alias("key"))
    unusable = each.filter(F.col("key").isin(UNUSABLE_ARTICLES)).select("id", F.lit("article is no key").alias("problem"), F.lit("error").alias("severity"))
    if articles is None:
        return own.unionByName(unusable)
    known = articles.groupBy(F.col("doc_id").alias("in_doc"), plain(F.col("article")).alias("key")).agg(F.sum("chunks").alias("chunks"))
    met = each.filter(~F.col("key").isin(UNUSABLE_ARTICLES)).join(known, ["in_doc", "key"], "left")
    spread = F.when(F.col("chunks").isNull(), "no such article").when(F.col("chunks") > MAX_CHUNKS, "article is spread")
    found = met.select("id", spread.alias("problem"), F.when(F.col("chunks").isNull(), "error").otherwise("warning").alias("severity")).filter("problem IS NOT NULL")
    return own.unionByName(unusable).unionByName(found)


def oracle_context(gold: DataFrame, chunks: DataFrame, hits: DataFrame, top_k: int = 12) -> DataFrame:
    """(query_id, place, chunk_id, role): a question's gold chunks in the order of the index, then hits that are no gold, by rank,
    up to `top_k` in all. gold: (query_id, doc_id, article), chunks: (chunk_id, doc_id, article), hits: (query_id, chunk_id, rank).
    A question without gold chunks has no context."""
    # Questions that want the same (doc_id, article) pairs have the same gold chunks in the same order: these are numbered once for each
    # such set and packed, so that the rows of a question come from a join alone, without an exchange or a sort of them. Questions of a set
    # meet its chunks in blocks, chunk by chunk, and a task has few sets: columns hold one value many times over or the same questions
    # again and again, which files need little room for. Question by question, each list would leave the reach of their compression.
    key = lambda f: f.withColumn("key", F.trim("article")).drop("article")
    wanted, held = key(gold).distinct(), key(chunks)
    sets = key(gold).filter("doc_id IS NOT NULL AND key IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("doc_id", "key"))).alias("set"))
    members = sets.select("set").distinct().select("set", F.explode("set").alias("m")).select("set", "m.doc_id", "m.key")
    each = members.join(held, ["doc_id", "key"]).select("set", "chunk_id")
    numbered = each.withColumn("place", F.row_number().over(Window.partitionBy("set").orderBy("chunk_id")))
    packs = numbered.groupBy("set", F.floor((F.col("place") - 1) / PACK).alias("pack")).agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))).alias("rows"))
    packs = cut(packs.select("set", "pack", F.transform("rows", lambda r: r["chunk_id"]).alias("chunk_ids")))
    asked = cut(sets.groupBy("set").agg(F.count("*").alias("questions")).join(packs.groupBy("set").agg(F.sum(F.size("chunk_ids")).alias("n")), "set"))
    rows = asked.agg(F.sum(F.col("questions") * F.col("n"))).first()[0] or 0
    tasks = max(4 * gold.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))  # few rows in, many out: adaptive execution would coalesce them
    parts = F.ceil(F.col("questions") / F.greatest(F.lit(1), F.least(F.lit(8 * BLOCK), F.floor(TASK_ROWS / F.col("n")))))
    near = sets.join(bounded(asked), "set").select("set", "query_id", F.pmod(F.xxhash64("query_id"), parts).alias("part"))
    near = near.repartitionByRange(tasks, "set", "part").groupBy("set", "part").agg(F.transform(F.collect_list(F.struct("query_id")), lambda q: q["query_id"]).alias("all"))
    starts = F.sequence(F.lit(1), F.size("all"), F.lit(BLOCK))
    blocks = near.select("set", F.explode(F.transform(starts, lambda i: F.slice("all", i, BLOCK))).alias("query_ids"))
    # Compiled together with the join, the generator would hold all rows of a block and its chunks before any goes on; a lambda keeps it apart.
    met = blocks.join(bounded(packs), "set").select("query_ids", "pack", F.posexplode(F.transform("chunk_ids", lambda c: c)).alias("at", "chunk_id"))
    golden = met.select(F.explode("query_ids").alias("query_id"), "pack", "at", "chunk_id")
    golden = golden.select("query_id", (F.col("pack") * PACK + F.col("at") + 1).cast("int").alias("place"), "chunk_id", F.lit("gold").alias("role"))
    counts = sets.join(bounded(asked), "set").select("query_id", "n")
    few = counts.filter(F.col("n") < top_k)  # only these have places left
    others = hits.join(few, "query_id", "left_semi").join(held, "chunk_id").join(wanted, ["query_id", "doc_id", "key"], "left_anti").select("query_id", "chunk_id", "rank")
    others = others.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).filter(F.col("at") <= top_k)
    noise = others.join(few, "query_id").filter(F.col("at") <= F.lit(top_k) - F.col("n"))
    return golden.unionByName(noise.select("query_id", (F.col("n") + F.col("at")).cast("int").alias("place"), "chunk_id", F.lit("distractor").alias("role")))


def failure_blame(answered: Column, expected: dict[str, Column], joined: Column, source_found: Column, prediction: Column) -> Column:
    """What a wrong answer is blamed on, from the text of all hits: null for a right one. `expected`: normalize, type, subtype,
    keywords (an array), article."""
    from quillmill.functions.dates import dates_in

    placeholder = F.contains(joined, F.lit("<표>"))
    keywords = F.when(F.size(expected["keywords"]) > 0, F.forall(expected["keywords"], lambda k: F.contains(joined, k))).otherwise(source_found)
    retrieved = source_found & keywords
    dated = lambda c: F.size(dates_in(c)) > 0
    return (
        F.when(answered, F.lit(None).cast("string"))
        .when(expected["normalize"] == "unknown", F.when(placeholder | F.contains(joined, F.lit("별표")), "generation_failure").otherwise("extraction_failure"))
        .when((expected["type"] == "table") & (expected["subtype"] == "cell_value") & placeholder & ~joined.rlike(r"\d"), "extraction_failure")
        .when(~retrieved, "retrieval_failure")
        .when((expected["type"] == "date") & dated(joined) & ~dated(prediction), "generation_failure")
        .when(F.coalesce(F.contains(joined, expected["article"]), F.lit(False)), "generation_failure").otherwise("chunking_failure")
    )


def facts_in(prediction: Column, facts: Column) -> Column:
    """Those of the facts that a prediction has: of a fact with several pieces of two characters or more one is enough."""
    said = plain(prediction)

    def has(fact: Column) -> Column:
        pieces = F.filter(F.split(fact, r"[·/,]| 또는 "), lambda p: F.length(plain(p)) >= 2)
        return let(pieces, lambda ps: F.when(F.size(ps) > 0, F.exists(ps, lambda p: F.contains(said, plain(p)))).otherwise(F.contains(said, plain(fact))))

    return F.filter(facts, has)


def judged_score(answer_type: Column, base: Column, prediction: Column, required: Column, forbidden: Column, wants_judge: Column, verdict: Column) -> Column:
    """A struct of correct, partial and reason. `base`: whether the plain comparison takes the answer for right; `verdict`: an
    outside judge's word, null where there was none. A forbidden fact settles it; the judge never overturns a right answer."""
    found = facts_in(prediction, required)
    share = F.coalesce(F.size(found) / F.nullif(F.size(required), F.lit(0)), F.lit(0.0))
    listed = answer_type == "list_all"
    right = F.when(listed, F.size(found) == F.size(required)).otherwise(base)
    partial = F.when(listed, share).otherwise(right.cast("double"))
    own = F.when(listed, F.when(right, "all_facts").otherwise("missing_facts")).when((answer_type == "conditional") & ~right & verdict.isNull(), "needs_judge").otherwise(F.when(right, "match").otherwise("mismatch"))
    asks = verdict.isNotNull() & ~right & (answer_type.isin("abstain", "conditional") | wants_judge | ~right)
    correct = right | (asks & verdict.isin("correct", "abstain_ok"))
    by_judge = F.when(verdict.isin("correct", "abstain_ok"), 1.0).when(verdict == "partial", F.greatest(partial, F.lit(0.5))).when(verdict == "hallucination", 0.0).otherwise(partial)
    scored = F.struct(correct.alias("correct"), F.when(asks, by_judge).otherwise(partial).alias("partial"), F.when(asks, F.concat(F.lit("judge_"), verdict)).otherwise(own).alias("reason"))
    none = F.struct(F.lit(False).alias("correct"), F.lit(0.0).alias("partial"), F.lit("forbidden_fact").alias("reason"))
    return F.when(F.size(facts_in(prediction, forbidden)) > 0, none).otherwise(scored)


def judge_batches(wrong: DataFrame, cached: DataFrame, size: int = 15, runs: int = 64) -> DataFrame:
    """(key, batch, place) of what is still to be judged: distinct keys without those that are cached, in key order, `size` to a
    batch. Keys are numbered in two levels, by ranges of their hash prefix, so that no one task numbers all."""
    todo = wrong.select("key").distinct().join(cached.select("key"), "key", "left_anti").withColumn("run", F.conv(F.substring("key", 1, 2), 16, 10).cast("int") % 256 * runs / 256)
    todo = todo.withColumn("run", F.floor("run").cast("int"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = todo.groupBy("run").agg(F.count("*").alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("run").orderBy("key")) - 1
    numbered = todo.withColumn("number", number).join(F.broadcast(offsets), "run").select("key", (F.col("number") + F.col("offset")).alias("number"))
    return numbered.select("key", F.floor(F.col("number") / size).cast("int").alias("batch"), (F.col("number") % size).cast("int").alias("place"))


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def gold_of_orders(spark, d: str) -> DataFrame:
    """Gold records made of orders, with every kind of defect here and there."""
    o = table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    k, c = F.col("k"), F.col("o_custkey")
    kind = _pick([*ANSWER_TYPES, "guess"], c)
    prefix = _pick([*CATEGORIES, "ZZ"], k)
    articles = F.when(k % 5 == 0, F.array().cast("array<struct<doc_id:string,article:string>>")).otherwise(
        F.array(F.struct((c % 40).cast("string").alias("doc_id"), F.when(k % 11 == 0, " 부칙 ").otherwise(F.concat(F.lit("Part "), (k % 9).cast("string"))).alias("article")))
    )
    return o.select(
        F.concat(prefix, F.lit("-"), F.when(k % 50 == 1, k - 1).otherwise(k).cast("string")).alias("id"), k.alias("line"), F.when(k % 4 == 0, F.lit("")).when(k % 13 == 0, F.lit("HAK")).otherwise(prefix).alias("category"),
        kind.alias("answer_type"), _pick([*NORMALIZE_TYPES, "odd"], k + c).alias("normalize"), F.when(k % 17 == 0, " ").otherwise(F.col("o_orderpriority")).alias("question"), F.when(k % 19 == 0, "").otherwise("yes").alias("answer"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("o_orderstatus"))).alias("required_facts"), articles.alias("gold_articles"),
        F.when(k % 2 == 0, _pick([*UNANSWERABLE_REASONS, "why"], c)).alias("unanswerable_reason"), F.when(k % 23 == 0, "").when(k % 29 == 0, "999").otherwise((c % 40).cast("string")).alias("doc_id"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("key"))).alias("keywords"), (k % 2 == 1).alias("judge"), F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("span"))).alias("gold_spans"),
    )


_PICK = lambda values, at: f"[{', '.join(repr(v) for v in values)}][1 + ({at}) % {len(values)}]"
_GOLD = f"""gold AS (SELECT {_PICK([*CATEGORIES, 'ZZ'], 'o_orderkey')} AS prefix, o_orderkey AS k, o_custkey AS c, {_PICK([*ANSWER_TYPES, 'guess'], 'o_custkey')} AS kind, {_PICK([*NORMALIZE_TYPES, 'odd'], 'o_orderkey + o_custkey')} AS normalize,
    prefix || '-' || CASE WHEN k % 50 = 1 THEN k - 1 ELSE k END AS id, CASE WHEN k % 4 = 0 THEN '' WHEN k % 13 = 0 THEN 'HAK' ELSE prefix END AS category, CASE WHEN k % 23 = 0 THEN '' WHEN k % 29 = 0 THEN '999' ELSE (c % 40)::VARCHAR END AS doc_id,
    CASE WHEN k % 2 = 0 THEN {_PICK([*UNANSWERABLE_REASONS, 'why'], 'o_custkey')} END AS reason, k % 5 <> 0 AS has_articles, kind = 'abstain' AS abstains FROM orders)"""


@query("scr10_joi18_gold_validation", f"""
  WITH {_GOLD}, idx AS (SELECT (l_suppkey % 40)::VARCHAR AS doc_id, 'part' || (l_partkey % 7) AS key, count(*) AS chunks FROM lineitem GROUP BY 1, 2),
  own AS (SELECT id, unnest(list_filter([
      CASE WHEN row_number() OVER (PARTITION BY id ORDER BY k) > 1 THEN 'id repeated' END, CASE WHEN prefix = 'ZZ' THEN 'unknown prefix' END, CASE WHEN prefix <> 'ZZ' AND category <> '' AND category <> prefix THEN 'category differs from prefix' END,
      CASE WHEN kind = 'guess' THEN 'unknown answer type' END, CASE WHEN normalize = 'odd' THEN 'unknown normalize' END, CASE WHEN k % 17 = 0 THEN 'no question' END, CASE WHEN abstains AND normalize <> 'unknown' THEN 'abstaining but not unknown' END,
      CASE WHEN NOT abstains AND normalize = 'unknown' THEN 'unknown but not abstaining' END, CASE WHEN kind = 'list_all' AND k % 3 = 0 THEN 'list without facts' END, CASE WHEN abstains AND has_articles THEN 'abstaining with articles' END,
      CASE WHEN abstains AND coalesce(reason, 'why') = 'why' THEN 'abstaining without reason' END, CASE WHEN NOT abstains AND NOT has_articles THEN 'no articles' END, CASE WHEN NOT abstains AND reason IS NOT NULL THEN 'reason without abstaining' END,
      CASE WHEN NOT abstains AND k % 19 = 0 THEN 'no answer' END, CASE WHEN NOT abstains AND doc_id = '' THEN 'no document' END, CASE WHEN NOT abstains AND k % 7 = 0 THEN 'no keywords' END,
      CASE WHEN NOT abstains AND has_articles AND doc_id = '999' THEN 'document not among articles' END, CASE WHEN kind IN ('list_all', 'conditional') AND k % 2 = 0 THEN 'free form without judge' END, CASE WHEN NOT abstains AND k % 6 = 0 THEN 'no spans' END,
      CASE WHEN has_articles AND k % 11 = 0 THEN 'article is no key' END], lambda x: x IS NOT NULL)) AS problem FROM gold),
  met AS (SELECT id, CASE WHEN chunks IS NULL THEN 'no such article' WHEN chunks > 4 THEN 'article is spread' END AS problem FROM gold LEFT JOIN idx ON idx.doc_id = (c % 40)::VARCHAR AND key = 'part' || (k % 9) WHERE has_articles AND k % 11 <> 0)
  SELECT id, problem, CASE WHEN problem IN ('free form without judge', 'no spans', 'article is spread') THEN 'warning' ELSE 'error' END AS severity FROM (FROM own UNION ALL FROM met) WHERE problem IS NOT NULL""")
def gold_validation(spark, d):
    chunks = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 40).cast("string").alias("doc_id"), F.concat(F.lit("part"), (F.col("l_partkey") % 7).cast("string")).alias("article")).agg(F.count("*").alias("chunks"))
    return gold_problems(gold_of_orders(spark, d), chunks)


@query("agg29_gold_composition", f"""
  WITH {_GOLD} SELECT facet, value, count(*)::BIGINT AS n FROM (SELECT 'prefix' AS facet, prefix AS value FROM gold UNION ALL SELECT 'answer_type', kind FROM gold UNION ALL SELECT 'normalize', normalize FROM gold UNION ALL SELECT 'judge', CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END FROM gold) GROUP BY 1, 2""")
def gold_composition(spark, d):
    """How many records there are of each kind, all facets in one pass."""
    gold = gold_of_orders(spark, d)
    facets = {"prefix": F.regexp_extract("id", r"^([A-Z]+)", 1), "answer_type": F.col("answer_type"), "normalize": F.col("normalize"), "judge": F.col("judge").cast("string")}
    each = gold.select(F.inline(F.array(*[F.struct(F.lit(name).alias("facet"), value.alias("value")) for name, value in facets.items()])))
    return each.groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("joi17_oracle_context", """
  WITH gold AS (SELECT DISTINCT c_custkey AS query_id, (c_nationkey % 9) AS doc_id, c_custkey % 5 AS article FROM customer),
  chunks AS (SELECT p_partkey AS chunk_id, p_partkey % 9 AS doc_id, p_size % 50 AS article FROM part),
  g AS (SELECT query_id, chunk_id FROM gold JOIN chunks USING (doc_id, article)), n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
  hits AS (SELECT o_custkey AS query_id, 1 + o_orderkey % (SELECT count(*) FROM part) AS chunk_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
  o AS (SELECT h.query_id, h.chunk_id, row_number() OVER (PARTITION BY h.query_id ORDER BY rank, h.chunk_id) AS pos FROM hits h JOIN chunks c USING (chunk_id) WHERE NOT EXISTS (SELECT 1 FROM gold WHERE gold.query_id = h.query_id AND gold.doc_id = c.doc_id AND gold.article = c.article)),
  u AS (SELECT query_id, chunk_id, 'gold' AS role, chunk_id AS x FROM g UNION ALL SELECT query_id, chunk_id, 'distractor', pos FROM o JOIN n USING (query_id) WHERE pos <= 12 - n)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY role <> 'gold', x)::INTEGER AS place, chunk_id, role FROM u""")
def oracle_contexts(spark, d):
    customers, parts, orders = (table(spark, d, t) for t in ("customer", "part", "orders"))
    gold = customers.select(F.col("c_custkey").alias("query_id"), (F.col("c_nationkey") % 9).cast("bigint").alias("doc_id"), (F.col("c_custkey") % 5).cast("string").alias("article"))
    chunks = parts.select(F.col("p_partkey").alias("chunk_id"), (F.col("p_partkey") % 9).alias("doc_id"), F.concat(F.lit(" "), (F.col("p_size") % 50).cast("string")).alias("article"))
    ranked = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    hits = orders.crossJoin(parts.agg(F.count("*").alias("n")))  # one row
    return oracle_context(gold, chunks, hits.select(F.col("o_custkey").alias("query_id"), (1 + F.col("o_orderkey") % F.col("n")).alias("chunk_id"), ranked.alias("rank")))


@query("scr3_failure_heuristic", r"""
  WITH q AS (SELECT o_orderkey AS k, o_orderkey % 4 = 0 AS answered, ['text', 'unknown', 'date', 'number'][1 + o_custkey % 4] AS normalize, ['date', 'table', 'text'][1 + o_orderkey % 3] AS type, ['cell_value', 'other'][1 + o_custkey % 2] AS subtype,
      CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE ['key' || (o_orderkey % 3)] END AS keywords, 'art' || (o_orderkey % 7) AS article, CASE WHEN o_custkey % 3 = 0 THEN '2020. 1. 2.' ELSE 'none' END AS prediction,
      concat(CASE WHEN o_custkey % 5 = 0 THEN '<표> ' ELSE '' END, CASE WHEN o_orderkey % 6 = 0 THEN '별표 ' ELSE '' END, 'key', o_custkey % 3, ' ', CASE WHEN o_custkey % 7 < 3 THEN 'art' || (o_custkey % 7) ELSE '' END, CASE WHEN o_custkey % 11 = 0 THEN ' 2019-03-04' ELSE '' END) AS joined,
      o_custkey % 6 <> 0 AS source_found FROM orders),
  x AS (SELECT *, contains(joined, '<표>') AS ph, source_found AND (CASE WHEN len(keywords) > 0 THEN contains(joined, keywords[1]) ELSE source_found END) AS got FROM q)
  SELECT k, CASE WHEN answered THEN NULL WHEN normalize = 'unknown' THEN CASE WHEN ph OR contains(joined, '별표') THEN 'generation_failure' ELSE 'extraction_failure' END
    WHEN type = 'table' AND subtype = 'cell_value' AND ph AND NOT regexp_matches(joined, '[0-9]') THEN 'extraction_failure' WHEN NOT got THEN 'retrieval_failure'
    WHEN type = 'date' AND contains(joined, '2019-03-04') AND prediction = 'none' THEN 'generation_failure' WHEN contains(joined, article) THEN 'generation_failure' ELSE 'chunking_failure' END AS blame FROM x""")
def failure_heuristic(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    expected = {
        "normalize": _pick(["text", "unknown", "date", "number"], c), "type": _pick(["date", "table", "text"], k), "subtype": _pick(["cell_value", "other"], c),
        "keywords": F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("key"), (k % 3).cast("string")))), "article": F.concat(F.lit("art"), (k % 7).cast("string")),
    }
    joined = F.concat(
        F.when(c % 5 == 0, "<표> ").otherwise(""), F.when(k % 6 == 0, "별표 ").otherwise(""), F.lit("key"), (c % 3).cast("string"), F.lit(" "), F.when(c % 7 < 3, F.concat(F.lit("art"), (c % 7).cast("string"))).otherwise(""), F.when(c % 11 == 0, " 2019-03-04").otherwise(""),
    )
    asked = table(spark, d, "orders").select(k.alias("k"), (k % 4 == 0).alias("answered"), *[v.alias(n) for n, v in expected.items()], joined.alias("joined"), (c % 6 != 0).alias("found"), F.when(c % 3 == 0, "2020. 1. 2.").otherwise("none").alias("prediction"))
    return asked.select("k", failure_blame(F.col("answered"), {n: F.col(n) for n in expected}, F.col("joined"), F.col("found"), F.col("prediction")).alias("blame"))


@query("scr6_judged_scores", r"""
  WITH q AS (SELECT o_orderkey AS k, ['exact', 'list_all', 'list_any', 'conditional', 'abstain'][1 + o_orderkey % 5] AS kind, o_custkey % 3 = 0 AS base, lower(o_orderpriority || ' ' || o_orderstatus || ' ' || (o_custkey % 10)) AS said,
      CASE WHEN o_custkey % 13 = 0 THEN ['high·x'] ELSE [] END AS forbidden, [['correct'], ['partial'], ['hallucination'], ['wrong'], [NULL]][1 + o_custkey % 5][1] AS verdict, o_orderpriority AS p FROM orders),
  f AS (SELECT *, (CASE WHEN contains(p, 'URGENT') OR contains(p, 'LOW') THEN 1 ELSE 0 END + CASE WHEN contains(p, 'MEDIUM') THEN 1 ELSE 0 END) AS n_found FROM q),
  r AS (SELECT *, CASE WHEN kind = 'list_all' THEN n_found = 2 ELSE base END AS ok, CASE WHEN kind = 'list_all' THEN n_found / 2 ELSE CASE WHEN base THEN 1.0 ELSE 0.0 END END AS part, len(forbidden) > 0 AND contains(p, 'HIGH') AS bad FROM f)
  SELECT k, NOT bad AND (ok OR coalesce(verdict = 'correct', false)) AS correct, CASE WHEN bad THEN 0 WHEN ok OR verdict IS NULL THEN part WHEN verdict = 'correct' THEN 1 WHEN verdict = 'partial' THEN greatest(part, 0.5) WHEN verdict = 'hallucination' THEN 0 ELSE part END::DOUBLE AS partial,
    CASE WHEN bad THEN 'forbidden_fact' WHEN NOT ok AND verdict IS NOT NULL THEN 'judge_' || verdict WHEN kind = 'list_all' THEN CASE WHEN ok THEN 'all_facts' ELSE 'missing_facts' END WHEN kind = 'conditional' AND NOT ok THEN 'needs_judge' WHEN ok THEN 'match' ELSE 'mismatch' END AS reason FROM r""")
def judged_scores(spark, d):
    """Answers by their logical form: forbidden and required facts, abstaining, conditions, and a judge's word on what is not right."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    verdict = F.when(c % 5 != 4, _pick(["correct", "partial", "hallucination", "wrong", ""], c))
    required, none = F.array(F.lit("Urgent/low"), F.lit("'medium'")), F.array().cast("array<string>")
    rows = table(spark, d, "orders").select(k.alias("k"), _pick(ANSWER_TYPES, k).alias("kind"), (c % 3 == 0).alias("base"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus", (c % 10).cast("string")).alias("said"), F.when(c % 13 == 0, F.array(F.lit("high·x"))).otherwise(none).alias("forbidden"), verdict.alias("verdict"))
    return rows.select("k", judged_score(F.col("kind"), F.col("base"), F.col("said"), required, F.col("forbidden"), F.lit(False), F.col("verdict")).alias("s")).select("k", "s.*")


@query("scr12_judge_batches", """
  WITH w AS (SELECT DISTINCT sha256(lang || chr(31) || text) AS key FROM documents), c AS (SELECT DISTINCT sha256(lang || chr(31) || text) AS key FROM documents WHERE doc_id % 3 = 0),
  t AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS n FROM w WHERE key NOT IN (SELECT key FROM c)) SELECT key, (n // 15)::INTEGER AS batch, (n % 15)::INTEGER AS place FROM t""")
def judge_batches_query(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("\x1f", "lang", "text"), 256).alias("key"))
    return judge_batches(docs, docs.filter("doc_id % 3 = 0"))


@query("sup17_live_evaluation", """
  WITH q AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey END AS gold_doc FROM customer), live AS (SELECT DISTINCT s_nationkey AS doc_id FROM supplier WHERE s_acctbal > 8000),
  hits AS (SELECT o_custkey AS query_id, o_orderkey % 25 AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderkey % 25 IN (SELECT doc_id FROM live)),
  h AS (SELECT q.query_id, min(rank) FILTER (hits.doc_id = q.gold_doc) AS first FROM q LEFT JOIN hits ON hits.query_id = q.query_id AND rank <= 12 GROUP BY 1)
  SELECT query_id, gold_doc IS NULL OR gold_doc IN (SELECT doc_id FROM live) AS indexed, CASE WHEN gold_doc IS NULL THEN 'none' WHEN first IS NULL THEN 'miss' ELSE 'hit' END AS recall, coalesce(first, 0)::INTEGER AS first_rank,
    CASE WHEN gold_doc IS NULL THEN 'control' WHEN gold_doc NOT IN (SELECT doc_id FROM live) THEN 'not_indexed' WHEN first IS NULL THEN 'retrieval_miss' ELSE 'retrieved' END AS stage FROM q JOIN h USING (query_id)""")
def live_evaluation(spark, d):
    """What an evaluation run over a live index notes of each question: whether its gold document is indexed at all (questions
    without one are controls and count as indexed), whether and where it is found, and the stage that this leaves it in."""
    gold = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_nationkey")).cast("bigint").alias("gold_doc"))
    live = table(spark, d, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").cast("bigint").alias("doc_id")).distinct()
    ranked = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 25).alias("doc_id"), "o_totalprice", "o_orderkey", "o_custkey").join(live, "doc_id", "left_semi").select("query_id", "doc_id", ranked.alias("rank")).filter("rank <= 12")
    coverage = live.select(F.col("doc_id").alias("gold_doc"), F.lit(True).alias("known"))
    first = hits.join(gold, (hits["query_id"] == gold["query_id"]) & (F.col("doc_id") == F.col("gold_doc"))).groupBy(gold["query_id"]).agg(F.min("rank").alias("first_rank"))
    rows = gold.join(first, "query_id", "left").join(coverage, "gold_doc", "left")
    indexed = F.col("gold_doc").isNull() | F.col("known").isNotNull()
    stage = F.when(F.col("gold_doc").isNull(), "control").when(~indexed, "not_indexed").when(F.col("first_rank").isNull(), "retrieval_miss").otherwise("retrieved")
    return rows.select("query_id", indexed.alias("indexed"), F.when(F.col("gold_doc").isNull(), "none").when(F.col("first_rank").isNull(), "miss").otherwise("hit").alias("recall"), F.coalesce("first_rank", F.lit(0)).alias("first_rank"), stage.alias("stage"))


def article_hits(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, articles, found, first_rank): how many of a question's gold articles (query_id, doc_id, article) are among its hits
    (query_id, doc_id, article, rank), and the best rank of any; 0 if none is. Articles are compared composed and trimmed."""
    from quillmill.functions.text import nfc

    key = lambda f: f.withColumn("key", F.trim(nfc("article"))).drop("article")
    wanted = key(gold).distinct()
    met = wanted.join(key(hits), ["query_id", "doc_id", "key"]).groupBy("query_id", "doc_id", "key").agg(F.min("rank").alias("rank"))
    found = met.groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first_rank"))
    counts = wanted.groupBy("query_id").agg(F.count("*").alias("articles")).join(found, "query_id", "left")
    return counts.select("query_id", "articles", F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), F.coalesce("first_rank", F.lit(0)).alias("first_rank"))


@query("joi16_article_hits", """
  WITH g AS (SELECT DISTINCT c_custkey AS query_id, (c_nationkey + i) % 9 AS doc_id, (c_custkey + i) % 5 AS article FROM (SELECT *, unnest(range(0, 3)) AS i FROM customer)),
  h AS (SELECT o_custkey AS query_id, o_orderkey % 9 AS doc_id, floor(o_totalprice)::BIGINT % 5 AS article, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
  m AS (SELECT query_id, doc_id, article, min(rank) AS rank FROM g JOIN h USING (query_id, doc_id, article) WHERE rank <= 12 GROUP BY 1, 2, 3)
  SELECT query_id, count(*)::BIGINT AS articles, count(rank)::BIGINT AS found, coalesce(min(rank), 0)::INTEGER AS first_rank FROM g LEFT JOIN m USING (query_id, doc_id, article) GROUP BY query_id""")
def article_hits_query(spark, d):
    """Three gold articles a question; the hits' articles are spelled with marks apart and blanks around."""
    spelled = lambda n, apart: F.concat(F.lit(" e\u0301t" if apart else "\u00e9t"), n.cast("string"), F.lit(" " if apart else ""))
    c = table(spark, d, "customer").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    gold = c.select(F.col("c_custkey").alias("query_id"), ((F.col("c_nationkey") + F.col("i")) % 9).cast("bigint").alias("doc_id"), spelled((F.col("c_custkey") + F.col("i")) % 5, False).alias("article"))
    ranked = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 9).alias("doc_id"), spelled(F.floor("o_totalprice") % 5, True).alias("article"), ranked.alias("rank")).filter("rank <= 12")
    return article_hits(gold, hits)
