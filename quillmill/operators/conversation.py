"""Conversations: history and evidence budgets, routing, sessions and what a turn leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.language import INTENTS, parse_intent, parse_language, resolve_language
from quillmill.functions.text import has_any, truncated
from quillmill.operators.textual import pick, sql_pick
from quillmill.registry import query
from quillmill.sources.tables import table

# Fixed values: words that lean on what was said before, Korean ones anywhere, English ones as words; and the length up to
# which an utterance counts as leaning in any case.
KOREAN_ANAPHORA = [
    "그거", "그것", "그건", "그걸", "그런", "그중", "그 중", "그때", "그 때",
    "그럼", "그러면", "그리고", "그다음", "그 다음", "거기", "저거", "저것",
    "이거", "이것", "이건", "위에서", "앞에서", "방금", "아까", "해당", "말한",
]  # fmt: skip
ENGLISH_ANAPHORA = [
    "it", "its", "that", "this", "these", "those", "there", "then", "they",
    "them", "he", "she", "same", "above", "previous", "instead",
    "what about", "how about", "and the", "what if",
]  # fmt: skip
SHORT = 15


def needs_condense(text: Column) -> Column:
    """Whether an utterance leans on the turns before it."""
    said = F.trim(F.coalesce(text, F.lit("")))
    return (said != "") & ((F.length(said) <= SHORT) | has_any(said, KOREAN_ANAPHORA) | said.rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(ENGLISH_ANAPHORA)})([^\p{{L}}\p{{N}}_]|$)"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation, system messages left out, in order."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.filter("role <> 'system'").withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n)


def budgeted_history(messages: DataFrame, budget: int) -> DataFrame:
    """The newest messages within `budget` characters; the one at the boundary is cut to what is left."""
    talk = messages.filter(F.col("role").isin("user", "assistant") & (F.length("text") > 0)).withColumn("text", F.trim("text"))
    newer = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    left = budget - F.coalesce(F.sum(F.length("text")).over(newer), F.lit(0))
    return talk.withColumn("left", left).filter("left > 0").withColumn("text", F.when(F.length("text") > F.col("left"), F.substring("text", F.lit(1), F.col("left").cast("int"))).otherwise(F.col("text")))


def evidence_budget(hits: DataFrame, budget: int) -> DataFrame:
    """The first blocks of each question within `budget` characters: the first in any case, none after the first that
    doesn't fit. `dropped` counts what was left out."""
    order = Window.partitionBy("query_id").orderBy("rank")
    upto = hits.withColumn("sum", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = upto.withColumn("fits", (F.col("rank") == 1) | (F.col("sum") <= budget))
    kept = fits.withColumn("kept", F.min(F.col("fits").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return kept.withColumn("dropped", F.count_if(~F.col("kept")).over(Window.partitionBy("query_id")))


def route(intent: Column, has_attachment: Column, failed: Column) -> Column:
    """The next step for an intent; feelings come first, then what must not be searched, then attachments."""
    return (
        F.when(intent == "emotion", "generate").when(intent == "abuse", "handle_abuse").when(intent == "personal", "handle_personal").when(has_attachment, "generate")
        .when(intent == "document", "handle_attachment_required").when(intent == "small_talk", "generate").when(intent.isin("academic", "career"), "retrieve")
        .when(failed, "retrieve").otherwise("handle_ambiguous")
    )  # fmt: skip


def route_after_retrieval(found: Column, intent: Column) -> Column:
    return F.when(found | (intent == "career"), "generate").otherwise("handle_fallback")


def unanswered_reason(found: Column, failed: Column, loose: Column) -> Column:
    return F.when(found, F.lit(None).cast("string")).when(failed, "MODEL_ERROR").when(loose, "LOW_SCORE").otherwise("NO_RESULT")


_ANAPHORA = "|".join(ENGLISH_ANAPHORA)


@query("cnv1_condense_prefilter", f"""
  SELECT conv_id, turn, length(trim(text)) > 0 AND (length(trim(text)) <= 15 OR regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({_ANAPHORA})([^\\p{{L}}\\p{{N}}_]|$)')) AS leans
  FROM conversations WHERE role = 'user'""")
def condense(spark, d):
    said = table(spark, d, "conversations").filter("role = 'user'")
    return said.select("conv_id", "turn", needs_condense(F.col("text")).alias("leans"))


@query("win6_last_messages", """
  SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system') WHERE back <= 3""")
def last_messages_query(spark, d):
    return last_messages(table(spark, d, "conversations"), 3).select("conv_id", "turn", "role")


@query("win5_history_budget", """
  WITH m AS (SELECT conv_id, turn, trim(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 0),
    b AS (SELECT *, 800 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM m)
  SELECT conv_id, turn, least(length(text), rest)::BIGINT AS size FROM b WHERE rest > 0""")
def history_budget(spark, d):
    return budgeted_history(table(spark, d, "conversations"), 800).select("conv_id", "turn", F.length("text").cast("bigint").alias("size"))


@query("win4_cnv4_evidence_budget", """
  WITH h AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, length(text) AS n FROM conversations),
    s AS (SELECT *, rank = 1 OR sum(n) OVER (PARTITION BY query_id ORDER BY rank) <= 900 AS fits FROM h), k AS (SELECT *, bool_and(fits) OVER (PARTITION BY query_id ORDER BY rank) AS kept FROM s)
  SELECT query_id, count(*) FILTER (kept)::BIGINT AS kept, count(*) FILTER (NOT kept)::BIGINT AS dropped FROM k GROUP BY 1""")
def evidence(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"), F.col("text").alias("block"))
    return evidence_budget(turns, 900).groupBy("query_id").agg(F.count_if("kept").alias("kept"), F.max("dropped").alias("dropped"))


@query("cnv6_unanswered_reasons", """
  SELECT CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_type = 'error' THEN 'MODEL_ERROR' WHEN value > 20 THEN 'LOW_SCORE' ELSE 'NO_RESULT' END AS reason, count(*)::BIGINT AS n FROM events GROUP BY 1""")
def reasons(spark, d):
    reason = unanswered_reason(F.col("event_id") % 4 == 0, F.col("event_type") == "error", F.col("value") > 20)
    return table(spark, d, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_ANSWERS = ["ACADEMIC", " small_talk ", "I think: career", "?", "the intent is personal or document", "unknown", "Emotion!", "abuse"]
_TAILS = ["", " | jp", "|ko", " | `en`.", "|vi\nmore | zh", " | ZH | ko"]
_SESSIONS = ["ko", "auto", "en"]


@query("lng2_lng3_labels", f"""
  WITH x AS (SELECT event_id, {sql_pick(_ANSWERS, 'event_id')} AS a, {sql_pick(_TAILS, 'event_id // 8')} AS b, {sql_pick(_SESSIONS, 'event_id // 5')} AS session, CASE WHEN event_id % 7 < 3 THEN {sql_pick(['auto', 'vi'], 'event_id')} END AS asked FROM events),
  y AS (SELECT *, lower(trim(a || b)) AS low, trim(split_part(split_part(lower(a || b), chr(10), 1), '|', 2) || CASE WHEN contains(b, 'ZH |') THEN '| ko' ELSE '' END, ' .`"''') AS named FROM x)
  SELECT event_id, CASE WHEN low IN ({", ".join(repr(i) for i in INTENTS)}) THEN low {" ".join(f"WHEN contains(low, {i!r}) THEN {i!r}" for i in sorted(INTENTS, key=lambda x: (-len(x), [-ord(c) for c in x])))} ELSE 'unknown' END AS intent,
    coalesce(CASE WHEN named IN ('ko', 'en', 'zh', 'vi') THEN named END, '') AS language, coalesce(CASE WHEN asked IS NOT NULL AND asked <> 'auto' THEN asked WHEN asked IS NULL AND session <> 'auto' THEN session END, '') AS resolved FROM y""")
def labels(spark, d):
    """Model answers in many spellings, and the language that a session asks for."""
    k = F.col("event_id")
    answer = F.concat(pick(_ANSWERS, k), pick(_TAILS, F.floor(k / 8)))
    requested, session = F.when(k % 7 < 3, pick(["auto", "vi"], k)), pick(_SESSIONS, F.floor(k / 5))
    empty = lambda c: F.coalesce(c, F.lit(""))  # noqa: E731
    return table(spark, d, "events").select("event_id", parse_intent(answer).alias("intent"), empty(parse_language(answer)).alias("language"), empty(resolve_language(requested, session)).alias("resolved"))


def regulation_label(file_name: Column, article: Column) -> Column:
    """The file's name without its ending, and the article if there is one."""
    title = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.when(F.coalesce(article, F.lit("")) != "", F.trim(F.concat_ws(" ", title, article))).otherwise(title)


def source_payload(answers: DataFrame, regulations: DataFrame) -> DataFrame:
    """(query_id, sources): what an answer rests on, stored answers first and regulations after them, each side by rank.
    answers: (query_id, rank, id, question, category, url, score), regulations: (query_id, rank, id, doc_id, article, section, file_name, score)."""
    none = F.lit(None).cast("string")
    shown = F.round(F.col("score") * 10_000) / 10_000  # by the binary value, as SQL does; F.round(score, 4) goes by the shortest decimal, 0.06545 to 0.0655
    entry = lambda kind, label, category, url, doc, article, section: F.struct(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), label.alias("label"), category.alias("category"), url.alias("url"), doc.alias("doc_id"), article.alias("article"), section.alias("section"), shown.alias("score"))  # noqa: E731
    first = answers.select("query_id", F.lit(0).alias("side"), "rank", entry("faq", F.col("question"), F.col("category"), F.col("url"), none, none, none).alias("source"))
    second = regulations.select("query_id", F.lit(1).alias("side"), "rank", entry("regulation", regulation_label(F.col("file_name"), F.col("article")), none, none, F.col("doc_id"), F.col("article"), F.col("section")).alias("source"))
    grouped = first.unionByName(second).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("side", "rank", "source"))).alias("all"))  # as many as a search returns
    return grouped.select("query_id", F.transform("all", lambda x: x["source"]).alias("sources"))


@query("cnv5_source_payload", """
  WITH u AS (SELECT o_custkey AS query_id, 0 AS side, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, 'faq' AS kind, o_orderkey::VARCHAR AS id, 'Q ' || o_orderpriority AS label, round(o_totalprice / 1e6, 4) AS score FROM orders
    UNION ALL SELECT o_custkey, 1, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey), 'regulation', l_partkey::VARCHAR, (l_partkey % 5) || '-0-1 규정' || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ' 제' || l_linenumber || '조' END, round(l_extendedprice / 1e6, 4) FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
  SELECT query_id, string_agg(kind || ':' || id || ':' || label || ':' || printf('%.4f', score), ';' ORDER BY side, rank) AS sources FROM u WHERE rank <= 3 GROUP BY query_id""")
def sources(spark, d):
    best = lambda f, *order: f.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter("rank <= 3")  # noqa: E731
    orders = table(spark, d, "orders").withColumn("query_id", F.col("o_custkey"))
    answers = best(orders, F.desc("o_totalprice"), "o_orderkey").select("query_id", "rank", F.col("o_orderkey").alias("id"), F.concat(F.lit("Q "), "o_orderpriority").alias("question"), F.col("o_orderstatus").alias("category"), F.lit(None).cast("string").alias("url"), (F.col("o_totalprice") / 1e6).alias("score"))
    lines = table(spark, d, "lineitem").join(orders.select("query_id", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    article = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("제"), F.col("l_linenumber").cast("string"), F.lit("조")))
    regs = best(lines, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").select("query_id", "rank", F.col("l_partkey").alias("id"), F.lit("1-0-1").alias("doc_id"), article.alias("article"), F.lit("article").alias("section"), F.concat((F.col("l_partkey") % 5).cast("string"), F.lit("-0-1 규정.hwp")).alias("file_name"), (F.col("l_extendedprice") / 1e6).alias("score"))
    shown = F.transform("sources", lambda x: F.concat_ws(":", x["kind"], x["id"], x["label"], F.format_string("%.4f", x["score"])))
    return source_payload(answers, regs).select("query_id", F.array_join(shown, ";").alias("sources"))


@query("cnv6_routing", f"""
  WITH x AS (SELECT event_id, lower(trim({sql_pick(_ANSWERS, 'event_id')} || {sql_pick(_TAILS, 'event_id // 8')})) AS low, event_id % 3 = 0 AS att, event_type = 'error' AS bad, value > 10 AS found FROM events),
  i AS (SELECT *, CASE WHEN low IN ({", ".join(repr(i) for i in INTENTS)}) THEN low {" ".join(f"WHEN contains(low, {i!r}) THEN {i!r}" for i in sorted(INTENTS, key=lambda x: (-len(x), [-ord(c) for c in x])))} ELSE 'unknown' END AS intent FROM x),
  r AS (SELECT *, CASE WHEN intent = 'emotion' THEN 'generate' WHEN intent = 'abuse' THEN 'handle_abuse' WHEN intent = 'personal' THEN 'handle_personal' WHEN att THEN 'generate' WHEN intent = 'document' THEN 'handle_attachment_required'
     WHEN intent = 'small_talk' THEN 'generate' WHEN intent IN ('academic', 'career') THEN 'retrieve' WHEN bad THEN 'retrieve' ELSE 'handle_ambiguous' END AS step FROM i)
  SELECT event_id, intent, step, CASE WHEN step <> 'retrieve' THEN step WHEN found OR intent = 'career' THEN 'generate' ELSE 'handle_fallback' END AS then_step FROM r""")
def routing(spark, d):
    """From the model's answer to the steps of a turn: before the search, and after it."""
    k = F.col("event_id")
    intent = parse_intent(F.concat(pick(_ANSWERS, k), pick(_TAILS, F.floor(k / 8))))
    turns = table(spark, d, "events").select("event_id", intent.alias("intent"), (k % 3 == 0).alias("att"), (F.col("event_type") == "error").alias("bad"), (F.col("value") > 10).alias("found"))
    steps = turns.withColumn("step", route(F.col("intent"), F.col("att"), F.col("bad")))
    return steps.select("event_id", "intent", "step", F.when(F.col("step") == "retrieve", route_after_retrieval(F.col("found"), F.col("intent"))).otherwise(F.col("step")).alias("then_step"))


def persisted_turns(turns: DataFrame, rules=None) -> dict[str, DataFrame]:
    """The rows that turns (session, turn, question, answer, intent, searched, n_sources, first_source, reason) leave in the tables
    of messages, searches, unanswered questions and sessions. Texts are masked before they are kept; a search is kept with the
    query that was searched for; a question is answered if there is no reason why not."""
    from quillmill.functions.masking import MASKING_RULES, apply_rules
    from quillmill.functions.text import short_title

    rules = MASKING_RULES if rules is None else rules
    masked = turns.withColumns({c: apply_rules(F.col(c), rules) for c in ("question", "answer", "searched")})
    said = masked.select("session", "turn", F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("boolean").alias("answered")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("reason").isNull().alias("answered")))).alias("m"))
    searches = masked.filter("searched IS NOT NULL").select("session", "turn", F.col("searched").alias("query"), "intent", F.col("n_sources").alias("results"), F.when(F.col("n_sources") > 0, F.col("first_source")).alias("selected"))
    unanswered = masked.filter("reason IS NOT NULL").select("session", "turn", "question", "reason")
    title = F.min_by(short_title(F.col("question")), "turn")
    sessions = masked.groupBy("session").agg((2 * F.count("*")).alias("messages"), title.alias("title"), F.max("turn").alias("last"))
    return {"messages": said.select("session", "turn", "m.*"), "searches": searches, "unanswered": unanswered, "sessions": sessions}


@query("cnv8_turn_persistence", r"""
  WITH t AS (SELECT u.conv_id, u.turn, u.text AS q, coalesce(a.text, '') AS answer, ['academic', 'career', 'unknown'][1 + u.turn % 3] AS intent, u.turn % 4 <> 2 AS searches, u.conv_id % 3 AS n, CASE WHEN a.text IS NULL THEN 'NO_RESULT' WHEN u.turn % 5 = 4 THEN 'LOW_SCORE' END AS reason
    FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'), f AS (SELECT *, trim(regexp_replace(q, '[ 	

]+', ' ', 'g')) AS folded FROM t)
  SELECT 'message' AS kind, conv_id, turn, 'user' AS a, md5(q) AS b FROM t UNION ALL SELECT 'message', conv_id, turn, 'assistant' || CASE WHEN reason IS NULL THEN '' ELSE '?' END, md5(answer) FROM t UNION ALL SELECT 'search', conv_id, turn, intent || n, md5('find ' || q) FROM t WHERE searches
  UNION ALL SELECT 'unanswered', conv_id, turn, reason, md5(q) FROM t WHERE reason IS NOT NULL UNION ALL SELECT 'session', conv_id, 2 * count(*), max(turn)::VARCHAR, arg_min(CASE WHEN length(folded) > 30 THEN substr(folded, 1, 30) || '...' ELSE folded END, turn) FROM f GROUP BY conv_id""")
def turn_persistence(spark, d):
    """All four tables' rows. The conversations hold nothing that the rule used here masks, so that SQL can say what is kept."""
    talk = table(spark, d, "conversations")
    answers = talk.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("found"))
    k = F.col("turn")
    turns = talk.filter("role = 'user'").join(answers, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("session"), "turn", F.col("text").alias("question"), F.coalesce("found", F.lit("")).alias("answer"), pick(["academic", "career", "unknown"], k).alias("intent"),
        F.when(k % 4 != 2, F.concat(F.lit("find "), "text")).alias("searched"), (F.col("conv_id") % 3).alias("n_sources"), F.lit("s1").alias("first_source"), F.when(F.col("found").isNull(), "NO_RESULT").when(k % 5 == 4, "LOW_SCORE").alias("reason"),
    )  # fmt: skip
    kept = persisted_turns(turns, [("resident", r"\d{6}-\d{7}", "full", "******-*******")])
    row = lambda f, kind, turn, a, b: f.select(F.lit(kind).alias("kind"), F.col("session").alias("conv_id"), turn.alias("turn"), a.alias("a"), b.alias("b"))  # noqa: E731
    said = F.concat("role", F.when(F.col("answered") == False, "?").otherwise(""))  # noqa: E712
    rows = row(kept["messages"], "message", k, said, F.md5("content"))
    rows = rows.unionByName(row(kept["searches"], "search", k, F.concat("intent", F.col("results").cast("string")), F.md5("query")))
    rows = rows.unionByName(row(kept["unanswered"], "unanswered", k, F.col("reason"), F.md5("question")))
    return rows.unionByName(row(kept["sessions"], "session", F.col("messages"), F.col("last").cast("string"), F.col("title")))


def attached_content(questions: DataFrame, attachments: DataFrame, limit: int = 8000) -> DataFrame:
    """(query_id, text, images): the user's content of a turn: attached documents' texts, those whose pages come as images named
    as such, then the question, cut at `limit`; a request to explain where only files were sent.
    attachments: (query_id, place, kind, file_name, text, pages as an array of image addresses)."""
    pages = F.coalesce(F.size("pages"), F.lit(0)) > 0
    filled = F.coalesce("text", F.lit("")) != ""
    title = F.concat(F.lit("[첨부 문서: "), "file_name", F.lit("]"))
    block = F.when((F.col("kind") == "document") & filled, F.concat_ws("\n", title, F.col("text"))).when((F.col("kind") == "document") & pages, F.concat(title, F.lit(" (아래 페이지 이미지를 참고하세요)")))
    listed = attachments.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block"), "pages"))).alias("all"))  # a turn's few files
    rows = questions.join(listed, "query_id", "left")
    empty = F.array().cast("array<string>")
    blocks = F.coalesce(F.filter(F.transform("all", lambda x: x["block"]), lambda b: b.isNotNull()), empty)
    images = F.coalesce(F.flatten(F.transform("all", lambda x: F.coalesce(x["pages"], empty))), empty)
    asked = truncated(F.col("question"), limit)
    rows = rows.select("query_id", blocks.alias("blocks"), images.alias("images"), asked.alias("asked"))
    own = F.when(F.col("asked") != "", F.col("asked")).when((F.size("blocks") == 0) & (F.size("images") > 0), "첨부한 파일 내용을 바탕으로 설명해 주세요.")
    return rows.select("query_id", F.concat_ws("\n\n", F.nullif(F.array_join("blocks", "\n\n"), F.lit("")), own).alias("text"), "images")


@query("cnv11_attached_content", """
  WITH f AS (SELECT o_custkey AS query_id, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'image' ELSE 'document' END AS kind, 'f' || o_orderkey || '.pdf' AS name, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS text, o_orderkey % 5 AS pages FROM orders),
  b AS (SELECT query_id, string_agg(CASE WHEN kind = 'document' AND text <> '' THEN '[첨부 문서: ' || name || ']' || chr(10) || text WHEN kind = 'document' AND pages > 0 THEN '[첨부 문서: ' || name || '] (아래 페이지 이미지를 참고하세요)' END, chr(10) || chr(10) ORDER BY o_orderkey) AS blocks, sum(pages)::BIGINT AS images FROM f GROUP BY 1)
  SELECT c_custkey AS query_id, concat_ws(chr(10) || chr(10), blocks, CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN length(c_name) > 12 THEN rtrim(substr(c_name, 1, 12)) || ' …(이하 생략)' ELSE c_name END WHEN blocks IS NULL AND coalesce(images, 0) > 0 THEN '첨부한 파일 내용을 바탕으로 설명해 주세요.' END) AS text, coalesce(images, 0)::BIGINT AS images FROM customer LEFT JOIN b ON query_id = c_custkey""")
def attachments(spark, d):
    k = F.col("o_orderkey")
    pages = F.transform(F.filter(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: i > 0), lambda i: F.concat(F.lit("page"), i.cast("string")))
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), k.alias("place"), F.when(k % 3 == 0, "image").otherwise("document").alias("kind"), F.concat(F.lit("f"), k.cast("string"), F.lit(".pdf")).alias("file_name"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("text"), pages.alias("pages"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("question"))
    return attached_content(asked, files, 12).select("query_id", "text", F.size("images").cast("bigint").alias("images"))


#: This engine's own wording of what an answering model is told: for all turns, and by intent.
RULES = ["Answer in {language}.", "State as facts only what the evidence says.", "Name the sources used.", "Say so if the evidence is not enough."]
INTENT_RULES = {"emotion": "Acknowledge the feeling before anything else.", "small_talk": "Be brief and friendly.", "career": "General advice is allowed; particulars need evidence.", "document": "Attached files come first as evidence."}
NO_EVIDENCE = "(none)"


def system_prompt(language: Column, intent: Column, attached: Column, summary: Column, evidence: Column, contact: str = "") -> Column:
    """The rules, numbered in order, those of the intent and of attachments after the general ones; a contact, the summary of the
    conversation and the evidence blocks in sections of their own."""
    some = lambda c: F.filter(c, lambda x: x.isNotNull())  # noqa: E731
    own = [F.when(intent == i, rule) for i, rule in INTENT_RULES.items() if i != "document"] + [F.when((intent == "document") | attached, INTENT_RULES["document"])]
    rules = some(F.array(*[F.replace(F.lit(r), F.lit("{language}"), language) for r in RULES], *own))
    numbered = F.transform(rules, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r))
    section = lambda name, body: F.concat(F.lit(f"\n[{name}]\n"), body)  # noqa: E731
    parts = [F.lit("[Rules]"), F.array_join(numbered, "\n"), section("Contact", F.lit(contact)) if contact else None, F.when(F.coalesce(summary, F.lit("")) != "", section("Summary", F.trim(summary))), section("Evidence", F.when(F.size(evidence) > 0, F.array_join(evidence, "\n")).otherwise(NO_EVIDENCE))]
    return F.concat_ws("\n", *[p for p in parts if p is not None])


_RULE_SQL = "".join(f"CASE WHEN intent = '{i}' THEN '{r}' END, " for i, r in INTENT_RULES.items() if i != "document") + f"CASE WHEN intent = 'document' OR att THEN '{INTENT_RULES['document']}' END"


@query("sup24_system_prompt", f"""
  WITH t AS (SELECT conv_id, ['ko', 'en', 'vi'][1 + conv_id % 3] AS lang, {sql_pick(INTENTS, 'conv_id')} AS intent, conv_id % 4 = 0 AS att, min(CASE WHEN turn = 0 THEN text END) AS summary, coalesce(list(substr(text, 1, 60) ORDER BY turn) FILTER (role = 'assistant'), []) AS evidence FROM conversations GROUP BY conv_id),
  r AS (SELECT *, list_filter(['Answer in ' || lang || '.', '{RULES[1]}', '{RULES[2]}', '{RULES[3]}', {_RULE_SQL}], lambda x: x IS NOT NULL) AS rules FROM t)
  SELECT conv_id, md5('[Rules]' || chr(10) || array_to_string(list_transform(rules, lambda x, i: i || '. ' || x), chr(10)) || chr(10) || chr(10) || '[Contact]' || chr(10) || '000' || CASE WHEN conv_id % 2 = 0 AND coalesce(summary, '') <> '' THEN chr(10) || chr(10) || '[Summary]' || chr(10) || trim(summary) ELSE '' END
    || chr(10) || chr(10) || '[Evidence]' || chr(10) || CASE WHEN len(evidence) > 0 THEN array_to_string(evidence, chr(10)) ELSE '(none)' END) AS prompt FROM r""")
def prompts(spark, d):
    k = F.col("conv_id")
    talk = table(spark, d, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("summary"), F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.substring("text", 1, 60).alias("t"))))).alias("said"))
    prompt = system_prompt(pick(["ko", "en", "vi"], k), pick(INTENTS, k), k % 4 == 0, F.when(k % 2 == 0, F.col("summary")), F.transform("said", lambda x: x["t"]), "000")
    return talk.select("conv_id", F.md5(prompt).alias("prompt"))
