"""Rollups of usage, conversations, ratings and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.keywords import keyword, tokens_of
from quillmill.functions.money import percent_change
from quillmill.registry import query
from quillmill.sources.tables import table


def usage(spark, d: str) -> DataFrame:
    """The event log as a model usage log: an event type is a model, errors are failed calls, `k` holds the tokens."""
    events = table(spark, d, "events")
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    return events.select(
        "event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM").alias("month"), "user_id",
        F.col("event_type").alias("model"), (F.col("event_type") != "error").alias("ok"), tokens.alias("tokens"), "value",
    )


_USAGE = """(SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, user_id, event_type AS model,
  event_type <> 'error' AS ok, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS tokens, value FROM events)"""

_PRICES = [("click", 2.0), ("view", 0.5), ("purchase", 8.0), ("error", 1.0)]
_PRICES_SQL = "(VALUES ('click', 2.0::DOUBLE), ('view', 0.5), ('purchase', 8.0), ('error', 1.0)) AS p(model, price)"


def costed(spark, d: str) -> DataFrame:
    """Usage with its cost at current prices; a model without a price costs nothing. The price table has a few constant rows."""
    prices = spark.createDataFrame(_PRICES, "model string, price double")
    return usage(spark, d).join(F.broadcast(prices), "model", "left").withColumn("cost", F.col("tokens") * F.coalesce("price", F.lit(0.0)) / 1e6)


_COSTED = f"(SELECT u.*, u.tokens * coalesce(p.price, 0) / 1e6 AS cost FROM {_USAGE} u LEFT JOIN {_PRICES_SQL} ON u.model = p.model)"


@query("agg1_jsn1_usage_rollup", f"""
  SELECT day, model, count(*)::BIGINT AS calls, count(*) FILTER (ok)::BIGINT AS successes, count(*) FILTER (NOT ok)::BIGINT AS failures,
         sum(tokens)::BIGINT AS tokens FROM {_USAGE} GROUP BY day, model""")
def usage_rollup(spark, d):
    return usage(spark, d).groupBy("day", "model").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.sum("tokens").alias("tokens")
    )


@query("agg2_mth1_joi5_cost_grouping_sets", f"""
  SELECT coalesce(day, '*') AS day, coalesce(model, '*') AS model, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost
  FROM {_COSTED} GROUP BY GROUPING SETS ((day), (model), ())""")
def cost_overview(spark, d):
    sets = costed(spark, d).groupingSets([["day"], ["model"], []], "day", "model")
    out = sets.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))
    return out.select(F.coalesce("day", F.lit("*")).alias("day"), F.coalesce("model", F.lit("*")).alias("model"), "calls", "tokens", "cost")


@query("agg3_mth2_month_over_month", f"""
  WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1),
       p AS (SELECT *, lag(n) OVER (ORDER BY month) AS n0, lag(v) OVER (ORDER BY month) AS v0 FROM m)
  SELECT month, n, round(v, 2) AS value, CASE WHEN coalesce(n0, 0) = 0 THEN 0.0 ELSE round((n - n0) / n0 * 100, 2) END AS n_change FROM p""")
def month_over_month(spark, d):
    months = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    before = Window.orderBy("month")  # a row for each month
    return months.withColumn("n0", F.lag("n").over(before)).select("month", "n", F.round("v", 2).alias("value"), percent_change(F.col("n"), F.col("n0")).alias("n_change"))


@query("agg4_top1_user_cost_top20", f"""
  SELECT user_id, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost FROM {_COSTED}
  GROUP BY user_id ORDER BY round(sum(cost), 6) DESC, user_id LIMIT 20""")
def user_cost(spark, d):
    users = costed(spark, d).groupBy("user_id").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))
    return users.orderBy(F.desc("cost"), "user_id").limit(20)


@query("agg5_agg16_agg20_active_counts", """
  SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0)::BIGINT AS active, (SELECT count(*) FROM embeddings)::BIGINT AS points,
         (SELECT count(DISTINCT c_mktsegment) FROM customer)::BIGINT AS groups""")
def active_counts(spark, d):
    customers = table(spark, d, "customer").agg(F.count_if(F.col("c_acctbal") > 0).alias("active"), F.countDistinct("c_mktsegment").alias("groups"))
    return customers.crossJoin(table(spark, d, "embeddings").agg(F.count("*").alias("points"))).select("active", "points", "groups")  # one row each


@query("agg6_flt12_chatbot_stats", """
  SELECT count(*) FILTER (event_type = 'click')::BIGINT AS questions, round(avg(value) FILTER (event_type = 'view' AND value > 0), 6) AS latency,
         count(DISTINCT user_id)::BIGINT AS users, count(*) FILTER (event_type = 'error')::BIGINT AS unanswered
  FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'""")
def chatbot_stats(spark, d):
    """Over the closed period 5 to 20 January, written as a half-open one."""
    period = table(spark, d, "events").filter((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-21").cast("timestamp")))
    return period.agg(
        F.count_if(F.col("event_type") == "click").alias("questions"),
        F.round(F.avg(F.when((F.col("event_type") == "view") & (F.col("value") > 0), F.col("value"))), 6).alias("latency"),
        F.countDistinct("user_id").alias("users"),
        F.count_if(F.col("event_type") == "error").alias("unanswered"),
    )


@query("agg7_joi7_daily_trend", """
  WITH q AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1),
       u AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
  SELECT coalesce(q.day, u.day) AS day, coalesce(q.n, 0)::BIGINT AS questions, coalesce(u.n, 0)::BIGINT AS unanswered FROM q FULL JOIN u ON q.day = u.day""")
def daily_trend(spark, d):
    events = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    daily = lambda kind, name: events.filter(F.col("event_type") == kind).groupBy("day").agg(F.count("*").alias(name))
    both = daily("click", "questions").join(daily("error", "unanswered"), "day", "full")
    return both.select("day", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("questions", "unanswered")])


KEYWORD_SQL = r"""
  WITH t AS (SELECT unnest(string_split_regex(lower(text), '[ \t\n\r\x0b\x0c]+')) AS raw FROM conversations WHERE role = 'user'),
       b AS (SELECT regexp_replace(raw, '[^\p{{L}}\p{{N}}]+', '', 'g') AS base FROM t),
       k AS (SELECT CASE WHEN length(base) >= 3 THEN regexp_replace(base, '({particles})$', '') ELSE base END AS keyword FROM b)
  SELECT keyword, count(*)::BIGINT AS n FROM k WHERE length(keyword) > 1 AND keyword NOT IN ({stop}) GROUP BY keyword ORDER BY n DESC, keyword LIMIT 20"""


def _keyword_sql() -> str:
    from quillmill.functions.keywords import PARTICLES, STOP_WORDS

    return KEYWORD_SQL.format(particles="|".join(PARTICLES), stop=", ".join(f"'{w}'" for w in STOP_WORDS))


@query("key1_agg8_keyword_frequency", _keyword_sql())
def keyword_frequency(spark, d):
    words = table(spark, d, "conversations").filter("role = 'user'").select(F.explode(tokens_of(F.col("text"))).alias("raw"))
    return words.select(keyword(F.col("raw")).alias("keyword")).filter("keyword is not null").groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(20)


INTENTS = ["view", "click", "purchase", "scroll", "search", "error", "login", "logout"]


@query("agg9_intent_distribution", f"""
  WITH dim AS (SELECT unnest({INTENTS!r}) AS intent, unnest(range({len(INTENTS)})) AS place),
       n AS (SELECT event_type AS intent, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1)
  SELECT dim.intent, coalesce(n.n, 0)::BIGINT AS n, round(coalesce(n.n, 0) / sum(coalesce(n.n, 0)) OVER (), 4) AS ratio FROM dim LEFT JOIN n ON dim.intent = n.intent""")
def intent_distribution(spark, d):
    """Filled with zeros over the fixed list of intents; rows without an intent are not in the denominator."""
    found = table(spark, d, "events").filter("event_type is not null").groupBy(F.col("event_type").alias("intent")).agg(F.count("*").alias("n"))
    dim = spark.createDataFrame([(x,) for x in INTENTS], "intent string")
    joined = dim.join(found, "intent", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    whole = Window.partitionBy(F.lit(1))  # as many rows as there are intents
    return joined.select("intent", "n", F.round(F.col("n") / F.sum("n").over(whole), 4).alias("ratio"))


@query("agg10_rating_histogram", """
  WITH r AS (SELECT 1 + l_linenumber % 5 AS rating FROM lineitem), n AS (SELECT rating, count(*) AS n FROM r GROUP BY 1),
       dim AS (SELECT unnest(range(1, 6)) AS rating)
  SELECT dim.rating::INTEGER AS rating, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / sum(n) OVER (), 4) AS ratio,
         round(sum(dim.rating * coalesce(n, 0)) OVER () / sum(n) OVER (), 4) AS mean FROM dim LEFT JOIN n ON dim.rating = n.rating""")
def rating_histogram(spark, d):
    found = table(spark, d, "lineitem").groupBy((1 + F.col("l_linenumber") % 5).cast("int").alias("rating")).agg(F.count("*").alias("n"))
    dim = spark.sql("SELECT explode(sequence(1, 5)) AS rating")
    whole = Window.partitionBy(F.lit(1))  # five rows
    joined = dim.join(found, "rating", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    return joined.select("rating", "n", F.round(F.col("n") / F.sum("n").over(whole), 4).alias("ratio"), F.round(F.sum(F.col("rating") * F.col("n")).over(whole) / F.sum("n").over(whole), 4).alias("mean"))


@query("agg11_daily_rating", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, round(avg(value), 2) AS mean FROM events GROUP BY 1")
def daily_rating(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("mean"))


@query("agg12_user_activity", "SELECT user_id, count(*)::BIGINT AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_active FROM events GROUP BY user_id")
def user_activity(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_active"))


@query("agg13_documents_per_collection", "SELECT source, count(*)::BIGINT AS n, coalesce(sum(n_chars) FILTER (n_chars > 500), 0)::BIGINT AS chars FROM documents GROUP BY source")
def documents_per_collection(spark, d):
    chars = F.coalesce(F.sum(F.when(F.col("n_chars") > 500, F.col("n_chars"))), F.lit(0)).cast("bigint")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), chars.alias("chars"))


STATUSES = ["O", "F", "P"]


@query("agg14_status_counts", """
  SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS "O", count(*) FILTER (o_orderstatus = 'F')::BIGINT AS "F",
         count(*) FILTER (o_orderstatus = 'P')::BIGINT AS "P", count(*)::BIGINT AS total FROM orders GROUP BY 1""")
def status_counts(spark, d):
    """A pivot over the fixed statuses, filled with zeros, and the total, in one aggregation."""
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


@query("agg15_joi5_category_counts", """
  SELECT n_name AS category, count(c_custkey)::BIGINT AS items, CAST(greatest(1, ceil(count(c_custkey) / 20)) AS BIGINT) AS pages
  FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name""")
def category_counts(spark, d):
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("items"))
    joined = table(spark, d, "nation").join(counts, "n_nationkey", "left").withColumn("items", F.coalesce("items", F.lit(0)).cast("bigint"))
    return joined.select(F.col("n_name").alias("category"), "items", F.greatest(F.lit(1), F.ceil(F.col("items") / 20)).cast("bigint").alias("pages"))


@query("agg21_section_counts", "SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def section_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query("agg22_corpus_defects", """
  WITH n AS (SELECT text, count(*) AS c FROM documents GROUP BY text)
  SELECT count(*)::BIGINT AS docs, count(*) FILTER (length(text) < 40)::BIGINT AS broken, count(*) FILTER (NOT regexp_matches(text, '[0-9]'))::BIGINT AS without_number,
         (SELECT count(*) FROM n WHERE c > 1)::BIGINT AS duplicated, sum(length(text))::BIGINT AS chars FROM documents""")
def corpus_defects(spark, d):
    docs = table(spark, d, "documents").select(F.length("text").alias("size"), (~F.col("text").rlike("[0-9]")).alias("plain"), F.sha2("text", 256).alias("hash"))
    by_text = docs.groupBy("hash").agg(F.count("*").alias("c"), F.sum("size").alias("chars"), F.count_if(F.col("size") < 40).alias("broken"), F.count_if("plain").alias("plain"))
    return by_text.agg(F.sum("c").alias("docs"), F.sum("broken").alias("broken"), F.sum("plain").alias("without_number"), F.count_if(F.col("c") > 1).alias("duplicated"), F.sum("chars").alias("chars"))


@query("agg31_mth_percentiles_load_summary", """
  WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS mean, max(value) AS most FROM events GROUP BY event_type)
  SELECT event_type, n::BIGINT AS n, v[CAST(round_even((n - 1) * 50 / 100.0, 0) AS INTEGER) + 1] AS p50, v[CAST(round_even((n - 1) * 90 / 100.0, 0) AS INTEGER) + 1] AS p90, most, round(mean, 4) AS mean FROM s""")
def load_summary(spark, d):
    """Nearest-rank percentiles: values are counted, so that the running sums that find a rank go over distinct values, in
    ranges of each group, and no group is gathered."""
    return nearest_ranks(table(spark, d, "events").select("event_type", "value"), "event_type", "value", {"p50": 50, "p90": 90}, digits=4)


def nearest_ranks(rows: DataFrame, by: str, value: str, percents: dict[str, int], digits: int = 4, ranges: int = 64) -> DataFrame:
    """n, the nearest-rank percentiles, most and mean of each group. A group's values are dealt into `ranges` of equal width, so
    a very large group is spread over tasks; the ranges' counts say in which of them a rank lies."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    about = rows.groupBy(by).agg(F.count("*").alias("all"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.min(value).alias("least"))
    share = (F.col(value) - F.col("least")) / F.nullif(F.col("most") - F.col("least"), F.lit(0.0))
    placed = counted.join(about.select(by, "n", "most", "least"), by).withColumn("range", F.coalesce(F.least(F.floor(share * ranges), F.lit(ranges - 1)), F.lit(0)).cast("int"))
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # `ranges` rows a group
    offsets = placed.groupBy(by, "range").agg(F.sum("c").alias("c")).select(by, "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(by, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.withColumn("upto", F.sum("c").over(within)).join(offsets, [by, "range"]).withColumn("upto", F.col("upto") + F.col("offset"))
    rank = lambda p: F.bround((F.col("n") - 1) * p / 100.0, 0) + 1
    found = upto.groupBy(by).agg(*[F.min(F.when(F.col("upto") >= rank(p), F.col(value))).alias(name) for name, p in percents.items()])
    return about.join(found, by, "left").select(by, F.col("all").alias("n"), *percents, "most", F.round("mean", digits).alias("mean"))


@query("agg32_outcome_totals", """
  SELECT o_custkey AS job, count(*)::BIGINT AS total, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS failed, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS skipped,
         CASE WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'failed' ELSE 'completed' END AS status FROM orders GROUP BY 1""")
def outcome_totals(spark, d):
    """A job has failed only if all of its items have."""
    failed = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("job")).agg(
        F.count("*").alias("total"), failed.alias("failed"), F.count_if(F.col("o_orderstatus") == "P").alias("skipped"),
        F.when(failed == F.count("*"), "failed").otherwise("completed").alias("status"),
    )


@query("agg33_win10_derived_status", """
  WITH last AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last_status, count(*) FILTER (o_orderstatus = 'F') AS errors FROM orders GROUP BY 1)
  SELECT c_custkey AS source_id, CASE WHEN last_status = 'P' THEN 'running' WHEN last_status = 'F' THEN 'failed' WHEN errors > 0 THEN 'partial' WHEN last_status IS NULL THEN 'none' ELSE 'ready' END AS status
  FROM customer LEFT JOIN last ON c_custkey = o_custkey""")
def derived_status(spark, d):
    """The latest job decides before the documents' own states do."""
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("last"), F.count_if(F.col("o_orderstatus") == "F").alias("errors"))
    joined = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    status = F.when(F.col("last") == "P", "running").when(F.col("last") == "F", "failed").when(F.col("errors") > 0, "partial").when(F.col("last").isNull(), "none").otherwise("ready")
    return joined.select(F.col("c_custkey").alias("source_id"), status.alias("status"))


@query("flt13_flt14_month_filters", """
  SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31 23:59:59')::BIGINT AS closed_month,
         count(*) FILTER (ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01')::BIGINT AS open_month FROM events""")
def month_filters(spark, d):
    """The closed month ends at 23:59:59 and so leaves out fractions of its last second; the half-open one does not."""
    from quillmill.functions.periods import closed_month, half_open_month

    events = table(spark, d, "events")
    return events.agg(F.count_if(closed_month(F.col("ts"), 2024, 1)).alias("closed_month"), F.count_if(half_open_month(F.col("ts"), "2024.01")).alias("open_month"))
