"""Ranked retrieval: dense, lexical and hybrid, for many questions at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.lexical import TOKEN, articles, bigrams, document_ids, tokens
from quillmill.functions.vectors import cosine
from quillmill.operators import inverted_index
from quillmill.plans.checkpoints import bounded, cut
from quillmill.registry import query
from quillmill.sources.tables import table

# Fixed values of the ranking.
K1, B = 1.5, 0.75
DENSE_WEIGHT, LEXICAL_WEIGHT = 0.55, 0.45
DOCUMENT_BOOST, ARTICLE_BOOST, PRIMARY_BOOST = 0.15, 0.10, 0.05
CANDIDATES = 4
#: Titles of a part: what one task matches and counts.
TITLES = 20_000


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k rows of each question with their rank. Ranks are limited before the shuffle (WindowGroupLimit)."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


#: Questions of a block and vectors of a part at most, and bytes of either in double precision: what one task of the dense search holds.
BLOCK, PART, BYTES = 8192, 50_000, 64 << 20


def _nearest(k: int, others_only: bool):
    """Of one part of vectors, those that are among the k best of a question of one block, by a matrix product."""

    def matrix(rows: pa.Table) -> np.ndarray:
        values = np.stack([np.asarray(v.values, np.float64) for v in rows.column("v")])
        return values / np.maximum(np.sqrt((values * values).sum(1, keepdims=True)), 1e-300)

    def best(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        ask, have = rows.filter(pa.array(side == 0)), rows.filter(pa.array(side == 1))
        names, ids, found = ask.column("id").to_numpy(), have.column("id").to_numpy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(names) and len(ids):
            q, v = matrix(ask), matrix(have).T
            for at in range(0, len(names), 64):
                score = q[at : at + 64] @ v
                if others_only:
                    score[names[at : at + 64, None] == ids[None, :]] = -np.inf
                floor = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else -np.inf
                row, column = np.nonzero(score >= floor - 1e-9)  # ties stay, and are ranked by their exact scores later
                found.append((names[at + row], ids[column]))
        return pa.table({"query_id": np.concatenate([f[0] for f in found]), "id": np.concatenate([f[1] for f in found])})

    return best


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, *order: Column, others_only: bool = False) -> DataFrame:
    """The k vectors nearest to each question by cosine, with their other columns, `score` and `rank`.

    Questions (query_id, embedding) are dealt into blocks of about `BLOCK`, vectors (id, embedding, ...) into parts of about
    `PART`, or fewer where vectors are long; each part meets each block once, as a matrix product, and only the k best of a part go on. Scores of these few are
    worked out exactly. `others_only`: a question's own vector doesn't count.
    """
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    fit = max(1, BYTES // (8 * max(width, 1)))
    blocks = max(1, -(-queries.count() // min(BLOCK, fit)))
    parts = max(1, -(-n // min(PART, fit)), min(queries.sparkSession.sparkContext.defaultParallelism, n // 500))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
    asked = queries.select(F.lit(0).alias("side"), dealt("query_id", blocks).alias("block"), every(parts).alias("part"), F.col("query_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    stored = vectors.select(F.lit(1).alias("side"), every(blocks).alias("block"), dealt("id", parts).alias("part"), F.col("id").cast("long").alias("id"), F.col("embedding").alias("v"))
    near = asked.unionByName(stored).groupBy("block", "part").applyInArrow(_nearest(k, others_only), "query_id long, id long")
    scored = near.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").join(vectors, "id").withColumn("score", cosine(F.col("embedding"), F.col("q"))).drop("q", "embedding")
    return top_k(scored, k, *(order or (F.desc("score"), F.col("id"))))


def postings(docs: DataFrame, id_column: str, text_column: str, terms: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """(id, length, token, tf) of the tokens in `terms`, and a row with a null token for each document. Texts are cut into
    tokens once, and tokens are counted before they are exchanged."""
    cut_up = docs.select(F.col(id_column).alias("id"), tokens(F.col(text_column), pattern).alias("tokens"))
    each = cut_up.select("id", F.size("tokens").alias("length"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "tokens")).alias("said"))
    wanted = bounded(terms.select("token").distinct())
    return each.join(wanted, F.col("said") == F.col("token"), "left").groupBy("id", "length", "token").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(query_id, id, score). A term that a question repeats counts as often.

    Postings of the questions' terms and all documents' lengths come from one pass. The postings are dealt by document, so
    the sums of a question's terms need no exchange, and a top-k after them sends on only the best of each partition.
    """
    terms = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf"))
    all_rows = cut(postings(docs, id_column, text_column, terms))
    found = all_rows.filter("token IS NOT NULL")
    about = all_rows.filter("token IS NULL").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.join(df, "token").crossJoin(about).select("query_id", "token", "mean", (F.col("qf") * idf).alias("w"))  # one row of statistics
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return found.repartition("id").join(bounded(weighed), "token").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def all_terms(queries: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(query_id, id, score): documents that have all of a question's terms, by sum of tf / (1 + ln(1 + length))."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    found = postings(docs, id_column, text_column, terms).filter("token IS NOT NULL").repartition("id")
    scored = found.join(bounded(terms), "token").withColumn("part", F.col("tf") / (1 + F.log(1.0 + F.col("length"))))
    return scored.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.count("*").alias("has")).join(bounded(need), "query_id").filter("has = need").select("query_id", "id", "score")


def min_max(value: Column, by: str = "query_id") -> Column:
    """Within a question's candidates from 0 to 1; all 1 if they don't differ. Null stays null."""
    whole = Window.partitionBy(by)
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    return F.when(value.isNotNull(), F.when(high - low < 1e-12, 1.0).otherwise((value - low) / (high - low)))


def fuse(dense: DataFrame, lexical: DataFrame, boosts: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """Merge candidates of both sides (query_id, id, score[, rank]); a side that lacks one counts 0. limit 0: all.

    Ties keep the dense order, then the lexical one, then the id.
    """
    side = lambda f, name: f.select("query_id", "id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))
    both = side(dense, "dense").join(side(lexical, "lexical"), ["query_id", "id"], "full")
    both = both.join(boosts, ["query_id", "id"], "left") if boosts is not None else both.withColumn("boost", F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = both.withColumns({"dense_norm": zero(min_max(F.col("dense_score"))), "lexical_norm": zero(min_max(F.col("lexical_score"))), "boost": zero(F.col("boost"))})
    both = both.withColumn("score", DENSE_WEIGHT * F.col("dense_norm") + LEXICAL_WEIGHT * F.col("lexical_norm") + F.col("boost"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), "id")
    ranked = both.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit) if limit else ranked


def signal_boost(document: Column, article: Column, section: Column, named_documents: Column, named_articles: Column, primary: str) -> Column:
    """Exact matches of the question's signals with the chunk's metadata; the primary document only where none is named."""
    first = F.when((document == primary) & (F.size(named_documents) == 0) & (section == "article"), PRIMARY_BOOST).otherwise(0.0)
    return F.when(F.array_contains(named_documents, document), DOCUMENT_BOOST).otherwise(0.0) + F.when(F.array_contains(named_articles, article), ARTICLE_BOOST).otherwise(0.0) + first


def _vector_queries(spark, d: str) -> DataFrame:
    """The vectors whose id is divisible by 20 as the batch of queries."""
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _vectors(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")


_DENSE = """(SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)"""


@query("top1_top6_dns1_cosine_top_k", f"SELECT query_id, id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {_DENSE}) WHERE rank <= 10")
def cosine_top_k(spark, d):
    return dense_top_k(_vector_queries(spark, d), _vectors(spark, d), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("top2_top3_flt5_filtered_top_k", f"SELECT query_id, id, label, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {_DENSE} WHERE label IN (1, 2, 3)) WHERE rank <= 5 AND score >= 0.1")
def filtered_top_k(spark, d):
    """The filter is applied before ranking, the threshold after."""
    vectors = _vectors(spark, d).filter(F.col("label").isin(1, 2, 3))
    return dense_top_k(_vector_queries(spark, d), vectors, 5).filter("score >= 0.1").select("query_id", "id", "label", "rank")


@query("top3_joi5_answers", f"""
  WITH f AS (SELECT doc_id AS id, lang, source, CASE WHEN doc_id % 10 = 0 THEN 'draft' ELSE 'published' END AS status, CASE WHEN doc_id % 9 <> 4 THEN md5(text) END AS answer FROM documents),
  s AS (SELECT x.query_id, x.id, f.answer, x.score, row_number() OVER (PARTITION BY x.query_id ORDER BY x.score DESC, x.id) AS rank FROM {_DENSE} x JOIN f ON f.id = x.id JOIN f q ON q.id = x.query_id WHERE f.status = 'published' AND f.lang = q.lang)
  SELECT query_id, id, rank::INTEGER AS rank, answer FROM s WHERE rank <= 5 AND score >= 0.15""")
def answers(spark, d):
    """Published entries in the question's own language, nearest first, a threshold after the limit, and each with its answer if it has one."""
    entries = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.when(F.col("doc_id") % 10 == 0, "draft").otherwise("published").alias("status"), F.when(F.col("doc_id") % 9 != 4, F.md5("text")).alias("answer"))
    known = _vectors(spark, d).drop("label").join(entries.select("id", "lang", "status"), "id")
    asked = _vector_queries(spark, d).join(entries.select(F.col("id").alias("query_id"), "lang"), "query_id")
    hits = None
    for language in sorted(r["lang"] for r in entries.select("lang").filter("lang IS NOT NULL").distinct().collect()):  # a search a language, of its entries alone
        mine = F.col("lang") == language
        found = dense_top_k(asked.filter(mine).select("query_id", "embedding"), known.filter(mine & (F.col("status") == "published")).select("id", "embedding"), 5).filter("score >= 0.15")
        hits = found if hits is None else hits.unionByName(found)
    return hits.join(entries.select("id", "answer"), "id", "left").select("query_id", "id", "rank", "answer")


@query("flt16_filter_after_ranking", f"SELECT query_id, id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {_DENSE}) WHERE rank <= 40 AND label = 3")
def filter_after_ranking(spark, d):
    return dense_top_k(_vector_queries(spark, d), _vectors(spark, d), 40).filter("label = 3").select("query_id", "id", "rank")


_TOKENS = r"""t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents),
  len AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS length FROM documents),
  tf AS (SELECT id, token, count(*) AS tf FROM t GROUP BY 1, 2)"""
_TERMS = r"qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM benchmark)"
_BM25 = f"""{_TOKENS}, {_TERMS}, q AS (SELECT query_id, token, count(*) AS qf FROM qt GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
  s AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
  bm AS (SELECT query_id, tf.id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score
    FROM tf JOIN q USING (token) JOIN df USING (token) JOIN len ON len.id = tf.id, s GROUP BY 1, 2)"""


def _index(spark, d: str) -> inverted_index.Index:
    return inverted_index.stored_index(spark, d, "documents", "doc_id", "text")


def _questions(spark, d: str) -> DataFrame:
    """Each benchmark item as a question."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("lex3_lex5_bm25", f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm) WHERE rank <= 10")
def bm25_query(spark, d):
    return inverted_index.search(_questions(spark, d), _index(spark, d), 10).best.select("query_id", "id", F.round("score", 6).alias("score"))


_ALL = r"""two AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS terms FROM benchmark),
  q2 AS (SELECT query_id, unnest(terms) AS token, len(terms) AS need FROM two)"""


@query("lex1_lex4_top4_all_terms", f"""WITH {_TOKENS}, {_ALL}
  SELECT query_id, tf.id, round(sum(tf / (1 + ln(1 + length))), 6) AS score FROM tf JOIN q2 USING (token) JOIN len ON len.id = tf.id GROUP BY query_id, tf.id, need HAVING count(*) = need""")
def all_terms_query(spark, d):
    return inverted_index.matches(_questions(spark, d), _index(spark, d)).select("query_id", "id", F.round("score", 6).alias("score"))


def title_boosts(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, id, boost): a strong boost for titles (id, title) that share a word of two characters or more with a question
    (query_id, text), or 30 % of whose letter pairs it has; a weak one from 15 %. Pairs meet on what they share: pairs of letters
    and words in one join, of titles dealt by id into parts of `TITLES`, where their matches are also counted."""

    def shared(rows: DataFrame, column: str, *keep: str) -> DataFrame:
        words = F.array_distinct(F.filter(tokens(F.col(column)), lambda t: F.length(t) >= 2))
        each = F.concat(F.transform(bigrams(F.col(column)), lambda g: F.struct(F.lit(False).alias("whole"), g.alias("part"))), F.transform(words, lambda w: F.struct(F.lit(True).alias("whole"), w.alias("part"))))
        return rows.select(*keep, F.explode(each).alias("it")).select(*keep, "it.whole", "it.part")

    parts = max(titles.sparkSession.sparkContext.defaultParallelism, -(-titles.count() // TITLES))
    sized = titles.repartition(parts, "id").withColumn("n", F.size(bigrams(F.col("title"))))
    met = shared(sized, "title", "id", "n").join(bounded(shared(questions, "text", "query_id")), ["whole", "part"])
    found = met.groupBy("query_id", "id").agg(F.bool_or("whole").alias("word"), (F.count_if(~F.col("whole")) / F.first("n")).alias("ratio"))
    boost = F.when(F.col("word") | (F.col("ratio") >= 0.30), 0.15).when(F.col("ratio") >= 0.15, 0.05)
    return found.select("query_id", "id", boost.alias("boost")).filter("boost IS NOT NULL")


_GRAMS = lambda c: f"list_distinct(flatten(list_transform(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1), lambda t: list_transform(range(1, length(t)::BIGINT), lambda i: substr(t, i, 2)))))"
_WORDS = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2))"


@query("lex6_lex7_title_route", f"""
  WITH p AS (SELECT p_partkey AS id, {_GRAMS('p_name')} AS g, {_WORDS('p_name')} AS w FROM part), n AS (SELECT n_nationkey AS query_id, n_name || ' ' || ['bolt', 'wid', 'gears', 'lar'][1 + n_nationkey % 4] AS said FROM nation), q AS (SELECT query_id, {_GRAMS('said')} AS g, {_WORDS('said')} AS w FROM n),
    r AS (SELECT query_id, id, len(list_intersect(q.g, p.g)) / len(p.g) AS ratio, len(list_intersect(q.w, p.w)) > 0 AS word FROM p, q WHERE len(p.g) > 0)
  SELECT query_id, id, CASE WHEN word OR ratio >= 0.30 THEN 0.15 ELSE 0.05 END::DOUBLE AS boost FROM r WHERE word OR ratio >= 0.15""")
def title_route(spark, d):
    k = F.col("n_nationkey")
    said = F.concat_ws(" ", "n_name", F.element_at(F.array(*[F.lit(w) for w in ("bolt", "wid", "gears", "lar")]), (k % 4 + 1).cast("int")))
    return title_boosts(table(spark, d, "nation").select(k.alias("query_id"), said.alias("text")), table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))


# Each question names a document number, an article, or nothing; each document has a number, an article and a kind of section.
_SIGNALLED = "asked AS (SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN ' 3-1-' || (item_id % 10) || ' ' WHEN 1 THEN ' 제' || (item_id % 7) || ' 조' ELSE '' END AS text FROM benchmark)"
_BOOST = """CASE WHEN q % 3 = 0 AND i % 10 = q % 10 AND i % 50 <> 0 THEN 0.15 ELSE 0 END + CASE WHEN q % 3 = 1 AND i % 7 = q % 7 THEN 0.10 ELSE 0 END + CASE WHEN i % 50 = 0 AND q % 3 <> 0 AND i % 2 = 0 THEN 0.05 ELSE 0 END"""


def signalled_questions(spark, d: str) -> DataFrame:
    k = F.col("item_id")
    said = F.when(k % 3 == 0, F.concat(F.lit(" 3-1-"), (k % 10).cast("string"), F.lit(" "))).when(k % 3 == 1, F.concat(F.lit(" 제"), (k % 7).cast("string"), F.lit(" 조"))).otherwise("")
    return table(spark, d, "benchmark").select(k.alias("query_id"), F.concat("text", said).alias("text"))


def chunk_metadata(i: Column) -> dict[str, Column]:
    number = F.when(i % 50 == 0, "2-0-1").otherwise(F.concat(F.lit("3-1-"), (i % 10).cast("string")))
    return {"document": number, "article": F.concat(F.lit("제"), (i % 7).cast("string"), F.lit("조")), "section": F.when(i % 2 == 0, "article").otherwise("addendum")}


def signal_boosts(questions: DataFrame, candidates: DataFrame, primary: str = "2-0-1") -> DataFrame:
    """(query_id, id, boost) of candidates (query_id, id, document, article, section) from what the questions' texts name."""
    signals = questions.select("query_id", document_ids(F.col("text")).alias("named"), articles(F.col("text")).alias("named_articles"))
    boost = signal_boost(F.col("document"), F.col("article"), F.col("section"), F.col("named"), F.col("named_articles"), primary)
    return candidates.join(bounded(signals), "query_id").select("query_id", "id", boost.alias("boost"))


_DENSE_ITEMS = _DENSE.replace("vec_id % 20 = 0", "vec_id IN (SELECT item_id FROM benchmark)")
_HYBRID = f"""WITH {_SIGNALLED}, {_BM25.replace("FROM benchmark", "FROM asked")}, lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm),
  den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {_DENSE_ITEMS}),
  l AS (SELECT * FROM lex WHERE rank <= 48), v AS (SELECT * FROM den WHERE rank <= 48),
  ln AS (SELECT query_id, id, rank, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM l WINDOW w AS (PARTITION BY query_id)),
  vn AS (SELECT query_id, id, rank, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM v WINDOW w AS (PARTITION BY query_id)),
  j AS (SELECT coalesce(vn.query_id, ln.query_id) AS q, coalesce(vn.id, ln.id) AS i, 0.55 * coalesce(vn.x, 0) + 0.45 * coalesce(ln.x, 0) AS base FROM vn FULL JOIN ln ON vn.query_id = ln.query_id AND vn.id = ln.id),
  f AS (SELECT q AS query_id, i AS id, base + {_BOOST} AS score FROM j)"""


@query("hyb2_hyb3_hyb4_hyb5_joi7_win1_win2_hybrid", f"{_HYBRID} SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f) WHERE rank <= 12")
def hybrid(spark, d):
    """Dense and lexical candidates, four times as many as wanted from each side, fused with boosts for the documents and
    articles that the question's text names."""
    questions = signalled_questions(spark, d)
    items = questions.select("query_id").join(table(spark, d, "embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    dense = cut(dense_top_k(items, _vectors(spark, d).drop("label"), 12 * CANDIDATES, F.desc(F.round("score", 9)), F.col("id")))
    lexical = cut(inverted_index.search(questions, _index(spark, d), 12 * CANDIDATES).best)
    named = dense.select("query_id", "id").union(lexical.select("query_id", "id")).distinct()
    boosts = signal_boosts(questions, named.select("query_id", "id", *[c.alias(n) for n, c in chunk_metadata(F.col("id")).items()]))
    fused = fuse(dense, lexical, boosts, limit=0)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return fused.withColumn("place", best).filter("place <= 12").select("query_id", "id", F.round("score", 6).alias("score"))


@query("hyb6_backends", f"""
  WITH {_BM25}, {_ALL}, al AS (SELECT query_id, tf.id, sum(tf / (1 + ln(1 + length))) AS score FROM tf JOIN q2 USING (token) JOIN len ON len.id = tf.id GROUP BY query_id, tf.id, need HAVING count(*) = need), den AS (SELECT query_id, id, score FROM {_DENSE_ITEMS}),
  u AS (SELECT 'bm25' AS backend, query_id, id, score FROM bm UNION ALL SELECT 'all_terms', query_id, id, score FROM al UNION ALL SELECT 'dense', query_id, id, score FROM den)
  SELECT backend, query_id, id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY backend, query_id ORDER BY round(score, 9) DESC, id) AS rank FROM u) WHERE rank <= 3""")
def backends(spark, d):
    """The same questions by each of the single backends, for comparison."""
    questions, index = _questions(spark, d), _index(spark, d)
    best = lambda f: top_k(f, 3, F.desc(F.round("score", 9)), F.col("id"))
    items = questions.select("query_id").join(table(spark, d, "embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    found = {"bm25": inverted_index.search(questions, index, 3).best, "all_terms": best(inverted_index.matches(questions, index)), "dense": dense_top_k(items, _vectors(spark, d), 3, F.desc(F.round("score", 9)), F.col("id"))}
    each = [f.select(F.lit(name).alias("backend"), "query_id", "id", "rank") for name, f in found.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("hyb6_win3_max_normalised", f"WITH {_BM25} SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5")
def max_normalised(spark, d):
    best = inverted_index.search(_questions(spark, d), _index(spark, d), 5).best
    share = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
    return best.select("query_id", "id", F.round(share, 6).alias("score"))


@query("win11_document_vote", f"""
  SELECT query_id, label, round(sum(1.0 / rank), 6) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {_DENSE}) WHERE rank <= 5 GROUP BY 1, 2""")
def document_vote(spark, d):
    hits = dense_top_k(_vector_queries(spark, d), _vectors(spark, d), 5)
    return hits.groupBy("query_id", "label").agg(F.round(F.sum(1 / F.col("rank")), 6).alias("votes"))


@query("scr4_scr5_agg25_recall_curve", f"""
  WITH h AS (SELECT r.query_id, min(r.rank) AS first FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {_DENSE} WHERE id <> query_id) r
    JOIN embeddings g ON g.vec_id = r.query_id AND g.label = r.label WHERE r.rank <= 50 GROUP BY 1), q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0)
  SELECT k::INTEGER AS k, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 4) AS recall, round(avg(CASE WHEN first <= k THEN 1.0 / first ELSE 0.0 END), 4) AS mrr
  FROM q LEFT JOIN h USING (query_id), (SELECT unnest([1, 3, 5, 10, 20, 50]) AS k) GROUP BY k""")
def recall_curve(spark, d):
    """The first hit of the question's own label decides; each question is spread over the depths."""
    gold = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold"))
    first = dense_top_k(_vector_queries(spark, d), _vectors(spark, d), 50, others_only=True).join(gold, "query_id").filter("label = gold").groupBy("query_id").agg(F.min("rank").alias("first"))
    every = _vector_queries(spark, d).select("query_id").join(first, "query_id", "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10, 20, 50)])))
    found = F.coalesce(F.col("first") <= F.col("k"), F.lit(False))
    return every.groupBy("k").agg(F.round(F.avg(found.cast("double")), 4).alias("recall"), F.round(F.avg(F.when(found, 1 / F.col("first")).otherwise(0.0)), 4).alias("mrr"))


@query("dns2_unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS before, 1.0::DOUBLE AS after FROM embeddings")
def unit_vectors(spark, d):
    from quillmill.functions.vectors import norm, unit

    return table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 5).alias("before"), F.round(norm(unit(F.col("embedding"))), 9).alias("after"))
