"""Document preparation: chunks, structure, tables, dates, masking and languages."""

from __future__ import annotations

import html.parser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import dates, facts, lexical, masking, text
from quillmill.functions.language import language_by_script
from quillmill.registry import query
from quillmill.sources.tables import dealt, table


@query("txt3_fixed_windows", """
  SELECT doc_id, i::INTEGER AS chunk_index, md5(substr(text, i * 900 + 1, 1000)) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 900 + 1)) AS i FROM documents WHERE length(text) > 0)""")
def fixed_windows(spark, d):
    docs = dealt(table(spark, d, "documents")).select("doc_id", F.posexplode(text.fixed_windows(F.col("text"), 1000, 100)).alias("chunk_index", "piece"))
    return docs.select("doc_id", "chunk_index", F.md5("piece").alias("chunk"))


@query("txt5_sup6_window_pieces", """
  WITH p AS (SELECT doc_id, i, trim(substr(text, i * 1100 + 1, 1200), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS piece
    FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1200) / 1100))::BIGINT + 1)) AS i FROM documents))
  SELECT doc_id, md5(piece) AS chunk, length(piece)::BIGINT AS size FROM p WHERE length(piece) > 0""")
def window_pieces(spark, d):
    docs = dealt(table(spark, d, "documents")).select("doc_id", F.explode(text.window_pieces(F.col("text"), 1200, 100)).alias("piece"))
    return docs.select("doc_id", F.md5("piece").alias("chunk"), F.length("piece").cast("bigint").alias("size"))


@query("txt1_txt2_paragraph_chunks")
def paragraph_chunks(spark, d):
    """Greedy packing depends on all that came before it, which SQL can't express; tests hold it against the stated rules."""
    docs = dealt(table(spark, d, "documents")).select("doc_id", text.paragraph_chunks(F.col("text"), 1000, 100).alias("chunks"))
    return docs.select("doc_id", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "chunk"))


@query("txt4_cnv3_estimates_and_titles", r"""
  SELECT doc_id, CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 500) ELSE 0 END::BIGINT AS chunks,
    CASE WHEN length(t) > 30 THEN substr(t, 1, 30) || '...' ELSE t END AS title FROM (SELECT doc_id, text, trim(regexp_replace(text, '[ \t\n\r\x0b\x0c]+', ' ', 'g')) AS t FROM documents)""")
def estimates_and_titles(spark, d):
    return dealt(table(spark, d, "documents")).select("doc_id", text.chunk_estimate(F.col("text")).alias("chunks"), text.short_title(F.col("text")).alias("title"))


@query("cnv2_cnv7_truncation", """
  SELECT doc_id, CASE WHEN length(t) > 120 THEN rtrim(substr(t, 1, 120)) || '…' ELSE t END AS head, right(text, 80) AS tail FROM (SELECT doc_id, text, trim(text) AS t FROM documents)""")
def truncation(spark, d):
    return dealt(table(spark, d, "documents")).select("doc_id", text.truncated(F.col("text"), 120, "…").alias("head"), F.right("text", F.lit(80)).alias("tail"))


def regulations(spark, d: str) -> DataFrame:
    """Regulations made of the documents: their lines under article heads with dates of revision, one to three addenda with
    dates of their own, and an attachment, under a dated file name."""
    docs = dealt(table(spark, d, "documents")).select("doc_id", "source", F.split("text", "\n").alias("lines"))
    k = F.col("doc_id")
    name = F.format_string("%d-0-%d규정(시행2020.%d.1.).hwp", k % 5 + 1, k, k % 14)
    heads = F.transform("lines", lambda line, i: F.concat(F.lit("제"), (i + 1).cast("string"), F.lit("조(항목)\n"), line, F.format_string(" (개정 %d. 3. %d.)", 2000 + (k + i) % 20, i % 28 + 1)))
    addendum = lambda i: F.concat(
        F.format_string("부 칙(%d. %d. %d.)\n① 이 규정은 %d년 %d월 %d일부터 시행한다.", 2010 + i, (k + i) % 12 + 1, (k * 7 + i) % 28 + 1, 2011 + i, (k + i) % 12 + 1, (k * 3 + i) % 28 + 1),
        F.when((k + i) % 4 == 0, " 종전의 것에도 소급하여 적용한다.").otherwise(""), F.lit("\n② 따로 정한다."),
    )
    addenda = F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), addendum)
    body = F.concat(F.lit("규정 머리말\n"), F.array_join(heads, "\n"), F.lit("\n"), F.array_join(addenda, "\n"), F.lit("\n[별표 1]\n표"))
    return docs.select("doc_id", name.alias("file_name"), body.alias("text"))


_REGULATIONS = """(SELECT doc_id, (doc_id % 5 + 1) || '-0-' || doc_id || '규정(시행2020.' || (doc_id % 14) || '.1.).hwp' AS file_name, string_split(text, chr(10)) AS lines FROM documents)"""
_ADDENDA = """(SELECT doc_id, i, make_date((2010 + i)::INTEGER, ((doc_id + i) % 12 + 1)::INTEGER, ((doc_id * 7 + i) % 28 + 1)::INTEGER)::VARCHAR AS header, make_date((2011 + i)::INTEGER, ((doc_id + i) % 12 + 1)::INTEGER, ((doc_id * 3 + i) % 28 + 1)::INTEGER)::VARCHAR AS enforced,
  (doc_id + i) % 4 = 0 AS retro, '부 칙(' || (2010 + i) || '. ' || ((doc_id + i) % 12 + 1) || '. ' || ((doc_id * 7 + i) % 28 + 1) || '.)' || chr(10) || '① 이 규정은 ' || (2011 + i) || '년 ' || ((doc_id + i) % 12 + 1) || '월 ' || ((doc_id * 3 + i) % 28 + 1) || '일부터 시행한다.'
  || CASE WHEN (doc_id + i) % 4 = 0 THEN ' 종전의 것에도 소급하여 적용한다.' ELSE '' END || chr(10) || '② 따로 정한다.' AS block FROM (SELECT doc_id, unnest(range(1, doc_id % 3 + 2)) AS i FROM documents))"""
_REVISED = "make_date((2000 + (doc_id + i - 1) % 20)::INTEGER, 3, ((i - 1) % 28 + 1)::INTEGER)::VARCHAR"


@query("txt6_txt8_section_split", f"""
  WITH r AS {_REGULATIONS}, a AS (SELECT doc_id, lines, unnest(range(1, len(lines)::BIGINT + 1)) AS i FROM r)
  SELECT doc_id, 'article' AS kind, '제' || i || '조' AS article, md5('제' || i || '조(항목)' || chr(10) || lines[i] || ' (개정 ' || (2000 + (doc_id + i - 1) % 20) || '. 3. ' || ((i - 1) % 28 + 1) || '.)' || chr(10)) AS block FROM a
  UNION ALL SELECT doc_id, 'addendum', '부칙', md5(block || chr(10)) FROM {_ADDENDA} UNION ALL SELECT doc_id, 'attachment', '[별표 1]', md5('[별표 1]' || chr(10) || '표') FROM r UNION ALL SELECT doc_id, 'body', NULL, md5('규정 머리말' || chr(10)) FROM r""")
def section_split(spark, d):
    blocks = regulations(spark, d).select("doc_id", F.explode(text.sections(F.col("text"))).alias("block"))
    return blocks.select("doc_id", text.section_kind(F.col("block")).alias("kind"), text.section_article(F.col("block")).alias("article"), F.md5("block").alias("block"))


def document_chunks(docs: DataFrame, tables: DataFrame, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """(doc_id, chunk_index, section, article, chunk) of regulations (doc_id, file_name, text): a chunk about the document itself,
    then the body's, then its tables' (doc_id, name, rows), each with a bracketed prefix that says what it is part of. A table
    that an article refers to names that article in its caption, the first three at most."""
    number, effective = dates.document_number(F.col("file_name")), dates.effective_date(F.col("file_name"))
    named = docs.select("doc_id", "file_name", number.alias("number"), effective.alias("effective"), "text")
    title = F.trim(F.regexp_replace(F.regexp_replace("file_name", r"^[\d-]+", ""), r"\(.*$|\.[A-Za-z]+$", ""))
    about = F.concat(F.lit("이 문서는 "), title, F.lit("이다."), F.when(F.col("effective").isNotNull(), F.concat(F.lit(" 시행일은 "), "effective", F.lit("이다."))).otherwise(" 시행일은 파일명에 없다."))
    none = F.lit(None).cast("string")
    first = named.select("doc_id", "number", "effective", F.lit(0).alias("part"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit("meta").alias("section"), F.lit("문서메타").alias("article"), about.alias("piece"))
    blocks = named.select("doc_id", "number", "effective", F.posexplode(text.sections(F.col("text"))).alias("i", "block"))
    blocks = blocks.select("*", text.section_kind(F.col("block")).alias("section"), text.section_article(F.col("block")).alias("article"))
    body = blocks.select("doc_id", "number", "effective", F.lit(1).alias("part"), "i", F.posexplode(text.clauses(F.col("block"), limit, overlap)).alias("j", "piece"), "section", "article").select(first.columns)
    refers = blocks.filter("section = 'article'").select("doc_id", "i", "article", F.explode(F.array_distinct(F.regexp_extract_all("block", F.lit(r"별표\s*(\d+)"), F.lit(1)))).alias("attachment"))
    place = F.row_number().over(Window.partitionBy("doc_id", "attachment").orderBy("i"))
    captions = refers.withColumn("place", place).filter("place <= 3").groupBy("doc_id", "attachment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "article"))), lambda x: x["article"]), ", ").alias("articles"))
    each = tables.withColumn("attachment", F.regexp_extract("name", r"(\d+)", 1)).join(captions, ["doc_id", "attachment"], "left").join(named.select("doc_id", "number", "effective"), "doc_id")
    shown = F.concat(F.when(F.col("articles").isNotNull(), F.concat(F.lit("[관련 조항: "), "articles", F.lit("]\n"))).otherwise(""), text.table_text(F.col("name"), F.lit("attachment"), F.col("rows"), F.lit(None).cast("int")))
    last = each.select("doc_id", "number", "effective", F.lit(2).alias("part"), F.col("attachment").cast("int").alias("i"), F.lit(0).alias("j"), F.lit("table").alias("section"), F.col("name").alias("article"), shown.alias("piece"))
    whole = first.unionByName(body).unionByName(last)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "i", "j")) - 1
    prefix = text.chunk_prefix(F.col("number"), F.col("effective"), F.col("article"), F.col("section"), F.col("piece"))
    return whole.select("doc_id", index.alias("chunk_index"), "section", F.coalesce("article", none).alias("article"), F.concat(prefix, F.lit("\n"), "piece").alias("chunk"))


@query("txt9_txt13_txt14_document_chunks", f"""
  WITH x AS (SELECT doc_id, ['widget', 'bolt', 'gear'][1 + doc_id % 3] AS word, CASE WHEN doc_id % 14 BETWEEN 1 AND 12 THEN '2020-' || lpad((doc_id % 14)::VARCHAR, 2, '0') || '-01' END AS eff, (doc_id % 5 + 1) || '-0-' || doc_id AS num, doc_id % 4 AS r FROM documents),
  p AS (SELECT *, '[문서:' || num || coalesce(' | 파일명시행일:' || eff, '') AS pre FROM x),
  u AS (SELECT doc_id, 0 AS o, 'meta' AS section, '문서메타' AS article, pre || ' | 조항:문서메타 | 유형:meta' || CASE WHEN eff IS NULL THEN '' ELSE ' | 본문날짜:' || eff END || ']' || chr(10) || '이 문서는 ' || word || '규정이다. 시행일은 ' || coalesce(eff || '이다.', '파일명에 없다.') AS chunk FROM p
    UNION ALL SELECT doc_id, i, 'article', '제' || i || '조', pre || ' | 조항:제' || i || '조 | 유형:article]' || chr(10) || '제' || i || '조(' || word || ')' || chr(10) || CASE WHEN i <= r THEN '별표 1에 따른다.' || CASE WHEN i = 5 THEN '' ELSE chr(10) END ELSE word || i || CASE WHEN i = 5 THEN '' ELSE chr(10) END END FROM (SELECT *, unnest(range(1, 6)) AS i FROM p)
    UNION ALL SELECT doc_id, 9, 'table', '별표 1', pre || ' | 조항:별표 1 | 유형:table]' || chr(10) || CASE WHEN r > 0 THEN '[관련 조항: ' || array_to_string(list_transform(range(1, least(r, 3) + 1), lambda i: '제' || i || '조'), ', ') || ']' || chr(10) ELSE '' END
      || '[표 별표 1] 출처:attachment' || chr(10) || '| 직종 | 정원 |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || word || ' | ' || doc_id || ' |' || chr(10) || '[셀요약]' || chr(10) || '직종=' || word || '; 정원=' || doc_id FROM p)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INTEGER AS chunk_index, section, article, md5(chunk) AS chunk FROM u""")
def whole_chunks(spark, d):
    """Five articles a document, some of which refer to its table."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("r"), F.element_at(F.array(*[F.lit(w) for w in ("widget", "bolt", "gear")]), (F.col("doc_id") % 3 + 1).cast("int")).alias("word"))
    name = F.concat((F.col("doc_id") % 5 + 1).cast("string"), F.lit("-0-"), F.col("doc_id").cast("string"), "word", F.lit("규정(시행2020."), (F.col("doc_id") % 14).cast("string"), F.lit(".1.).hwp"))
    articles = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit("제"), i.cast("string"), F.lit("조("), F.col("word"), F.lit(")\n"), F.when(i <= F.col("r"), "별표 1에 따른다.").otherwise(F.concat(F.col("word"), i.cast("string")))))
    rows = F.array(F.array(F.lit("직종"), F.lit("정원")), F.array(F.col("word"), F.col("doc_id").cast("string")))
    tables = docs.select("doc_id", F.lit("별표 1").alias("name"), rows.alias("rows"))
    chunks = document_chunks(docs.select("doc_id", name.alias("file_name"), F.array_join(articles, "\n").alias("text")), tables)
    return chunks.withColumn("chunk", F.md5("chunk"))


@query("txt7_txt10_sup11_sup14_regulation_chunks")
def regulation_chunks(spark, d):
    """Sections, cut at clauses where they are long, each with its bracketed origin. Tests hold the rules against fixed cases."""
    found = regulations(spark, d).select("doc_id", dates.document_number(F.col("file_name")).alias("number"), dates.effective_date(F.col("file_name")).alias("effective"), F.explode(text.sections(F.col("text"))).alias("block"))
    pieces = found.select("*", F.explode(text.clauses(F.col("block"))).alias("piece"))
    prefix = text.chunk_prefix(F.col("number"), F.col("effective"), text.section_article(F.col("block")), text.section_kind(F.col("block")), F.col("piece"))
    return pieces.select("doc_id", F.concat(prefix, F.lit("\n"), F.col("piece")).alias("chunk"), F.slice(dates.dates_in(F.col("piece")), 1, 20).alias("dates_in_chunk"))


@query("dat1_dat2_txt9_file_dates", f"""
  SELECT doc_id, regexp_extract(file_name, '^([0-9]+-[0-9]+-[0-9]+)', 1) AS number,
    CASE WHEN doc_id % 14 BETWEEN 1 AND 12 THEN '2020-' || lpad((doc_id % 14)::VARCHAR, 2, '0') || '-01' END AS effective FROM {_REGULATIONS}""")
def file_dates(spark, d):
    return regulations(spark, d).select("doc_id", dates.document_number(F.col("file_name")).alias("number"), dates.effective_date(F.col("file_name")).alias("effective"))


@query("dat3_text_dates", r"""
  WITH f AS (SELECT doc_id, regexp_extract_all(text, '(?:19\d{2}|20\d{2})\s*[.\-/년]\s*\d{1,2}\s*[.\-/월]\s*\d{1,2}') AS found FROM (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' 2020. ' || (doc_id % 12 + 1) || '. ' || (doc_id % 31 + 1) || '.' WHEN 1 THEN ' 2021-13-41 2019년 2월 30일 2018/4/9 ' ELSE '' END AS text FROM documents))
  SELECT doc_id, len(list_filter(found, lambda x: try_strptime(regexp_replace(x, '^(\d{4})\D+(\d{1,2})\D+(\d{1,2})$', '\1-\2-\3'), '%Y-%m-%d') IS NOT NULL))::INTEGER AS n_dates FROM f""")
def text_dates(spark, d):
    """How many valid dates each document has. Behind the texts stand dates, some of days that aren't there."""
    k = F.col("doc_id")
    dated = F.when(k % 3 == 0, F.format_string(" 2020. %d. %d.", k % 12 + 1, k % 31 + 1)).when(k % 3 == 1, " 2021-13-41 2019년 2월 30일 2018/4/9 ").otherwise("")
    return dealt(table(spark, d, "documents")).select("doc_id", F.size(dates.dates_in(F.concat(F.coalesce("text", F.lit("")), dated))).alias("n_dates"))


@query("dat4_dat6_date_facts", f"""
  SELECT r.doc_id, a.enforced, a.n::INTEGER AS addenda, r.revised FROM (SELECT doc_id, max({_REVISED}) AS revised FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10)))::BIGINT + 1)) AS i FROM documents) GROUP BY 1) r
  JOIN (SELECT doc_id, arg_max(enforced, i) AS enforced, count(*) AS n FROM {_ADDENDA} GROUP BY 1) a USING (doc_id)""")
def date_facts(spark, d):
    """The last addendum's date of enforcement, how many addenda there are, and the articles' last revision."""
    marks = F.flatten(F.transform(F.filter("blocks", lambda b: text.section_kind(b) == "article"), facts.revisions))
    found = F.flatten(F.transform(F.filter("blocks", lambda b: text.section_kind(b) == "addendum"), facts.addenda))
    docs = regulations(spark, d).select("doc_id", text.sections(F.col("text")).alias("blocks"))
    return docs.select("doc_id", found.alias("a"), F.array_max(marks).alias("revised")).select("doc_id", facts.effective(F.element_at("a", -1)).alias("enforced"), F.size("a").alias("addenda"), "revised")


def pick(values: list[str], at) -> object:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def sql_pick(values: list[str], at: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{listed}][1 + ({at}) % {len(values)}]"


def sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# Questions put together from parts: what is asked about, which words say it, and numbers of the row.
SUBJECTS = ["장학 규정", "제{n}조", "학칙 2-0-{n}", "별표 {n}", "기숙사", "복전", "2024-03-0{n} 공고", "교생", "정원", "제 {n} 조의 2", "부칙", "12-3-{n}0과 제{n}조"]
VERBS = ["개정된 날짜", "최초 시행일", "현행 시행일", "부칙 중 201{n}학년도 시행일", "개정규정의 시행일", "마지막 부칙", "나가려면", "변경 금액은 얼마", "신설은 언제", "벌금과 할인", "몇 명인지", "시행된 날", "들어가려면", "내용"]


def asked(k) -> object:
    """A question for each number: all combinations of subjects and verbs come up."""
    said = F.concat_ws(" ", pick(SUBJECTS, k), pick(VERBS, F.floor(k / len(SUBJECTS))))
    return F.replace(said, F.lit("{n}"), (k % 9 + 1).cast("string"))


_ASKED = f"replace({sql_pick(SUBJECTS, 'o_orderkey')} || ' ' || {sql_pick(VERBS, f'o_orderkey // {len(SUBJECTS)}')}, '{{n}}', (o_orderkey % 9 + 1)::VARCHAR)"


@query("dat8_date_kinds", f"""
  WITH q AS (SELECT o_orderkey, {_ASKED} AS said, replace(said, ' ', '') AS bare FROM orders)
  SELECT o_orderkey, CASE WHEN regexp_matches(said, '제[0-9]+조') AND {sql_any('bare', dates.REVISED)} THEN 'article_revision' WHEN {sql_any('bare', dates.FIRST)} THEN 'first_enacted' WHEN {sql_any('bare', dates.FILE_NAME)} THEN 'filename_effective'
    WHEN {sql_any('bare', dates.ADDENDUM)} THEN CASE WHEN regexp_matches(said, '(19|20)[0-9][0-9] *(학년도|년도|년)') THEN 'historical_addendum' ELSE 'latest_addendum' END WHEN {sql_any('bare', dates.LATEST)} THEN 'latest_addendum'
    WHEN {sql_any('bare', ['시행일', '시행된'])} THEN 'filename_effective' ELSE 'unknown' END AS kind FROM q""")
def date_kinds(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.date_question_kind(asked(F.col("o_orderkey"))).alias("kind"))


@query("dat11_local_times", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS seoul FROM events")
def local_times(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(F.from_utc_timestamp("ts", "Asia/Seoul"), "yyyy-MM-dd HH:mm:ss").alias("seoul"))


class _Cells(html.parser.HTMLParser):
    """Rows of cells of each table; nested tables add to the cell they are in."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.depth, self.cell = 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            self.tables[-1][-1].append("")
            self.cell = True

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.depth and self.cell:
            self.tables[-1][-1][-1] += data


def html_tables(page: str | None) -> list[list[list[str]]]:
    """Tables of a page: white space folded, rows without text dropped."""
    parser = _Cells()
    parser.feed(page or "")
    folded = [[[" ".join(c.split()) for c in row] for row in t] for t in parser.tables]
    return [[row for row in t if any(row)] for t in folded]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def tables_of(pages: pd.Series) -> pd.Series:
    return pages.map(html_tables)


@query("src5_txt11_txt12_sup12_html_tables", r"""
  WITH p AS (SELECT page_id, page_id % 4 AS n, page_id % 2 = 1 AS bare FROM pages), r AS (SELECT *, list_transform(range(1, n + 1), lambda i: ['row' || i, CASE WHEN bare THEN '' ELSE (page_id * i)::VARCHAR END, CASE WHEN bare THEN '' ELSE '8' END, '']) AS body FROM p)
  SELECT page_id, page_id || '-T1' AS table_id, (n + 1)::INTEGER AS n_rows, md5('[표 ' || page_id || '-T1] 출처:p' || chr(10) || '| 직종 | 정원 | 현원 | 비고 |' || chr(10) || '| --- | --- | --- | --- |' || array_to_string(list_transform(body, lambda x: chr(10) || '| ' || array_to_string(x, ' | ') || ' |'), '')
    || CASE WHEN n > 0 THEN chr(10) || '[셀요약]' || array_to_string(list_transform(body, lambda x: chr(10) || '직종=' || x[1] || CASE WHEN bare THEN '' ELSE '; 정원=' || x[2] || '; 현원=8' END), '') ELSE '' END || CASE WHEN n = 0 OR bare AND n >= 2 THEN chr(10) || '[주의] 이 표의 수치 셀이 비어 있거나 거의 비어 있습니다. 금액을 추정하지 마세요.' ELSE '' END) AS shown
  FROM r""")
def tables_from_html(spark, d):
    """All tables of each page's whole HTML, at whose end one of its own is put, as pages of these tables hold none: read, cleaned
    and written as Markdown with cell lines."""
    k = F.col("page_id")
    filled = lambda v: F.when(k % 2 == 0, v).otherwise(F.lit(""))
    cell = lambda v: F.concat(F.lit("<td>"), v, F.lit(" </td>"))
    rows = F.transform(F.filter(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: i > 0), lambda i: F.concat(F.lit("<tr><td>row"), i.cast("string"), F.lit("</td>"), cell(filled((k * i).cast("string"))), cell(filled(F.lit("8"))), cell(F.lit(" ")), F.lit("</tr><tr><td> </td></tr>")))
    page = F.concat(F.coalesce("html", F.lit("")), F.lit("<table><tr><th>직종</th><th>정원</th><th> 현원</th><th>비고</th></tr>"), F.array_join(rows, ""), F.lit("</table>"))
    found = table(spark, d, "pages").select("page_id", F.posexplode(tables_of(page)).alias("i", "rows"))
    name = F.concat(k.cast("string"), F.lit("-T"), (F.col("i") + 1).cast("string"))
    cells = F.size(F.filter(F.flatten("rows"), lambda c: c != ""))
    return found.select("page_id", name.alias("table_id"), F.size("rows").alias("n_rows"), F.md5(text.table_text(name, F.lit("p"), F.col("rows"), cells)).alias("shown"))


@query("msk1_msk2_msk3_masking")
def masked(spark, d):
    """All seed rules over whole texts. Which texts change is compared with a count in SQL by msk3_pattern_counts."""
    docs = dealt(table(spark, d, "documents")).select("doc_id", "text", masking.masker()("text").alias("masked"))
    return docs.filter("text <> masked").select("doc_id", F.md5("masked").alias("masked"), (F.length("text") - F.length("masked")).cast("bigint").alias("shorter"))


@query("msk3_pattern_counts", r"""
  SELECT count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::BIGINT AS mails, count(*) FILTER (regexp_matches(text, '01[0-9]-?\d{3,4}-?\d{4}'))::BIGINT AS phones,
    count(*) FILTER (regexp_matches(text, '\d{6}-?\d{7}'))::BIGINT AS residents FROM documents""")
def pattern_counts(spark, d):
    hits = {name: F.count_if(F.col("text").rlike(pattern)) for name, (_, pattern, _, _) in zip(("students", "phones", "mails", "residents"), masking.MASKING_RULES, strict=True)}
    return dealt(table(spark, d, "documents")).agg(*[hits[c].alias(c) for c in ("mails", "phones", "residents")])


@query("msk4_native_mail_mask", r"""
  SELECT doc_id, md5(regexp_replace(text, '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', '\1****@\2', 'g')) AS masked FROM documents""")
def native_mail_mask(spark, d):
    """The rule for addresses as a regular expression of the JVM: no Python in the plan."""
    return dealt(table(spark, d, "documents")).select("doc_id", F.md5(F.regexp_replace("text", r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1****@$2")).alias("masked"))


@query("grd1_mod1_guardrails", r"""
  SELECT conv_id, turn, regexp_matches(text, '(?i)(fuck|shit|bitch)') AS blocked, CASE WHEN contains(lower(text), 'worthless') THEN 'worthless' WHEN contains(lower(text), 'ouan') THEN 'ouan' END AS word,
    regexp_replace(regexp_replace(text, '\d{6}-?\d{7}', '******-*******', 'g'), '01[0-9]-?\d{3,4}-?\d{4}', '010-****-****', 'g') AS shown FROM (SELECT conv_id, turn, text || CASE (conv_id + turn) % 5 WHEN 0 THEN ' Shit!' WHEN 1 THEN ' 010-1234-5678, worthless' WHEN 2 THEN ' 900101-1234567' ELSE '' END AS text FROM conversations)""")
def guardrails(spark, d):
    """Turns that end with what the rules are about, one in five each."""
    k = (F.col("conv_id") + F.col("turn")) % 5
    talk = table(spark, d, "conversations").withColumn("text", F.concat("text", F.when(k == 0, " Shit!").when(k == 1, " 010-1234-5678, worthless").when(k == 2, " 900101-1234567").otherwise("")))
    return talk.select("conv_id", "turn", F.contains(F.coalesce(masking.guardrail(F.col("text"), "input"), F.lit("")), F.lit("부적절")).alias("blocked"), masking.first_word(F.col("text"), ["worthless", "ouan"]).alias("word"), masking.guardrail(F.col("text"), "output").alias("shown"))


@query("lng1_language_by_script", r"""
  WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^가-힣ㄱ-ㆎ]', '', 'g')) AS ko, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS zh, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS la,
    length(regexp_replace(text, '[^ăâđêôơưĂÂĐÊÔƠƯàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ]', '', 'g')) AS vi FROM documents)
  SELECT doc_id, CASE WHEN ko > 0 AND ko * 3 >= la THEN 'ko' WHEN vi > 0 THEN 'vi' WHEN zh > 0 THEN 'zh' WHEN la > 0 THEN 'en' ELSE 'ko' END AS language FROM c""")
def language(spark, d):
    return table(spark, d, "documents").select("doc_id", language_by_script(F.col("text")).alias("language"))


_EXPANDED = ", ".join(
    [f"CASE WHEN {sql_any('said', t)} THEN [{', '.join(repr(x) for x in terms)}] ELSE [] END" for t, terms in lexical.SYNONYMS]
    + [f"CASE WHEN {sql_any('said', c)} AND {sql_any('said', a)} THEN [{', '.join(repr(x) for x in terms)}] ELSE [] END" for c, a, terms in lexical.CONTEXT_SYNONYMS]
)


@query("lex8_synonyms", f"""
  WITH q AS (SELECT o_orderkey, {_ASKED} AS said FROM orders)
  SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(flatten([{_EXPANDED}]), lambda t: NOT contains(said, t)))), ' ') AS terms FROM q""")
def synonyms(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(lexical.expansion_terms(asked(F.col("o_orderkey")))), " ").alias("terms"))


@query("hyb1_query_signals", rf"""
  WITH q AS (SELECT o_orderkey, {_ASKED} AS said FROM orders)
  SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(said, '[0-9-]+'), lambda x: regexp_full_match(x, '[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{1,3}}')))), ',') AS documents,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(said, '제 *[0-9]+ *조( *의 *[0-9]+)?'), lambda x: replace(x, ' ', '')))), ',') AS articles FROM q""")
def query_signals(spark, d):
    said = asked(F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(lexical.document_ids(said)), ",").alias("documents"), F.array_join(F.array_sort(lexical.articles(said)), ",").alias("articles"))


@query("win8_win9_renumber_and_overlap", """
  WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
  SELECT doc_id, (row_number() OVER w - 1)::INTEGER AS chunk_index, count(*) OVER (PARTITION BY doc_id)::BIGINT AS total_chunks,
    md5(line || coalesce(chr(10) || substr(lead(line) OVER w, 1, 20), '')) AS chunk FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def renumber_and_overlap(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    tail = F.coalesce(F.concat(F.lit("\n"), F.substring(F.lead("line").over(w), 1, 20)), F.lit(""))
    return lines.select("doc_id", (F.row_number().over(w) - 1).alias("chunk_index"), F.count("*").over(Window.partitionBy("doc_id")).alias("total_chunks"), F.md5(F.concat("line", tail)).alias("chunk"))
