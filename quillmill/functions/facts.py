"""Date facts of regulations: addenda and revisions, and answers from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.binding import let
from quillmill.functions.dates import YEAR_OF, date_question_kind, dates_in, enforced_date
from quillmill.functions.text import stripped

# Items of an addendum, forms that follow one, marks of revisions, and words of retroaction.
ITEM = r"(?m)(?=^\s*\d+[.．]\s)|(?=^\s*[①②③④⑤⑥⑦⑧⑨⑩])"
FORM = r"(?m)^\s*\[별[지표]"
REVISION = r"[（(]\s*(?:개정|변경|신설|전문개정|일부개정|폐지|본조신설|제목개정)\s*([^)）]*)[)）]"
RETROACTIVE = r"적용한다|소급"

def addenda(block: Column) -> Column:
    """The addenda in a block: each item that declares enforcement with a date; without any, the block itself if it has a
    date. Of forms that follow nothing is read."""

    def addendum(at: Column, text: Column, enforced: Column) -> Column:
        return F.struct(at["header"].alias("header_date"), enforced.alias("enforced_from"), text.rlike(RETROACTIVE).alias("retroactive"), F.substring(stripped(text), 1, 300).alias("text"))

    def found(at: Column) -> Column:
        rest = F.when(F.contains(at["body"], F.lit("\n")), F.regexp_replace(at["body"], r"\A[^\n]*\n", "")).otherwise("")
        declared = F.filter(F.transform(F.split(rest, ITEM), lambda item: addendum(at, item, enforced_date(item))), lambda a: a["enforced_from"].isNotNull())
        own = F.filter(F.array(addendum(at, at["body"], F.lit(None).cast("string"))), lambda _: F.size(dates_in(at["body"])) > 0)
        return let(declared, lambda listed: F.when(F.size(listed) > 0, listed).otherwise(own))

    body = stripped(F.get(F.split(F.coalesce(block, F.lit("")), FORM, 2), F.lit(0)))
    header = lambda b: F.get(dates_in(F.substring_index(b, "\n", 1)), F.lit(0))
    return let(let(body, lambda b: F.struct(b.alias("body"), header(b).alias("header"))), found)


def revisions(block: Column) -> Column:
    """The distinct dates of an article's revision marks, in order."""
    marks = F.regexp_extract_all(F.coalesce(block, F.lit("")), F.lit(REVISION), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(marks, lambda m: dates_in(m)))))


def effective(addendum: Column) -> Column:
    return F.coalesce(addendum["enforced_from"], addendum["header_date"])


def answer(question: Column, file_date: Column, addenda_column: Column, by_article: Column) -> Column:
    """The date that a question asks for: of the file name, of the last, first or named addendum, or of an article's last
    revision. The last addendum is the last in order, whatever its date."""
    kind = date_question_kind(question)
    last, first = (F.when(F.size(addenda_column) > 0, effective(F.element_at(addenda_column, at))) for at in (-1, 1))
    year = F.regexp_extract(question, YEAR_OF, 1)
    named = F.get(F.concat(F.filter(addenda_column, lambda a: F.contains(a["text"], year)), F.filter(addenda_column, lambda a: effective(a).startswith(year))), F.lit(0))
    article = F.regexp_extract(question, r"제\d+조(?:의\d+)?", 0)
    return (
        F.when(kind == "filename_effective", file_date).when(kind == "latest_addendum", last).when(kind == "first_enacted", first)
        .when(kind == "historical_addendum", F.coalesce(effective(named), last)).when(kind == "article_revision", F.element_at(by_article[article], -1)).otherwise(file_date)
    )


def loosely_present(iso: Column, text: Column) -> Column:
    """Whether a date stands in the text in one of its usual forms."""
    part = lambda i: F.regexp_extract(iso, r"^(\d{4})-(\d{2})-(\d{2})$", i)
    bare = lambda i: F.regexp_replace(part(i), "^0", "")
    pattern = F.concat(part(1), F.lit(r"\s*[.\-년]\s*0?"), bare(2), F.lit(r"\s*[.\-월]\s*0?"), bare(3))
    return F.when(part(1) != "", F.regexp_like(text, pattern)).otherwise(False)


def age_hours(captured: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(captured)) / 3.6e9
