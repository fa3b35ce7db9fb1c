"""Dates in file names and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms in which dates occur.
FILE_DATE = r"시행\s*\+?\s*(\d{4})(?!\d)\s*[.\-년]?\s*\+?\s*(\d{1,2})(?!\d)\s*[.\-월]?\s*\+?\s*(\d{1,2})(?!\d)"
TEXT_DATE = r"(19\d{2}|20\d{2})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})\s*일?"
DOCUMENT_NUMBER = r"^(\d+-\d+-\d+)"
ENFORCED = r"시행(?:한다|하다|된다|함)"


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD, or null where there is no such day."""
    joined = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.date_format(F.try_to_date(joined, "yyyy-MM-dd"), "yyyy-MM-dd")


def document_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, DOCUMENT_NUMBER, 1), F.lit(""))


def effective_date(name: Column) -> Column:
    """The date of enforcement in a file name. A year of five digits is no year."""
    part = lambda i: F.regexp_extract(name, FILE_DATE, i)
    return F.when(part(1) != "", iso_date(part(1), part(2), part(3)))


def dates_in(text: Column) -> Column:
    """All valid dates of a text in order, repeated ones too."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TEXT_DATE), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, TEXT_DATE, i)
    return F.filter(F.transform(found, lambda x: iso_date(part(x, 1), part(x, 2), part(x, 3))), lambda x: x.isNotNull())


def enforced_date(text: Column) -> Column:
    """The first date of the first line that declares enforcement and has a date."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda line: line.rlike(ENFORCED) & (F.size(dates_in(line)) > 0))
    return F.when(F.size(lines) > 0, F.get(dates_in(F.get(lines, F.lit(0))), F.lit(0)))


# Words that tell kinds of date questions apart.
REVISED = ["개정", "변경", "신설", "전문개정"]
FIRST = ["최초", "제정된", "처음", "맨처음"]
FILE_NAME = ["파일명", "현행시행", "현행"]
ADDENDUM = ["부칙", "개정규정", "개정학칙", "개정내규", "개정규칙", "개정된"]
LATEST = ["최신", "최근", "마지막", "최종"]
YEAR_OF = r"((?:19|20)\d{2})\s*(?:학년도|년도|년)"


def date_question_kind(question: Column) -> Column:
    """One of six kinds; the order of the rules matters."""
    from quillmill.functions.text import has_any

    q = F.replace(question, F.lit(" "), F.lit(""))
    return (
        F.when(question.rlike(r"제\d+조") & has_any(q, REVISED), "article_revision")
        .when(has_any(q, FIRST), "first_enacted")
        .when(has_any(q, FILE_NAME), "filename_effective")
        .when(has_any(q, ADDENDUM), F.when(question.rlike(YEAR_OF), "historical_addendum").otherwise("latest_addendum"))
        .when(has_any(q, LATEST), "latest_addendum")
        .when(has_any(q, ["시행일", "시행된"]), "filename_effective")
        .otherwise("unknown")
    )
