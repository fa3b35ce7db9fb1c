"""Tokens, bigrams, synonyms and signals of search texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script. The narrower Korean/ASCII class is KOREAN_TOKEN.
TOKEN, KOREAN_TOKEN = r"[\p{L}\p{N}]+", r"[0-9A-Za-z가-힣]+"

# A question with one of the first words is also searched by the second ones.
SYNONYMS = [
    (["기숙사", "기숙"], ["생활관"]),
    (["교생"], ["학교현장실습", "교육실습"]),
    (["복전"], ["복수전공"]),
    (["부전"], ["부전공"]),
    (["출첵"], ["출석"]),
    (["성적컷", "성적 컷", "커트라인"], ["평점평균"]),
    (["벌금", "과태료"], ["연체료"]),
    (["짤리", "짤려", "잘리", "잘려"], ["탈락"]),
    (["알바", "아르바이트"], ["근로장학"]),
    (["군대", "군입대", "입대"], ["군입대", "병역"]),
    (["과 옮기", "과 옮길", "학과 옮기", "학과 바꾸", "과 바꾸"], ["전과"]),
    (["깎아", "깎아줘", "깎아주", "할인"], ["감면", "면제"]),
]
# A context word and an action word together add the third.
CONTEXT_SYNONYMS = [
    (["기숙사", "생활관", "기숙"], ["나가", "나갈", "나오", "그만"], ["퇴사"]),
    (["기숙사", "생활관", "기숙"], ["들어가", "들어갈", "살", "신청"], ["입사"]),
]


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def bigrams(text: Column, pattern: str = TOKEN) -> Column:
    """The distinct pairs of neighbouring characters within tokens."""
    pairs = F.transform(
        F.filter(tokens(text, pattern), lambda t: F.length(t) > 1),
        lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))),
    )
    return F.array_distinct(F.flatten(pairs))


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def expansion_terms(text: Column) -> Column:
    """Terms to search besides the question's own, in the rules' order, without those that it already has."""
    found = [F.when(_any(text, triggers), F.array(*[F.lit(x) for x in terms])) for triggers, terms in SYNONYMS]
    found += [F.when(_any(text, contexts) & _any(text, actions), F.array(*[F.lit(x) for x in terms])) for contexts, actions, terms in CONTEXT_SYNONYMS]
    empty = F.array().cast("array<string>")
    return F.filter(F.array_distinct(F.concat(*[F.coalesce(x, empty) for x in found])), lambda t: ~F.contains(text, t))


def expanded(text: Column) -> Column:
    """The question with its expansion terms behind it."""
    terms = expansion_terms(text)
    return F.when(F.size(terms) > 0, F.concat_ws(" ", text, F.array_join(terms, " "))).otherwise(text)


def document_ids(text: Column) -> Column:
    """Document numbers named in a question; dates are not taken for numbers."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\d-])(\d{1,2}-\d{1,2}-\d{1,3})(?![\d-])"), F.lit(1)))


def articles(text: Column) -> Column:
    """Articles named in a question, without inner blanks."""
    raw = F.regexp_extract_all(text, F.lit(r"제\s*\d+\s*조(?:\s*의\s*\d+)?"), F.lit(0))
    return F.array_distinct(F.transform(raw, lambda a: F.regexp_replace(a, r"\s+", "")))
