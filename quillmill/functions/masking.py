"""Masking of personal data, guardrails and word filters."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.binding import let

# The rules that come with the engine, in the order in which they are applied: name, pattern, method, replacement.
MASKING_RULES = [
    ("학번", r"(?<!\d)\d{8}(?!\d)", "partial", "****"),
    ("전화번호", r"01[0-9]-?\d{3,4}-?\d{4}", "middle", "****"),
    ("이메일", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "partial", "****"),
    ("주민등록번호", r"\d{6}-?\d{7}", "full", "******-*******"),
]

# Guardrails by priority: priority, direction, pattern, action, message or replacement.
GUARDRAILS = [
    (10, "input", r"(?i)(ignore (all )?previous|system prompt|you are now|jailbreak|DAN mode|forget (your )?instructions|역할.?무시|이전.?지시.?무시|시스템.?프롬프트)", "block", "학사·취업 안내 목적의 질문만 도와드릴 수 있습니다. 다른 요청은 처리할 수 없습니다."),
    (20, "input", r"(?i)(시발|씨발|ㅅㅂ|ㅆㅂ|병신|개새|좆|지랄|fuck|shit|bitch)", "block", "부적절한 표현이 포함되어 있어 답변할 수 없습니다. 학사·취업 관련 질문을 다시 입력해 주세요."),
    (30, "input", r"(?i)(다른\s*사람|타인|남의).{0,24}(학번|주민|전화|성적|개인정보)", "block", "타인의 개인정보는 조회·제공할 수 없습니다. 본인 관련 학사 문의는 학사지원팀에 문의해 주세요."),
    (40, "output", r"\d{6}-?\d{7}", "replace", "******-*******"),
    (50, "output", r"01[0-9]-?\d{3,4}-?\d{4}", "replace", "010-****-****"),
]


def masked(found: Column, method: str, replacement: str | None = "****") -> Column:
    """A match without what must not be seen: nothing of it is left (`full`), or its ends; of an address the first letter of
    the local part and the domain."""
    by, n = F.lit(replacement or "****"), F.length(found)
    if method == "full":
        return by
    third = F.floor(n / 3).cast("int")
    shortest, head, tail = (4, F.least(third, F.lit(3)), F.least(third, F.lit(4))) if method == "middle" else (2, F.when(n < 6, 1).otherwise(2), F.when(n < 8, 1).otherwise(2))
    ends = F.concat(F.left(found, head), by, F.right(found, tail))
    if method != "middle":
        initial = F.regexp_extract(found, r"(?s)\A([^@])[^@]", 1)  # empty if the local part has one letter at most
        ends = F.when(F.contains(found, F.lit("@")), F.concat(initial, by, F.regexp_extract(found, r"(?s)\A[^@]*(@.*)", 1))).otherwise(ends)
    return F.when(n > shortest, ends).when(n > 0, by).otherwise(found)


@functools.cache
def usable_pattern(pattern: str) -> bool:
    """Whether the JVM takes the pattern, asked once for each, without a job; one that matches nothing at all has no place to mask."""
    try:
        return not SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern).matcher("").lookingAt()
    except IllegalArgumentException:
        return False


def apply_rule(pattern: str, method: str, replacement: str):
    """What stands between the matches of a text, and the matches masked, put together in turn."""
    pattern = f"(?U){pattern}"

    def run(text: Column) -> Column:
        hidden = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: masked(found, method, replacement))
        parts = F.zip_with(F.split(text, pattern), hidden, lambda between, m: F.concat(between, F.coalesce(m, F.lit(""))))
        return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)

    return run


def apply_rules(text: Column, rules: Sequence[tuple[str, str, str, str]]) -> Column:
    """All rules one after the other; a rule whose pattern is invalid is passed over."""
    for _, pattern, method, replacement in rules:
        if usable_pattern(pattern):
            text = let(text, apply_rule(pattern, method, replacement))
    return text


def masker(rules: Sequence[tuple[str, str, str, str]] = MASKING_RULES):
    """The rules as a function of columns."""
    return lambda text: apply_rules(F.col(text) if isinstance(text, str) else text, rules)


def mask_native(text: Column) -> Column:
    """The rules that come with the engine as regular expressions of the JVM, for tables where Python is too slow.

    Their matches have few lengths, so each length's mask is a replacement of its own.
    """
    text = F.regexp_replace(text, r"(?<!\d)(\d{2})\d{4}(\d{2})(?!\d)", "$1****$2")
    text = F.regexp_replace(text, r"(01[0-9])-\d{3,4}-\d(\d{3})|(01[0-9])\d{3,4}-?\d(\d{3})|(01[0-9])-\d{3,4}\d(\d{3})", "$1$3$5****$2$4$6")
    text = F.regexp_replace(text, r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1****@$2")
    return F.regexp_replace(text, r"\d{6}-?\d{7}", "******-*******")


def guardrail(text: Column, direction: str) -> Column:
    """For inputs the message of the first blocking rule that matches, or null; for outputs the text after all replacements."""
    rules = [r for r in sorted(GUARDRAILS) if r[1] == direction]
    if direction == "output":
        for _, _, pattern, _, replacement in rules:
            text = F.regexp_replace(text, pattern, replacement)
        return text
    found = F.lit(None).cast("string")
    for _, _, pattern, _, message in reversed(rules):
        found = F.when(text.rlike(pattern), F.lit(message)).otherwise(found)
    return found


def first_word(text: Column, words: list[str]) -> Column:
    """The first of the words that the text contains, in lower case; null if none."""
    listed = F.array(*[F.lit(w.strip().lower()) for w in words if w.strip()])
    return F.get(F.filter(listed, lambda w: F.contains(F.lower(text), w)), F.lit(0))
