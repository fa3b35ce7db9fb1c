"""Language by script, and labels in model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.binding import let

# Letters that only Vietnamese has among the languages told apart, languages, and intents.
VIETNAMESE = "ăâđêôơưĂÂĐÊÔƠƯàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ"
LANGUAGES = ["ko", "en", "zh", "vi"]
INTENTS = ["academic", "career", "personal", "document", "emotion", "small_talk", "abuse", "unknown"]


def count_of(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def language_by_script(text: Column) -> Column:
    """Korean if its letters, counted three times, are as many as Latin ones; then Vietnamese, Chinese, English; else Korean.
    ASCII goes in runs first, so that the classes of letters meet only what is left; Latin letters are counted beside Korean ones alone."""
    text = F.coalesce(text, F.lit(""))
    korean, latin = "가-힣ㄱ-ㆎ", "A-Za-z"

    def decided(rest: Column) -> Column:
        mostly = F.rlike(rest, F.lit(f"[{korean}]")) & (count_of(rest, korean) * 3 >= count_of(text, latin))
        found = F.when(mostly, "ko").when(F.rlike(rest, F.lit(f"[{VIETNAMESE}]")), "vi").when(F.rlike(rest, F.lit("[一-鿿]")), "zh")
        return found.when(F.rlike(text, F.lit(f"[{latin}]")), "en").otherwise("ko")

    return let(F.regexp_replace(text, r"[\x00-\x7f]+", ""), decided)


def parse_intent(answer: Column) -> Column:
    """The intent that an answer names; longer names first; unknown if none."""
    lowered = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    found = F.lit("unknown")
    for name in sorted(INTENTS, key=lambda x: (len(x), x)):
        found = F.when(F.contains(lowered, F.lit(name)), name).otherwise(found)
    return F.when(lowered.isin(INTENTS), lowered).otherwise(found)


def parse_language(answer: Column) -> Column:
    """The language after the first bar of an `intent|language` line, if it is a known one."""
    line = F.get(F.filter(F.transform(F.split(F.lower(answer), "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    named = F.btrim(F.get(F.split(line, r"\|", 2), F.lit(1)), F.lit(" .`\"'"))
    return F.when(named.isin(LANGUAGES), named)


def resolve_language(requested: Column, session: Column) -> Column:
    """The requested language, else the session's; `auto` stands for none and is not passed on."""
    return F.coalesce(F.when(requested.isNotNull() & (requested != "auto"), requested), F.when(requested.isNull() & (session != "auto"), session))
