"""Keywords of questions: tokens, endings and stop words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles cut off at the end of a token, longer ones first.
PARTICLES = [
    "에서부터", "으로부터", "에게서", "한테서", "이라고", "이라는", "으로서", "으로써",
    "에서는", "에게는", "에서도", "에게도", "까지는", "부터는", "께서는",
    "라고", "라는", "까지", "부터", "에서", "에게", "한테", "처럼", "보다", "으로",
    "이나", "이란", "이든", "든지", "밖에", "조차", "마저", "마다", "께서", "이라",
    "은", "는", "이", "가", "을", "를", "의", "에",
]

# Words that are not counted.
STOP_WORDS = [
    "그것", "이것", "저것", "무엇", "어디", "언제", "어떤", "무슨", "어떻게", "얼마",
    "그리고", "그러나", "하지만", "그런데", "그래서", "또는", "그럼", "만약",
    "있나요", "있는지", "있습니다", "있어요", "없나요", "없는지", "됩니다", "되나요",
    "인가요", "입니다", "합니다", "하나요", "해주세요", "알려주세요", "알려줘",
    "궁금합니다", "궁금해요", "부탁드립니다", "안녕하세요", "감사합니다",
    "언제인가요", "무엇인가요", "어디인가요", "가능한가요", "있을까요", "해야하나요",
    "대해", "대한", "관련", "위해", "하는", "하고", "해서", "때문", "경우", "가능",
    "저는", "제가", "우리", "정말", "진짜", "혹시", "다시", "너무", "좀더",
    "the", "and", "for", "you", "are", "how", "what", "when", "where", "which",
    "that", "this", "with", "can", "please", "tell", "about",
]


def tokens_of(text: Column) -> Column:
    """Tokens between white space, in lower case."""
    return F.split(F.lower(text), r"[ \t\n\r\x0b\x0c]+")


def keyword(token: Column) -> Column:
    """The token's letters and digits without a trailing particle (from 3 characters on); null if it doesn't count."""
    base = F.regexp_replace(token, r"[^\p{L}\p{N}]+", "")
    word = F.when(F.length(base) >= 3, F.regexp_replace(base, f"({'|'.join(PARTICLES)})$", "")).otherwise(base)
    return F.when((F.length(word) > 1) & ~word.isin(STOP_WORDS), word)
