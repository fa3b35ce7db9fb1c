"""Normalisation and scoring of answers against gold answers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How answers say that they don't know.
ABSTAINING = ["모름", "모릅", "모르겠", "모르", "알 수 없", "확인할 수 없", "표에 없", "정보가 없", "포함되어 있지 않", "unknown", "don't know", "do not know"]


def _plain(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "")


def as_date(text: str | None) -> str | None:
    """The first date; the range of month and day is all that is checked."""
    body = _plain(text).replace("+", " ")
    for pattern in (r"(19\d{2}|20\d{2})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})\s*일?", r"(19\d{2}|20\d{2})(\d{2})(\d{2})"):
        found = re.search(pattern, body)
        if found and 1 <= int(found[2]) <= 12 and 1 <= int(found[3]) <= 31:
            return f"{int(found[1]):04d}-{int(found[2]):02d}-{int(found[3]):02d}"
    return None


def as_number(text: str | None) -> str | None:
    found = re.search(r"\d+(?:\.\d+)?", _plain(text).replace(",", "").replace(" ", ""))
    return found[0] if found else None


def as_percent(text: str | None) -> str | None:
    found = re.search(r"(\d+(?:\.\d+)?)\s*(?:%|퍼\s*센트)", _plain(text))
    return f"{found[1]}%" if found else None


def as_items(text: str | None) -> list[str]:
    parts = re.split(r"[·•/|;,，、\n]", _plain(text))
    return [re.sub(r"^[0-9]+[.)]\s*", "", p.strip()) for p in parts if p.strip()]


def as_text(text: str | None) -> str:
    return re.sub(r"[\s\"'`“”‘’]+", "", _plain(text).lower())


def is_correct(mode: str, gold: str, others: list[str], answer: str | None) -> bool:
    """Whether an answer is right in one of the modes date, number, percent, list, unknown and text.

    In text mode containment counts either way, so an empty answer is taken for right.
    """
    wanted, answer = [gold, *[x for x in others if x != gold]], answer or ""
    if mode in ("date", "number"):
        read = as_date if mode == "date" else as_number
        return read(answer) is not None and read(answer) in {read(w) for w in wanted}
    if mode == "percent":
        value = as_percent(answer) or (f"{as_number(answer)}%" if as_number(answer) else None)
        return value is not None and (value in {as_percent(w) for w in wanted} or any(value in _plain(w) for w in wanted))
    if mode == "list":
        most = max((as_items(w) for w in wanted), key=len)
        return set(most or [as_text(gold)]) <= set(as_items(answer)) or all(as_text(x) in as_text(answer) for x in most)
    if mode == "unknown":
        return any(as_text(m) in as_text(answer) for m in ABSTAINING)
    return any(w and (w in as_text(answer) or as_text(answer) in w) for w in map(as_text, wanted))


@F.pandas_udf(T.BooleanType())
def correct(mode: pd.Series, gold: pd.Series, others: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([is_correct(m, g, list(o) if o is not None else [], a) for m, g, o, a in zip(mode, gold, others, answer, strict=True)])
