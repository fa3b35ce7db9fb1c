"""Templates, redaction, model answers, token counts and cover density."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date format letters and what stands for them, in the order in which they are replaced.
FORMAT_LETTERS = [
    ("yyyy", "%Y"), ("yy", "%y"), ("y", "%Y"), ("MMMM", "%B"), ("MMM", "%b"), ("MM", "%m"), ("M", "%m"), ("dddd", "%A"), ("ddd", "%a"), ("dd", "%d"), ("d", "%d"), ("HH", "%H"), ("H", "%H"),
    ("hh", "%I"), ("h", "%I"), ("mm", "%M"), ("m", "%M"), ("ss", "%S"), ("s", "%S"), ("fff", "%f"), ("ff", "%f"), ("f", "%f"), ("tt", "%p"), ("t", "%p"),
]


def strftime_format(pattern: str) -> str:
    """A date format of letters as one for strftime. Letters followed by other letters are left alone."""
    for letters, code in FORMAT_LETTERS:
        pattern = re.sub(rf"(?<!%){letters}(?![a-zA-Z])", code, pattern)
    return pattern


def render(template: Column, now: Column, values: dict[str, Column]) -> Column:
    """Fill `{{name}}` from the values and `{{now}}` from the given moment."""
    filled = F.replace(template, F.lit("{{now}}"), F.date_format(now, "yyyy-MM-dd HH:mm:ss"))
    for name, value in values.items():
        filled = F.replace(filled, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return filled


def host_class(value: Column, containers: list[str]) -> Column:
    """What kind of host an address names, without naming it; the scheme stays."""
    scheme = F.regexp_extract(value, r"^([^:/]*://)", 1)
    host = F.regexp_extract(value, r"^(?:[^:/]*://)?([^/:]*)", 1)
    kind = (
        F.when(host.isin(containers), F.concat(F.lit("container:"), host)).when(host.isin("localhost", "127.0.0.1"), "localhost")
        .when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(host.rlike(r"^(10\.|127\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.)"), "private-ip").otherwise("public-ip"))
        .when(F.contains(host, F.lit(".")), "public-host").otherwise("name")
    )
    return F.when(F.coalesce(value, F.lit("")) == "", "empty").otherwise(F.concat(scheme, kind))


def redact(mode: Column, value: Column, containers: list[str]) -> Column:
    """plain: the value; presence: set or unset; shape: its kind of host; otherwise nothing."""
    filled = F.coalesce(value, F.lit("")) != ""
    return F.when(mode == "plain", value).when(mode == "presence", F.when(filled, "set").otherwise("unset")).when(mode == "shape", host_class(value, containers))


def comparable(path: Column, prefixes: list[str], suffixes: list[str], excluded: list[str]) -> Column:
    """Paths that are compared: under a prefix, without a volatile suffix, not listed as duplicates."""
    under = F.lit(False)
    for p in prefixes:
        under = under | path.startswith(p)
    for s in suffixes:
        under = under & ~path.endswith(s)
    return under & ~path.isin(excluded)


def token_counts(prompt: Column, cached: Column, completion: Column, reasoning: Column, total: Column) -> Column:
    """A struct of input, cached, output and reasoning tokens. Output always includes reasoning: where the total shows that
    it doesn't yet, it is added; where reasoning isn't given, what the total has beyond is taken for it."""
    p, c, r, t, k = (F.coalesce(x, F.lit(0)) for x in (prompt, completion, reasoning, total, cached))
    beyond = t - p - c
    hidden = F.when((r == 0) & (beyond > 0), beyond).otherwise(r)
    added = F.when((r > 0) & (t >= p + c + r), r).when((r == 0) & (beyond > 0), beyond).otherwise(0)
    return F.struct(p.alias("input"), k.alias("cached"), (c + added).alias("output"), hidden.alias("reasoning"))


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace; an empty object if there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(found == "", "{}").otherwise(found)


def clean_answer(text: Column) -> Column:
    """A model's answer without its thoughts and turn marks."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<thought>.*?</thought>|<end_of_turn>|<eos>|<turn\|>|<start_of_turn>", ""))


def answer_value(text: Column) -> Column:
    """The value of the first `label: value` line, else the whole answer."""
    found = F.regexp_extract(text, r"(?m)^\s*(?:날짜|값|답)\s*[:：]\s*(.+)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(F.trim(text))


def flatten_json(value, path: str = "") -> dict[str, str]:
    """Nested objects as dotted paths, list items by their index: a[0].b. Empty lists and objects stay as they are."""
    import json

    inner: list[tuple[str, object]] = []
    if isinstance(value, dict):
        inner = [(f"{path}.{k}" if path else str(k), value[k]) for k in sorted(value)]
    elif isinstance(value, list):
        inner = [(f"{path}[{i}]", v) for i, v in enumerate(value)]
    if inner:
        return {p: x for at, v in inner for p, x in flatten_json(v, at).items()}
    if value == {} and not path:
        return {}
    return {path: json.dumps(value, sort_keys=True, ensure_ascii=False) if isinstance(value, (list, dict, bool)) or value is None else str(value)}


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flat_paths(documents: pd.Series) -> pd.Series:
    """Objects of any depth; Spark's own JSON functions need a schema."""
    import json

    return documents.map(lambda d: flatten_json(json.loads(d)) if d else {})


def decode_bytes(raw: bytes | None) -> str | None:
    """Text of unknown encoding by a cascade; zero bytes go, and so does white space at both ends."""
    for encoding in ("utf-8", "utf-8-sig", "cp949", "euc-kr", "latin-1"):
        try:
            return (raw or b"").decode(encoding).replace("\x00", "").strip() or None
        except UnicodeDecodeError:
            continue
    return None


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(decode_bytes)


def cover_density(tokens: list[str], terms: list[str]) -> float:
    """Sum over minimal spans that hold all terms of 1 / (1 + words in them beyond the terms): an approximation of
    full-text search's cover density rank with equal weights."""
    wanted = set(terms)
    if not wanted:
        return 0.0
    last: dict[str, int] = {}
    total, before = 0.0, -1
    for i, t in enumerate(tokens):
        if t in wanted:
            last[t] = i
            if len(last) == len(wanted):
                start = min(last.values())
                if start > before:
                    total += 1.0 / (1 + (i - start + 1 - len(wanted)))
                    before = start
    return total


def cover_density_of(terms: list[str]) -> Callable:
    @F.pandas_udf("double")
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: cover_density(list(t), terms))

    return run
