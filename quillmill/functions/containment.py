"""Whether JSON contains JSON, by value and type: objects by their keys, arrays by their elements, at any depth."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(name: str) -> str:
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"a key with both kinds of quotes: {name}")
    return f"$[{quote}{name}{quote}]"


def _holder(wanted) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(_holds(x, wanted), F.lit(False))


def _holds(found: Column, wanted) -> Column:
    """Of a VARIANT value; null where there is none."""
    kind = F.schema_of_variant(found)
    if isinstance(wanted, dict):
        keys = [F.coalesce(_holds(F.try_variant_get(found, _key(k), "variant"), v), F.lit(False)) for k, v in wanted.items()]
        out = kind.startswith("OBJECT")
        for k in keys:
            out = out & k
        return out
    if isinstance(wanted, (list, tuple)):
        out, items = kind.startswith("ARRAY"), F.try_variant_get(found, "$", "array<variant>")
        for w in wanted:
            out = out & F.coalesce(F.exists(items, _holder(w)), F.lit(False))
        return out
    if wanted is None:
        return F.is_variant_null(found)
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == wanted)
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(found, "$", "string") == wanted)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    if isinstance(wanted, int):
        return number & (F.try_variant_get(found, "$", "decimal(38,9)") == F.lit(Decimal(wanted)))
    return number & (F.try_variant_get(found, "$", "double") == float(wanted))


def json_contains(text: Column, wanted) -> Column:
    """Whether the JSON of a text column contains `wanted` (objects, lists, texts, numbers, truth values, None). Numbers are equal by value,
    7 is unlike "7"; an element of a list may be found anywhere in the array, an empty list or object in any. False for null
    and for what isn't JSON."""
    return F.coalesce(_holds(F.try_parse_json(text), wanted), F.lit(False))
