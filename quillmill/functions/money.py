"""Model costs and changes between periods, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usage_cost(kind: Column, usage: dict[str, Column], price: dict[str, Column], requests: Column) -> Column:
    """Expected cost: prices are for a million tokens (a thousand requests for ranking). Unknown kinds and missing prices: 0."""
    part = lambda name: F.coalesce(usage[name], F.lit(0)) * F.coalesce(price[name], F.lit(0.0))
    text = (part("input_tokens") + part("cached_input_tokens") + part("output_tokens")) / 1e6
    vector = (part("single_tokens") + part("batch_tokens")) / 1e6
    ranked = requests / 1e3 * F.coalesce(price["searches"], F.lit(0.0))
    return F.when(kind == "text_generation", text).when(kind == "embedding", vector).when(kind == "rerank", ranked).otherwise(0.0)


def percent_change(now: Column, before: Column) -> Column:
    """In percent to two places; 0 if there was nothing before."""
    return F.when(F.coalesce(before, F.lit(0)) == 0, 0.0).otherwise(F.bround((now - before) / F.nullif(before, F.lit(0)) * 100, 2))


def nearest_rank(values: Column, percent: float) -> Column:
    """The element of the sorted array at the rank (n - 1) * percent / 100, rounded half to even."""
    at = F.bround((F.size(values) - 1) * F.lit(percent) / 100.0, 0).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.greatest(at, F.lit(1))))
