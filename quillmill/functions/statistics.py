"""Intervals and paired tests."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """A struct of rate, low and high; zeros without observations."""
    n = F.nullif(n, F.lit(0))
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    zero = F.lit(0.0)
    seen = lambda c: F.when(n.isNotNull(), c).otherwise(zero)
    return F.struct(seen(p).alias("rate"), seen(F.greatest(zero, middle - half)).alias("low"), seen(F.least(F.lit(1.0), middle + half)).alias("high"))


def mcnemar_p(b: int, c: int) -> float:
    """The exact two-sided p of McNemar's test for b and c discordant pairs."""
    n, k = b + c, max(b, c)
    if not n:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(k, n + 1))
    return min(1.0, 2 * tail / 2**n)


@F.pandas_udf(T.DoubleType())
def mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(x), int(y)) for x, y in zip(b, c, strict=True)])


def bootstrap(values: list[float], draws: int = 10_000, seed: int = 20260812) -> tuple[float, float, float]:
    """Mean and 95 % interval of the means of redrawn samples; the same for the same values in the same order."""
    if not values:
        return 0.0, 0.0, 0.0
    n, source = len(values), random.Random(seed)
    means = sorted(sum(values[source.randrange(n)] for _ in range(n)) / n for _ in range(draws))
    return sum(values) / n, means[int(0.025 * draws)], means[int(0.975 * draws) - 1]


def kappa(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Cohen's kappa of two raters of a yes/no question: pairs of two yes, yes of each, pairs in all."""
    agreed = (both + (n - a - b + both)) / n
    expected = (a / n) * (b / n) + (1 - a / n) * (1 - b / n)
    return F.when(expected >= 1, 1.0).otherwise((agreed - expected) / (1 - expected))
