"""Scalar expressions that several operators or their users need."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def null_for_nan(x: Column) -> Column:
    """Null where a number is not a number or infinite: what JSON can hold, and what aggregates leave out."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def binary_entropy(p: Column) -> Column:
    """In nats; 0 at 0 and 1."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log(p) - (1 - p) * F.log(1 - p))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal, one empty one shares nothing."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def noise_after(rates: Column) -> Column:
    """Rate at which a sum of bits differs after independent flips of these rates."""
    return F.aggregate(rates, F.lit(0.0), lambda q, p: q * (1 - p) + (1 - q) * p)


@F.pandas_udf(DoubleType())
def mutual_information(a: pd.Series, b: pd.Series) -> float:
    """Plug-in mutual information in nats as an aggregate of two columns, for groups that fit a task; larger ones go through ``operators.information``."""
    n = pd.crosstab(a, b).to_numpy(float)
    if not n.size:
        return 0.0
    p = n / n.sum()
    expected = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    return float((p[p > 0] * np.log(p[p > 0] / expected[p > 0])).sum())
