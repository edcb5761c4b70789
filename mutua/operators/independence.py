"""Chi-square tests of conditional independence and cross-validated linear fits, both from aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutua.sqltext import Op

#: Chi-square statistic and degrees of freedom of x and y in each stratum (keys, z) of at least 5 rows; tables of two by two are corrected by half a count.
CHI_SQUARE = Op("""
WITH c AS (SELECT keys, z, x, y, CAST(count(*) AS DOUBLE) AS n FROM {observed} GROUP BY keys, z, x, y),
xs AS (SELECT keys, z, x, sum(n) AS nx FROM c GROUP BY keys, z, x), ys AS (SELECT keys, z, y, sum(n) AS ny FROM c GROUP BY keys, z, y),
s AS (SELECT keys, z, sum(n) AS total, count(DISTINCT x) AS kx, count(DISTINCT y) AS ky FROM c GROUP BY keys, z),
t AS (SELECT s.keys, s.z, total, kx, ky, nx * ny / total AS e, coalesce(c.n, CAST(0 AS DOUBLE)) AS o FROM s JOIN xs ON xs.keys = s.keys AND xs.z = s.z JOIN ys ON ys.keys = s.keys AND ys.z = s.z
  LEFT JOIN c ON c.keys = s.keys AND c.z = s.z AND c.x = xs.x AND c.y = ys.y WHERE total >= 5 AND kx > 1 AND ky > 1)
SELECT keys, z, CAST(max((kx - 1) * (ky - 1)) AS BIGINT) AS dof, sum(power(abs(o - e) - CASE WHEN kx = 2 AND ky = 2 THEN least(DBL(0.5), abs(o - e)) ELSE 0 END, 2) / e) AS chi2 FROM t GROUP BY keys, z
""")


def chi_square_tail(x: float, dof: int) -> float:
    """P(chi-square of ``dof`` degrees of freedom > x): a finite sum, with the complementary error function for odd ones."""
    if x <= 0:
        return 1.0
    h = x / 2
    if dof % 2 == 0:
        return min(1.0, sum(math.exp(k * math.log(h) - h - math.lgamma(k + 1)) for k in range(dof // 2)))
    return min(1.0, math.erfc(math.sqrt(h)) + sum(math.exp((k - 0.5) * math.log(h) - h - math.lgamma(k + 0.5)) for k in range(1, dof // 2 + 1)))


def conditional_independence(observed: DataFrame) -> DataFrame:
    """Smallest p over the strata of each key, and how many strata were tested."""

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"keys": rows["keys"], "p": [chi_square_tail(x, int(d)) for x, d in zip(rows["chi2"], rows["dof"])]})

    tested = CHI_SQUARE(observed=observed).mapInPandas(tails, "keys string, p double")
    return tested.groupBy("keys").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("strata"))


def cross_validated_r2(rows: DataFrame, y: str, xs: list[str], grp: str, key: str, folds: int = 5) -> DataFrame:
    """R squared of linear fits on rows of other folds, by group; folds come from a hash of ``key``.

    Each fold is reduced to sums of products by one aggregate; the fits see only those.
    """
    names = ["__one", *xs, y]
    values = rows.select(F.col(grp).cast("string").alias("grp"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold"), F.lit(1.0).alias("__one"), *[F.col(c).cast("double").alias(c) for c in [*xs, y]]).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = values.groupBy("grp", "fold").agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in pairs])

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        n = len(names)
        m = np.zeros((len(table), n, n))
        for i, j in pairs:
            m[:, i, j] = m[:, j, i] = table[f"m{i}_{j}"]
        total, left, spread = m.sum(0), 0.0, 0.0
        for k in range(len(table)):
            train = total - m[k]
            if train[0, 0] < n:
                continue
            b = np.append(-np.linalg.lstsq(train[:-1, :-1], train[:-1, -1], rcond=None)[0], 1)
            left += b @ m[k] @ b
            mean = train[0, -1] / train[0, 0]
            spread += m[k][-1, -1] - 2 * mean * m[k][0, -1] + mean * mean * m[k][0, 0]
        return pd.DataFrame({"grp": [table["grp"].iloc[0]], "n": [int(total[0, 0])], "r2": [1 - left / spread if spread > 1e-12 else 0.0]})

    return sums.groupBy("grp").applyInPandas(fit, "grp string, n long, r2 double")
