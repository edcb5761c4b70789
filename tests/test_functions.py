import math

from pyspark.sql import functions as F

from mutua.functions import expressions as e


def test_scalars(spark):
    row = spark.range(1).select(
        e.null_for_nan(F.lit(float("nan"))).alias("nan"),
        e.null_for_nan(F.lit(float("-inf"))).alias("inf"),
        e.null_for_nan(F.lit(1.5)).alias("kept"),
        e.half_even(F.lit(2.5)).alias("even"),
        e.binary_entropy(F.lit(0.5)).alias("h"),
        e.binary_entropy(F.lit(1.0)).alias("h1"),
        e.clip(F.lit(9.0), 0, 5).alias("clip"),
        e.set_jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("j"),
        e.set_jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("j0"),
        e.noise_after(F.array(F.lit(0.1), F.lit(0.2))).alias("q"),
    ).first()
    assert row.nan is None and row.inf is None and row.kept == 1.5 and row.even == 2
    assert math.isclose(row.h, math.log(2)) and row.h1 == 0 and row.clip == 5
    assert math.isclose(row.j, 1 / 3) and row.j0 == 1 and math.isclose(row.q, 0.1 * 0.8 + 0.9 * 0.2)


def test_information_as_an_aggregate(spark):
    rows = spark.range(100).selectExpr("id % 2 as g", "id % 4 as a", "id % 4 as b")
    got = rows.groupBy("g").agg(e.mutual_information("a", "b").alias("mi")).collect()
    assert all(math.isclose(r.mi, math.log(2)) for r in got)
