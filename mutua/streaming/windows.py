"""Streaming forms of the window operators; each has a batch twin that gives the same rows.

Event time is cast to TIMESTAMP: a watermark does not take timestamps without a zone.
State is bounded by the watermark, or by the number of keys where a function keeps one number for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def ticks(spark: SparkSession, folder: str, schema: StructType | str, form: str = "json", per_trigger: int = 64) -> DataFrame:
    """A stream of the files that appear in a folder, with an explicit schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(form).load(folder)


def event_time(events: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn(column, F.col(column).cast("timestamp"))
    return timed.withWatermark(column, late) if events.isStreaming else timed


def windowed_counts(events: DataFrame, width: str = "1 day", step: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by sliding window and event type; rows later than the watermark are left out by a stream."""
    w = F.window("ts", width, step or width)
    out = event_time(events, late=late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def activity_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    out = event_time(events, late=late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def pair_counts(bins: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Running contingency counts of (a, b) by window: mutual information of a stream is a function of these."""
    out = event_time(bins, late=late).groupBy(F.window("ts", width).alias("w"), "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "a", "b", "n")


def information(counts: DataFrame) -> DataFrame:
    """Plug-in mutual information of each window's counts; for ``foreachBatch`` or the batch twin."""
    by = lambda *c: F.sum("n").over(Window.partitionBy("start", *c)).cast("double")
    terms = counts.select("start", "n", by().alias("all"), by("a").alias("na"), by("b").alias("nb"))
    return terms.groupBy("start").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"))


def _smooth(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, share: float) -> Iterator[pd.DataFrame]:
    level, n = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one key's rows of one trigger
    levels = []
    for v in rows["value"]:
        level = v if level is None else (1 - share) * level + share * v
        n += 1
        levels.append(level)
    state.update((level, n))
    yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "level": levels})


def smoothed_levels(events: DataFrame, share: float = 0.3) -> DataFrame:
    """Exponentially smoothed value of each user after each event; the state is one level and a count per user."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    run = lambda key, batches, state: _smooth(key, batches, state, share)
    return timed.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, level double", "level double, n long", "append", GroupStateTimeout.NoTimeout)
