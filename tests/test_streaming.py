"""Streams against their batch twins."""

import pandas as pd

from mutua.streaming import windows


def _run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).toPandas()


def _stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "events")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(folder)
    return events, windows.ticks(spark, folder, events.schema, "parquet", per_trigger=1)


def test_windows_equal_the_batch(spark, sf_dir, tmp_path):
    events, stream = _stream(spark, sf_dir, tmp_path)
    got = _run(windows.windowed_counts(stream, late="40 days"), "w", "complete")
    want = windows.windowed_counts(events).toPandas()
    key = ["start", "event_type"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))


def test_smoothed_levels(spark, sf_dir, tmp_path):
    events, stream = _stream(spark, sf_dir, tmp_path)
    got = _run(windows.smoothed_levels(stream), "levels").set_index("event_id").level
    for _, rows in events.toPandas().sort_values(["ts", "event_id"]).groupby("user_id"):
        level = None
        for event_id, v in zip(rows.event_id, rows.value):
            level = v if level is None else 0.7 * level + 0.3 * v
            assert abs(got[event_id] - level) < 1e-9


def test_information_of_counts(spark):
    rows = [(0, 0, 10), (0, 1, 0), (1, 1, 10)]
    counts = spark.createDataFrame([("s", a, b, n) for a, b, n in rows if n], "start string, a int, b int, n long")
    assert abs(windows.information(counts).first().mi - 0.6931471805599453) < 1e-12
