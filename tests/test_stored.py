"""Stored counters: nine measures, replays and a compaction that change nothing, first rows and last ratings."""

import datetime

from pyspark.sql import functions as F

from lodestone.streaming import stored

E = "ts timestamp, kind string, consumed boolean, usd double, identity string"
ROWS = [
    (datetime.datetime(2026, 6, 30, 10), "model", None, None, "u"),
    (datetime.datetime(2026, 6, 30, 11), "fallback", None, None, "u"),
    (datetime.datetime(2026, 6, 30, 12), "fallback", True, None, None),
    (datetime.datetime(2026, 7, 1, 9), "model", True, 0.5, "v"),
    (datetime.datetime(2026, 7, 1, 9), None, None, None, "v"),
    (None, "model", None, None, "u"),
]


def totals(df):
    return {tuple(r[k] for k in stored.KEY): tuple(round(r[m], 6) for m in stored.MEASURES) for r in df.collect()}


def test_nine_measures(spark):
    got = totals(stored.usage(spark.createDataFrame(ROWS, E)))
    assert got == {
        ("day", "2026-06-30", "global", "all"): (1, 2, 2, 3, 3, 3072, 24, 3, 0.002),
        ("month", "2026-06", "global", "all"): (1, 2, 2, 3, 3, 3072, 24, 3, 0.002),
        ("day", "2026-06-30", "device", "u"): (1, 1, 1, 2, 0, 0, 0, 2, 0.001),
        ("day", "2026-07-01", "global", "all"): (1, 1, 0, 2, 2, 2048, 16, 2, 0.5),
        ("month", "2026-07", "global", "all"): (1, 1, 0, 2, 2, 2048, 16, 2, 0.5),
        ("day", "2026-07-01", "device", "v"): (1, 1, 0, 2, 0, 0, 0, 2, 0.5),
    }


def test_replays_and_compaction_change_nothing(spark, tmp_path):
    path, sink = str(tmp_path / "c"), None
    sink = stored.counters_sink(path)
    parts = [spark.createDataFrame(ROWS[k : k + 2], E) for k in (0, 2, 4)]
    want = totals(stored.usage(spark.createDataFrame(ROWS, E)))
    for n, p in enumerate(parts):
        sink(p, n)
        sink(p, n)
    assert totals(stored.counters(spark, path)) == want
    stored.compacted(spark, path)
    assert totals(stored.counters(spark, path)) == want
    sink(parts[2], 2)  # a replay of what the base holds
    assert totals(stored.counters(spark, path)) == want
    sink(parts[0], 3)
    assert totals(stored.counters(spark, path))["day", "2026-06-30", "device", "u"] == (2, 2, 2, 4, 0, 0, 0, 4, 0.002)


def test_a_stream_that_starts_anew(spark, tmp_path):
    spark.createDataFrame(ROWS, E).repartition(3).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "c")
    for _ in range(2):  # without its checkpoint the second run replays every batch under the same numbers
        run = spark.readStream.schema(E).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(stored.counters_sink(path)).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert totals(stored.counters(spark, path)) == totals(stored.usage(spark.createDataFrame(ROWS, E)))


def test_first_rows_and_last_ratings(spark, tmp_path):
    keep = stored.rows_sink(str(tmp_path / "e"))
    keep(spark.createDataFrame([("m", "old"), ("n", "x"), (None, "a"), (None, "a")], "message_id string, q string"), 0)
    keep(spark.createDataFrame([("m", "new")], "message_id string, q string"), 1)
    keep(spark.createDataFrame([("m", "new")], "message_id string, q string"), 1)
    events = stored.first_rows(spark, str(tmp_path / "e"))
    assert sorted(map(tuple, events.collect()), key=str) == sorted([("m", "old"), ("n", "x"), (None, "a"), (None, "a")], key=str)
    rate = stored.rows_sink(str(tmp_path / "r"))
    t = datetime.datetime(2026, 1, 1)
    rate(spark.createDataFrame([("m", t, "up"), ("m", t.replace(year=2025), "down")], "message_id string, ts timestamp, rating string"), 0)
    rate(spark.createDataFrame([("n", t, "up"), ("n", t, "down"), (None, t, "up")], "message_id string, ts timestamp, rating string"), 1)
    rate(spark.createDataFrame([("m", t.replace(year=2024), "down")], "message_id string, ts timestamp, rating string"), 2)
    got = stored.with_ratings(events, stored.stored_ratings(spark, str(tmp_path / "r"))).filter("message_id is not null")
    assert sorted((r.message_id, r.rating) for r in got.collect()) == [("m", "down"), ("n", "up")]
