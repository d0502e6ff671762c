"""Ladder reservations against a sequential fold, batch and stream, and the cases that they are made for."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ladder as La

Q = "request_id long, scope string, ts timestamp, tokens double, excluded array<string>, undo long"


def at(text):
    return datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc)


def models(spark, rows, **more):
    df = spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], Q)
    return {r.request_id: (r.model, r.day, r.day_count, r.day_tokens) for r in La.reserved(df, **more).collect()}


def test_first_rung_that_has_room(spark):
    got = models(spark, [(1, "s", at("2026-06-30T10:05:58"), 2999.2), (2, "s", at("2026-06-30T10:06:00")), (3, "s", at("2026-06-30T10:06:02"), None, ["gemini-2.5-flash-lite", "gemini-3-flash-preview"]), (4, "s", at("2026-06-30T10:06:02"), 1.0, [r.model for r in La.LADDER])])
    assert got[1] == ("gemini-3.1-flash-lite", "2026-06-30", 1, 3000)
    assert got[2][0] == "gemini-2.5-flash-lite"  # two seconds after the last one, four are needed
    assert got[3][:1] == ("gemini-3.1-flash-lite",) and got[4][0] is None


def test_days_are_pacific_and_run_out(spark):
    one = (La.Rung("a", 60, 2), La.Rung("b", 60, 1))
    rows = [(i, "s", at("2026-06-30T06:30:00") + datetime.timedelta(minutes=i)) for i in range(4)] + [(9, "s", at("2026-06-30T07:00:00"))]
    got = models(spark, rows, ladder=one)
    assert [got[i][0] for i in range(4)] == ["a", "a", "b", None] and got[0][1] == "2026-06-29"
    assert got[9] == ("a", "2026-06-30", 1, 0)


def test_spacing_goes_over_midnight(spark):
    one = (La.Rung("a", 1, 5),)
    got = models(spark, [(1, "s", at("2026-06-30T23:59:40")), (2, "s", at("2026-07-01T00:00:10")), (3, "s", at("2026-07-01T00:00:40"))], ladder=one, zone="UTC")
    assert [got[i][0] for i in (1, 2, 3)] == ["a", None, "a"]


def test_undo_gives_the_day_back_but_not_the_spacing(spark):
    one = (La.Rung("a", 1, 1),)
    t = at("2026-06-30T10:00:00")
    rows = [(1, "s", t, 7.0), (2, "s", t + datetime.timedelta(seconds=5), None, None, 1), (3, "s", t + datetime.timedelta(seconds=10)), (4, "s", t + datetime.timedelta(seconds=60), 2.0), (5, "s", t + datetime.timedelta(seconds=61), None, None, 1), (6, "s", t + datetime.timedelta(seconds=62), None, None, 3)]
    got = models(spark, rows, ladder=one)
    assert got[1] == ("a", "2026-06-30", 1, 7) and got[2] == ("a", "2026-06-30", 0, 0)
    assert got[3][0] is None and got[4] == ("a", "2026-06-30", 1, 2) and got[5][0] is None and got[6][0] is None


def test_ladders_in_another_order():
    assert [r.model for r in La.ordered(La.LADDER, ["x", "gemini-2.5-flash", "x"])][:3] == ["x", "gemini-2.5-flash", "gemini-3.1-flash-lite"]
    assert La.ordered(La.LADDER, ["x"])[0] == La.Rung("x", 1, 1) and len(La.ordered(La.LADDER, ["gemini-2.5-flash"])) == 5


def random_rows(seed, n=600):
    r = random.Random(seed)
    now, rows = at("2026-06-29T20:00:00"), []
    for i in range(n):
        now += datetime.timedelta(milliseconds=r.choice([0, 500, 3000, 20_000, 400_000]))
        undo = r.randrange(max(1, i)) if r.random() < 0.2 else None
        rows.append((i, r.choice(["s", "s", "t", None] if r.random() < 0.1 else ["s", "s", "t"]), now if r.random() < 0.98 else None, r.choice([None, -4.0, 2.5, 10.0]), r.choice([None, [], ["a"], ["b", "c"]]), undo))
    return rows


RUNGS = (La.Rung("a", 20, 9), La.Rung("b", 3, 30), La.Rung("c", 1, 12))


def sequential(rows):
    """{id: (model, count, tokens)} by plain dictionaries."""
    counts, tokens, last, open_, out = {}, {}, {}, {}, {}
    for i, scope, ts, t, excluded, undo in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[1], r[2], r[0])):
        day = (ts - datetime.timedelta(hours=7)).date()  # summer
        t, out[i] = max(0, math.ceil(t or 0)), (None, None, None)
        if undo is not None:
            model, d, n = open_.pop((scope, undo), (None, None, 0))
            if model and d == day:
                counts[scope, model, d] -= 1
                tokens[scope, model, d] -= n
                out[i] = (model, counts[scope, model, d], tokens[scope, model, d])
            continue
        for r in RUNGS:
            k = (scope, r.model, day)
            if r.model not in (excluded or []) and counts.get(k, 0) < r.rpd and (ts - last.get((scope, r.model), at("2000-01-01"))).total_seconds() * 1000 >= math.ceil(60_000 / r.rpm):
                counts[k], tokens[k], last[scope, r.model] = counts.get(k, 0) + 1, tokens.get(k, 0) + t, ts
                open_[scope, i] = (r.model, day, t)
                out[i] = (r.model, counts[k], tokens[k])
                break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_sequential_fold(spark, seed):
    rows = random_rows(seed)
    got = {r.request_id: (r.model, r.day_count, r.day_tokens) for r in La.reserved(spark.createDataFrame(rows, Q).repartition(5), RUNGS).collect()}
    want = sequential(rows)
    assert len(got) == len(rows) and all(got[i] == want.get(i, (None, None, None)) for i in got)
    assert {m for m, *_ in got.values()} == {"a", "b", "c", None}


def test_stream_equals_batch(spark, tmp_path):
    rows = [r for r in random_rows(4, 300) if r[1] and r[2]]
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], Q).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(Q).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = La.reserved_stream(stream, RUNGS).writeStream.format("memory").queryName("ladder").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(180)
    key = ["request_id", "model", "day", "day_count", "day_tokens", "undone"]
    got = sorted(map(tuple, spark.table("ladder").select(key).collect()), key=str)
    assert got == sorted(map(tuple, La.reserved(spark.createDataFrame(rows, Q), RUNGS).select(key).collect()), key=str)


def test_windows_hold_what_is_left(spark):
    rows = random_rows(5)
    done = La.reserved(spark.createDataFrame(rows, Q), RUNGS)
    left = {(r.scope, r.model, r.day): r.requests for r in La.windows(done).collect()}
    last = {}
    for r in sorted(done.join(spark.createDataFrame(rows, Q).select("request_id", "ts"), "request_id").filter("model is not null").collect(), key=lambda r: (r.ts, r.request_id)):
        last[r.scope, r.model, r.day] = r.day_count
    assert left == last and La.reserved(spark.createDataFrame([], Q)).count() == 0
    assert spark.range(1).select(La.excluded_by(F.array(F.lit("a"), F.lit(None), F.lit("a")))).first()[0] == ["a"]
