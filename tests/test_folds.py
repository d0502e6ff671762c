"""Admission folds and text functions on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import admission, ingest, retrieval
from lodestone.sources import files
from lodestone.streaming import counters


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_arabic_folding(spark):
    assert one(spark, "  آباؤنا...  في   السَّماء! ", T.normalize_search) == "اباونا في السماء"
    assert one(spark, "إِزّاي أتعلم عن رؤيا الملاءة وⲠⲓⲛⲟⲩϯ?", T.normalize_search) == "ازاي اتعلم عن رويا الملاءه وⲠⲓⲛⲟⲩϯ"
    assert one(spark, "a b  c abc", lambda x: T.replace_phrase(x, "b c", "z")) == "a z abc"
    assert one(spark, "x:y:12", T.ordinal) == 12 and one(spark, "x", T.ordinal) == 0
    assert one(spark, "aa aa", lambda x: T.occurrences(x, F.lit("aa"))) == 2


def test_quota_boundary():
    rows = [("a", "n")] * 51
    out = list(admission.admit_rows(rows, (50, 150, 650)))
    assert all(x for x, _ in out[:50]) and out[50] == (False, "actor_daily_quota")
    out = list(admission.admit_rows([(i, "n") for i in range(151)], (50, 150, 650)))
    assert out[150] == (False, "network_daily_quota")
    assert list(admission.admit_rows([(None, "n")], (1, 1, 1))) == [(False, "quota_identity_unavailable")]


def test_spacing_batch_equals_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 2, start + dt.timedelta(seconds=i)) for i in range(40)]
    e = spark.createDataFrame(rows, "event_id long, key long, ts timestamp")
    batch = sorted(admission.leaky(e, 15).collect())
    assert [x.event_id for x in batch if x.accepted][:4] == [0, 1, 4, 5]
    for part in (e.filter("event_id < 20"), e.filter("event_id >= 20")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = counters.leaky(s, 15).writeStream.format("memory").queryName("spaced").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("spaced").collect()) == batch


def test_admission_without_gathering(spark):
    import random

    r = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=r.randrange(4000)), a, None if a is None else a % 5 or None) for i in range(3000) for a in [None if r.random() < 0.05 else 0 if r.random() < 0.3 else r.randrange(60)]]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, actor long, network long")
    for limits in ((3, 30, 120), (3, 10, 1000), (50, 20, 60), (4, 1000, 1000)):
        cut = admission.reserve(e, limits, one_network=True)
        assert sorted(cut.collect(), key=str) == sorted(admission.reserve(e, limits).collect(), key=str)
    k = e.select("event_id", (F.col("event_id") % 3).alias("key"), "ts")
    for plan in (cut, admission.leaky(k, 1)):
        assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    got = {x.event_id: x.accepted for x in admission.leaky(k, 1).collect()}
    for key in range(3):
        mine = sorted((t, i) for i, t, _, _ in rows if i % 3 == key)
        ok = list(admission.spaced_rows([int(t.timestamp() * 1000) for t, _ in mine], 60_000))
        assert [got[i] for _, i in mine] == ok


def test_lower_percentile_without_ranks(spark):
    from lodestone.operators import observability

    rows = [(k, v) for k, n in ((1, 1), (2, 10), (None, 7), (3, 100)) for v in [None, *[(i * 7) % 5 for i in range(n)]]]
    d = spark.createDataFrame(rows, "k long, v long")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = observability.lower_percentile(d, "k", "v", p)
        assert "row_number" not in got._jdf.queryExecution().toString()
        want = {k: sorted(v for x, v in rows if x == k and v is not None) for k, _ in rows}
        assert {x.k: (x.n, x.v) for x in got.collect()} == {k: (len(v), v[int((len(v) - 1) * p)]) for k, v in want.items()}


def test_chunks():
    assert ingest.split_text("# A\nx\n# B\ny", 6) == ["# A\nx", "# B\ny"]
    assert ingest.split_text(None) == [] and ingest.split_text("a" * 50, 10) == ["a" * 50]
    assert all(len(p) <= 40 for p in ingest.split_text("One two three. " * 30, 40))


def test_fusion_and_merge(spark):
    v = spark.createDataFrame([(1, 7, 0.9, 1)], "query_id long, chunk_id long, score double, rank long")
    x = spark.createDataFrame([(1, 7, 50.0, 2)], "query_id long, chunk_id long, score double, rank long")
    got = retrieval.fuse((v, "vector", 1.0), (x, "lexical", 1.0), k=5).first()
    assert abs(got.score - (1 / 61 + 1 / 62 + 0.05)) < 1e-8 and got.raw_score == 50.0
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    b = spark.createDataFrame([(2, "c")], "k long, v string")
    assert sorted(files.merge_last(a, b, key="k").collect()) == [(1, "a"), (2, "c")]
