"""The best chunks by blocks against the best of all scored pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import best, nearest, postings, retrieval, scoring, search
from lodestone.sources.files import stored
from tests.test_postings import STOP, fixture


def listed(frame):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in frame.select("query_id", "rank", "chunk_id", "score").collect())


@pytest.mark.parametrize("seed, stop", [(2, STOP), (5, frozenset())])
def test_best_equal_all_scores(spark, monkeypatch, seed, stop):
    monkeypatch.setattr(best, "BLOCK", 9)
    chunks, texts = fixture(spark, seed)
    r = random.Random(seed)
    texts = [*texts, *[" ".join(r.sample("ab abc kalam كتاب والكتاب سلام شفاء c the kitab bca".split(), 4)) for _ in range(8)], *texts[:3]]
    asked = postings.features(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"), stop)
    ready = postings.prepared(chunks, stop)
    queries = [(x.query_id, x.q) for x in asked.select("query_id", "q").collect() if x.q]
    every = scoring.scored(chunks, queries, stop)
    got = best.best(asked, ready, 12, stop)
    assert listed(got) == listed(retrieval.top_k(every, 12, "chunk_id"))
    # all of them, rounded, with the flag
    got = postings.marked(best.best(asked, ready, 1000, stop, digits=6), asked, ready)
    want = every.withColumn("score", F.round("score", 6))
    assert {(x.query_id, x.chunk_id, x.score, x.structured) for x in got.collect()} == {(x.query_id, x.chunk_id, x.score, x.structured) for x in want.collect()}


def test_best_within_shards(spark):
    chunks, texts = fixture(spark, 3, 60)
    asked = postings.features(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"), STOP)
    asked = asked.withColumn("keys", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("s2"), F.lit("s0"))).otherwise(F.array(F.lit("s1"), F.lit("none"))))
    shards = chunks.select("chunk_id", "shard").union(chunks.filter("chunk_id like '%4'").select("chunk_id", F.lit("s2")))
    ready = postings.prepared(chunks, STOP)
    within = asked.select("query_id", F.posexplode("keys").alias("n", "shard"))
    found = postings.candidates(asked, postings.index(ready, shards), within.drop("n")).join(within, ["query_id", "shard"]).drop("shard")
    want = retrieval.top_k(postings.scored(asked, ready, found), 9, "n", "chunk_id")
    assert listed(best.best(asked, ready, 9, STOP, shards, "keys")) == listed(want) and want.count() > 50


def test_no_row_for_each_pair(spark):
    """Queries and chunks go to the tasks; pairs of them were joined, exploded and scored one by one before."""
    from lodestone.plans import registry

    plan = registry.QUERIES["postings_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "title_words" not in plan


def test_nearest_equal_all_cosines(spark):
    r = random.Random(4)
    inf, nan = float("inf"), float("nan")
    some = [[r.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(4)] for _ in range(60)] + [[r.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    odd = [None, [1.0, None, 0.0, 2.0], [nan, 1.0, 0.0, 0.0], [inf, 1.0, 1.0, 1.0], [1.0, 2.0], [], [0.0] * 4]
    rows = [(f"c:{i}", v, r.choice(["a", "b", "c", None]), r.choice([None, "x", "y"])) for i, v in enumerate([*some, *odd])]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<double>, domain string, library string")
    asked = [(i, v, r.sample(["a", "b", "c"], r.randrange(1, 4)), r.sample(["x", "y"], r.randrange(2))) for i, v in enumerate([*some[::5], *some[1::7], *odd])]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>, domains array<string>, shut array<string>")
    pairs = queries.filter("vector is not null").withColumn("domain", F.explode("domains")).join(vectors.filter("embedding is not null"), "domain")
    pairs = pairs.filter(~F.coalesce(F.array_contains("shut", F.col("library")), F.lit(False)))
    every = pairs.select("query_id", "chunk_id", nearest.cosine(F.col("vector"), F.col("embedding")).alias("score"))
    for k in (1, 9, 200):
        got, want = (sorted((x.query_id, x["rank"], x.chunk_id, str(x.score)) for x in retrieval.top_k(f, k, "chunk_id").collect()) for f in (nearest.nearest(queries, vectors, k), every))
        assert got == want and len(want) > 30


def test_rounding_is_sparks(spark):
    r = random.Random(1)
    x = [r.choice([-1, 1]) * r.randrange(200_000) / 200_000 for _ in range(300)] + [r.uniform(-1, 1) for _ in range(300)] + [0.0, -1e-9]
    want = [v.x for v in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", F.round("x", 5).alias("x")).orderBy("i").collect()]
    assert nearest.rounded(np.array(x)).tolist() == want


def test_whole_retrieval_joins_no_pairs(spark):
    """Vectors and queries of a domain were joined pair by pair, and so were candidates, nearly all chunks of a shard."""
    q = spark.createDataFrame([(i, "genesis verse", [float(i), 1.0]) for i in range(40)], "query_id long, text string, vector array<double>")
    c = spark.createDataFrame([(f"d:{i}", str(i), "genesis", "u", "t", "bible", None) for i in range(50)], "chunk_id string, doc_id string, title string, url string, text string, domain string, library string")
    v = spark.createDataFrame([(f"d:{i}", [1.0, float(i)]) for i in range(50)], "chunk_id string, embedding array<double>")
    shards = c.select("chunk_id", F.lit("lexical:domain:bible").alias("shard"))
    plans = []

    def keep(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return stored(frame)

    assert search.retrieve(q, c, v, shards, keep=keep).results.count() == 200
    assert any("MapInArrow" in p for p in plans)
