"""Scores from the index against scoring every chunk, on words in which matches hide."""

import random

from pyspark.sql import functions as F

from lodestone.functions import lexicon as L
from lodestone.operators import postings, scoring

STOP = L.stop_words()
WORDS = "ab abc bca cab abca bc a c aab bbca kalam qalam the kitab الكتاب كتاب والكتاب سلام سلم الرب المسيح شفاء شفا قديس القديس abcabcab".split()


def fixture(spark, seed=2, n=160):
    r = random.Random(seed)
    some = lambda k: " ".join(r.choice(WORDS) for _ in range(r.randrange(k)))
    chunks = spark.createDataFrame(
        [(f"c:{i}", some(5), some(4), some(9) or None, [some(3)] if i % 3 else None, ("bible", "taqs", "tari5", None)[i % 4], [some(3)], "s" + str(i % 3)) for i in range(n)],
        "chunk_id string, title string, section string, search_text string, keywords array<string>, domain string, events array<string>, shard string",
    )
    texts = [some(7) for _ in range(9)] + ["", None, "من هو", "ab ca", "abcab", "في", "c", "شفاء سلام"]
    return chunks, texts


def test_index_gives_every_positive_score(spark):
    chunks, texts = fixture(spark)
    asked = postings.features(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"), STOP)
    ready = postings.prepared(chunks, STOP)
    pairs = postings.candidates(asked, postings.index(ready)).select("query_id", "chunk_id")
    got = {(r.query_id, r.chunk_id): (round(r.score, 6), r.structured) for r in postings.scored(asked, ready, pairs).collect()}
    queries = [(r.query_id, r.q) for r in asked.select("query_id", "q").collect() if r.q]
    want = {(r.query_id, r.chunk_id): (round(r.score, 6), r.structured) for r in scoring.scored(chunks, queries, STOP).collect()}
    assert len(want) > 800 and got == want
    # a match that only the squeezed form shows
    alone = spark.createDataFrame([("x:0", "za bc d", None)], "chunk_id string, title string, domain string")
    ask = postings.features(spark.createDataFrame([(1, "zab cd"), (2, "zab de"), (3, "bc de")], "query_id int, text string"))
    ready = postings.prepared(alone)
    found = postings.candidates(ask, postings.index(ready)).select("query_id", "chunk_id")
    assert {r.query_id: r.score for r in postings.scored(ask, ready, found).collect()} == {1: 6.0, 3: 5.0 + 12.0 + 9.0}


def test_shards_are_pruned(spark):
    chunks, texts = fixture(spark, 3, 60)
    asked = postings.features(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"), STOP)
    ready = postings.prepared(chunks, STOP)
    within = spark.createDataFrame([(i, f"s{i % 3}") for i in range(0, len(texts), 2)], "query_id long, shard string")
    parts = postings.index(ready, chunks.select("chunk_id", "shard"))
    every = postings.scored(asked, ready, postings.candidates(asked, postings.index(ready)).select("query_id", "chunk_id"))
    want = every.join(chunks.select("chunk_id", "shard"), "chunk_id").join(within, ["query_id", "shard"]).select("query_id", "shard", "chunk_id", F.round("score", 6)).collect()
    found = postings.candidates(asked, parts, within)
    got = postings.scored(asked, ready, found).select("query_id", "shard", "chunk_id", F.round("score", 6)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
