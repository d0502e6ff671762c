"""Retrieval over tables of queries and chunks: lexical and vector candidates, fusion, hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def simple_norm(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), T.NOT_WORD, " "))


def simple_score(title: Column, body: Column, query: str) -> Column:
    """Whole query in text 12 and title 20; each token in the title 8, plus its count in the text up to 8."""
    tokens = [t for t in query.split() if len(t) > 1]
    hit = lambda x, q, w: F.when(F.contains(x, F.lit(q)), w).otherwise(0)
    score = hit(body, query, 12) + hit(title, query, 20)
    for t in tokens:
        score = score + hit(title, t, 8) + T.occurrences(body, F.lit(t))
    return score.cast("long")


def top_k(scored: DataFrame, k: int, *ties: str, by: str = "query_id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank; ties go by the given columns."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def lexical_candidates(chunks: DataFrame, queries: list[tuple[int, str]], k: int) -> DataFrame:
    """chunks (chunk_id, title, text) scored against each query; only positive scores count."""
    base = chunks.select("chunk_id", simple_norm(F.col("title")).alias("_t"), simple_norm(F.col("text")).alias("_x"))
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), simple_score(F.col("_t"), F.col("_x"), q).alias("score")) for i, q in queries])
    scored = base.select("chunk_id", F.explode(F.filter(each, lambda s: s["score"] > 0)).alias("s")).select("s.query_id", "chunk_id", "s.score")
    return top_k(scored, k, "chunk_id")


def vector_candidates(index: DataFrame, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """Exact cosine top k of queries (query_id, qvec) over index (vec_id, embedding); `same`: a column both must share."""
    on = F.col("query_id") != F.col("vec_id")
    if same:
        on = on & (F.col(f"q_{same}") == F.col(same))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = dot(F.col("qvec"), F.col("embedding")) / F.sqrt(dot(F.col("qvec"), F.col("qvec")) * dot(F.col("embedding"), F.col("embedding")))
    pairs = index.join(queries, on).select("query_id", "vec_id", F.round(score, 5).alias("score"))
    return top_k(pairs, k, "vec_id")


def fuse(*sources: tuple[DataFrame, str, float], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: weight / (constant + rank), plus a thousandth of the raw score for sources but `vector`."""
    rows = None
    for n, (frame, name, weight) in enumerate(sources):
        raw = F.lit(0.0) if name == "vector" else F.col("score") * 0.001
        part = frame.select("query_id", "chunk_id", F.lit(n).alias("source_no"), F.col("rank"), F.col("score").cast("double").alias("raw"), (F.lit(float(weight)) / (constant + F.col("rank")) + raw).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"), F.max("raw").alias("raw_score"), F.min(F.struct("source_no", "rank")).alias("first"))
    return top_k(fused, k, "first", "chunk_id").drop("first")


def hydrate(candidates: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Candidates whose chunk exists with all required fields, the k best of each query."""
    ok = chunks.filter((F.length("title") > 0) & (F.length("text") > 0))
    return top_k(candidates.drop("rank").join(ok, "chunk_id"), k, "chunk_id")
