"""Retrieval and answer evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected_rank(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """For each expected item the rank of its first hit: hits (query_id, doc_id, rank), expected (query_id, doc_id)."""
    found = expected.join(hits, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return found


def hit_report(ranks: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return ranks.agg(F.count("*").alias("items"), F.round(share(F.col("rank") <= k), 6).alias("hit_at_k"), F.round(share(F.col("rank") == 1), 6).alias("hit_at_1")).withColumn("passed", F.col("hit_at_k") >= threshold)


def invariants(hits: DataFrame) -> DataFrame:
    """Rows that break what every hit must hold, by rule."""
    rules = F.array(*[F.when(c, F.lit(n)) for n, c in (("no_id", F.col("chunk_id").isNull()), ("no_url", F.coalesce(F.length("url"), F.lit(0)) == 0), ("no_text", F.coalesce(F.length("text"), F.lit(0)) == 0))])
    return hits.select(F.explode(F.array_compact(rules)).alias("rule")).groupBy("rule").count()


def answer_report(answers: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    mean = F.round(F.avg(F.when(F.col("context_chars") > 0, F.col("context_chars")))).cast("long")
    return answers.agg(F.count("*").alias("items"), n(F.col("valid")).alias("answered"), n(~F.col("valid")).alias("handoff"), n(F.size("citations") > 0).alias("cited"), mean.alias("mean_context"))


def reduction_percent(full, compact):
    return F.when(full > 0, F.round(100 * (full - compact) / full)).otherwise(0).cast("long")


def phase_report(rows: DataFrame) -> DataFrame:
    """Sum of every phase of a map column `phases`, the slowest first."""
    p = rows.select(F.explode("phases").alias("phase", "ms"))
    return p.groupBy("phase").agg(F.round(F.sum("ms"), 3).alias("total_ms")).orderBy(F.desc("total_ms"), "phase")


def holders(passages: DataFrame, docs: DataFrame, size: int = 5) -> DataFrame:
    """For each passage the documents whose text holds it whole: (item_id, documents, first_doc); passages without any have no row.

    Candidates meet on up to `size` of a passage's inner words, which any text around it leaves as they are. Passages of less
    than three words have none and are sought in every text, as a stated set of queries. Blank passages are in every text that
    holds their blanks; null passages and texts match nothing; repeated passages and ids count once."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    p = passages.filter("passage is not null").select("item_id", "passage", words("passage").alias("w")).withColumn("n", F.least(F.lit(size), F.size("w") - 2))
    rows = docs.filter("text is not null").select("doc_id", "text")
    keys = p.filter("n > 0").select("item_id", "passage", "n", F.xxhash64("n", F.array_join(F.expr("slice(w, 2, n)"), " ")).alias("key"))
    sizes = [r.n for r in keys.select("n").distinct().collect()]  # at most `size` numbers
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice("w", i, n), " ")))
    none = F.array().cast("array<bigint>")
    every = F.concat(none, *[F.when(F.size("w") >= n, grams(n)).otherwise(none) for n in sizes])
    post = rows.select("doc_id", words("text").alias("w")).select("doc_id", F.explode(F.array_distinct(every)).alias("key"))
    near = post.join(keys, "key").select("item_id", "doc_id", "passage").distinct()
    hits = near.join(rows, "doc_id").filter(F.contains("text", "passage")).select("item_id", "doc_id")
    short = p.filter("n <= 0").select("item_id", "passage").join(rows, F.contains("text", "passage")).select("item_id", "doc_id")
    return hits.union(short).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))
