"""Usage counters, query events and feedback kept by a stream, exactly once.

A batch's increments are added up by key and written to a folder of the batch's own number, which a replay of the batch writes
over; what is stored is the sum of all folders, so a replay changes nothing. `compacted` adds up all folders into one, also
under the number of the last; readers take the last such base and the batches after it. Run it between batches.

Counters have nine measures by period, scope and key: each request counts once for its day and its month as a whole, and, where it
names who asks, for its day under that name, where storage reads and vector searches don't count. Null kinds count as neither model nor
fallback calls; a null cost of an attempt is the estimate; rows without a time are left out. Events and ratings are rows by
batch: the first row of a message stays, the last rating of a message wins (within a batch by time, then by the row's order of
values).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["period_type", "period_key", "scope", "usage_key"]
MEASURES = ["model_calls", "quota_attempts", "fallback_calls", "retrieval_calls", "vectorize_queries", "vectorize_dimensions", "kv_reads_estimated", "d1_writes_estimated", "estimated_usd"]
SHARED = ["vectorize_queries", "vectorize_dimensions", "kv_reads_estimated"]
# What one retrieval and one answer are estimated at.
DIMENSIONS, READS, COST = 1024, 8, 0.001


def usage(events: DataFrame, cost: float = COST) -> DataFrame:
    """Increments by key of events (ts, kind: model or fallback, consumed, usd, identity); `consumed` says whether quota was used,
    a null one that a model call used it."""
    model = F.coalesce(F.col("kind") == "model", F.lit(False))
    attempt = F.coalesce(F.col("consumed"), model)
    one = lambda x: F.when(x, 1).otherwise(0).cast("long")
    values = {
        "model_calls": one(model), "quota_attempts": one(attempt), "fallback_calls": one(F.coalesce(F.col("kind") == "fallback", F.lit(False))), "retrieval_calls": F.lit(1).cast("long"), "vectorize_queries": F.lit(1).cast("long"),
        "vectorize_dimensions": F.lit(DIMENSIONS).cast("long"), "kv_reads_estimated": F.lit(READS).cast("long"), "d1_writes_estimated": F.lit(1).cast("long"), "estimated_usd": F.coalesce(F.col("usd").cast("double"), F.when(attempt, cost).otherwise(0.0)),
    }
    key = lambda kind, form, scope, who: F.struct(F.lit(kind).alias("period_type"), F.date_format("ts", form).alias("period_key"), F.lit(scope).alias("scope"), who.cast("string").alias("usage_key"))
    day, month = key("day", "yyyy-MM-dd", "global", F.lit("all")), key("month", "yyyy-MM", "global", F.lit("all"))
    own = key("day", "yyyy-MM-dd", "device", F.col("identity"))
    keys = F.when(F.col("identity").isNull(), F.array(day, month)).otherwise(F.array(day, month, own))
    rows = events.filter("ts is not null").select(*[v.alias(k) for k, v in values.items()], F.inline(keys))
    shared = [F.when(F.col("scope") == "global", F.col(m)).otherwise(F.lit(0)).alias(m) if m in SHARED else F.col(m) for m in MEASURES]
    return rows.select(*KEY, *shared).groupBy(*KEY).agg(*[F.sum(m).alias(m) for m in MEASURES])


def counters_sink(path: str, cost: float = COST) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch` on a stream of events: adds each batch to the counters in a folder, once however often it runs."""

    def write(batch: DataFrame, number: int) -> None:
        usage(batch, cost).write.mode("overwrite").parquet(f"{path}/kind=batch/number={number}")

    return write


def rows_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: keeps each batch's rows, once however often it runs."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/kind=batch/number={number}")

    return write


def _kept(spark: SparkSession, path: str) -> DataFrame:
    """The last base and the batches after it."""
    rows = spark.read.option("basePath", path).parquet(path)
    base = rows.filter("kind = 'base'").agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0]  # one number
    return rows.filter((F.col("number") > base) | ((F.col("kind") == "base") & (F.col("number") == base)))


def counters(spark: SparkSession, path: str) -> DataFrame:
    """The stored counters: a row a key."""
    return _kept(spark, path).groupBy(*KEY).agg(*[F.sum(m).alias(m) for m in MEASURES])


def compacted(spark: SparkSession, path: str) -> None:
    """Adds up all that is stored into a base of the last batch's number."""
    kept = _kept(spark, path)
    last = kept.agg(F.max("number")).first()[0]
    kept.groupBy(*KEY).agg(*[F.sum(m).alias(m) for m in MEASURES]).write.mode("overwrite").parquet(f"{path}/kind=base/number={last}")


def first_rows(spark: SparkSession, path: str, key: str = "message_id") -> DataFrame:
    """Of the stored rows of each message the first one; rows without a message stay."""
    rows = _kept(spark, path)
    columns = [c for c in rows.columns if c not in ("kind", "number")]
    w = Window.partitionBy(key).orderBy("number", *columns)
    named = rows.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return named.select(*columns).union(rows.filter(F.col(key).isNull()).select(*columns))


def with_ratings(events: DataFrame, ratings: DataFrame, key: str = "message_id") -> DataFrame:
    """events with the last rating (ts, rating, number of its batch) of their message; a message's ratings are pre-aggregated, so a
    message with many is one row before the join."""
    order = F.struct(*[c for c in ("number", "ts", "rating") if c in ratings.columns])
    last = ratings.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("rating", order).alias("rating"))
    return events.drop("rating").join(last, key, "left")


def stored_ratings(spark: SparkSession, path: str) -> DataFrame:
    """The stored ratings with their batch's number."""
    return _kept(spark, path).drop("kind")
