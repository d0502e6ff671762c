"""Usage, cost, quota and summary aggregates over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(events: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return events.agg(F.count("*").alias("total"), flag(F.col("answered")).alias("answered"), flag(~F.col("answered")).alias("fallbacks"), flag(F.col("rating") == "up").alias("likes"), flag(F.col("rating") == "down").alias("dislikes"), flag(F.col("rating").isNull()).alias("unrated"))


def top_groups(events: DataFrame, keys: list[str], n: int) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *keys).limit(n)


def lower_percentile(values: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """sorted[floor((n - 1) p)] of each key: running sums over its distinct values, which are counted first."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_k"))
    totals = counts.groupBy(key).agg(F.sum("_k").alias("n"))
    upto = F.sum("_k").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    place = F.floor((F.col("n") - 1) * p) + 1
    ranked = counts.withColumn("_r", upto).alias("c").join(totals.alias("t"), F.col(f"c.{key}").eqNullSafe(F.col(f"t.{key}")))
    return ranked.filter((F.col("_r") >= place) & (F.col("_r") - F.col("_k") < place)).select(f"c.{key}", "n", value)


def usage_counters(events: DataFrame) -> DataFrame:
    """Sums by day, by month and by day and user, in one pass of grouping sets."""
    e = events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM").alias("month"), "user_id", "cost")
    sets = e.groupingSets([["day"], ["month"], ["day", "user_id"]], "day", "month", "user_id")
    each = sets.agg(F.grouping("month").alias("_m"), F.grouping("user_id").alias("_u"), F.count("*").alias("queries"), F.round(F.sum("cost"), 2).alias("cost"))
    by_user = F.col("_u") == 0
    return each.select(
        F.when(F.col("_m") == 0, "month").otherwise("day").alias("period_type"), F.coalesce("day", "month").alias("period_key"),
        F.when(by_user, "device").otherwise("global").alias("scope"), F.when(by_user, F.col("user_id").cast("string")).otherwise("all").alias("usage_key"), "queries", "cost",
    )


def guarded(events: DataFrame, key: list[str], limit: int, order: list[str]) -> DataFrame:
    """The first `limit` events of each key are admitted."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return events.withColumn("admitted", n <= limit)


def budget_alerts(events: DataFrame, limit: float, thresholds=(80, 90, 100)) -> DataFrame:
    """The event at which a user's running count of the day passes each threshold of the limit."""
    run = F.count("*").over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    e = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("used", run)
    t = e.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    return t.filter((F.col("used") * 100 >= F.col("threshold") * limit) & ((F.col("used") - 1) * 100 < F.col("threshold") * limit)).select("user_id", "day", F.col("threshold").cast("long").alias("threshold"), F.col("used"), "event_id")


def retention(events: DataFrame, cutoff: str) -> DataFrame:
    """Previews older than the cutoff are cleared."""
    old = F.col("ts") < F.lit(cutoff).cast("timestamp_ntz")
    return events.withColumns({"preview": F.when(~old, F.col("preview")), "expired": old})


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = events.withColumn("_new", F.coalesce((since > gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    e = e.withColumn("session_no", F.sum("_new").over(w))
    return e.groupBy("user_id", "session_no").agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each left row with the last right value of its key at or before its time: union and one window, no range join."""
    a = left.withColumns({"_side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, ts, value).withColumn("_side", F.lit(0))
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return both.filter("_side = 1").drop("_side")
