"""The operator's view of query events: filters, totals with shares, the largest groups and the topics left in them.

Events: (created_at, user_id, query_text, answered, retrieved, cited, rating, domains, doc_ids, failure_reason, cpu_ms, over_budget).
Null flags count as false; null arrays are empty. Groups of equal size go by their key; null keys are a group of their own and come
first. Empty tables give zeros, or no groups.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days of a range, and how many rows a list holds.
DAYS = {"24h": 1, "7d": 7, "30d": 30}
RECENT, DOMAINS, FAILURES, SOURCES, OVER_BUDGET = 50, 20, 25, 25, 25


def since(now: datetime.datetime, range_: str | None) -> datetime.datetime:
    """The start of a range; seven days for others than those of `DAYS`."""
    return now - datetime.timedelta(days=DAYS.get(range_ or "", 7))


def topic_of(value: str | None) -> str | None:
    """A topic that a filter may name: up to 80 letters, digits, _ and -."""
    topic = (value or "").strip()
    return topic if 0 < len(topic) <= 80 and all(c.isascii() and (c.isalnum() or c in "_-") for c in topic) else None


def filtered(events: DataFrame, start: datetime.datetime, answer_state: str = "all", feedback: str = "all", topic: str | None = None) -> DataFrame:
    """Events from a time on by answer (answered, unanswered), rating (up, down, unrated) and a text within their domains."""
    out = events.filter(F.col("created_at") >= F.lit(start))
    if answer_state in ("answered", "unanswered"):
        out = out.filter(_true("answered") == F.lit(answer_state == "answered"))
    if feedback in ("up", "down"):
        out = out.filter(F.col("rating") == feedback)
    if feedback == "unrated":
        out = out.filter(F.col("rating").isNull())
    if topic_of(topic):
        out = out.filter(F.contains(F.lower(_key("domains")), F.lit(topic_of(topic).lower())))
    return out


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _key(c: str) -> Column:
    return F.to_json(F.coalesce(F.col(c), F.array().cast("array<string>")))


def _sum(on: Column) -> Column:
    return F.coalesce(F.sum(F.when(on, 1).otherwise(0)), F.lit(0)).cast("long")


def share(part: Column, total: Column) -> Column:
    """A share in whole per cent, halves up; 0 % of nothing."""
    return F.concat(F.when(total > 0, F.floor(100 * part / total + 0.5)).otherwise(0).cast("string"), F.lit("%"))


def totals(events: DataFrame) -> DataFrame:
    rows = events.agg(
        F.count("*").alias("total_queries"), _sum(_true("answered")).alias("answered_queries"), _sum(_true("retrieved")).alias("retrieved_references"), _sum(_true("cited")).alias("cited_references"),
        _sum(F.col("rating") == "up").alias("likes"), _sum(F.col("rating") == "down").alias("dislikes"), _sum(F.col("rating").isNull()).alias("neutral"), _sum(_true("over_budget")).alias("over_budget_queries"),
    )
    return rows.select("*", share(F.col("answered_queries"), F.col("total_queries")).alias("answered_percent"), share(F.col("over_budget_queries"), F.col("total_queries")).alias("over_budget_percent"))


def domain_groups(events: DataFrame, n: int = DOMAINS) -> DataFrame:
    """The n largest groups of equal domains, each with `topics`: the distinct domains of all groups left, sorted. The events are
    read once; topics come from the n rows."""
    groups = events.groupBy(_key("domains").alias("domains")).agg(F.count("*").alias("total_queries"), _sum(_true("answered")).alias("answered_queries"), _sum(F.col("rating") == "down").alias("dislikes"))
    top = groups.orderBy(F.desc("total_queries"), "domains").limit(n)
    own = F.filter(F.from_json("domains", "array<string>"), lambda x: x.isNotNull() & (x != ""))
    return top.withColumn("topics", F.array_sort(F.array_distinct(F.flatten(F.collect_list(own).over(Window.partitionBy(F.lit(0)))))))  # n rows


def failures(events: DataFrame, n: int = FAILURES) -> DataFrame:
    rows = events.filter(~_true("answered")).groupBy("query_text", "failure_reason").agg(F.count("*").alias("total_queries"))
    return rows.orderBy(F.desc("total_queries"), "query_text", "failure_reason").limit(n)


def sources(events: DataFrame, n: int = SOURCES) -> DataFrame:
    rows = events.filter(F.size(F.coalesce("doc_ids", F.array().cast("array<string>"))) > 0).groupBy(_key("doc_ids").alias("doc_ids"))
    return rows.agg(F.count("*").alias("total_queries"), _sum(F.col("rating") == "down").alias("dislikes")).orderBy(F.desc("dislikes"), F.desc("total_queries"), "doc_ids").limit(n)


def recent(events: DataFrame, n: int = RECENT, *ties: str) -> DataFrame:
    return events.orderBy(F.desc("created_at"), *ties).limit(n)


def over_budget(events: DataFrame, n: int = OVER_BUDGET, *ties: str) -> DataFrame:
    return events.filter(_true("over_budget")).orderBy(F.desc("cpu_ms"), F.desc("created_at"), *ties).limit(n).select("created_at", "user_id", "query_text", "cpu_ms", *ties)
