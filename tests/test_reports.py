"""Reports on query events: filters, shares, topics of the groups left."""

import datetime

import pytest

from lodestone.operators import reports

NOW = datetime.datetime(2026, 7, 24)
E = "created_at timestamp, user_id long, query_text string, answered boolean, retrieved boolean, cited boolean, rating string, domains array<string>, doc_ids array<string>, failure_reason string, cpu_ms double, over_budget boolean"


def event(day, answered=True, rating=None, domains=("a",), docs=(), cpu=1.0, over=False, reason=None, text="q"):
    return (NOW - datetime.timedelta(days=day), 1, text, answered, None, True, rating, None if domains is None else list(domains), list(docs), reason, cpu, over)


def test_totals_and_shares(spark):
    rows = [event(0), event(0, None, "up"), event(0, False, "down", over=True)] + [event(0)] * 5
    got = reports.totals(spark.createDataFrame(rows, E)).first()
    assert (got.total_queries, got.answered_queries, got.retrieved_references, got.cited_references, got.likes, got.dislikes, got.neutral) == (8, 6, 0, 8, 1, 1, 6)
    assert got.answered_percent == "75%" and got.over_budget_percent == "13%"  # 12.5, halves up
    none = reports.totals(spark.createDataFrame([], E)).first()
    assert none.total_queries == 0 and none.answered_queries == 0 and none.answered_percent == "0%"


def test_topics_are_those_of_the_groups_left(spark):
    rows = [event(0, domains=("a", "b"))] * 3 + [event(0, domains=("c", ""))] * 2 + [event(0, domains=("z",))] + [event(0, domains=None)] * 2
    got = reports.domain_groups(spark.createDataFrame(rows, E), 3).collect()
    assert [(r.domains, r.total_queries) for r in got] == [('["a","b"]', 3), ('["c",""]', 2), ("[]", 2)]
    assert all(r.topics == ["a", "b", "c"] for r in got)


def test_filters(spark):
    df = spark.createDataFrame([event(8, text="old"), event(2, False, "down", ("al-x",), text="no"), event(1, None, None, ("b",), text="null"), event(0, True, "up", ("B_c",), text="yes")], E)
    start = reports.since(NOW, "7d")
    said = lambda **k: sorted(r.query_text for r in reports.filtered(df, start, **k).collect())
    assert said() == ["no", "null", "yes"] and said(answer_state="unanswered") == ["no", "null"] and said(feedback="unrated") == ["null"]
    assert said(feedback="up") == ["yes"] and said(topic="b") == ["null", "yes"] and said(topic="b_C") == ["yes"] and said(topic="%") == ["no", "null", "yes"]


@pytest.mark.parametrize("name, days", [("24h", 1), ("30d", 30), ("odd", 7), (None, 7)])
def test_ranges(name, days):
    assert reports.since(NOW, name) == NOW - datetime.timedelta(days=days)


def test_lists(spark):
    df = spark.createDataFrame([event(0, False, text="b", reason="x"), event(1, False, text="a"), event(2, False, text="a"), event(3, False, "down", docs=("d",), text="a", cpu=9.0, over=True), event(4, True, docs=("e",), cpu=9.0, over=True, text="z"), event(5, docs=("e",))], E)
    assert [tuple(r) for r in reports.failures(df).collect()] == [("a", None, 3), ("b", "x", 1)]
    assert [tuple(r) for r in reports.sources(df).collect()] == [('["d"]', 1, 1), ('["e"]', 2, 0)]
    assert [r.query_text for r in reports.over_budget(df).collect()] == ["a", "z"] and reports.recent(df, 2).count() == 2
