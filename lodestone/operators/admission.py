"""Admission folds: decisions that depend on what was admitted before, so that a window can't express them."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REASONS = ("actor_daily_quota", "network_daily_quota", "global_daily_quota")


def admit_rows(rows, limits: tuple[int, int, int], counts: dict | None = None):
    """(admitted, reason) of (actor, network) rows in their order; a refused row uses nothing up."""
    counts = {} if counts is None else counts
    for actor, network in rows:
        if actor is None:
            yield False, "quota_identity_unavailable"
            continue
        keys = (("a", actor), ("n", network), ("g", None))
        full = [r for k, m, r in zip(keys, limits, REASONS) if counts.get(k, 0) >= m]
        if full:
            yield False, full[0]
        else:
            for k in keys:
                counts[k] = counts.get(k, 0) + 1
            yield True, None


def reserve(events: DataFrame, limits=(50, 150, 650), one_network: bool = False) -> DataFrame:
    """events (event_id, ts, actor, network) with `admitted` and `reason`: the fold of admit_rows over each UTC day in time order.

    one_network says that an actor has one network (an error where it hasn't); then each quota cuts what the narrower ones
    left, in order, and no day is gathered. Else one fold a day, since an actor's networks couple the quotas."""
    e = events.select("event_id", "ts", "actor", "network", F.to_date("ts").alias("day"))
    if one_network:
        return _cut(e, limits)

    def day(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        out = list(admit_rows(((None if pd.isna(a) else a, None if pd.isna(n) else n) for a, n in zip(pdf.actor, pdf.network)), limits))
        return pd.DataFrame({"event_id": pdf.event_id, "admitted": [x for x, _ in out], "reason": [x for _, x in out]})

    return e.groupBy("day").applyInPandas(day, "event_id long, admitted boolean, reason string")


def _cut(e: DataFrame, limits: tuple[int, int, int]) -> DataFrame:
    """A refused row uses nothing up and an actor's rows share all counters, so that a quota's admitted rows are the first
    of those that the narrower quotas let pass; a quota is full after its last admitted row, where that filled it."""
    at = F.struct("ts", "event_id")
    keys = (["day", "actor", "network"], ["day", "network"], ["day"])
    left = e.filter("actor is not null").select("event_id", "ts", "day", "actor", "network")
    full = []
    for key, limit in zip(keys, limits):
        # row_number with a filter on it keeps `limit` rows of each key before the exchange (window group limit)
        left = left.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("ts", "event_id"))).filter(F.col("_n") <= limit)
    for key, limit, name in zip(keys, limits, ("_a", "_w", "_g")):
        of = left.groupBy(*key).agg(F.count("*").alias("_k"), F.max(at).alias(name)).filter(F.col("_k") >= limit).drop("_k")
        full.append(of.select(*[F.col(k).alias(f"{name}{k}") for k in key], name))
    out = e.withColumn("_at", at)
    for key, name, of in zip(keys, ("_a", "_w", "_g"), full):
        on = [F.col(k).eqNullSafe(F.col(f"{name}{k}")) for k in key]
        out = out.join(of, on, "left")
    after = [F.coalesce(F.col("_at") > F.col(name), F.lit(False)) for name in ("_a", "_w", "_g")]
    reason = F.when(F.col("actor").isNull(), "quota_identity_unavailable")
    for late, text in zip(after, REASONS):
        reason = reason.when(late, text)
    several = e.filter("actor is not null").groupBy("day", "actor").agg(F.min("network").alias("_lo"), F.max("network").alias("_hi"), F.count("network").alias("_c"), F.count("*").alias("_m"))
    several = several.filter("_lo <> _hi or (_c > 0 and _c < _m)").limit(1).count()
    if several:
        raise ValueError("an actor has several networks on one day")
    return out.select("event_id", reason.isNull().alias("admitted"), reason.alias("reason"))


def spaced_rows(times, interval_ms: int):
    """Greedy spacing: accept when the last accepted time is at least the interval ago."""
    last = None
    for t in times:
        ok = last is None or t - last >= interval_ms
        last = t if ok else last
        yield ok


def leaky(events: DataFrame, rpm: int) -> DataFrame:
    """events (event_id, key, ts) with `accepted`, at most one every ceil(60000 / rpm) ms for each key.

    A task streams its keys in sorted order with the last accepted time as state; no key is gathered. The first event
    after a gap of the interval is accepted whatever came before, so the parts between gaps are dealt over tasks."""
    interval = -(-60_000 // max(1, rpm))
    e = events.select(F.col("event_id").cast("long").alias("event_id"), "key", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ms") - F.lag("ms").over(w) >= interval, F.lit(True))
    e = e.withColumn("part", F.sum(gap.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def fold(batches):
        at, last = None, None
        for b in batches:
            ok = []
            for key, part, t in zip(*(b.column(c).to_pylist() for c in ("key", "part", "ms"))):
                if (key, part) != at:
                    at, last = (key, part), None
                yes = last is None or t is not None and t - last >= interval
                last = t if yes else last
                ok.append(yes)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array(ok, pa.bool_())], ["event_id", "accepted"])

    dealt = e.repartition("key", "part").sortWithinPartitions("key", "part", "ts", "event_id")
    return dealt.select("event_id", "key", "part", "ms").mapInArrow(fold, "event_id long, accepted boolean")
