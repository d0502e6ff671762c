"""Streaming forms of the counters and of the admission fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.admission import spaced_rows


def windowed_usage(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def leaky(events: DataFrame, rpm: int) -> DataFrame:
    """As the batch fold, with the last accepted time of a key as state; a batch's events are taken in time order."""
    interval = -(-60_000 // max(1, rpm))

    def fold(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        ms = rows.ts.astype("datetime64[ms]").astype("int64")
        ok = list(spaced_rows(ms, interval)) if last is None else list(spaced_rows([last, *ms], interval))[1:]
        taken = [t for t, x in zip(ms, ok) if x]
        if taken or last is not None:
            state.update((int(taken[-1]) if taken else last,))
        yield pd.DataFrame({"event_id": rows.event_id, "accepted": ok})

    return events.select("event_id", "key", "ts").groupBy("key").applyInPandasWithState(fold, "event_id long, accepted boolean", "last long", "append", GroupStateTimeout.NoTimeout)
