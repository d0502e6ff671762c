"""Reservations on a ladder of models, each limited by requests a day and by spacing, with undo.

Requests of a scope are taken in the order of (ts, request_id). Each goes to the first model of the ladder, without those that it
excludes, whose day (of `zone`) has room and whose last reservation is at least ceil(60000 / rpm) ms ago; both limits are reserved
together or not at all, and a request that no model can take gets none. An undo row (`undo`: the id of an earlier request) gives
that request's day count and tokens back, never below zero; the spacing stays, since the model was called. It's ignored where the
request got no model or was undone before, or where its day is over. Rows without a scope or time are refused (fail closed).
Token estimates below zero or null count as zero.

The state is small (a count, tokens and a time for each model, and the day's reservations that may be undone), so a task
streams its rows in sorted order. Days start anew but for the spacing: a scope is cut at each midnight that lies in a gap of at least
the longest spacing, and the parts are dealt over tasks. Rows equal in scope, time and id are taken in any order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.calendar import local_date


@dataclass(frozen=True)
class Rung:
    """A model's limits."""

    model: str
    rpm: int
    rpd: int

    @property
    def spacing(self) -> int:
        return math.ceil(60_000 / max(1, self.rpm))


# The default ladder, most requests a day first.
LADDER = (Rung("gemini-3.1-flash-lite", 15, 500), Rung("gemini-2.5-flash-lite", 10, 20), Rung("gemini-3-flash-preview", 5, 20), Rung("gemini-3.5-flash", 5, 20), Rung("gemini-2.5-flash", 5, 20))
PACIFIC = "America/Los_Angeles"
OUT = "request_id long, scope string, day string, model string, day_count int, day_tokens long, undone boolean"


def ordered(ladder: tuple[Rung, ...], names: list[str]) -> tuple[Rung, ...]:
    """The ladder with the named models first, in their order; unknown ones get one request a minute and a day."""
    own = {r.model: r for r in ladder}
    first = [own.get(n, Rung(n, 1, 1)) for n in dict.fromkeys(names)]
    return (*first, *[r for r in ladder if r.model not in names])


@dataclass
class State:
    """Counts and tokens of a day, and each model's last reservation."""

    day: str = ""
    counts: dict = field(default_factory=dict)
    tokens: dict = field(default_factory=dict)
    last: dict = field(default_factory=dict)
    open: dict = field(default_factory=dict)

    def turned(self, day: str) -> None:
        if day != self.day:
            self.day, self.counts, self.tokens, self.open = day, {}, {}, {}

    def reserve(self, request: int, ms: int, tokens: int, excluded, ladder) -> tuple:
        """(model, its day's count, its day's tokens), or Nones."""
        for r in ladder:
            n = self.counts.get(r.model, 0)
            if r.model in (excluded or ()) or n >= r.rpd or ms - self.last.get(r.model, -math.inf) < r.spacing:
                continue
            self.counts[r.model], self.last[r.model] = n + 1, ms
            self.tokens[r.model] = self.tokens.get(r.model, 0) + tokens
            self.open[request] = (r.model, tokens)
            return r.model, n + 1, self.tokens[r.model]
        return None, None, None

    def undo(self, request: int) -> tuple:
        """(model, its day's count, its day's tokens) after the reservation is given back, or Nones."""
        model, tokens = self.open.pop(request, (None, 0))
        if model is None:
            return None, None, None
        self.counts[model], self.tokens[model] = max(0, self.counts[model] - 1), max(0, self.tokens[model] - tokens)
        return model, self.counts[model], self.tokens[model]

    def taken(self, request: int, day: str, ms: int, tokens: int, excluded, undo, ladder) -> tuple:
        self.turned(day)
        return self.reserve(request, ms, tokens, excluded, ladder) if undo is None else self.undo(undo)


def _rows(requests: DataFrame, zone: str) -> DataFrame:
    """The columns that the fold needs; missing ones are null."""
    have = requests.columns
    at = F.col("ts").cast("timestamp")
    optional = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    tokens = F.greatest(F.lit(0), F.coalesce(F.ceil(F.col("tokens").cast("double")) if "tokens" in have else F.lit(0), F.lit(0))).cast("long")
    return requests.select(F.col("request_id").cast("long").alias("request_id"), "scope", at.alias("ts"), F.unix_millis(at).alias("ms"), F.date_format(local_date(at, 0, zone), "yyyy-MM-dd").alias("day"), tokens.alias("tokens"), optional("excluded", "array<string>"), optional("undo", "long"))


def reserved(requests: DataFrame, ladder: tuple[Rung, ...] = LADDER, zone: str = PACIFIC) -> DataFrame:
    """requests (request_id, scope, ts; tokens, excluded, undo where they have them) with the model of each, and that model's count
    and tokens of the day after it. `undone` tells the undo rows."""
    e = _rows(requests, zone)
    fine = F.col("scope").isNotNull() & F.col("ms").isNotNull()
    longest = max((r.spacing for r in ladder), default=0)
    # one row a scope and day; days are few
    days = e.filter(fine).groupBy("scope", "day").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    w = Window.partitionBy("scope").orderBy("day")
    cut = F.coalesce(F.col("first") - F.lag("last").over(w) >= longest, F.lit(True))
    days = days.withColumn("part", F.sum(cut.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = e.filter(fine).join(days.select("scope", "day", "part"), ["scope", "day"])

    def fold(batches):
        at, state = None, State()
        for b in batches:
            out = []
            for scope, part, *row in zip(*(b.column(c).to_pylist() for c in ("scope", "part", "request_id", "day", "ms", "tokens", "excluded", "undo"))):
                if (scope, part) != at:
                    at, state = (scope, part), State()
                out.append((row[0], scope, row[1], *state.taken(*row, ladder), row[5] is not None))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in OUT.split(", ")])

    done = dealt.repartition("scope", "part").sortWithinPartitions("scope", "part", "ms", "request_id").mapInArrow(fold, OUT)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    refused = e.filter(~fine).select("request_id", "scope", "day", none("model", "string"), none("day_count", "int"), none("day_tokens", "long"), F.col("undo").isNotNull().alias("undone"))
    return done.union(refused)


def reserved_stream(requests: DataFrame, ladder: tuple[Rung, ...] = LADDER, zone: str = PACIFIC) -> DataFrame:
    """As `reserved`, over a stream whose batches follow one another in time; a scope's state goes from batch to batch. Rows without
    a scope or time are dropped."""
    kinds = "day string, counts map<string,int>, tokens map<string,long>, last map<string,long>, open map<long,struct<model:string,tokens:long>>"

    def fold(key, frames, held: GroupState):
        state = State()
        if held.exists:
            day, counts, tokens, last, open_ = held.get
            state = State(day, dict(counts), dict(tokens), dict(last), {k: tuple(v) for k, v in dict(open_).items()})
        rows = pd.concat(list(frames)).sort_values(["ms", "request_id"])
        out = []
        for r in rows.itertuples(index=False):
            undo = None if pd.isna(r.undo) else int(r.undo)
            out.append((r.request_id, r.scope, r.day, *state.taken(r.request_id, r.day, int(r.ms), int(r.tokens), [] if r.excluded is None else list(r.excluded), undo, ladder), undo is not None))
        held.update((state.day, state.counts, state.tokens, state.last, state.open))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])
        yield frame.astype({"day_count": "Int32", "day_tokens": "Int64"})

    e = _rows(requests, zone).filter(F.col("scope").isNotNull() & F.col("ms").isNotNull())
    return e.groupBy("scope").applyInPandasWithState(fold, OUT, kinds, "append", GroupStateTimeout.NoTimeout)


def windows(done: DataFrame) -> DataFrame:
    """(scope, model, day, requests, tokens): what each window holds after all rows."""
    sign = F.when(F.col("undone"), -1).otherwise(1)
    return done.filter(F.col("model").isNotNull()).groupBy("scope", "model", "day").agg(F.sum(sign).alias("requests"))


def excluded_by(failed: Column) -> Column:
    """The models that a retry leaves out, from the models tried before it."""
    return F.array_distinct(F.array_compact(failed))
