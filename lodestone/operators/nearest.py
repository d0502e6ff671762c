"""The nearest vectors of each query of a table, by cosine, in blocks of both: no row for each pair.

A task takes a block of queries and reads vectors in blocks; products of matrices find which vectors can be among the k nearest.
Only these are summed again, in the vectors' order, so that a cosine is to the last bit the one summed one by one. Vectors with
nulls, infinite or no numbers, and those of another length than most queries', are joined and summed one by one.
"""

from __future__ import annotations

import decimal
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.best import dealt, freed, read
from lodestone.sources.files import stored

BLOCK, ROWS, BATCH, DIGITS = 20_000, 4096, 64, 5  # queries of a task, vectors and queries at once: bound memory alone
OUT = "qid long, chunk_id string, score double"
SUNK, NEAR = -9.0, 2e-5  # below every cosine; more than rounding and another order of sums make


def cosine(a: Column, b: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(dot(a, a) * dot(b, b))
    return F.round(F.when(length > 0, dot(a, b) / length).otherwise(0.0), DIGITS)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, summed in their order."""
    out = np.zeros(max(len(a), len(b)))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def rounded(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """As Spark rounds: halves away from zero, from the shortest decimal."""
    at = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(at + 0.5) / 10.0**digits, x)
    for i in np.flatnonzero(np.abs(at - np.floor(at) - 0.5) < 1e-6).tolist():
        out[i] = float(decimal.Decimal(repr(float(x[i]))).quantize(decimal.Decimal(1).scaleb(-digits), decimal.ROUND_HALF_UP))
    return out + 0.0


class Nearest:
    """The nearest vectors of a block of queries (qid, vector, domains, libraries that are shut) so far."""

    def __init__(self, asked: list[tuple], k: int):
        self.k, self.asked = k, asked
        self.vectors = np.array([x[1] for x in asked], np.float64)
        self.squares = dot(self.vectors, self.vectors)
        self.best: list[list[tuple]] = [[] for _ in asked]
        self.least = np.full(len(asked), SUNK)

    def add(self, rows: list[tuple]) -> None:
        """rows: (chunk_id, embedding, domain, library)."""
        rows = sorted(rows, key=lambda x: x[0])
        kinds: dict = {}
        kind = np.array([kinds.setdefault(x[2:], len(kinds)) for x in rows])
        e = np.array([x[1] for x in rows], np.float64)
        squares, shown = dot(e, e), {}
        for a in range(0, len(self.asked), BATCH):
            q, own = self.vectors[a : a + BATCH], self.squares[a : a + BATCH]
            with np.errstate(all="ignore"):
                length = np.sqrt(own[:, None] * squares)
                near = np.where(length > 0, q @ e.T / length, 0.0)
            for row in range(len(q)):
                i = a + row
                sees = self.asked[i][2:]
                if sees not in shown:
                    shown[sees] = np.flatnonzero(np.array([d in sees[0] and x not in sees[1] for d, x in kinds])[kind])
                x = near[row, shown[sees]]
                some = np.flatnonzero(x >= self.least[i] - NEAR)
                if len(some) > self.k:
                    x = x[some]
                    some = some[x >= np.partition(x, len(x) - self.k)[len(x) - self.k] - NEAR]
                if len(some):
                    some = shown[sees][some]
                    size = length[row, some]
                    with np.errstate(all="ignore"):
                        score = rounded(np.where(size > 0, dot(q[row : row + 1], e[some]) / size, 0.0))
                    pick = np.lexsort((some, -score))[: self.k]
                    new = [(-s, rows[c][0]) for s, c in zip(score[pick].tolist(), some[pick].tolist())]
                    best = self.best[i] = sorted(self.best[i] + new)[: self.k]
                    if len(best) == self.k:
                        self.least[i] = -best[-1][0]

    def rows(self):
        """Arrow batches of what was found."""
        out = [(x[0], c, -s + 0.0) for x, best in zip(self.asked, self.best) for s, c in best]
        for at in range(0, len(out), 50_000):
            cols = list(zip(*out[at : at + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["qid", "chunk_id", "score"])


def _run(k: int):
    def run(batches):
        for _, each in groupby(read(batches), key=lambda r: r["part"]):
            asked, near, waiting = [], None, []
            for r in each:
                if not r["kind"]:
                    asked.append((r["qid"], r["vector"], tuple(r["domains"]), tuple(r["shut"])))
                    continue
                if not asked:
                    continue
                near = near or Nearest(asked, k)
                waiting.append((r["chunk_id"], r["vector"], r["domain"], r["library"]))
                if len(waiting) == ROWS:
                    near.add(waiting)
                    waiting = []
            if waiting:
                near.add(waiting)
            if near is not None:
                yield from near.rows()
            asked = near = waiting = None
            freed()

    return run


def nearest(asked: DataFrame, vectors: DataFrame, k: int, keep=stored) -> DataFrame:
    """(query_id, chunk_id, score) that hold the k nearest vectors of each query, cosines rounded; they may hold more.

    asked: (query_id, vector, domains, shut), vectors: (chunk_id, embedding, domain, library): a query sees vectors of its domains, but
    not those of libraries that are shut."""
    null = lambda kind: F.lit(None).cast(kind)
    own = keep(asked.filter(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"), "domains", "shut").withColumn("qid", F.monotonically_increasing_id()))
    most = own.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    there = vectors.filter(F.col("embedding").isNotNull() & F.col("domain").isNotNull()).withColumn("embedding", F.col("embedding").cast("array<double>"))
    usual = lambda v: (F.size(v) == (most["n"] if most else 0)) & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own, there = own.withColumn("_usual", usual(F.col("vector"))), there.withColumn("_usual", usual(F.col("embedding")))
    ask = own.filter("_usual").select("qid", "vector", "domains", "shut", *[null("string").alias(c) for c in ("chunk_id", "domain", "library")])
    rows = there.filter("_usual").select(null("long").alias("qid"), F.col("embedding").alias("vector"), null("array<string>").alias("domains"), null("array<string>").alias("shut"), "chunk_id", "domain", "library")
    found = dealt(ask, rows, "qid", own.count(), BLOCK).mapInArrow(_run(k), OUT)
    near = found.join(own.select("qid", "query_id"), "qid").select("query_id", "chunk_id", "score")
    for queries, others in ((own.filter("not _usual"), there), (own.filter("_usual"), there.filter("not _usual"))):
        pairs = queries.select("query_id", "vector", "shut", F.explode("domains").alias("domain")).join(others.drop("_usual"), "domain")
        pairs = pairs.filter(~F.coalesce(F.array_contains("shut", F.col("library")), F.lit(False)))
        near = near.union(pairs.select("query_id", "chunk_id", cosine(F.col("vector"), F.col("embedding"))))
    return near
