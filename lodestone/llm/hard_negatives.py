"""Hard-negative mining with an inverted multi-index.

Vectors are split into two halves; each half has its own codebook (k-means on at most `SAMPLE` rows chosen by hash; every row
is indexed). A pair of codes is a cell. For an anchor, a half's code bounds its part of the inner product by the centre's
product plus the radius times the length of the anchor's half; the radius is the largest distance of any row from its centre.
A heap visits the cells by the sum of both bounds (multi-sequence order) and stops once no unvisited cell can reach what is
kept: the five best positives, then ten rows in each score window. Results are exact, whatever the codebooks are.

Cells are laid out one after another and cut into shards of about `SHARD` rows, a full cell over several shards, by counts
that Spark adds up; each task searches one shard for one group of `ANCHORS` anchors, and Spark merges the shards' best rows.

Rows with a null label, a null vector or a null or non-finite component take no part. Every other row counts: repeated rows
and rows of one id are rows of their own (an anchor's copy may be its positive). Equal scores go by id (nulls last); rows
equal in both give equal results. Shorter vectors count as padded by zeros. Rows without an id are never anchors. Windows of negative
positives are empty; anchors without a positive or without a row in a window give no row. An empty table gives an empty
result; other columns are ignored. Components and scores beyond the range of a long are cut to it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written

CODES, SAMPLE, ROUNDS = 32, 8192, 8
SHARD, ANCHORS = 8192, 1024
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
BIG = 2.0**62
LAST = 2**63 - 1  # where null ids sort
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def numbered(rows: DataFrame) -> DataFrame:
    """(id, n, label, x): whole components, and `n` that tells rows of one id apart; it holds once the rows are written."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * 256, F.lit(-BIG)), F.lit(BIG))), F.lit(int(-BIG))), F.lit(int(BIG))))
    own = rows.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("x"))
    return own.withColumn("n", F.monotonically_increasing_id())


def codebook(sample: np.ndarray, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by k-means; the first ones are spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(codes, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        of = nearest(sample, centres)[0]
        for c in range(len(centres)):
            if (mine := sample[of == c]).size:
                centres[c] = mine.mean(0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    code = far.argmin(1)
    return code, np.sqrt(((x - centres[code]) ** 2).sum(1))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded by zeros."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < size[:, None]] = pc.list_flatten(lists).to_numpy()
    return out


def product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products, cut to the range of a long: by doubles where all sums stay below 2^53, else by Python's integers."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2.0**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    whole = x.astype(object) @ q.astype(object)
    return np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in whole], np.int64)


class Shard:
    """Rows of a few cells, sorted by cell, with the bounds of the index."""

    def __init__(self, rows: pa.Table, index: dict, width: int):
        rows = rows.sort_by([("u", "ascending"), ("v", "ascending")])
        self.x = matrix(rows["x"].combine_chunks(), width)
        self.none = pc.is_null(rows["id"]).to_numpy()
        self.id, self.n, self.label = (pc.fill_null(rows[c], LAST).to_numpy() for c in ("id", "n", "label"))
        code = rows["u"].to_numpy().astype(np.int64) * CODES + rows["v"].to_numpy()
        cells, starts = np.unique(code, return_index=True)
        self.cells = dict(zip(cells.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(code)])))
        self.codes = [np.unique(cells // CODES), np.unique(cells % CODES)]
        self.small = float(np.abs(self.x).max(initial=0)) * width < 2.0**51
        self.floats = self.x.astype(np.float64)
        self.index = index

    def products(self, start: int, stop: int, q: np.ndarray, qf: np.ndarray, most: float) -> np.ndarray:
        if self.small and most * float(np.abs(self.x).max(initial=0)) * len(q) < 2.0**53:
            return self.floats[start:stop] @ qf
        return product(self.x[start:stop], q)

    def walk(self, q: np.ndarray):
        """(start, stop, highest, lowest possible score) of the shard's cells, the highest possible score first."""
        half = self.index["half"]
        bounds = []
        for side, part in enumerate((q[:half], q[half:])):
            own = self.codes[side]
            dot = self.index["centres"][side][own] @ part
            reach = self.index["radius"][side][own] * np.sqrt((part**2).sum())
            order = np.argsort(-(dot + reach), kind="stable")
            bounds.append((own[order].tolist(), (dot + reach)[order].tolist(), (dot - reach)[order].tolist()))
        (us, uh, ul), (vs, vh, vl) = bounds
        slack = 1e-9 * float(np.abs(q).sum() * max(np.abs(self.index["centres"][0]).max(initial=0), np.abs(self.index["centres"][1]).max(initial=0), 1) + 1)
        todo, seen = [(-(uh[0] + vh[0]), 0, 0)], {(0, 0)}
        while todo:
            high, i, j = heapq.heappop(todo)
            if (place := self.cells.get(us[i] * CODES + vs[j])) is not None:
                yield *place, -high + slack, ul[i] + vl[j] - slack
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(us) and b < len(vs) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(todo, (-(uh[a] + vh[b]), a, b))

    def _row(self, score, i: int) -> tuple:
        return -int(score), int(self.id[i]), bool(self.none[i]), int(self.n[i])

    def positives(self, an: int, label: int, q: np.ndarray) -> list[tuple]:
        """The best rows (-score, id, whether it is null, n) of the anchor's label but itself."""
        best: list = []
        qf, most = q.astype(np.float64), float(np.abs(q).max(initial=0))
        for start, stop, high, _ in self.walk(qf):
            floor = -best[-1][0] if len(best) == POSITIVES else None
            if floor is not None and high < floor:
                break
            mine = np.flatnonzero(self.label[start:stop] == label) + start
            if not len(mine):
                continue
            s = self.products(start, stop, q, qf, most)[mine - start]
            keep = mine if floor is None else mine[s >= floor]
            s = s if floor is None else s[s >= floor]
            found = [self._row(v, i) for v, i in zip(s, keep) if self.n[i] != an]
            best = heapq.nsmallest(POSITIVES, best + found)
        return best

    def negatives(self, label: int, windows: list[int], q: np.ndarray) -> list[list[tuple]]:
        """For each positive's score the best rows, as of `positives`, of other labels in its window."""
        low = [-(-LOW * p // 100) for p in windows]
        high = [HIGH * p // 100 for p in windows]
        best: list[list] = [[] for _ in windows]
        live = [k for k in range(len(windows)) if low[k] <= high[k]]
        qf, most = q.astype(np.float64), float(np.abs(q).max(initial=0))
        top = max((high[k] for k in live), default=0)
        for start, stop, at_most, at_least in self.walk(qf) if live else ():
            floor = [-best[k][-1][0] if len(best[k]) == NEGATIVES else low[k] for k in range(len(windows))]
            live = [k for k in live if at_most >= floor[k]]
            if not live:
                break
            if at_least > top:
                continue
            other = np.flatnonzero(self.label[start:stop] != label) + start
            s = self.products(start, stop, q, qf, most)[other - start]
            for k in live:
                fits = np.flatnonzero((s >= floor[k]) & (s <= high[k]))
                if len(fits) > NEGATIVES:  # ties with the tenth stay, the ids decide
                    fits = fits[s[fits] >= np.partition(s[fits], -NEGATIVES)[-NEGATIVES]]
                if len(fits):
                    best[k] = heapq.nsmallest(NEGATIVES, best[k] + [self._row(s[i], other[i]) for i in fits])
        return best


def indexed(own: DataFrame, codes: int | None = None, sample: int = SAMPLE) -> tuple[DataFrame | None, dict, int]:
    """Rows with their cell (u, v), the codebooks with radii, and the width of the vectors."""
    width = own.agg(F.max(F.size("x"))).first()[0] or 0
    some = own.orderBy(F.xxhash64("id", "n"), "id", "n").limit(sample).select("x").toArrow()["x"].combine_chunks()  # at most `sample` rows
    if not len(some):
        return None, {}, 0
    x = matrix(some, width).astype(np.float64)
    half = width // 2
    centres = [codebook(part, codes or CODES) for part in (x[:, :half], x[:, half:])]

    def assign(batches):
        for b in batches:
            x = matrix(b.column("x"), width).astype(np.float64)
            got = [nearest(part, c) for part, c in zip((x[:, :half], x[:, half:]), centres)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(g[0].astype(np.int32)) for g in got], *[pa.array(g[1]) for g in got]], ["id", "n", "label", "x", "u", "v", "du", "dv"])

    rows = written(own.select("id", "n", "label", "x").mapInArrow(assign, "id long, n long, label long, x array<long>, u int, v int, du double, dv double"))
    radius = [np.zeros(len(c)) for c in centres]
    side = lambda n, code, far: F.struct(F.lit(n).alias("side"), F.col(code).alias("code"), F.col(far).alias("far"))
    sides = rows.select(F.inline(F.array(side(0, "u", "du"), side(1, "v", "dv"))))
    for r in sides.groupBy("side", "code").agg(F.max("far").alias("far")).collect():  # two rows a code
        radius[r.side][r.code] = r.far * (1 + 1e-9)
    return rows, {"half": half, "centres": centres, "radius": radius}, width


def mined(rows: DataFrame) -> DataFrame:
    """For each anchor (an id divisible by 100) and each of its first positives the first negatives in the score window, ranked.
    rows: (vec_id, embedding, label)."""
    spark = rows.sparkSession
    own = written(numbered(rows))
    own, index, width = indexed(own)
    if own is None:
        return spark.createDataFrame([], OUT)
    cells = sorted(own.groupBy("u", "v").count().collect())  # at most CODES * CODES rows
    start, plan = 0, []
    for u, v, n in cells:
        plan.append((u, v, start, n))
        start += n
    shards = -(-start // SHARD)
    plan = F.broadcast(spark.createDataFrame(plan, "u int, v int, start long, cell long"))  # a row a cell
    place = own.join(plan, ["u", "v"]).withColumn("s", F.floor((F.col("start") + F.pmod(F.xxhash64("id", "n"), "cell")) / SHARD).cast("int"))
    anchors = own.filter("id % 100 = 0").select(F.col("id").alias("aid"), F.col("n").alias("an"), F.col("label").alias("alabel"), F.col("x").alias("q"))
    groups = max(1, -(-anchors.count() // ANCHORS))
    anchors = anchors.withColumn("g", F.pmod(F.xxhash64("aid", "an"), F.lit(groups)).cast("int"))
    dealt = place.select("s", "id", "n", "label", "x", "u", "v", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")).groupBy("s", "g")
    asked = lambda df: df.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("t")).groupBy("t", "g")

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            shard = Shard(left, index, width)
            q = matrix(right["q"].combine_chunks(), width)
            for k, (aid, an, label) in enumerate(zip(*(right[c].to_pylist() for c in ("aid", "an", "alabel")))):
                out += [(aid, an, None if none else i, n, -s) for s, i, none, n in shard.positives(an, label, q[k])]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["aid", "an", "pid", "pn", "score"])

    best = dealt.cogroup(asked(anchors)).applyInArrow(first, "aid long, an long, pid long, pn long, score long")
    rank = F.row_number().over(Window.partitionBy("aid", "an").orderBy(F.desc("score"), F.asc_nulls_last("pid"), "pn"))
    chosen = best.withColumn("p", rank).filter(F.col("p") <= POSITIVES)
    per = written(chosen.groupBy("aid", "an").agg(F.array_sort(F.collect_list(F.struct("p", "pid", "score"))).alias("positives")))  # five at most
    wanted = anchors.join(per, ["aid", "an"]).withColumn("windows", F.col("positives.score"))

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            shard = Shard(left, index, width)
            q = matrix(right["q"].combine_chunks(), width)
            for k, (aid, an, label, windows) in enumerate(zip(*(right[c].to_pylist() for c in ("aid", "an", "alabel", "windows")))):
                for p, found in enumerate(shard.negatives(label, windows, q[k])):
                    out += [(aid, an, p + 1, None if none else i, n, -s) for s, i, none, n in found]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["aid", "an", "p", "nid", "nn", "negative_score"])

    near = dealt.cogroup(asked(wanted.select("aid", "an", "alabel", "q", "windows", "g"))).applyInArrow(second, "aid long, an long, p int, nid long, nn long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("aid", "an", "p").orderBy(F.desc("negative_score"), F.asc_nulls_last("nid"), "nn"))
    ranked = near.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES)
    said = per.select("aid", "an", F.inline("positives")).withColumnRenamed("score", "positive_score")
    return ranked.join(said, ["aid", "an", "p"]).select(F.col("aid").alias("anchor_id"), F.col("pid").alias("positive_id"), "rank", F.col("nid").alias("negative_id"), "positive_score", "negative_score")


#: For tables whose ids differ. The sum over the components stays far below what a double holds exactly.
ORACLE_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS aid, r.id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score FROM r AS a, r WHERE a.id % 100 = 0 AND a.id <> r.id),
p AS (SELECT aid, id AS pid, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, id) <= 5)
SELECT p.aid AS anchor_id, pid AS positive_id, row_number() OVER (PARTITION BY p.aid, pid ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s ON s.aid = p.aid AND NOT same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps
QUALIFY row_number() OVER (PARTITION BY p.aid, pid ORDER BY score DESC, id) <= 10"""


def query(embeddings: DataFrame) -> DataFrame:
    """The label of every seventh id is shifted first, so that some positives lie far from their anchor."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(embeddings.select("vec_id", "embedding", shifted.alias("label")))
