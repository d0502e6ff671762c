"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sorted set of sources that hold them). A flow sends the token
capacity of patterns to source quotas; the k-th pass over a pattern costs k, so that repetition is spread before any
document is repeated again. Documents are then taken in a seeded order until their pattern's flow is met.

Only patterns and sources reach the driver, at most `max_patterns` of them (beyond that the operator raises; it never
drops any). Null and blank texts have size 0 and are never taken. A null source is a source of its own, ordered last.
Repeated rows count each on its own; ties in the seeded order go by id, then size. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, written

BUCKETS = 1024
OUT = "doc_id long, size long, source_size long, target double, taken long"


def targets(sizes: dict, weights=(1, 2, 3), most: int = 3) -> dict:
    """Quota of each source: its weight's share of all sizes, at most `most` times its size; the excess is dealt again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, list(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def flow(patterns: dict[tuple, int], quota: dict, most: int = 3) -> dict[tuple, dict]:
    """Tokens that each pattern sends to each source: a maximum flow of least cost, the k-th pass over a pattern costing k.

    Levels are opened one after another, and paths are augmented until none is left; opening a cheaper level first
    gives the least convex cost because cost lies on the pattern's arcs alone."""
    sent = {p: dict.fromkeys(p, 0) for p in patterns}
    got = dict.fromkeys(quota, 0)
    need = {s: round(q) for s, q in quota.items()}
    holders: dict = {}
    for p in patterns:
        for s in p:
            holders.setdefault(s, []).append(p)
    for level in range(1, most + 1):
        while True:
            queue, seen = deque(), {}
            for p in sorted(patterns, key=str):
                if sum(sent[p].values()) < level * patterns[p]:
                    queue.append(("p", p))
                    seen["p", p] = None
            end = None
            while queue and end is None:
                kind, x = node = queue.popleft()
                for y in x if kind == "p" else [p for p in holders.get(x, []) if sent[p][x] > 0]:
                    step = ("s" if kind == "p" else "p", y)
                    if step not in seen:
                        seen[step] = node
                        queue.append(step)
                        if step[0] == "s" and got[y] < need[y]:
                            end = step
                            break
            if end is None:
                break
            path = [end]
            while seen[path[-1]] is not None:
                path.append(seen[path[-1]])
            path.reverse()
            steps = list(zip(path, path[1:]))
            room = min([level * patterns[path[0][1]] - sum(sent[path[0][1]].values()), need[end[1]] - got[end[1]], *[sent[b[1]][a[1]] for a, b in steps if a[0] == "s"]])
            for a, b in steps:
                if a[0] == "p":
                    sent[a[1]][b[1]] += room
                else:
                    sent[b[1]][a[1]] -= room
            got[end[1]] += room
    return sent


def mixed(docs: DataFrame, members: str = "members", size: str = "size", weights=(1, 2, 3), most: int = 3, seed: int = 7, max_patterns: int = 20_000) -> DataFrame:
    """docs (doc_id, `size`, `members`: array of sources) with `taken`: the tokens of whole passes the mix takes of each row."""
    spark = docs.sparkSession
    key = F.to_json(F.struct(F.array_sort(F.array_distinct(members)).alias("m")), {"ignoreNullFields": "false"})
    d = docs.withColumns({"_p": key, "_h": F.xxhash64(F.lit(seed), "doc_id")}).withColumn("_b", F.pmod(F.shiftright("_h", 8), F.lit(BUCKETS)).cast("int"))
    sums = written(d.groupBy("_p", "_b").agg(F.sum(size).alias("n"), F.first(F.array_sort(F.array_distinct(members))).alias("m")))
    rows = sums.groupBy("_p").agg(F.sum("n").alias("n"), F.first("m").alias("m")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(r.m): r.n for r in rows}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quota = targets(sizes, weights, most)
    sent = flow(patterns, quota, most)
    plan = [(r._p, int(sum(sent[tuple(r.m)].values())), int(r.n), float(sum(quota[s] for s in r.m)), int(sum(sizes[s] for s in r.m))) for r in rows]
    plan = F.broadcast(spark.createDataFrame(plan, "_p string, _flow long, _all long, target double, source_size long"))  # at most max_patterns rows
    passes = F.when(F.col("_all") > 0, F.floor(F.col("_flow") / F.col("_all"))).otherwise(0).cast("long")
    plan = plan.withColumns({"_passes": passes, "_rest": F.col("_flow") - passes * F.col("_all")})
    before = F.sum("n").over(Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    edge = sums.withColumn("_before", F.coalesce(before, F.lit(0))).join(plan.select("_p", "_rest"), "_p").filter((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("n") > F.col("_rest")))
    edge = F.broadcast(edge.select("_p", F.col("_b").alias("_edge"), "_before"))  # one row a pattern
    d = d.join(plan, "_p").join(edge, "_p", "left")
    inside = d.filter(F.col("_b") == F.col("_edge")).drop("_edge")
    so_far = F.sum(size).over(Window.partitionBy("_p").orderBy("_h", "doc_id", size).rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_extra", (F.col("_before") + so_far - F.col(size) / 2 <= F.col("_rest")).cast("long"))
    rest = d.filter(~F.col("_b").eqNullSafe(F.col("_edge"))).withColumn("_extra", F.coalesce((F.col("_b") < F.col("_edge")).cast("long"), F.lit(0)))
    keep = [c for c in docs.columns if c not in ("target", "source_size", "taken")] + ["target", "source_size"]
    taken = (F.col(size) * F.least(F.col("_passes") + F.col("_extra"), F.lit(most))).alias("taken")
    return rest.select(*keep, taken).unionByName(inside.select(*keep, taken))


def sized(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.array("source").alias("members"))


def query(docs: DataFrame) -> DataFrame:
    return mixed(sized(docs, "doc_id")).select("doc_id", "size", "source_size", "target", "taken")
