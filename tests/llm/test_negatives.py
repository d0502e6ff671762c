"""Hard negatives against comparing every anchor with every row."""

import math
import random

import pytest

from lodestone.llm import hard_negatives as H

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
TYPES = "vec_id long, embedding array<double>, label int, score double, x string"


def brute(rows):
    """rows: (id, vector, label)."""
    fine = [(i, [math.floor(256 * c) for c in v], la) for i, v, la in rows if v is not None and la is not None and all(c is not None and math.isfinite(c) for c in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (i, q, la) in enumerate(fine):
        if i is None or i % 100:
            continue
        score = lambda v: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v))))  # noqa: E731,B023
        all_ = sorted(((-score(v), last(j), j, lb) for m, (j, v, lb) in enumerate(fine) if m != n), key=lambda x: x[:2])
        for p, _, pid, _ in [x for x in all_ if x[3] == la][:5]:
            fits = [x for x in all_ if x[3] != la and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(i, pid, k + 1, x[2], -p, -x[0]) for k, x in enumerate(fits)]
    return sorted(out, key=str)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 0.5, "y") for r in rows], TYPES).repartition(parts)
    return sorted((tuple(r[c] for c in COLUMNS) for r in H.mined(df).collect()), key=str)


def clustered(seed, n, dims=16, labels=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    return [(i, [c + r.gauss(0, 0.4) for c in r.choice(centres)], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("shard,anchors,codes", [(8192, 1024, 32), (60, 2, 5), (7, 1, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, shard, anchors, codes):
    monkeypatch.setattr(H, "SHARD", shard)
    monkeypatch.setattr(H, "ANCHORS", anchors)
    monkeypatch.setattr(H, "CODES", codes)
    rows = clustered(3, 420)
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5, 0.25], 1), (0, [1.0, 0.5, 0.25], 1), (0, [0.5, 0.5], 2), (None, [0.7, 0.2, 0.1], 1), (None, [0.5, 0.2, 0.1], 2), (100, [], 1), (200, [0.0, 0.0, 0.0], 1), (300, [-1.0, 0.1, 0.0], 1),
            (1, None, 1), (2, [1.0, None, 0.0], 1), (3, [nan, 1.0, 0.0], 2), (4, [inf, 1.0, 0.0], 2), (5, [1.0, 1.0, 1.0], None), (6, [0.3, 0.3, 0.3], 2), (7, [0.3, 0.3, 0.3], 2), (8, [0.3, 0.3, 0.3], 3), (6, [0.3, 0.3, 0.3], 2)]
    rows += [(10 + i, [0.6, 0.3, 0.0], 2) for i in range(14)] + [(400, [3e6, 1.0, 2e5], 3), (41, [2e6, 1.5, 2.0], 3), (42, [1.1e6, 0.0, 0.0], 2), (500, [1e30, 0.0, 0.0], 5), (51, [1e30, 0.0, 0.0], 5)]
    assert mined(spark, rows[:-2]) == brute(rows[:-2])
    mined(spark, rows)  # beyond a long's range: cut, no failure
    assert mined(spark, []) == [] and mined(spark, [(1, None, 1)]) == [] and mined(spark, [(100, [1.0, 1.0], 1)]) == []


def test_the_walk_visits_cells_by_their_bound_and_stops():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    x = (r.normal(size=(12, 8))[r.integers(0, 12, 3000)] * 200 + r.normal(size=(3000, 8)) * 8).astype(int)
    centres = [H.codebook(x[:, a:b].astype(float), 12) for a, b in ((0, 4), (4, 8))]
    (u, du), (v, dv) = (H.nearest(x[:, a:b].astype(float), c) for (a, b), c in zip(((0, 4), (4, 8)), centres))
    radius = [np.array([d[c == k].max(initial=0) for k in range(12)]) for c, d in ((u, du), (v, dv))]
    rows = pa.table({"id": np.arange(3000), "n": np.arange(3000), "label": np.zeros(3000, int), "x": x.tolist(), "u": u.astype("i4"), "v": v.astype("i4")})
    shard = H.Shard(rows, {"half": 4, "centres": centres, "radius": radius}, 8)
    cells = list(shard.walk(x[0].astype(float)))
    assert sum(b - a for a, b, *_ in cells) == 3000 and [c[2] for c in cells] == sorted((c[2] for c in cells), reverse=True)
    for a, b, high, low in cells:
        s = shard.x[a:b] @ x[0]
        assert s.max() <= high and s.min() >= low
    visited = []
    whole = shard.walk
    shard.walk = lambda q: (visited.append(c) or c for c in whole(q))
    shard.positives(0, 0, x[0])
    assert sum(b - a for a, b, *_ in visited) < 1500  # clusters far away are never looked at
