"""Chroma audio fingerprints and their alignment.

A recording's samples become frames of twelve pitch classes; filters over the integral image of these frames, each
quantised to two bits, give one packed 32-bit integer a frame. Two recordings meet in an offset histogram: every position
of one and every position of the other vote for the offset between them, with the bits in which their integers agree. The
votes of all offsets are one correlation, made by Fourier transforms for many pairs at once (`votes`); 32 bits for each
overlapping frame less the votes are the wrong bits, exactly. Matches are recordings of at most `MOST_ERRORS` wrong bits at an
offset whose overlap is half of the shorter recording. `compared` tests all pairs and all such offsets, so it leaves none out.

`aligned` is the search by an index, for tables whose pairs are too many: the histogram counts equal integers alone, of the
recordings that hold one of a query's integers or of those with its least certain bits turned (`probes`: the `WEAK` filters
nearest to a level's edge, all subsets). It misses matches without such an integer (recall in README); the query doesn't use it.

Recordings are derived from vectors: each component sounds one note; null components are left out. Null or empty recordings have no
fingerprint and match nothing; of equal errors the nearest offset wins, then the smallest; repeated rows match each other, also under one id; rows without an id are
found and ask nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, FRAME, HOP, NOTE = 4096, 512, 256, 512
#: Filters (kind, first pitch class, classes, frames): 0 mean, 1 halves of pitch, 2 halves of time, 3 chequered.
FILTERS = [(k, c, h, w) for k, c, h, w in zip((1, 2, 3, 2) * 4, (0, 2, 4, 6, 8, 1, 3, 5, 0, 4, 8, 2, 6, 0, 3, 6), (4, 4, 4, 4, 4, 6, 6, 6, 12, 8, 4, 6, 6, 12, 8, 4), (8, 8, 8, 8, 8, 4, 4, 4, 16, 16, 16, 12, 12, 4, 12, 4))]
CUTS, WEAK, MOST_ERRORS = (-0.04, 0.0, 0.04), 8, 0.25
BLOCK = 512  # recordings of each side that meet in one task's group
SINGLE = 4096  # up to this size, single precision keeps sums well within half a vote
STRIPS = 5_400, 100_000  # offsets of queries, and of recordings, whose histograms are made at once


_tones = np.sin(2 * np.pi * (220 * 2 ** (np.arange(24) / 12))[:, None] * (np.arange(NOTE) / RATE))


def samples(vector: list[float]) -> np.ndarray:
    """A tone of `NOTE` samples for each component; its size picks one of 24 semitones."""
    v = np.asarray(vector, float)
    return _tones[np.clip(np.round((v * np.sqrt(len(v)) + 2) * 6), 0, 23).astype(int)].ravel()


_at = np.arange(FRAME // 2 + 1)
_class = np.zeros((FRAME // 2 + 1, 12))
_class[_at[1:], np.round(12 * np.log2(_at[1:] * RATE / FRAME / 220)).astype(int) % 12] = _at[1:] * RATE / FRAME >= 100
_window = np.hanning(FRAME)


def levels(x: np.ndarray) -> np.ndarray:
    """The value of each filter at each frame that every filter can reach."""
    n = (len(x) - FRAME) // HOP + 1 - max(f[3] for f in FILTERS) + 1
    if n <= 0:
        return np.empty((0, len(FILTERS)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * _window
    spectrum = np.fft.rfft(frames, axis=1)
    chroma = (spectrum.real**2 + spectrum.imag**2) @ _class
    chroma /= np.maximum(np.linalg.norm(chroma, axis=1, keepdims=True), 1e-9)
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(0).cumsum(1)
    area = lambda a, b, c, d: image[b : b + n, d] - image[a : a + n, d] - image[b : b + n, c] + image[a : a + n, c]
    out = np.empty((n, len(FILTERS)))
    for k, (kind, c, h, w) in enumerate(FILTERS):
        m, half = w // 2, c + h // 2
        if kind == 1:
            value = area(0, w, c, half) - area(0, w, half, c + h)
        elif kind == 2:
            value = area(0, m, c, c + h) - area(m, w, c, c + h)
        else:
            value = area(0, m, c, half) + area(m, w, half, c + h) - area(0, m, half, c + h) - area(m, w, c, half)
        out[:, k] = np.round(value / (w * h), 9)
    return out


def packed(values: np.ndarray) -> np.ndarray:
    """One integer a frame: each filter's level in Gray code, two bits, the first filter highest."""
    level = np.searchsorted(CUTS, values, side="right").astype(np.uint32)
    level ^= level >> np.uint32(1)
    return (level << np.arange(2 * len(FILTERS) - 2, -1, -2, dtype=np.uint32)).sum(1, dtype=np.uint32)


def fingerprint(x: np.ndarray) -> np.ndarray:
    return packed(levels(x))


def probed(values: np.ndarray, weak: int = WEAK) -> np.ndarray:
    """Per frame its integer and those with the bits of its `weak` least certain filters turned, all subsets."""
    away = np.abs(values[:, :, None] - np.array(CUTS))
    order = np.argsort(away.min(2), axis=1, kind="stable")[:, :weak]
    edge = np.take_along_axis(away.argmin(2), order, 1)  # crossing the middle edge turns the high bit, another edge the low one
    turn = np.uint32(1) << (2 * (len(FILTERS) - 1 - order) + (edge == 1)).astype(np.uint32)
    out = packed(values)[:, None]
    for k in range(weak):
        out = np.hstack([out, out ^ turn[:, k : k + 1]])
    return out


def _recording(vector) -> np.ndarray:
    return samples([x for x in vector or [] if x is not None])


def fingerprints(vectors: DataFrame) -> DataFrame:
    """(vec_id, print: array of integers) of each row's recording."""

    def run(batches):
        for b in batches:
            prints = [fingerprint(_recording(v)).astype(np.int64) for v in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(prints, pa.list_(pa.int64()))], ["vec_id", "print"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, print array<long>")


def probe_rows(values: np.ndarray, weak: int = WEAK) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct integers of `probed` and the positions of each."""
    every = probed(values, weak)
    flat = every.ravel()
    order = np.argsort(flat, kind="stable")
    found, start = np.unique(flat[order], return_index=True)
    places = np.split((order // every.shape[1]).astype(np.int32), start[1:]) if len(found) else []
    return found.astype(np.int64), [np.unique(x) for x in places]


def probes(vectors: DataFrame, weak: int = WEAK) -> DataFrame:
    """(query_id, key, qs: positions) of each row's recording, keys with turned bits included."""

    def run(batches):
        for b in batches:
            ids, keys, places = [], [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
                found, at = probe_rows(levels(_recording(v)), weak)
                ids += [i] * len(found)
                keys.append(found)
                places += at
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["query_id", "key", "qs"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, key long, qs array<int>")


def aligned(prints: DataFrame, queries: DataFrame, keys: DataFrame, most_errors: float = MOST_ERRORS) -> DataFrame:
    """For each query every recording within `most_errors`, at its offset of least error: (query_id, vec_id, offset, bit_error, hits).

    prints and queries are (vec_id, print), keys the queries' probes. Every offset with a shared key whose overlap is half of the shorter recording is tested."""
    post = prints.select("vec_id", F.posexplode("print").alias("pos", "key"))
    hits = post.join(keys, "key").filter("vec_id <> query_id").select("query_id", "vec_id", F.explode(F.transform("qs", lambda q: F.col("pos") - q)).alias("offset")).groupBy("query_id", "vec_id", "offset").count()
    pairs = hits.groupBy("query_id", "vec_id").agg(F.collect_list(F.struct("offset", F.col("count").alias("hits"))).alias("at"))  # at most one entry an offset
    both = pairs.join(queries.select(F.col("vec_id").alias("query_id"), F.col("print").alias("q")), "query_id").join(prints.select("vec_id", "print"), "vec_id")
    both = both.select("query_id", "vec_id", "q", "print", F.inline("at"))
    n = F.least(F.size("q") + F.least(F.col("offset"), F.lit(0)), F.size("print") - F.greatest(F.col("offset"), F.lit(0)))
    both = both.withColumn("n", n).filter(F.col("n") * 2 >= F.least(F.size("q"), F.size("print")))
    part = lambda c, start: F.slice(c, F.greatest(F.lit(1), 1 + start).cast("int"), F.col("n").cast("int"))
    differ = F.zip_with(part("q", -F.col("offset")), part("print", F.col("offset")), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    wrong = F.aggregate(differ, F.lit(0).cast("long"), lambda x, y: x + y)
    near = both.withColumn("bit_error", F.round(wrong / (32 * F.col("n")), 6)).filter(F.col("bit_error") <= most_errors)
    best = near.groupBy("query_id", "vec_id").agg(F.min(F.struct("bit_error", F.abs("offset").alias("far"), "offset", "hits")).alias("m"))
    return best.select("query_id", "vec_id", "m.offset", "m.bit_error", "m.hits")


def _spectra(x: np.ndarray, size: int) -> np.ndarray:
    """(frequency, recording, bit) of recordings of one length, bits as signs."""
    bits = np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1)
    signs = 1 - 2 * bits.astype(np.float32 if size <= SINGLE else np.float64)
    return np.fft.rfft(signs, size, axis=0).reshape(-1, len(x), 32)


def _transform_size(n: int) -> int:
    """The smallest product of twos, threes, fives and sevens from n on."""
    while True:
        m = n
        for k in (2, 3, 5, 7):
            while m % k == 0:
                m //= k
        if m == 1:
            return n
        n += 1


def votes(q: np.ndarray, r: np.ndarray, most_errors: float = MOST_ERRORS) -> tuple[np.ndarray, ...]:
    """The pairs of queries q and recordings r (integers, one length a side) within most_errors: (query, recording, offset, millionths of
    wrong bits, hits: equal integers there), at the offset of least error. Histograms are made a few queries by many recordings at a time, as
    many as the transform's size allows, so that neither long recordings nor many offsets within the limit fill the memory."""
    n, p = q.shape[1], r.shape[1]
    least = (min(n, p) + 1) // 2
    size = _transform_size(n + p - least)  # offsets of too small an overlap may fall together, others not
    offsets = np.arange(least - n, p - least + 1)
    overlap = np.minimum(n + np.minimum(offsets, 0), p - np.maximum(offsets, 0))
    least_agree, place = np.full(size, np.inf, np.float32 if size <= SINGLE else np.float64), np.zeros(size, np.int64)
    least_agree[offsets % size] = 32 * overlap * (1 - 2 * most_errors - 2e-6) - 0.5
    place[offsets % size] = np.arange(len(offsets))
    found = []
    for above in range(0, len(r), wide := max(1, STRIPS[1] // size)):
        of_r = _spectra(r[above : above + wide], size).transpose(0, 2, 1)
        for start in range(0, len(q), step := max(1, STRIPS[0] // size)):
            agree = np.fft.irfft(_spectra(q[start : start + step], size).conj() @ of_r, size, axis=0)  # equal bits less wrong ones
            at = np.flatnonzero(agree >= least_agree[:, None, None])
            k, i, j = np.unravel_index(at, agree.shape)
            o, bits = offsets[place[k]], 32 * overlap[place[k]]
            wrong = (bits - np.rint(agree.ravel()[at]).astype(np.int64)) // 2
            error = (2_000_000 * wrong + bits) // (2 * bits)  # rounded half up
            order = np.lexsort((o, np.abs(o), error, j, i))
            order = order[error[order] <= most_errors * 1e6]
            first = np.ones(len(order), bool)
            first[1:] = (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
            best = order[first]
            found.append((i[best] + start, j[best] + above, o[best], error[best], bits[best] // 32))
    i, j, o, error, frames = map(np.concatenate, zip(*found))
    hits = np.zeros(len(i), np.int64)
    for at in np.unique(o):
        own = np.flatnonzero(o == at)
        m, a, b = frames[own[0]], max(0, -at), max(0, at)
        hits[own] = (q[i[own], a : a + m] == r[j[own], b : b + m]).sum(1)
    return i, j, o, error, hits


def _of_one_length(table: pa.Table, id: str, most: int):
    """(ids, integers) of recordings of one length, about `most` integers at a time."""
    ids, prints = table.column(id).to_numpy(), table.column("print").combine_chunks()
    length = pc.list_value_length(prints).to_numpy(zero_copy_only=False)
    flat, start = prints.flatten().to_numpy().astype(np.uint32), np.cumsum(length) - length
    for n in np.unique(length):
        every = np.flatnonzero(length == n)
        step = max(1, most // n)
        for k in range(0, len(every), step):
            at = every[k : k + step]
            yield ids[at], flat[start[at][:, None] + np.arange(n)]


MATCH = "query_id long, vec_id long, offset int, bit_error double, hits long"


def met(left: pa.Table, right: pa.Table, most_errors: float = MOST_ERRORS) -> pa.Table:
    """The matches (`MATCH`) of a block of queries (query_id, print) in a block of recordings (vec_id, print) of other ids."""
    out = [[np.empty(0, np.int64)] for _ in range(5)]
    for ids, r in _of_one_length(right, "vec_id", STRIPS[1]):
        for asked, q in _of_one_length(left, "query_id", STRIPS[1]):
            i, j, *more = votes(q, r, most_errors)
            other = asked[i] != ids[j]
            for column, x in zip(out, (asked[i], ids[j], *more)):
                column.append(x[other])
    query_id, vec_id, offset, error, hits = map(np.concatenate, out)
    return pa.table([pa.array(query_id), pa.array(vec_id), pa.array(offset, pa.int32()), pa.array(error / 1e6), pa.array(hits)], ["query_id", "vec_id", "offset", "bit_error", "hits"])


def compared(prints: DataFrame, queries: DataFrame, most_errors: float = MOST_ERRORS) -> DataFrame:
    """For each query every recording of another id within `most_errors`, at its offset of least error: (query_id, vec_id, offset,
    bit_error, hits). prints and queries are (vec_id, print), ids neither null nor repeated, prints not empty; each block of queries meets each block of prints in a group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return met(left, right, most_errors)

    n_q, n_r = (max(1, -(-x.count() // BLOCK)) for x in (queries, prints))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("vec_id").alias("query_id"), "print", block(n_q).alias("q"), every(n_r).alias("r"))
    right = prints.select("vec_id", "print", block(n_r).alias("r"), every(n_q).alias("q"))
    parts = min(n_q * n_r, 4096)
    left, right = (x.repartition(parts, "q", "r").groupBy("q", "r") for x in (left, right))
    return left.cogroup(right).applyInArrow(run, MATCH)


def matches(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Every match of each query (vec_id, embedding) in vectors: (query_id, vec_id, offset, bit_error, hits, copies). Recordings
    of equal fingerprints are one class: a match is given once a class, by its smallest other id; `copies` counts its
    recordings other than the query."""
    from lodestone.llm.common import written

    prints = written(fingerprints(vectors).filter("size(print) > 0").withColumn("mark", F.sha2(F.to_json(F.struct("print")), 256)))
    classes = prints.groupBy("mark").agg(F.min("vec_id").alias("rep"), F.first("print").alias("print"), F.count("*").alias("n"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("class"), "mark", "rep", "print", "n"))
    named = classes.select("class", "mark", "rep", "n")
    ids = prints.groupBy("mark", "vec_id").agg(F.count("*").alias("rows"))
    second = ids.join(named.select("mark", "rep"), "mark").filter("vec_id <> rep or rows > 1").groupBy("mark").agg(F.min("vec_id").alias("second"))
    asked = ids.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").join(named, "mark").join(second, "mark", "left").drop("rows")
    same = asked.filter("n > 1").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") == F.col("rep"), F.col("second")).otherwise(F.col("rep")).alias("vec_id"), F.lit(0).alias("offset"), F.lit(0.0).alias("bit_error"), F.lit(None).cast("long").alias("hits"), (F.col("n") - 1).alias("copies"))
    recordings = classes.select(F.col("class").alias("vec_id"), "print")
    found = compared(recordings, written(recordings.join(asked.select(F.col("class").alias("vec_id")).distinct(), "vec_id", "left_semi")))
    found = found.withColumnsRenamed({"query_id": "asked", "vec_id": "class"}).join(asked.select(F.col("class").alias("asked"), F.col("vec_id").alias("query_id")), "asked")
    found = found.join(named.select("class", F.col("rep").alias("vec_id"), F.col("n").alias("copies")), "class")
    return same.union(found.select("query_id", "vec_id", "offset", "bit_error", "hits", "copies"))


def query(vectors: DataFrame) -> DataFrame:
    """Every match of every vector whose id is divisible by 100, against all: no cap on a query's matches."""
    return matches(vectors, vectors.filter("vec_id % 100 = 0"))
