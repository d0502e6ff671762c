"""N-gram Jaccard join by filters under several global token orders.

Tokens are hashed 5-word shingles. Any global order of tokens gives a necessary filter: two sets of Jaccard >= T share a
token in their prefixes of n - ceil(T n) + 1 tokens. All orders here put tokens that one document alone has first, which
ends most documents at once: whose prefix holds only such tokens links with nothing. The first order goes on by
ascending document frequency, two more by seeded hashes. Candidates come from shared prefix tokens of the first order
and are cut to those that share prefix tokens under each other order as well; only then are whole sets joined in and
verified exactly (a token is its 48 low hash bits and its bucket, at most 54 bits and more with more buckets).

Steps: (1) tasks hash whole texts and send packed tokens to buckets; equal sets in a batch go once. (2) Buckets find
tokens held more than once and send counts back by batch. (3) Documents left are joined: in star rounds every posting
list meets one central member, and linked documents are united; lists inside one component are done. (4) Pairs that are
left, of different components with a shared prefix token, are all verified, so no link between components is lost.

Null and blank texts have no set and link with nothing; fewer than five words make one shingle. Equal sets are one class
(ties: the smallest id stands for it). Repeated rows link; an empty table gives an empty result. No caps on candidates.
Classes are numbered apart from ids: an id may repeat with other texts or be null. A component without any id has a null
component_id; one id with texts that don't link gives components of one component_id, which `classes` tells apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import freed, kept, written

K, PERCENT, BATCH_TOKENS, BUCKET_CHARS = 5, 75, 500_000, 12_000_000
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
CACHE_WORDS = 150_000  # bounds memory alone
SALTS = 16


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, k: int = K):
        self.k, self.words = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the k-word shingles of a text."""
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        get = self.words.get
        h = [get(w) for w in words]
        if None in h:
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            for i, x in enumerate(h):
                if x is None:
                    h[i] = self.words[words[i]] = xxhash.xxh64_intdigest(words[i])
        h = np.array(h, np.uint64)
        if len(h) < self.k:
            h = np.concatenate([h, np.full(self.k - len(h), len(h), np.uint64)])
        out = h[: len(h) - self.k + 1].copy()
        for i in range(1, self.k):
            out = mix(out * np.uint64(0x2545F4914F6CDD1D) + h[i : len(h) - self.k + 1 + i])
        return np.unique(mix(out))


def need(n: int) -> int:
    """Smallest possible intersection of a set of n with a linked one."""
    return -(-PERCENT * n // 100)


def _blob(x: np.ndarray) -> bytes:
    return x.tobytes()


def _batches(n_buckets: int, k: int):
    """Rows (to, batch, kind, a, b, c): kind 0 the batch's documents for the way back, kind 1 tokens of a bucket."""

    def run(arrow):
        shingle = kept(("shingles", k), lambda: Shingler(k))
        task, number = TaskContext.get().partitionId(), 0
        ids, marks, sizes, rep, sets, by_sig, tokens = [], [], [], [], [], {}, 0

        def out():
            nonlocal number, ids, marks, sizes, rep, sets, by_sig, tokens
            if not ids:
                return None
            uid = hashlib.blake2b(f"{task},{number}".encode(), digest_size=16).hexdigest()  # no other batch has it, a retry has
            number += 1
            sig = b"".join(by_sig)
            head = _blob(np.array([i or 0 for i in ids], np.int64)) + _blob(np.array(marks, np.int64)) + _blob(np.array([i is None for i in ids]))
            rows = [(int(uid[:8], 16) % n_buckets, uid, 0, head, _blob(np.array([sizes, rep], np.int32)), sig)]
            if sets:
                tok = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
                at = (tok >> np.uint64(40)).astype(np.int64) % n_buckets
                order = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[order], np.arange(n_buckets + 1))
                low = tok[order]
                doc = doc[order]
                for b in range(n_buckets):
                    if cuts[b] < cuts[b + 1]:
                        s = low[cuts[b] : cuts[b + 1]]
                        packed = s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()  # 48 bits; the bucket holds more
                        rows.append((b, uid, 1, packed, _blob(doc[cuts[b] : cuts[b + 1]].astype(np.uint16 if len(sets) < 65536 else np.uint32)), b""))
            ids, marks, sizes, rep, sets, by_sig, tokens = [], [], [], [], [], {}, 0
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[3:])], ["to", "batch", "kind", "a", "b", "c"])

        for b in arrow:
            for i, m, t in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), (x.as_py() for x in b.column("text"))):
                s = shingle(t)
                ids.append(i)
                marks.append(m)
                sizes.append(len(s))
                if not len(s):
                    rep.append(-1)
                    continue
                sig = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if sig not in by_sig:
                    by_sig[sig] = len(by_sig)
                    sets.append(s)
                    tokens += len(s)
                rep.append(by_sig[sig])
                if tokens >= BATCH_TOKENS or len(ids) >= 60_000:
                    yield out()
        if (last := out()) is not None:
            yield last

    return run


def _tokens(a: bytes) -> np.ndarray:
    out = np.zeros((len(a) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(a, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _count(arrow):
    """Per bucket: back to each batch go its tokens that are held more than once, with their counts."""
    rows, heads = [], []
    for b in arrow:
        for r in b.to_pylist():
            (rows if r["kind"] else heads).append(r)
    for h in heads:
        yield pa.RecordBatch.from_arrays([pa.array([h["batch"]]), pa.array([0], pa.int32()), *(pa.array([h[c]], pa.binary()) for c in "abc")], ["batch", "kind", "a", "b", "c"])
    by_bucket: dict = {}
    while rows:
        r = rows.pop()
        by_bucket.setdefault(r["to"], []).append(r)
    while by_bucket:
        bucket, mine = by_bucket.popitem()
        toks = [_tokens(r["a"]) for r in mine]
        every = np.sort(np.concatenate(toks))
        start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        n = np.diff(np.append(start, len(every)))
        shared, n = every[start[n > 1]], n[n > 1]
        del every
        for r, t in zip(mine, toks):
            doc = np.frombuffer(r["b"], np.uint16 if len(r["b"]) == 2 * len(t) else np.uint32).astype(np.uint32)
            if not len(shared):
                continue
            at = np.minimum(np.searchsorted(shared, t), len(shared) - 1)
            hit = shared[at] == t
            if hit.any():
                full = mix(t[hit] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(bucket))
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]]), pa.array([1], pa.int32()), pa.array([_blob(full)], pa.binary()), pa.array([_blob(n[at[hit]].astype(np.uint32))], pa.binary()), pa.array([_blob(doc[hit])], pa.binary())], ["batch", "kind", "a", "b", "c"])
        toks = mine = r = t = doc = None
    freed()


SKETCH = 8  # 64-bit words


def _sketches(arrow):
    """Per set: its tokens without partners, and bits that flip once for each other token. Differing bits of two sets
    are at most the tokens by which they differ, so too many of them rule a pair out without its sets."""
    for b in arrow:
        words, alone = [], []
        for n, t in zip(b.column("n").to_pylist(), b.column("toks").to_pylist()):
            t = np.frombuffer(t, np.uint64)
            bits = np.bincount((mix(t ^ SEEDS[0]) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
            words.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            alone.append(n - len(t))
        flat = np.concatenate(words) if words else np.empty(0, np.int64)
        sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SKETCH), pa.int32()), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(alone, pa.int32()), sketch], ["cid", "alone", "sketch"])


ORDERS = "cid long, o0 binary, o1 binary"
SETS = "doc_id long, mark long, n int, sig binary, alive boolean, toks binary, dfs binary"


def _gather(arrow):
    """Per batch: every document with its set's size and signature, and the shared tokens of sets that can link."""
    by_batch: dict = {}
    for b in arrow:
        for r in b.to_pylist():
            by_batch.setdefault(r["batch"], []).append(r)
    while by_batch:
        _, rows = by_batch.popitem()
        head, *more = [r for r in rows if not r["kind"]]
        if more:
            raise ValueError("two batches have one key")
        rows = [r for r in rows if r["kind"]]
        many = len(head["a"]) // 17
        ids, marks = np.frombuffer(head["a"], np.int64, 2 * many).reshape(2, -1).tolist()
        ids = [None if x else i for i, x in zip(ids, head["a"][16 * many :])]
        sizes, rep = np.frombuffer(head["b"], np.int32).reshape(2, -1)
        tok = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows]) if rows else np.empty(0, np.uint64)
        df = np.concatenate([np.frombuffer(r["b"], np.uint32) for r in rows]) if rows else np.empty(0, np.uint32)
        doc = np.concatenate([np.frombuffer(r["c"], np.uint32) for r in rows]) if rows else np.empty(0, np.uint32)
        order = np.argsort(doc, kind="stable")
        tok, df, doc = tok[order], df[order], doc[order]
        n_sets = len(head["c"]) // 16
        cuts = np.searchsorted(doc, np.arange(n_sets + 1))
        out, first = [], set()
        for i, m, n, k in zip(ids, marks, sizes.tolist(), rep.tolist()):
            if k < 0:
                out.append((i, m, 0, None, False, None, None))
            else:
                sig = head["c"][16 * k : 16 * k + 16]
                alive = int(cuts[k + 1] - cuts[k]) >= need(n)
                give = alive and k not in first
                first.add(k)
                t, f = tok[cuts[k] : cuts[k + 1]], df[cuts[k] : cuts[k + 1]]
                out.append((i, m, n, sig, alive, _blob(t) if give else None, _blob(f) if give else None))
            if len(out) == 2000:
                yield _sets(out)
                out = []
        if out:
            yield _sets(out)
    head = rows = tok = df = doc = order = out = r = None
    freed()


def _sets(rows):
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.bool_()), pa.array(c[5], pa.binary()), pa.array(c[6], pa.binary())], ["doc_id", "mark", "n", "sig", "alive", "toks", "dfs"])


def _prefixes(arrow):
    """Rows (cid, n, tok, score, pos): the first order's prefix and the place of each token in it; score: how common a document's tokens are on average."""
    for b in arrow:
        cid, size, tok, score, pos = [], [], [], [], []
        for i, n, t, f in zip(*(b.column(c).to_pylist() for c in ("cid", "n", "toks", "dfs"))):
            t, f = np.frombuffer(t, np.uint64), np.frombuffer(f, np.uint32)
            p = n - need(n) + 1 - (n - len(t))
            if p > 0:
                own = t[np.lexsort((t, f))][:p]
                tok.append(own.view(np.int64))
                cid += [i] * len(own)
                size += [n] * len(own)
                score += [float(f.sum()) / n] * len(own)
                pos += range(n - len(t), n - len(t) + len(own))
        yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(size, pa.int32()), pa.array(np.concatenate(tok) if tok else np.empty(0, np.int64)), pa.array(score, pa.float64()), pa.array(pos, pa.int32())], ["cid", "n", "tok", "score", "pos"])


def _orders(arrow):
    """Rows (cid, o0, o1): a set's prefix under each seeded order, its tokens without partners first in every order."""
    for b in arrow:
        cols = [[] for _ in SEEDS]
        for n, t in zip(b.column("n").to_pylist(), b.column("toks").to_pylist()):
            t = np.frombuffer(t, np.uint64)
            p = n - need(n) + 1 - (n - len(t))
            for col, seed in zip(cols, SEEDS):
                col.append(_blob(t[:0] if p <= 0 else t if p >= len(t) else t[np.argpartition(mix(t ^ seed), p - 1)[:p]]))
        yield pa.RecordBatch.from_arrays([b.column("cid"), *(pa.array(c, pa.binary()) for c in cols)], ["cid", *(f"o{k}" for k in range(len(SEEDS)))])


def _shared(arrow):
    """Candidates whose prefixes share a token under every seeded order."""
    for b in arrow:
        ok = np.ones(b.num_rows, bool)
        for k in range(len(SEEDS)):
            for i, (x, y) in enumerate(zip(b.column(f"a{k}").to_pylist(), b.column(f"b{k}").to_pylist())):
                ok[i] = ok[i] and len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) > 0
        mask = pa.array(ok)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])


def ordered(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """The candidates (a, b) left after intersecting with the filters of the other orders."""
    side = lambda x: orders.select(F.col("cid").alias(x), *(F.col(f"o{k}").alias(f"{x}{k}") for k in range(len(SEEDS))))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_shared, "a long, b long")


def _linked(n_a: int, t_a: np.ndarray, n_b: int, t_b: np.ndarray) -> bool:
    if min(n_a, n_b) < need(max(n_a, n_b)):
        return False
    both = len(np.intersect1d(t_a, t_b, assume_unique=True))
    return 100 * both >= PERCENT * (n_a + n_b - both)


def _verify(arrow):
    for b in arrow:
        c = {x: b.column(x).to_pylist() for x in ("a", "b", "na", "nb", "ta", "tb")}
        ok = [_linked(na, np.frombuffer(ta, np.uint64), nb, np.frombuffer(tb, np.uint64)) for na, ta, nb, tb in zip(c["na"], c["ta"], c["nb"], c["tb"])]
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("toks").alias(f"t{x}"))
    return written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(_verify, "a long, b long"))


def spread(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows left joined with names (one row a key): a key that holds many rows goes to `SALTS` tasks. Names grow with the
    documents and are repeated here, which Spark's estimates of size leave out, so they are never broadcast."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    each = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each.hint("merge"), [key, "_salt"], "left").drop("_salt")


def united(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (cid, comp) after uniting the components that links (a, b) join: smallest labels spread along component links, halving paths."""
    of = lambda x: comp.select(F.col("cid").alias(x), F.col("comp").alias(f"c{x}"))
    ends = lambda x: of(x).join(links.select(x).distinct(), x, "left_semi")  # noqa: E731  one row an end, however many links it has
    edges = spread(spread(links, ends("a"), "a"), ends("b"), "b").filter("ca <> cb").select("ca", "cb").distinct()
    edges = written(edges.union(edges.select("cb", "ca")).distinct().toDF("u", "v"))
    label = written(edges.select("u").distinct().select("u", F.col("u").alias("to")))
    if label.isEmpty():
        return comp
    while True:
        near = edges.join(label.withColumnsRenamed({"u": "v", "to": "vt"}), "v").groupBy("u").agg(F.min("vt").alias("m"))
        step = written(label.join(near, "u", "left").select("u", F.least("to", F.coalesce("m", "to")).alias("to"), F.col("to").alias("was")))
        goals = step.select("to").distinct().join(step.select(F.col("u").alias("to"), F.col("to").alias("up")), "to")
        new = written(spread(step, goals, "to").select("u", F.least("to", F.coalesce("up", "to")).alias("to"), "was"))
        done = new.filter("to <> was").isEmpty()
        label = new.select("u", "to")
        if done:
            return written(spread(comp, label.withColumnsRenamed({"u": "comp"}), "comp").select("cid", F.coalesce("to", "comp").alias("comp")))


def components(docs: DataFrame, k: int = K, rounds: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    return classes(docs, k, rounds).select("doc_id", "n_shingles", "component_id")


def classes(docs: DataFrame, k: int = K, rounds: int = 3) -> DataFrame:
    """As components, with `mark`, the text's xxhash64, and `label`, which each component has for itself (null without a set)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    sent = docs.mapInArrow(_batches(buckets, k), "to int, batch string, kind int, a binary, b binary, c binary")
    back = sent.repartition(buckets, "to").mapInArrow(_count, "batch string, kind int, a binary, b binary, c binary")
    every = written(back.repartition(buckets, "batch").mapInArrow(_gather, SETS))
    alive = every.filter("alive").groupBy("sig").agg(F.min("doc_id").alias("low"), F.max_by(F.struct("n", "toks", "dfs"), F.col("toks").isNotNull()).alias("s"))
    sets = written(alive.select(F.monotonically_increasing_id().alias("cid"), "low", "sig", "s.n", "s.toks", "s.dfs"))
    posts = written(sets.select("cid", "n", "toks", "dfs").mapInArrow(_prefixes, "cid long, n int, tok long, score double, pos int"))
    orders = written(sets.select("cid", "n", "toks").mapInArrow(_orders, ORDERS))
    comp = sets.select("cid", F.col("cid").alias("comp"))
    for turn in range(rounds + 1):
        p = written(posts.join(comp, "cid"))
        lists = p.groupBy("tok").agg(F.max(F.struct("score", F.xxhash64(F.lit(turn), "cid").alias("h"), "cid", "comp", "n")).alias("best"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        if turn < rounds:
            near = p.join(lists.select("tok", F.col("best.cid").alias("b"), F.col("best.comp").alias("bc"), F.col("best.n").alias("nb")), "tok").filter("comp <> bc")
            pairs = near.select(F.col("cid").alias("a"), "b", "n", "nb")
        else:
            bits = sets.select("cid", "n", "toks").mapInArrow(_sketches, "cid long, alone int, sketch array<long>")
            bits = bits.select("cid", "alone", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])
            q = p.join(lists.select("tok"), "tok", "left_semi").join(bits, "cid")
            total = F.col("x.n") + F.col("y.n")
            least = total - F.floor(total * 100 / (100 + PERCENT))  # tokens both must share
            apart = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH)), F.col("x.alone") + F.col("y.alone"))
            rest = lambda s: F.col(f"{s}.n") - F.col(f"{s}.pos")  # noqa: E731  tokens from this place on
            on = (apart <= total - 2 * least) & (F.least(rest("x"), rest("y")) >= least) & (F.col("x.tok") == F.col("y.tok")) & (F.col("x.comp") < F.col("y.comp")) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * PERCENT)
            pairs = q.alias("x").join(q.alias("y"), on).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("nb"))
        pairs = pairs.filter(F.least("n", "nb") * 100 >= F.greatest("n", "nb") * PERCENT).select("a", "b").distinct()
        links = _verified(ordered(pairs, orders), sets)
        comp = united(comp, links)
    # a class's component: the smallest id of its documents; classes that are not alive stand alone
    by_sig = written(sets.join(comp, "cid").select("sig", "comp", "low"))
    named = by_sig.groupBy("comp").agg(F.min("low").alias("component_id"), F.min("sig").alias("label"))
    by_sig = spread(by_sig, named, "comp").select("sig", "component_id", "label")
    dead = every.filter("n > 0 and not alive").groupBy("sig").agg(F.min("doc_id").alias("component_id")).withColumn("label", F.col("sig"))
    found = every.select("doc_id", "mark", "n", "sig").join(by_sig.union(dead), "sig", "left")
    return found.select("doc_id", "mark", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "label")


def query(docs: DataFrame) -> DataFrame:
    return components(docs)
