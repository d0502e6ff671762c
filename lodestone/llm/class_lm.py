"""Brown class-based n-grams: exchange clustering, class transitions and word emissions, smoothed perplexity.

A text's tokens are its words with A-Z in lower case, then one end. P(word | word before) is the transition from class to class
times the word's share of its class. Transitions are smoothed by the class's own share. Words that training lacks share the
Good-Turing mass of their class (its words seen once), so that the probabilities of the vocabulary and of one unknown word a
class sum to 1.

Counts come from all training documents. Exchange clustering moves units: every word that makes up at least 1 / `SHARE` of all
tokens (so at most `SHARE` words, of up to `LONGEST` bytes) is one; all other words, known or not, belong to the unit of their
last three bytes (one of `GROUPS`), so every word has a class and new ones get it without being looked up. A sweep deals the units
to tasks; each task moves its units one after another to the class of highest likelihood; the moves of all tasks are put
together before the next sweep, and the map of the best likelihood stays. The driver holds the units' classes and matrices of
classes by classes, never the vocabulary: the counts of words that aren't frequent are joined to the blocks of documents that hold
them, whatever their number.

Null texts are empty: their only token is the end. Each row is a document of its own, so repeated rows and ids count each; a
null `held_out` counts as training. Without training documents every token is unknown and scores 0. Equal gains keep
the class. Other columns are ignored; an empty table gives an empty result. Memory: one block, `BLOCK` bytes of text or one
document.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import freed, sliced, written

CLASSES, SHARE, LONGEST, GROUPS, SWEEPS = 64, 200_000, 64, 2048, 6
TASKS = 32  # that share the units in a sweep
BLOCK = 5_000_000  # bytes of text
PRIOR = 5.0  # weight of a class's own share in its transitions
HELD = 400_000  # counts that a task keeps before it hands them on; a bound on memory alone
END = ""
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case, and the end."""
    return [*(text or "").encode().lower().split(), b""]


def counted(train: DataFrame) -> DataFrame:
    """(word, n) of all tokens of a table of texts."""

    def run(batches):
        seen = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for part in sliced(batches, BLOCK):
            for t in part.column("text").to_pylist():
                seen.update(tokens(t))
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        yield out()
        freed()

    return train.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Units:
    """The unit of each word: a number below `frequent` for frequent words, one of `GROUPS` above it for all others."""

    def __init__(self, words: list[str]):
        self.ids = {w.encode(): i for i, w in enumerate(words)}
        self.frequent = len(words)
        self.size = len(words) + GROUPS

    def of(self, words: list[bytes]) -> np.ndarray:
        get, first = self.ids.get, self.frequent
        return np.array([first + crc32(w[-3:]) % GROUPS if (i := get(w)) is None else i for w in words], np.int64)


def _log(x):
    return np.log(np.maximum(x, 1e-300))


def _xlogx(x):
    return x * _log(x)


def likelihood(pairs: np.ndarray) -> float:
    """The part of the log-likelihood that depends on the classes: pairs counts class after class."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(1)).sum() - _xlogx(pairs.sum(0)).sum())


def exchange(words: list[tuple], of: np.ndarray, pairs: np.ndarray, classes: int) -> list[int]:
    """New classes of units (id, units after it, their counts, units before it, their counts), each moved to the class of highest
    likelihood, one after another; `of` and `pairs` follow the moves."""
    size, out = len(pairs), []
    for w, after, n_after, before, n_before in words:
        own = of[w]
        r = np.bincount(of[after], n_after * (after != w), size)
        le = np.bincount(of[before], n_before * (before != w), size)
        both = float(n_after[after == w].sum())
        pairs[own] -= r
        pairs[:, own] -= le
        pairs[own, own] -= both
        cols, rows = np.flatnonzero(r), np.flatnonzero(le)
        a, b = pairs[:classes][:, cols], pairs[rows][:, :classes]
        gain = (_xlogx(a + r[cols]) - _xlogx(a)).sum(1) + (_xlogx(b + le[rows][:, None]) - _xlogx(b)).sum(0)
        k = np.arange(classes)
        d, dr, dl = pairs[k, k], r[:classes], le[:classes]
        gain += _xlogx(d + dr + dl + both) - _xlogx(d) - (_xlogx(d + dr) - _xlogx(d)) - (_xlogx(d + dl) - _xlogx(d))
        firsts, seconds = (pairs.sum(1) + le)[:classes], (pairs.sum(0) + r)[:classes]  # the neighbours' own totals stay
        gain -= _xlogx(firsts + r.sum() + both) - _xlogx(firsts) + _xlogx(seconds + le.sum() + both) - _xlogx(seconds)
        new = int(gain.argmax())
        new = int(own) if gain[own] >= gain[new] - 1e-12 * abs(gain[new]) else new
        pairs[new] += r
        pairs[:, new] += le
        pairs[new, new] += both
        of[w] = new
        out.append(new)
    return out


def _neighbours(train: DataFrame, units: Units) -> DataFrame:
    """A row a unit: the units after and before it, with counts."""

    def run(batches):
        for part in sliced(batches, BLOCK):
            flat = units.of([b"", *[w for t in part.column("text").to_pylist() for w in tokens(t)]])
            pair = np.sort(flat[:-1] * units.size + flat[1:])  # a text follows the end of the one before
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
            n, pair = np.diff(np.append(first, len(pair))), pair[first]
            yield pa.RecordBatch.from_arrays([pa.array((pair // units.size).astype(np.int32)), pa.array((pair % units.size).astype(np.int32)), pa.array(n)], ["w", "other", "n"])
        freed()

    pairs = train.select("text").mapInArrow(run, "w int, other int, n long").groupBy("w", "other").agg(F.sum("n").alias("n"))
    sides = pairs.select(F.inline(F.array(F.struct(F.col("w"), F.lit(True).alias("after"), F.col("other"), "n"), F.struct(F.col("other").alias("w"), F.lit(False).alias("after"), F.col("w").alias("other"), "n"))))
    side = lambda after: F.array_sort(F.collect_list(F.when(F.col("after") == F.lit(after), F.struct("other", "n"))))
    return sides.groupBy("w").agg(side(True).alias("after"), side(False).alias("before"))  # lists of at most `SHARE` + `GROUPS` + 1 units


def _lists(b: pa.RecordBatch):
    """(id, after, counts, before, counts) of each row."""
    cols = []
    for c in ("after", "before"):
        x = b.column(c)
        s = x.values
        cols.append((x.offsets.to_numpy(), s.field("other").to_numpy(), s.field("n").to_numpy().astype(float)))
    for k, w in enumerate(b.column("w").to_pylist()):
        yield (w, *[v[at[k] : at[k + 1]] for at, *vs in cols for v in vs])


def clustered(around: DataFrame, size: int, classes: int, sweeps: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of units 0 to size - 1, the counts of class after class, and the likelihood before each sweep."""

    def table(of: np.ndarray) -> np.ndarray:
        def run(batches):
            out = np.zeros((classes, classes))
            for b in batches:
                for w, after, n, *_ in _lists(b):
                    out[of[w]] += np.bincount(of[after], n, classes)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["at", "n"])

        total = np.zeros(classes**2)
        for r in around.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():  # pairs of classes
            total[r["at"]] = r.n
        return total.reshape(classes, -1)

    of = np.arange(size) % classes
    best, seen = None, []
    for sweep in range(sweeps + 1):
        pairs = table(of)
        seen.append(likelihood(pairs))
        if best is not None and seen[-1] <= max(seen[:-1]):
            break
        best = of, pairs
        if sweep == sweeps:
            break

        def moved(batches, of=of, pairs=pairs):
            task, own = None, ()
            for b in batches:
                ids, new = [], []
                for t, x in zip(b.column("task").to_pylist(), _lists(b)):
                    if t != task:  # however tasks' rows are read together, each starts from the same state
                        task, own = t, (of.copy(), pairs.copy())
                    ids.append(x[0])
                    new += exchange([x], *own, classes)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(new, pa.int32())], ["w", "c"])

        of = of.copy()
        for r in around.mapInArrow(moved, "w int, c int").collect():  # a row a unit
            of[r.w] = r.c
    return *best, seen


class Model:
    """What scores need beside the counts of words that aren't frequent: bounded by `SHARE`, `GROUPS` and the classes."""

    def __init__(self, units: Units, count: np.ndarray, of: np.ndarray, pairs: np.ndarray, facts: dict, once: np.ndarray):
        self.units, self.count, self.of, self.facts = units, count, of, facts
        self.tokens, self.words = facts["tokens"], facts["words"]
        own = pairs.sum(0)
        new = (once + 0.5) / (own + 1)
        share = own / max(1, self.tokens)
        if self.tokens:
            step = (pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR)
            self.step = np.log10(np.maximum(step, 1e-300))
            self.known, self.new = np.log10((1 - new) / np.maximum(own, 1)), np.log10(new)
        else:
            self.step, self.known, self.new = np.zeros(pairs.shape), np.zeros(len(own)), np.zeros(len(own))

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def emission(self, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class by its count; unknown words have the class's mass for new ones."""
        return np.where(n > 0, np.log10(np.maximum(n, 1)) + self.known[of], self.new[of])


def model(docs: DataFrame, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[DataFrame, Model]:
    """(word, n) of all training tokens, written, and the model. docs: (text, held_out)."""
    train = docs.filter(~F.coalesce("held_out", F.lit(False)))
    counts = written(counted(train))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    facts = {"tokens": total.n or 0, "words": total.v, "likelihood": []}
    often = (F.col("n") * SHARE >= F.lit(facts["tokens"])) & (F.octet_length("word") <= LONGEST) | (F.col("word") == END)
    top = counts.filter(often).orderBy(F.col("word") != END, F.desc("n"), "word").toArrow() if total.v else pa.table({"word": pa.array([""]), "n": pa.array([0])})  # at most SHARE + 1 words
    units = Units(top["word"].to_pylist())
    of, pairs, once = np.arange(units.size) % classes, np.zeros((classes, classes)), np.zeros(classes)
    if total.v:
        around = written(_neighbours(train, units).repartition(TASKS, "w").sortWithinPartitions("w").withColumn("task", F.spark_partition_id()))
        of, pairs, facts["likelihood"] = clustered(around, units.size, classes, sweeps)

        def single(batches):
            out = np.zeros(classes)
            for b in batches:
                out += np.bincount(of[units.of(b.column("word").cast(pa.binary()).to_pylist())], minlength=classes)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(out)], ["c", "n"])

        for r in counts.filter("n = 1").select("word").mapInArrow(single, "c long, n double").groupBy("c").agg(F.sum("n").alias("n")).collect():  # a row a class
            once[r.c] = r.n
    return counts, Model(units, top["n"].to_numpy().astype(float), of, pairs, facts, once)


def blocks(docs: DataFrame, m: Model) -> DataFrame:
    """Rows of kind 0 (a document: what its frequent words and its transitions score, and its other words as places in the
    block's list) and 1 (a word of a block that isn't frequent, with its class)."""
    kinds = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("at", pa.list_(pa.int32())), ("pos", pa.int32()), ("class", pa.int32()), ("word", pa.string())])

    def rows(size: int, **have):
        return pa.RecordBatch.from_arrays([have[f.name].cast(f.type) if f.name in have else pa.nulls(size, f.type) for f in kinds], schema=kinds)

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        units, end = m.units, m.of[0]
        base, emitted = m.base(m.count), m.emission(m.count, m.of[: units.frequent])
        for part in sliced(batches, BLOCK):
            block += 1
            flat, ends = [], [0]
            for t in part.column("text").to_pylist():
                flat += tokens(t)
                ends.append(len(flat))
            ends = np.array(ends)
            unit = units.of(flat)
            c = m.of[unit]
            before = np.append(end, c[:-1])
            before[ends[:-1]] = end
            often = unit < units.frequent
            known = np.where(often, unit, 0)
            seen = often & (m.count[known] > 0)
            doc = np.repeat(np.arange(part.num_rows), np.diff(ends))
            add = lambda x: np.bincount(doc, x, part.num_rows)
            place: dict = {}
            other = np.flatnonzero(~often)
            at = np.array([place.setdefault(flat[i], len(place)) for i in other.tolist()], np.int32)
            of = np.zeros(len(place), np.int32)
            of[at] = c[other]
            full = lambda v, k: pa.array(np.full(k, v))
            n = part.num_rows
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(other, ends), pa.int32()), pa.array(at))
            yield rows(n, block=full(block, n), kind=full(0, n), doc_id=part.column("doc_id"), held_out=part.column("held_out"), n_tokens=pa.array(np.diff(ends)), n_known=pa.array(add(seen).astype(np.int64)), base=pa.array(add(np.where(often, base[known], 0.0))), score=pa.array(add(m.step[before, c] + np.where(often, emitted[known], 0.0))), at=lists)
            k = len(place)
            yield rows(k, block=full(block, k), kind=full(1, k), pos=pa.array(np.arange(k)), word=pa.array(list(place), pa.binary()), **{"class": pa.array(of)})
        freed()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("held_out", F.lit(False)).alias("held_out"), "text").mapInArrow(run, "block long, kind int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, at array<int>, pos int, class int, word string")


def scored(docs: DataFrame, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """docs: (doc_id, text, held_out), learning from rows that aren't held out. A row a document: numbers of tokens and of
    tokens whose word is known, the unigram base's and the model's log10 probability, the model's perplexity."""
    docs = docs.select("doc_id", "text", "held_out")
    counts, m = model(docs, classes, sweeps)
    rows = written(blocks(docs, m))
    words = rows.filter("kind = 1").select("block", "pos", "class", "word")
    found = words.join(counts, "word", "left").select(F.col("block").alias("of"), "pos", "class", F.coalesce("n", F.lit(0)).alias("n"))
    head = Model.__new__(Model)  # without the units, which the sums don't need
    head.__dict__ = {k: v for k, v in m.__dict__.items() if k not in ("units", "count", "of")}

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        at = left["at"].combine_chunks()
        flat, doc, size = pc.list_flatten(at).to_numpy(), pc.list_parent_indices(at).to_numpy(), left.num_rows
        n, of = np.zeros(right.num_rows), np.zeros(right.num_rows, np.int64)
        pos = right["pos"].to_numpy()
        n[pos], of[pos] = right["n"].to_numpy(), right["class"].to_numpy()
        add = lambda x: np.bincount(doc, x[flat], size)
        known = left["n_known"].to_numpy() + add((n > 0).astype(float)).astype(np.int64)
        base, score = (left[k].to_numpy() + add(x) for k, x in (("base", head.base(n)), ("score", head.emission(n, of))))
        tokens_ = left["n_tokens"].to_numpy()
        with np.errstate(over="ignore"):
            perplexity = 10 ** (-score / tokens_)
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": tokens_, "n_known": known, "train_tokens": np.full(size, head.tokens), "base_score": base, "score": score, "perplexity": perplexity})

    parts = rows.filter("kind = 0").select("block", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "at")
    return parts.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(summed, OUT)


def query(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return scored(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")))
