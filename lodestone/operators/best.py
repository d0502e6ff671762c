"""The best chunks of each query of a table, by the weighted scores of `postings`, without a row for each pair.

Nearly every chunk holds some short word of a query inside its words, so candidates from an index are nearly all pairs. Here a
task holds a block of distinct queries and reads chunks in blocks. For a block of chunks it finds once

    terms     which fields hold a word or variant of any query: each distinct word is searched once, by one automaton
    phrases   where squeezed fields hold the pairs of neighbouring words, by another automaton; longer phrases are chains of pairs

and a query's scores are then sums of a few rows of these tables over all chunks of the block. A task keeps the k best chunks of
each of its queries. Scores are those of `postings.score`, bit by bit: all points but the title's are multiples of a quarter and
are summed as whole numbers. No pair is left out. Work is queries x chunks, some nanoseconds a pair; data moves once a block of
queries. Chunk ids are strings. Empty queries find nothing.
"""

from __future__ import annotations

import ctypes
import decimal
import gc
from bisect import bisect_right
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import scoring
from lodestone.operators.scoring import Query
from lodestone.sources.files import stored

BLOCK, CELLS, BATCH, WORDS, READ = 20_000, 12_000_000, 64, 100_000, 1000  # queries of a task; terms x chunks; queries at once; words kept; rows read at once: bound memory alone
OUT = "qid long, chunk_id string, score double, n int"
COLUMNS = {"chunk_id": "string", "fields": "array<struct<v:string,w:int,s:boolean>>", "title": "string", "section": "string", "ordinal": "int", "shards": "array<string>", "days": "array<string>"}


NONE = np.empty(0, np.int32)


def _points(w: int, part: int, factor: float) -> int:
    return round(4 * max(0.25, w // part * factor))


def _rounded(x: float, digits: int | None) -> float:
    """As Spark rounds: halves up, from the shortest decimal."""
    return x if digits is None else float(decimal.Decimal(repr(x)).quantize(decimal.Decimal(1).scaleb(-digits), decimal.ROUND_HALF_UP))


def _summed(flat: np.ndarray, ends: np.ndarray, own: np.ndarray, table: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each of own: the sum of the table's rows that its numbers have; row 0 is empty."""
    sizes = ends[own + 1] - ends[own]
    at = np.zeros((len(own), int(sizes.max(initial=0))), np.int64)
    at[np.arange(at.shape[1]) < sizes[:, None]] = row[flat[_ranges(ends[own], sizes)]]
    out = np.zeros((len(own), table.shape[1]), table.dtype)
    part = np.empty_like(out)
    for column in at.T:
        if column.any():
            np.take(table, column, axis=0, out=part, mode="clip")
            out += part
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] ... starts[i] + counts[i] - 1, one range after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _ragged(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x for r in rows for x in r], np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


class Queries:
    """A block of queries: their terms, phrases and groups by number, and the automata that find them."""

    def __init__(self, rows: list[tuple[int, str, list[str] | None, str | None]], stop: frozenset[str]):
        import ahocorasick

        rows = sorted(rows, key=lambda r: (r[1].count(" "), r[1]))  # those of one batch have about as many words
        self.ids, self.q, self.keys, self.days = (list(x) for x in zip(*rows))
        terms, loose, pairs, self.tri, self.four, groups = {}, {}, {}, {}, {}, {}
        term = lambda t: terms.setdefault(t, len(terms))
        tokens, phrases, covered, self.words, self.whole, n_phrases = [], [], [], [], [], 0
        self.phrase = []  # (phrase, squeezed) by number
        seen: dict = {}

        def phrase(p):
            if p not in seen:
                seen[p] = len(self.phrase)
                self.phrase.append(p)
            return seen[p]

        self.head = {}  # a pair's number: length of its first word
        for text in self.q:
            x = Query.of(text, stop)
            t = x.tokens
            tokens.append([term(w) for w in t])
            own = []
            for i in range(len(t) - 1):
                a = phrase(f"{t[i]} {t[i + 1]}")
                self.head[a] = len(t[i])
                own.append(a)
            every, chain = list(own), own
            for n, table in ((3, self.tri), (4, self.four)):
                longer = [phrase(" ".join(t[i : i + n])) for i in range(len(t) - n + 1)]
                table.update({(chain[i], own[i + n - 2]): a for i, a in enumerate(longer)})
                every += longer
                chain = longer
            every = list(dict.fromkeys(every))
            phrases.append(every)
            covered.append([groups.setdefault(tuple(term(w) for w in g if len(w) > 1), len(groups)) for g in x.groups])
            self.words.append(frozenset(t))
            literal = [p for p in reversed(every) if self.phrase[p] in text]
            some = max((w for w in t if w in text), key=len, default=None)
            self.whole.append((literal[0], -1) if literal else (-1, -1 if some is None else terms[some]))
        self.groups = [list(g) for g in groups]
        self.tokens, self.phrases, self.covered = _ragged(tokens), _ragged(phrases), _ragged(covered)
        self.n_groups = np.diff(self.covered[1])
        most = int(self.n_groups.max(initial=0))
        self.quarters = np.array([next((n for n in range(1, g + 1) if n / g >= 0.75), 1) for g in range(most + 1)], np.int64)
        self.terms = list(terms)
        self.weak = np.array([t in scoring.LOW_SIGNAL for t in self.terms], bool)
        self.long = np.array([len(t) >= 4 for t in self.terms], bool)
        self.find, self.find_loose, self.find_pairs = ahocorasick.Automaton(), ahocorasick.Automaton(), ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            self.find.add_word(t, i)
            loose.setdefault(scoring.loose(t), []).append(i)
        for t, i in loose.items():
            self.find_loose.add_word(t, i)
        for p in self.head:
            pairs.setdefault(self.phrase[p].replace(" ", ""), []).append(p)
        for c, p in pairs.items():
            self.find_pairs.add_word(c, (len(c), p))
        for x in (self.find, self.find_loose, self.find_pairs):
            x.make_automaton()
        self.by_token: dict[str, int] = terms
        self.plain = all(t == x for t, x in zip(self.terms, map(scoring.loose, self.terms)))
        self.most_words = max(map(len, self.words), default=0)
        self.longest = max(map(len, self.q), default=0)
        self.joined = "\n".join(self.q)
        self.starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in self.q])]).tolist()
        self.hits: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.some = bool(self.terms)

    def of_word(self, w: str) -> tuple[np.ndarray, np.ndarray]:
        """The terms inside a word, and those that only its loose form holds."""
        if w not in self.hits:
            if len(self.hits) >= WORDS:
                self.hits.clear()
            own = {i for _, i in self.find.iter(w)} if self.some else set()
            x = scoring.loose(w)
            more = {i for _, each in self.find_loose.iter(x) for i in each} - own if self.some and not (self.plain and x == w) else ()
            self.hits[w] = np.array(list(own), np.int32) if own else NONE, np.array(list(more), np.int32) if more else NONE
        return self.hits[w]

    def in_squeezed(self, v: str) -> list[int]:
        """The phrases that v without blanks holds."""
        if not self.head:
            return []
        at: dict[int, list[int]] = {}
        for end, (n, each) in self.find_pairs.iter(v.replace(" ", "")):
            start = end - n + 1
            at[start] = [*at[start], *each] if start in at else each
        head, next_ = self.head, at.get
        out = {a for each in at.values() for a in each}
        for start, each in at.items():
            for a in each:
                second = start + head[a]
                for b in next_(second, ()):
                    c = self.tri.get((a, b))
                    if c is not None:
                        out.add(c)
                        for d in next_(second + head[b], ()):
                            e = self.four.get((c, d))
                            if e is not None:
                                out.add(e)
        return list(out)


class Best:
    """The best chunks of a block of queries so far; a chunk is (chunk_id, fields, title, section, ordinal, days)."""

    def __init__(self, queries: Queries, k: int, stop: frozenset[str], digits: int | None, name: float, day: float):
        self.q, self.k, self.stop, self.digits, self.name, self.day = queries, k, stop, digits, name, day
        if digits is not None and digits < 2:
            raise ValueError("quarters must stay")
        self.near = 0.0 if digits is None else 10.0**-digits
        self.best: list[list[tuple]] = [[] for _ in queries.ids]
        self.least = np.full(len(queries.ids), 0.0)
        self.size = int(min(4096, max(128, CELLS // (len(queries.terms) + 1))))

    def add(self, chunks: list[tuple], shards: tuple[str, ...] | None) -> None:
        q, n = self.q, len(chunks)
        if shards is None:
            places = None
            active = np.arange(len(q.ids))
        else:
            places = {i: [at for at, key in enumerate(keys) if key in shards] for i, keys in enumerate(q.keys) if not set(shards).isdisjoint(keys)}
            active = np.array(sorted(places), np.int64)
        if not len(active):
            return
        chunks = sorted(chunks, key=lambda c: c[0])
        points, held, first, at, worth = self._tables(chunks)
        title, named = self._titles(chunks)
        bonus = self._bonus(chunks)
        inside: dict[int, frozenset] = {}
        tokens, t_at = q.tokens
        groups, g_at = q.covered
        phrases, p_at = q.phrases
        for begin in range(0, len(active), BATCH):
            own = active[begin : begin + BATCH]
            count = _summed(groups, g_at, own, held, self.group_row)
            size = q.n_groups[own]
            total = _summed(tokens, t_at, own, points, self.row).astype(np.int32)
            total += np.multiply(count, 48, dtype=np.int32)
            total += np.multiply((count >= q.quarters[size].astype(count.dtype)[:, None]) & (size > 0)[:, None], 112, dtype=np.int32)
            total += np.multiply((count == size.astype(count.dtype)[:, None]) & (size > 0)[:, None], 208, dtype=np.int32)
            sizes = p_at[own + 1] - p_at[own]
            mine = phrases[_ranges(p_at[own], sizes)]
            hits = first[mine + 1] - first[mine]
            if hits.any():
                where = _ranges(first[mine], hits)
                np.add.at(total.ravel(), np.repeat(np.repeat(np.arange(len(own)), sizes), hits) * n + at[where], worth[where])
            for row, i in enumerate(own.tolist()):
                phrase, term = q.whole[i]
                text = q.q[i]
                maybe = at[first[phrase] : first[phrase + 1]] if phrase >= 0 else np.flatnonzero(self.held[self.row[term]]) if term >= 0 else range(n)
                for c in maybe:
                    total[row, c] += 4 * sum(w for v, w, _ in chunks[c][1] if text in v)
            special: dict[int, dict[int, list]] = {}
            titled: dict[int, list] = {}
            if title[0]:
                said = _summed(tokens, t_at, own, title[2], title[3])
                for row, x in zip(*(y.tolist() for y in np.nonzero(2 * said >= title[1]))):
                    titled.setdefault(row, []).append((title[0][x], int(said[row, x]) / int(title[1][x])))
            for row, i in enumerate(own.tolist()):
                extra = self._extra(i, chunks, titled.get(row, ()), named.get(i, ()), bonus, inside)
                if extra:
                    special[row] = extra
            scores = {}
            for row, extra in special.items():
                for c, (add_name, add_title, add_named, add_day) in extra.items():
                    x = (int(total[row, c]) / 4 + add_title) + add_named
                    if add_name or add_day:
                        x = (add_name + x) + add_day
                    scores.setdefault(row, []).append((x, c))
                    total[row, c] = 0
            least = np.ceil((self.least[own] - self.near) * 4).astype(np.int64)
            hit_row, hit = np.nonzero(total >= np.maximum(1, least)[:, None])
            cuts = np.searchsorted(hit_row, np.arange(len(own) + 1))
            for row, i in enumerate(own.tolist()):
                mine = hit[cuts[row] : cuts[row + 1]]
                if len(mine) > self.k:
                    mine = mine[np.argsort(-total[row, mine], kind="stable")[: self.k]]
                new = [(-x / 4, c) for x, c in zip(total[row, mine].tolist(), mine.tolist())]
                floor = self.least[i] - self.near
                new += [(-_rounded(x, self.digits), c) for x, c in scores.get(row, ()) if x > 0 and x >= floor]
                if new:
                    self._keep(i, [(s, place, chunks[c][0]) for s, c in new for place in (places[i] if places else (0,))])

    def _keep(self, i: int, new: list[tuple]) -> None:
        best = self.best[i] = sorted(self.best[i] + new)[: self.k]
        if len(best) == self.k:
            self.least[i] = -best[-1][0]

    def _tables(self, chunks: list[tuple]):
        """Points of each term and group of terms by chunk; points of each phrase: (starts, chunks, points)."""
        q, n, kinds = self.q, len(chunks), {}
        placed = []
        for i, c in enumerate(chunks):
            seen: dict = {}
            for v, w, s in c[1]:
                seen[w] = seen.get(w, -1) + 1
                placed.append((i, v, w, s, kinds.setdefault((w, seen[w]), len(kinds))))
        if len(kinds) > 20:
            raise ValueError("more than 20 fields of a chunk")
        kind = np.uint8 if len(kinds) <= 8 else np.uint32
        bits, apart = np.zeros((n, len(q.terms)), kind), None
        number, cell, worth = [], [], []
        for i, v, w, s, b in placed:
            each = [q.of_word(x) for x in dict.fromkeys(v.split())]
            own = np.concatenate([x[0] for x in each]) if each else ()
            if len(own):
                bits[i][own] |= kind(1 << b)
            more = [x[1] for x in each if len(x[1])]
            if more:
                if apart is None:
                    apart = np.zeros_like(bits)
                apart[i][np.concatenate(more)] |= kind(1 << b)
            found = q.in_squeezed(v)
            if found:
                both, full = 4 * max(2, w // 2 if s else w // 3), 4 * (w if s else max(2, w // 2))
                number += found
                cell += [i] * len(found)
                worth += [both + full if q.phrase[p] in v else both for p in found]
        full = np.arange(1 << len(kinds))
        lut = lambda part, factor: sum(((full >> b & 1) * _points(w, part, factor) for (w, _), b in kinds.items()), np.zeros(len(full), np.int64)).astype(np.int16)
        there = bits.any(0) if apart is None else bits.any(0) | apart.any(0)
        kept = np.flatnonzero(there)
        self.row = np.zeros(len(q.terms), np.int64)
        self.row[kept] = np.arange(1, len(kept) + 1)
        points = np.zeros((len(kept) + 1, n), np.int16)
        held = np.zeros((len(kept) + 1, n), np.uint8)
        luts = {f: (lut(4, f), lut(5, f)) for f in (1.0, 0.25)}
        for weak, f in ((False, 1.0), (True, 0.25)):
            pick = np.flatnonzero(q.weak[kept] == weak)
            if not len(pick):
                continue
            own = np.ascontiguousarray(bits[:, kept[pick]].T)
            points[pick + 1] = luts[f][0][own]
            held[pick + 1] = own != 0
            if apart is not None:
                loose = np.ascontiguousarray(apart[:, kept[pick]].T)
                held[pick + 1] |= loose != 0
                points[pick + 1] += luts[f][1][loose & ~own] * q.long[kept[pick]][:, None]
        del bits, apart
        if points.max(initial=0) * np.diff(q.tokens[1]).max(initial=0) > 32_000:
            points = points.astype(np.int32)
        groups = self.held = held  # rows of terms; groups of several follow
        alone = np.array([self.row[g[0]] if len(g) == 1 else -1 for g in q.groups], np.int64)
        several = np.flatnonzero(alone < 0)
        if len(several):
            joined = np.zeros((len(several), n), np.uint8)
            for x, g in enumerate(several):
                joined[x] = np.bitwise_or.reduce(held[self.row[q.groups[g]]], axis=0) if q.groups[g] else 0
            alone[several] = len(held) + np.arange(len(several))
            groups = np.concatenate([held, joined])
        if q.n_groups.max(initial=0) > 255:
            groups = groups.astype(np.uint16)
        number, cell, worth = np.array(number, np.int64), np.array(cell, np.int64), np.array(worth, np.int32)
        pair, back = np.unique(number * n + cell, return_inverse=True)
        worth = np.bincount(back, worth, len(pair)).astype(np.int32) if len(pair) else worth
        first = np.searchsorted(pair, np.arange(len(q.phrase) + 1) * n)
        self.group_row = alone
        return points, groups, first, pair % n, worth

    def _titles(self, chunks: list[tuple]):
        """Short titles by their words: (chunks, sizes, words by title, rows of terms); chunks whose title stands in a query, by query."""
        q, sizes, where, by = self.q, [], [], {}
        tokens: dict[int, tuple] = {}
        inside: dict[str, list[int]] = {}
        for i, c in enumerate(chunks):
            title = c[2]
            if not title:
                continue
            words = {w for w in title.split() if len(w) > 1 and w not in self.stop}
            if len(words) <= 2 * q.most_words:
                own = Query.of(title, self.stop).tokens
                if own:
                    if len(own) <= 2 * q.most_words:
                        for t in own:
                            if t in q.by_token:
                                by.setdefault(q.by_token[t], []).append(len(where))
                        where.append(i)
                        sizes.append(len(own))
                    tokens[i] = own
            if len(title) <= q.longest:
                inside.setdefault(title, []).append(i)
        named: dict[int, list[int]] = {}
        for title, each in inside.items():
            each = [i for i in each if tokens.get(i) or Query.of(title, self.stop).tokens]
            at = q.joined.find(title) if each else -1
            while at >= 0:
                x = bisect_right(q.starts, at) - 1
                named.setdefault(x, []).extend(each)
                at = q.joined.find(title, q.starts[x + 1])
        table, row = np.zeros((len(by) + 1, len(where)), np.uint16), np.zeros(len(q.terms), np.int64)
        for x, (t, at) in enumerate(by.items(), 1):
            row[t] = x
            table[x, at] = 1
        return (where, np.array(sizes, np.int64), table, row), named

    def _bonus(self, chunks: list[tuple]):
        names, days = {}, {}
        if self.name or self.day:
            for i, c in enumerate(chunks):
                for x in {c[2], c[3]} - {""}:
                    names.setdefault(x, []).append(i)
                for x in set(c[5] or ()):
                    days.setdefault(x, []).append(i)
        return names, days

    def _extra(self, i: int, chunks, titled, named, bonus, inside) -> dict[int, list]:
        """What a query's chunks get for their titles, names and days: {chunk: [name, title, named, day]}."""
        q, out = self.q, {}
        whole = set(named)
        for c, share in titled:
            out[c] = [0.0, 40.0 if share >= 1 else 18 * share, 0.0, 0.0]
            if share >= 1:
                whole.add(c)
        for c in whole:
            if c not in inside:
                inside[c] = frozenset(Query.of(chunks[c][3], self.stop).tokens)
            if inside[c].isdisjoint(q.words[i]):
                out.setdefault(c, [0.0, 0.0, 0.0, 0.0])[2] = 15.0 / (chunks[c][4] + 1)
        names, days = bonus
        for c in names.get(q.q[i], ()):
            out.setdefault(c, [0.0, 0.0, 0.0, 0.0])[0] = self.name
        for c in days.get(q.days[i], ()) if q.days[i] is not None else ():
            out.setdefault(c, [0.0, 0.0, 0.0, 0.0])[3] = self.day
        return out

    def rows(self):
        """Arrow batches of what was found."""
        for at in range(0, len(self.best), 2000):
            cols = list(zip(*((self.q.ids[i], c, -s, n) for i in range(at, min(at + 2000, len(self.best))) for s, n, c in self.best[i])))
            if not cols:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32())], ["qid", "chunk_id", "score", "n"])


def read(batches):
    """Arrow batches' rows as dictionaries, few at a time."""
    for b in batches:
        for at in range(0, b.num_rows, READ):
            yield from b.slice(at, READ).to_pylist()


def freed() -> None:
    """Gives a Python worker's memory back to the machine: workers outlive their tasks, and the next stages need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def _run(k: int, stop: frozenset[str], digits: int | None, name: float, day: float):
    def run(batches):
        for _, each in groupby(read(batches), key=lambda r: r["part"]):
            asked, best, waiting, group = [], None, [], None
            for r in each:
                if not r["kind"]:
                    asked.append((r["qid"], r["q"], r["keys"], r["day"]))
                    continue
                if not asked:
                    continue
                if best is None:
                    best = Best(Queries(asked, stop), k, stop, digits, name, day)
                shards = None if r["shards"] is None else tuple(r["shards"])
                if waiting and (shards != group or len(waiting) == best.size):
                    best.add(waiting, group)
                    waiting = []
                group = shards
                waiting.append((r["chunk_id"], [(f["v"], f["w"], f["s"]) for f in r["fields"]], r["title"], r["section"], r["ordinal"], r["days"]))
            if waiting:
                best.add(waiting, group)
            if best is not None:
                best.q.hits.clear()
                yield from best.rows()
            asked = best = waiting = None
            freed()

    return run


def _spread(spark, n: int) -> list[int]:
    """n keys that hash partitioning into n parts deals to a part each."""
    found: dict[int, int] = {}
    for r in spark.range(24 * n).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("part")).collect():
        found.setdefault(r["part"], r["key"])
    return [found[i] for i in range(n)] if len(found) == n else list(range(n))


def dealt(asked: DataFrame, rows: DataFrame, by: str, n: int, block: int, group: str | None = None) -> DataFrame:
    """asked and rows, of the same columns, for mapInArrow: each task gets a block of asked (n rows in all, dealt by a column) first
    (kind 0) and then a part of the rows (kind 1), those of a group together; `part` tells tasks' shares apart."""
    spark = asked.sparkSession
    blocks = max(1, -(-n // block))
    parts = max(2, -(-2 * spark.sparkContext.defaultParallelism // blocks))
    places = F.lit(_spread(spark, blocks * parts))
    key = lambda part, block: F.element_at(places, (part * blocks + block + 1).cast("int")).alias("part")
    ask = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    ask = ask.select(key(F.col("_part"), F.pmod(F.xxhash64(by), F.lit(blocks))), F.lit(0).alias("kind"), *asked.columns)
    every = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every = every.select(key(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)), F.col("_block")), F.lit(1).alias("kind"), *asked.columns)
    both = ask.unionByName(every).repartition(blocks * parts, "part")
    return both.sortWithinPartitions("part", "kind", *([F.array_join(group, "\n")] if group else []))


def best(asked: DataFrame, chunks: DataFrame, k: int, stop: frozenset[str] = frozenset(), shards: DataFrame | None = None, keys: str | None = None, digits: int | None = None, day: str | None = None, days: Column | None = None, bonus: tuple[float, float] = (0.0, 0.0), keep=stored) -> DataFrame:
    """(query_id, chunk_id, score, rank, n): the k best chunks of positive score of each query, ties by n and chunk_id.

    asked: `postings.features`; chunks: `postings.prepared`. shards (chunk_id, shard) and keys, a column of asked with shards in
    their order: a query sees chunks of these shards, a chunk of several once for each, n its place. digits: scores are
    rounded before they are ranked. bonus: points for a title or section that equals the query, and for a chunk among whose days
    (a column of chunks) the query's day is."""
    null = lambda kind: F.lit(None).cast(kind)
    mine = asked.filter("q <> ''").select("query_id", "q", (F.col(keys) if keys else null("array<string>")).alias("keys"), (F.col(day) if day else null("string")).alias("day"))
    same = ["q", "keys", "day"]
    own = keep(mine.select(*same).distinct().select(F.monotonically_increasing_id().alias("qid"), *same))
    many = own.count()
    if not many:
        kinds = {x.name: x.dataType.simpleString() for x in asked.schema}
        return asked.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, chunk_id string, score double, n int, rank long")
    ask = own.select("qid", *same, *[null(kind).alias(c) for c, kind in COLUMNS.items()])
    rows = chunks.withColumn("shards", null("array<string>"))
    if shards is not None:
        rows = chunks.join(shards.groupBy("chunk_id").agg(F.array_sort(F.collect_set("shard")).alias("shards")), "chunk_id")
    fields = F.transform("fields", lambda f: F.struct(f["v"].alias("v"), f["w"].alias("w"), f["s"].alias("s")))
    rows = rows.select(null("long").alias("qid"), *[null(own.schema[c].dataType.simpleString()).alias(c) for c in same], "chunk_id", fields.alias("fields"), "title", "section", "ordinal", "shards", (null("array<string>") if days is None else days).alias("days"))
    found = dealt(ask, rows, "q", many, BLOCK, "shards").mapInArrow(_run(k, stop, digits, *bonus), OUT)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "n", "chunk_id")
    top = found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return mine.join(own.withColumnsRenamed({x: f"_{x}" for x in same}), (F.col("q") == F.col("_q")) & F.col("keys").eqNullSafe(F.col("_keys")) & F.col("day").eqNullSafe(F.col("_day"))).select("query_id", "qid").join(top, "qid").drop("qid")

