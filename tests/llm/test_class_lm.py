"""Class n-grams: counts against plain Python, probabilities that sum to 1, a clustering that finds planted classes."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from lodestone.llm import class_lm as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def base(rows):
    """{row: (n_tokens, n_known, train_tokens, base_score)} of (id, text, held)."""
    count = Counter(w for _, t, held in rows if not held for w in plain(t))
    n, v = sum(count.values()), len(count)
    return [(len(plain(t)), sum(w in count for w in plain(t)), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in plain(t))) for _, t, _ in rows]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, held_out boolean, n long, word string").repartition(3)


def grammar(seed, n):
    """Texts in which words of class a, b and c follow one another."""
    r = random.Random(seed)
    return [" ".join(f"{'abc'[k % 3]}{min(r.randrange(30), r.randrange(30))}" for k in range(r.randrange(3, 60))) for _ in range(n)]


def test_counts_and_base_scores(spark):
    rows = [(i, t, i % 5 == 1) for i, t in enumerate([None, "", "  \n", "One two ONE", "é É straße\x1cx", "new words here", "a\x0bb\tc\r d", *grammar(1, 60), "long " * 30_000])] + [(3, "One two ONE", False), (None, "two", None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in C.scored(frame(spark, rows), 6).collect())
    want = sorted((i is None, i or 0, a, b, c, round(d, 6)) for (i, *_), (a, b, c, d) in zip(rows, base(rows)))
    assert got == want


def test_scores_are_the_classes_probabilities(spark, monkeypatch):
    """From classes and counts alone; also with most words in units of several."""
    rows = [(i, t, i % 5 == 1) for i, t in enumerate([*grammar(2, 120), "unseen a1 words b2", None])]
    count = Counter(w for _, t, held in rows if not held for w in plain(t))
    for share in (200_000, 40):
        monkeypatch.setattr(C, "SHARE", share)
        df = frame(spark, rows)
        counts, m = C.model(df, 5, 4)
        assert {r.word: r.n for r in counts.collect()} == dict(count) and (share > 40) == (m.units.frequent == len(count))
        of = lambda w: int(m.of[m.units.of([w.encode()])[0]])  # noqa: E731,B023
        own, pairs, once = np.zeros(5), np.zeros((5, 5)), np.zeros(5)
        for w, n in count.items():
            own[of(w)] += n
            once[of(w)] += n == 1
        for _, t, held in rows:
            if not held:
                c = [of(w) for w in ["", *plain(t)]]
                for a, b in zip(c, c[1:]):
                    pairs[a, b] += 1
        new = (once + 0.5) / (own + 1)
        share_ = own / own.sum()
        step = (pairs + 5 * share_) / (pairs.sum(1, keepdims=True) + 5)
        assert np.allclose(step.sum(1), 1)
        for c in range(5):  # a class's words and its unknown one sum to 1
            assert own[c] == 0 or math.isclose(sum((1 - new[c]) * n / own[c] for w, n in count.items() if of(w) == c) + new[c], 1)
        for r in C.scored(df, 5, 4).collect():
            before, total = of(""), 0.0
            for w in plain(rows[r.doc_id][1]):
                c, n = of(w), count[w]
                total += math.log10(step[before, c]) + math.log10((1 - new[c]) * n / own[c] if n else new[c])
                before = c
            assert abs(total - r.score) < 1e-6 and math.isclose(r.perplexity, 10 ** (-total / r.n_tokens), rel_tol=1e-6)


def test_exchange_finds_planted_classes(spark):
    rows = [(i, t, False) for i, t in enumerate(grammar(3, 400))]
    counts, m = C.model(frame(spark, rows), 4, 8)
    assert m.facts["likelihood"][0] < max(m.facts["likelihood"])
    kinds = {}
    for r in counts.filter("n > 5").collect():
        kinds.setdefault(r.word[:1], Counter())[int(m.of[m.units.of([r.word.encode()])[0]])] += 1
    tops = [kinds[k].most_common(1)[0] for k in "abc"]
    assert len({c for c, _ in tops}) == 3 and all(n >= 0.9 * sum(kinds[k].values()) for k, (_, n) in zip("abc", tops))


def test_moves_raise_the_likelihood():
    r = np.random.default_rng(4)
    n, classes = 40, 5
    counts = r.integers(0, 4, (n, n)).astype(float)
    of = r.integers(0, classes, n)
    words = [(w, np.arange(n), counts[w], np.arange(n), counts[:, w]) for w in range(n)]

    def table(of):
        out = np.zeros((classes, classes))
        np.add.at(out, (of[:, None], of[None, :]), counts)
        return out

    pairs, before = table(of), C.likelihood(table(of))
    for w in words:
        choices = []
        for c in range(classes):
            other = of.copy()
            other[w[0]] = c
            choices.append(C.likelihood(table(other)))
        C.exchange([w], of, pairs, classes)
        assert np.allclose(pairs, table(of)) and math.isclose(C.likelihood(pairs), max(choices), rel_tol=1e-9)
    assert C.likelihood(pairs) > before


def test_nothing_to_learn_from(spark):
    assert C.scored(spark.createDataFrame([], "doc_id long, text string, held_out boolean")).count() == 0
    got = C.scored(spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held_out boolean")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_query_beats_its_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = C.query(docs).toPandas()
    assert len(got) == docs.count() and all((zlib.crc32(str(i).encode()) % 5 == 1) == h for i, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out & (got.n_known == got.n_tokens)]
    assert len(held) > 20 and held.score.sum() > 0.95 * held.base_score.sum()  # both are negative
