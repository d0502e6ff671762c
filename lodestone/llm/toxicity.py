"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

Both dictionaries start with the same ordinary background, so that ordinary windows cost the same with either; each ends
with words that are over-represented in its own class, chosen by their rates in the sample: toxic phrases of ordinary words,
words of up to 3 letters and words rarer than the rates allow can't score (README: figures of whole-text dictionaries). A text is cut into windows
of one word, each compressed behind the same carrier phrase with both dictionaries; a window is a hit when the toxic
dictionary saves at least `gain` bytes over the ordinary one and needs at most `cost` bytes. Both thresholds and a
logistic curve over hits and their share turn windows into a score; both are calibrated on rows of
the sample that the dictionaries did not see.

Only a bounded sample of labelled rows is used to fit (`SAMPLE` rows a class, smallest hash of the id first), with whole
texts; of texts of one label that link by op10's measure one is learnt from. Every whole text is scored. Null and blank texts have no windows and get the curve's value for no hit. Equal texts get equal scores;
rows with null labels or ids are not learnt from; with fewer than ten labelled rows of a class every score is 0.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join
from lodestone.llm.common import kept

SAMPLE = 2500  # rows a class that are fitted on, with their whole texts
DICT_BYTES, CUT, CACHE_WORDS = 16_384, 0.7, 400_000
OUT = "doc_id long, score double"


def wide(text: str) -> bytes:
    """Two bytes a character: one match in a dictionary then outweighs its own header even for short words."""
    return text.encode("utf-16-le", "surrogatepass")


def windows(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _dictionary(words: dict[str, int], size: int) -> bytes:
    """A dictionary trained on one class's passages, which follow whole; they alone where there are too few to train on."""
    plain = wide("".join(f" {w} " for w in words))[-size // 2 :]
    samples = [wide(f" {w} {w}") for w, n in words.items() for _ in range(min(n, 50))]
    try:
        return zstandard.train_dictionary(size // 2, samples, k=24, d=6).as_bytes()[-size // 2 :] + plain
    except zstandard.ZstdError:
        return plain


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=6, min_match=6, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, carrier: str = ""):
        self.parts, self.carrier, self.gain, self.cost, self.curve = (ordinary, toxic), carrier, 2, 4, np.zeros(3)
        self._tools, self._known = None, {}

    def __getstate__(self):
        return {**self.__dict__, "_tools": None, "_known": {}}

    def lengths(self, window: str) -> tuple[int, int]:
        """Bytes that the window adds to its carrier with the ordinary and with the toxic dictionary."""
        if self._tools is None:
            self._tools = [_compressor(p).compress for p in self.parts]
            self._base = [len(t(wide(self.carrier + " "))) for t in self._tools]
        if (known := self._known.get(window)) is None:
            bare = window.strip(".,;:!?")
            known = tuple(len(t(wide(f"{self.carrier} {bare} "))) - b for t, b in zip(self._tools, self._base)) if bare else (0, 0)
            if len(self._known) >= CACHE_WORDS:
                self._known.clear()
            self._known[window] = known
        return known

    def gains(self, text: str | None) -> np.ndarray:
        """(ordinary, toxic) lengths of all windows."""
        get, new = self._known.get, self.lengths
        return np.array([get(w) or new(w) for w in windows(text)], np.int32).reshape(-1, 2)

    def features(self, g: np.ndarray) -> np.ndarray:
        hits = int(((g[:, 0] - g[:, 1] >= self.gain) & (g[:, 1] <= self.cost)).sum())
        return np.array([1.0, np.log1p(hits), min(1.0, 30.0 * hits / max(len(g), 1))])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(self.gains(text)) @ self.curve, -30, 30))))


def copied(texts: list[str | None]) -> np.ndarray:
    """Marks each text that links, as op10 has it, with an earlier unmarked one; candidates share a token of their rarest ones."""
    shingle = jaccard_join.Shingler()
    sets = [shingle(t) for t in texts]
    every, df = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
    out, first = np.zeros(len(sets), bool), {}
    for i, s in enumerate(sets):
        n = len(s)
        prefix = s[np.argsort(df[np.searchsorted(every, s)], kind="stable")][: n - jaccard_join.need(n) + 1].tolist() if n else []
        near = {j for x in prefix for j in first.get(x, ())}
        out[i] = any(100 * (both := len(np.intersect1d(s, sets[j], assume_unique=True))) >= jaccard_join.PERCENT * (n + len(sets[j]) - both) for j in near if jaccard_join.need(max(n, len(sets[j]))) <= min(n, len(sets[j])))
        for x in () if out[i] else prefix:
            first.setdefault(x, []).append(i)
    return out


def fit(texts: list[str], labels: list[int]) -> Model | None:
    y = np.array(labels)
    if min((y == 1).sum(), (y == 0).sum()) < 10:
        return None
    learn = np.arange(len(y)) % 2 == 0
    seen: dict[str, list[int]] = {}
    count: dict[str, int] = {}
    own_texts = [t for t, x in zip(texts, learn) if x]
    copies = np.zeros(len(own_texts), bool)  # near copies of one text would pass for many texts
    for v in (0, 1):
        at = np.flatnonzero(y[learn] == v)
        copies[at] = copied([own_texts[i] for i in at])
    for t, v in [(t, v) for t, v, c in zip(own_texts, y[learn], copies) if not c]:
        w = [x.strip(".,;:!?") for x in (t or "").lower().split()]
        for x in set(w):
            seen.setdefault(x, [0, 0])[v] += 1
        for x in w if v == 0 else ():
            count[x] = count.get(x, 0) + 1
    n = [max(1, int((y[learn][~copies] == v).sum())) for v in (0, 1)]
    rate = {w: (c[1] / n[1], (c[0] + 0.5) / n[0]) for w, c in seen.items() if len(w) > 3}
    toxic = {w: seen[w][1] for w, (t, o) in rate.items() if seen[w][1] >= max(3, 0.015 * n[1]) and t > 10 * o}
    own = sorted((w for w, (t, o) in rate.items() if w not in toxic and o > t), key=lambda w: -seen[w][0])[:1500]
    common = sorted((w for w in count if w not in toxic), key=lambda w: (count[w], w))[-3000:]
    back = wide(" ".join(common)[-12_000:])
    model = Model(back + _dictionary({w: seen[w][0] for w in own}, DICT_BYTES), back + _dictionary(toxic, DICT_BYTES), " ".join(common[-4:]))
    held = [model.gains(t) for t in np.array(texts, object)[~learn]]
    yh = y[~learn]
    best = None
    for gain, cost in ((g, c) for g in range(2, 12) for c in range(1, 9)):
        model.gain, model.cost = gain, cost
        x = np.array([model.features(g) for g in held])
        w = np.zeros(3)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            s = np.where(yh == 1, 0.5 / max(1, (yh == 1).sum()), 0.5 / max(1, (yh == 0).sum())) * len(yh)
            w += np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (s * (yh - p)) - 0.05 * w)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) >= CUT
        good = p[yh == 1].mean() - 3 * p[yh == 0].mean()
        if best is None or good > best[0]:
            best = (good, gain, cost, w)
    model.gain, model.cost, model.curve = best[1:]
    return model


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model fitted on at most `sample` labelled rows of each class whose crc32(doc_id) mod 3 is not 1."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    take = [known.filter(f"toxic = {v}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    ids = F.broadcast(take[0].union(take[1]))  # at most 2 * sample rows
    rows = docs.select("doc_id", "text").join(ids, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(4 * sample).collect()
    return fit([r.text for r in rows], [r.toxic for r in rows])


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    key = model and hashlib.sha256(b"".join(model.parts) + repr((model.gain, model.cost, model.curve.tolist(), model.carrier)).encode()).hexdigest()

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if not model:
            return pd.Series(0.0, index=text.index)
        own = kept(("toxicity", key), lambda: model)
        return pd.Series([own.score(t) for t in text], dtype=float)

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), learned(docs, labels))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", "predicted")
