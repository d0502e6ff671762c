"""Language identification by a string kernel.

The kernel of two texts is the blended spectrum of their n-gram presence: for n = 1, 2 and 3 the number of n-grams that
both hold, over the geometric mean of their numbers, summed. Nyström landmarks (training texts spread over the languages)
turn a text into K(text, landmarks) K(landmarks, landmarks)^-1/2; one-versus-rest kernel ridge regression on these
features gives a score a language. Whole texts are scored in batches by matrix products. N-grams are held by a hash into
tables of 2^18 places.

Only a bounded sample is fitted on (`per_lang` training texts a language). Null texts and texts without a letter are
`und` with score 0; an equal score goes to the first language by name; without training rows all texts are `und`.
Repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS, NS = 18, (1, 2, 3)
PER_LANG, LANDMARKS, RIDGE, BATCH = 300, 96, 0.05, 64


def grams(text: str) -> list[np.ndarray]:
    """For each n a table of flags: which n-grams of the lower-cased text, other characters than letters as spaces, it holds."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters()[np.minimum(c, 0xFFFF)], c, 32)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in NS:
        h = (h[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :]) if len(c) >= n else np.empty(0, np.uint32)
        flags = np.zeros(1 << BITS, bool)
        flags[(h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)] = True
        out.append(flags)
    return out


_letters: list = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    return _letters[0]


class Model:
    """places: for each n the table places that landmarks use; marks: their flags there; lift, weight: the linear maps."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS):
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(x) for x in langs])
        order = sorted(range(len(texts)), key=lambda i: (int((y[:i] == y[i]).sum()), y[i]))
        marks = [grams(texts[i]) for i in order[:landmarks]]
        self.places = [np.flatnonzero(np.any([m[k] for m in marks], axis=0)) for k in range(len(NS))]
        flags = [np.array([m[k][p] for m in marks], np.float32) for k, p in enumerate(self.places)]
        self.marks = np.concatenate([f / np.sqrt(np.maximum(f.sum(1, keepdims=True), 1)) for f in flags], axis=1)
        val, vec = np.linalg.eigh((self.marks @ self.marks.T).astype(float))
        keep = val > 1e-6 * val.max()
        self.lift = (vec[:, keep] / np.sqrt(val[keep])).astype(np.float32)
        phi = np.concatenate([self.features(texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)])
        phi = np.hstack([phi, np.ones((len(phi), 1))]).astype(float)
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        share = np.bincount(y, minlength=len(self.langs))[y]
        w = phi / share[:, None]
        self.weight = np.linalg.solve(w.T @ phi + RIDGE / len(phi) * np.eye(phi.shape[1]), w.T @ target)

    def features(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), self.marks.shape[1]), np.float32)
        for i, t in enumerate(texts):
            at = 0
            for flags, p in zip(grams(t), self.places):
                x[i, at : at + len(p)] = flags[p] / np.sqrt(max(int(np.count_nonzero(flags)), 1))
                at += len(p)
        return (x @ self.marks.T) @ self.lift

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        s = np.hstack([self.features(texts), np.ones((len(texts), 1), np.float32)]) @ self.weight
        best = s.argmax(1)
        e = np.exp(4 * (s - s.max(1, keepdims=True)))
        return [self.langs[i] for i in best], (e.max(1) / e.sum(1)).tolist()


def learned(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """A model of at most `per_lang` training texts a language: crc32(doc_id) mod 4 is not 2 and lang is not null."""
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null and text rlike '\\\\p{L}'").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_lang).select("doc_id")
    rows = known.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text", F.xxhash64("doc_id").alias("h")).collect()  # at most per_lang texts a language
    rows.sort(key=lambda r: (r.h, r.lang))
    return Model([r.text for r in rows], [r.lang for r in rows]) if rows else None


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if model and t and any(c.isalpha() for c in t)]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            for k in range(0, len(known), BATCH):
                part = known[k : k + BATCH]
                for i, a, s in zip(part, *model.predict([texts[i] for i in part])):
                    lang[i], score[i] = a, s
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    out = identified(docs, learned(docs))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score")
