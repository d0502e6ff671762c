"""Weighted lexical scoring over many fields, as one expression a chunk and query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Field weights; the enrichment fields, in which phrases count in full, and the domains that use them; words
# that tell little.
WEIGHTS = {"title": 20, "section": 10, "search_text": 12, "detail_search_text": 18, "summary": 18, "categories": 8, "keywords": 20, "domain": 8, "facets": 8, "authors": 6}
ENRICHMENT = {"events": 36, "aliases": 36, "entities": 24, "places": 24, "symbols": 20, "themes": 16, "enriched_terms": 12}
ENRICHED_DOMAINS = ("bible", "taqs")
LOW_SIGNAL = ("المسيح", "يسوع", "السيد", "ربنا", "الرب", "الله")


@dataclass(frozen=True)
class Query:
    """A normalized query with its distinct token variants, their phrases and the words it must cover."""

    text: str
    tokens: tuple[str, ...]
    groups: tuple[tuple[str, ...], ...]

    @staticmethod
    def of(text: str, stop: frozenset[str] = frozenset()) -> Query:
        own = [w for w in text.split() if len(w) > 1]
        variants = [tuple(dict.fromkeys((w, strip(w), drop(w), strip(drop(w))))) for w in own]
        tokens = tuple(t for t in dict.fromkeys(v for g in variants for v in g) if t not in stop and len(t) > 1)
        return Query(text, tokens, tuple(g for w, g in zip(own, variants) if w not in stop))

    @property
    def phrases(self) -> list[str]:
        t = self.tokens
        return list(dict.fromkeys(" ".join(t[i : i + n]) for n in (2, 3, 4) for i in range(len(t) - n + 1)))


def strip(w: str) -> str:
    return w[2:] if w.startswith(T.ARTICLE) and len(w) > 3 else w


def drop(w: str) -> str:
    return w[1:] if len(w) > 4 and w[0] in T.PROCLITICS and w[1:].startswith(T.ARTICLE) else w


def loose(text: str) -> str:
    """As `T.loose`, for a query's own words."""
    own = [w[:-1] + "ا" if w.endswith("ء") else w for w in text.split()]
    return " ".join(w if len(w) < 4 else w[0] + w[1:].replace("ا", "") for w in own)


def _hit(value: Column, term: str, points: float) -> Column:
    return F.when(F.contains(value, F.lit(term)), F.lit(float(points))).otherwise(0.0)


def field_score(value: Column, freed: Column, weight: int, q: Query, structured: bool) -> Column:
    """Whole query w; each token w // 4 (of four letters and more also w // 5 in the loose form `freed`), a quarter of that for
    words that tell little, .25 at least; each phrase w // 2, in its compact form w // 3, 2 at least (structured: w and w // 2)."""
    out = _hit(value, q.text, weight)
    for t in q.tokens:
        factor = 0.25 if t in LOW_SIGNAL else 1
        near = _hit(freed, loose(t), max(0.25, weight // 5 * factor)) if len(t) >= 4 else F.lit(0.0)
        out = out + F.when(F.contains(value, F.lit(t)), max(0.25, float(weight // 4 * factor))).otherwise(near)
    squeezed = T.compact(value)
    for p in q.phrases:
        out = out + _hit(value, p, weight if structured else max(2, weight // 2))
        out = out + _hit(squeezed, p.replace(" ", ""), max(2, weight // 2 if structured else weight // 3))
    return out


def _named(values: list[tuple[Column, Column]], terms) -> Column:
    """Whether any of the values, or its loose form, holds any of the terms."""
    out = F.lit(False)
    for value, freed in values:
        for t in terms:
            out = out | F.contains(value, F.lit(t)) | F.contains(freed, F.lit(loose(t)))
    return out


def coverage(values: list[tuple[Column, Column]], q: Query) -> Column:
    """12 for each covered word group, 80 more when all are, 28 more from three quarters on."""
    if not q.groups:
        return F.lit(0.0)
    n = sum((F.when(_named(values, g), 1).otherwise(0) for g in q.groups), F.lit(0))
    return n * 12.0 + F.when(n == len(q.groups), 80.0).when(n >= 0.75 * len(q.groups), 28.0).otherwise(0.0)


def _of(words: Column, q: Query) -> Column:
    return F.filter(words, lambda w: w.isin(list(q.tokens) or [""]))


def title_prior(title: Column, q: Query, stop: frozenset[str] = frozenset()) -> Column:
    """40 for a title whose token variants are all in the query, 18 times their share from one half on."""
    words = T.tokenize(title, sorted(stop))
    share = F.size(_of(words, q)) / F.size(words)
    return F.when(F.size(words) == 0, 0.0).when(share >= 1, 40.0).when(share >= 0.5, 18 * share).otherwise(0.0)


def broad_title_prior(title: Column, section: Column, ordinal: Column, q: Query, stop: frozenset[str] = frozenset()) -> Column:
    """15 / (ordinal + 1) where the title or all its token variants stand in the query and none of the section's does."""
    words = T.tokenize(title, sorted(stop))
    named = F.contains(F.lit(q.text), title) | (F.size(_of(words, q)) == F.size(words))
    inner = F.size(_of(T.tokenize(section, sorted(stop)), q)) > 0
    return F.when((F.size(words) > 0) & named & ~inner, 15.0 / (ordinal + 1)).otherwise(0.0)


def scored(chunks: DataFrame, queries: list[tuple[int, str]], stop: frozenset[str] = frozenset(), normal=lambda c: F.lower(T.normalize_search(c))) -> DataFrame:
    """(query_id, chunk_id, score, structured) of chunks with any of the weighted fields; only positive scores.

    Enrichment fields count in `ENRICHED_DOMAINS` alone; `structured` tells whether one of them, in any domain, holds a word of
    the query. Null fields are empty; other columns are ignored."""
    fields = [c for c in (*WEIGHTS, *ENRICHMENT) if c in chunks.columns]
    kinds = dict(chunks.dtypes)
    text = lambda c: normal(F.coalesce(F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c).cast("string"), F.lit("")))
    rich = F.coalesce(F.col("domain").isin(*ENRICHED_DOMAINS), F.lit(False)) if "domain" in fields else F.lit(False)
    base = chunks.select("chunk_id", rich.alias("_rich"), *[text(c).alias(c) for c in fields])
    base = base.select("*", *[T.loose(F.col(c)).alias(f"_loose_{c}") for c in fields])
    both = lambda names: [(F.col(c), F.col(f"_loose_{c}")) for c in names if c in fields]
    extra = [(F.when(F.col("_rich"), v), F.when(F.col("_rich"), w)) for v, w in both(ENRICHMENT)]
    each = []
    for i, raw in queries:
        q = Query.of(raw, stop)
        score = sum((field_score(v, w, WEIGHTS[c], q, False) for c in WEIGHTS for v, w in both([c])), F.lit(0.0))
        more = sum((field_score(v, w, ENRICHMENT[c], q, True) for c in ENRICHMENT for v, w in both([c])), F.lit(0.0))
        score = score + F.when(F.col("_rich"), more).otherwise(0.0) + coverage([*both(WEIGHTS), *[(F.coalesce(v, F.lit("")), F.coalesce(w, F.lit(""))) for v, w in extra]], q)
        if "title" in fields:
            section = F.col("section") if "section" in fields else F.lit("")
            score = score + title_prior(F.col("title"), q, stop) + broad_title_prior(F.col("title"), section, T.ordinal(F.col("chunk_id").cast("string")), q, stop)
        named = _named(both(ENRICHMENT), [t for g in q.groups for t in g])
        each.append(F.struct(F.lit(i).cast("long").alias("query_id"), score.alias("score"), named.alias("structured")))
    rows = base.select("chunk_id", F.explode(F.array(*each)).alias("s")).select("s.query_id", "chunk_id", "s.score", "s.structured")
    return rows.filter("score > 0")
