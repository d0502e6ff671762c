"""The whole retrieval against plain Python, query by query, and each gate on a case made for it."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import lexicon as L
from lodestone.operators import calendar, router, scoring, search

STOP = L.stop_words()
ENRICH = scoring.ENRICHMENT


# ---- plain Python ----
def variants(w):
    return list(dict.fromkeys((w, scoring.strip(w), scoring.drop(w), scoring.strip(scoring.drop(w)))))


def tokenize(text):
    own = [v for w in text.split() if len(w) > 1 for v in variants(w)]
    return [t for t in dict.fromkeys(own) if len(t) > 1 and t not in STOP]


def norm(x):
    x = " ".join(x) if isinstance(x, list) else x or ""
    return " ".join(L.normal(x).split())


def fields_of(c, text=True):
    out = [(norm(c.get(k)), w, False) for k, w in scoring.WEIGHTS.items() if text or k != "search_text"]
    if c.get("domain") in scoring.ENRICHED_DOMAINS:
        out += [(norm(c.get(k)), w, True) for k, w in ENRICH.items()]
    return [f for f in out if f[0]]


def points(c, q, text=True):
    if not q:
        return 0  # an empty query finds no words
    tokens, raw = tokenize(q), [w for w in q.split() if len(w) > 1 and w not in STOP]
    phrases = list(dict.fromkeys(" ".join(tokens[i : i + n]) for n in (2, 3, 4) for i in range(len(tokens) - n + 1)))
    groups = [variants(w) for w in raw]
    fields, total = fields_of(c, text), 0.0
    for v, w, s in fields:
        total += w * (q in v)
        for t in tokens:
            factor = 0.25 if t in scoring.LOW_SIGNAL else 1
            if t in v:
                total += max(0.25, w // 4 * factor)
            elif len(t) >= 4 and scoring.loose(t) in scoring.loose(v):
                total += max(0.25, w // 5 * factor)
        for p in phrases:
            total += (w if s else max(2, w // 2)) * (p in v)
            total += max(2, w // 2 if s else w // 3) * (p.replace(" ", "") in v.replace(" ", ""))
    held = lambda g: any(t in v or scoring.loose(t) in scoring.loose(v) for t in g for v, *_ in fields)
    n = sum(map(held, groups))
    if n:
        total += 12 * n + (80 if n == len(groups) else 28 if n / len(groups) >= 0.75 else 0)
    title = tokenize(norm(c.get("title")))
    if title:
        share = sum(t in tokens for t in title) / len(title)
        total += 40 if share >= 1 else 18 * share if share >= 0.5 else 0
        if (norm(c["title"]) in q or share >= 1) and not set(tokenize(norm(c.get("section")))) & set(tokens):
            last = c["chunk_id"].split(":")[-1]
            total += 15 / ((int(last) if last.isdigit() else 0) + 1)
    return total


def structured(c, q):
    values = [norm(c.get(k)) for k in ENRICH]
    return any(t in v or scoring.loose(t) in scoring.loose(v) for w in q.split() if len(w) > 1 and w not in STOP for t in variants(w) for v in values if v)


def holds(q, listed):
    return any(w in q for w in L.words(listed))


def library_ok(name, q, domains, o):
    asked = {"cartoon": holds(q, L.CARTOON), "aqwal": holds(q, L.SAYINGS), "coptic": "coptic" in domains, "about": "school" in domains, "seneksar": "saints" in domains or holds(q, L.DAY_BOOK)}
    return name in o.libraries and asked[name]


def keys_of(q, domains, scores, o):
    out = []
    for k in o.keys:
        if k != "lexical:domain":
            out.append(k)
            continue
        teach = "ta3lim" in domains and scores["ta3lim"] >= 2 and scores["bible"] <= 0
        out += [f"lexical:domain:{d}" for d in domains if not teach or d != "bible"]
        out += ["lexical:facet:sermon"] * teach
        if "bible" in domains:
            import re

            out += ["lexical:facet:bible-summary-detail"] + ["lexical:facet:verse"] * bool(holds(q, L.VERSE) or re.search(r"(?:^|\s)(?:[1-3]\s+)?[^\W\d_]+\s+\d+\s+\d+(?:\s|$)", q))
        out += [f"lexical:facet:{key}" for n, key in (("aqwal", "fathers"), ("cartoon", "cartoon"), ("seneksar", "seneksar")) if library_ok(n, q, domains, o)]
    return list(dict.fromkeys(out))


def reference(query, route, chunks, vectors, shards, o):
    """{gate: value} and the ids returned, for one query (text, vector)."""
    q = norm(query[0])
    scores, domains, strict = route
    tokens, raw = tokenize(q), len(q.split())
    allow = lambda ds: ds if o.hymns or holds(q, L.HYMN) else [d for d in ds if d != "al7an"] or list(L.DEFAULT_DOMAINS)
    domains = allow(domains)
    whole = lambda c: all(c.get(k) for k in ("doc_id", "chunk_id", "title", "url", "text"))
    day = None
    for listed, more in ((L.TOMORROW, 1), (L.TODAY, 0)):
        if day is None and any(w in q for w in listed.split(", ")):
            day = day_key(datetime.date(2027, 9, 10) + datetime.timedelta(more))

    def metadata():
        out = []
        for c in (c for c in chunks.values() if (c["chunk_id"], search.METADATA_SHARD) in shards):
            dated = c.get("library") == "seneksar" and day is not None and f"seneksar-date:{day}" in (c.get("keywords") or [])
            s = 80 * (norm(c.get("title")) == q or norm(c.get("section")) == q) * bool(q) + points(c, q, False) + 1000 * dated
            ident = [v for v in (norm(c.get("title")), norm(c.get("section")), norm(c.get("keywords"))) if v]
            own = any(t in v or scoring.loose(t) in scoring.loose(v) for t in tokens if len(t) >= 4 for v in ident)
            if s > 0:
                out.append((-s, c["chunk_id"], dated or own))
        return [(i + 1, c, -s, st) for i, (s, c, st) in enumerate(sorted(out)[: o.candidate_k])]

    pre = None
    if not any(scores.values()) and (holds(q, L.IDENTITY) or raw <= 3 and any(len(scoring.strip(t)) >= 5 for t in tokens)):
        pre = metadata()
        if pre and pre[0][2] >= 30:
            near = [chunks[c].get("domain") for _, c, s, _ in pre if s >= max(30, pre[0][2] - 12)]
            near = list(dict.fromkeys(d for d in near if d in L.DOMAINS))
            domains = allow(near) if near else domains
    vec = []
    if query[1] is not None:
        for cid, v in vectors.items():
            c = chunks.get(cid)
            if c and v is not None and c.get("domain") in domains and (c.get("library") not in L.OPTIONAL or library_ok(c["library"], q, domains, o)):
                dot = sum(a * b for a, b in zip(query[1], v))
                size = math.sqrt(sum(a * a for a in query[1]) * sum(b * b for b in v))
                vec.append((-round(dot / size, 5) if size else 0.0, cid))
    vec = [(i + 1, c, -s) for i, (s, c) in enumerate(sorted(vec)[: o.candidate_k])]
    first = [(c, s) for _, c, s in vec if whole(chunks[c])][: o.top_k]
    titles = [(norm(chunks[c]["title"]), tokenize(norm(chunks[c]["title"]))) for c, _ in first]
    bible = lambda c: chunks[c].get("domain") == "bible" or c.startswith("bible-summary:")

    def exact():
        for t, w in titles:
            if w and set(w) <= set(tokens) and (q == t or raw <= len(t.split())):
                return True
        most = max([sum(x in tokens for x in w) / len(tokens) if tokens else 0 for _, w in titles], default=0)
        return raw <= 3 and most < 0.25 or scores["bible"] <= 0 and any(bible(c) for c, _ in first) or scores["bible"] > 0 and most < 0.25 or "ta3lim" in domains and most < 0.5

    def lexical():
        if not vec or not first or scores["ta3lim"] > 0 or "taqs" in domains and holds(q, L.BOUNDARY):
            return True
        if "tari5" in domains or "saints" in domains:
            if raw >= 4 or exact():
                return True
            if any(chunks[c].get("domain") in domains for c, _ in first):
                return False
            if any(chunks[c].get("domain") for c, _ in first):
                return True
        return vec[0][2] < 0.65 or exact()

    gates = {"discover": pre is not None, "lexical": lexical(), "expand": False, "metadata": False}
    if not gates["lexical"]:
        return gates, [c for c, _ in first]

    def words(keys):
        out = []
        for n, k in enumerate(keys):
            for c in chunks.values():
                if (c["chunk_id"], k) in shards and (s := points(c, q)) > 0:
                    out.append((-round(s, 9), n, c["chunk_id"]))
        return [(i + 1, c, -s, structured(chunks[c], q)) for i, (s, _, c) in enumerate(sorted(out)[: o.candidate_k])]

    lex = words(keys_of(q, domains, scores, o))
    more = [f for d in domains for f in L.FALLBACKS.get(d, ()) if f not in domains]
    if not first and not lex and more:
        gates["expand"] = True
        lex = words(keys_of(q, list(dict.fromkeys([*domains, *more])), scores, o))
    by_route = "saints" in domains or (scores["ta3lim"] < 2 and ("tari5" in domains or "bible" in domains))
    gates["metadata"] = bool(bool(pre) or not vec or by_route or vec[0][2] < 0.65)
    meta = (metadata() if pre is None else pre) if gates["metadata"] else []
    meta = [m for m in meta if not (chunks[m[1]].get("library") in L.OPTIONAL and chunks[m[1]]["library"] not in o.libraries and m[2] < 65)]
    meta = [m for m in meta if o.hymns or holds(q, L.HYMN) or chunks[m[1]].get("domain") != "al7an" or m[2] >= 65 or m[3]]
    if strict:
        meta = [] if first or lex else [m for m in meta if chunks[m[1]].get("domain") in domains]
    least = 65 if any(m[2] >= 65 for m in meta) else 8
    meta = [m for m in meta if m[2] >= least]
    if first and not bible(first[0][0]):
        lex = [x for x in lex if not (x[1].startswith(("bible-summary:", "verse:")) and not (x[2] >= 30 and x[3]))]
    total = {}
    for n, rows in enumerate((vec, lex, meta)):
        for rank, c, s, *_ in rows:
            part = (1.3 if strict and n == 0 else 1) / (60 + rank) + (0 if n == 0 or strict else s * 0.001)
            a, b = total.get(c, (0, (n, rank)))
            total[c] = (a + part, min(b, (n, rank)))
    order = sorted(total, key=lambda c: (-round(total[c][0], 9), total[c][1], c))
    return gates, [c for c in order if whole(chunks[c])][: o.top_k]


def day_key(d):
    leap = lambda y: y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    back = d - datetime.timedelta(1)
    if leap(d.year + 1) and d.month >= 9:
        if (d.month, d.day) == (9, 11):
            return "02-29"
        return f"{back if (d.month, d.day) > (9, 11) else d:%m-%d}"
    return f"{back if leap(d.year) and d.month < 3 else d:%m-%d}"


# ---- fixtures ----
WORDS = "هابيل قايين كتاب سفر تكوين قديس مار جرجس سيره طقس قداس بخور لحن توبه محبه نتعلم شمعه ملكوت يوسف genesis verse hymn school path inner coptic today".split()
CHUNK = "chunk_id string, doc_id string, title string, url string, text string, domain string, library string, section string, search_text string, keywords array<string>, events array<string>"


def world(seed, n=70, only=None):
    r = random.Random(seed)
    some = lambda k: " ".join(r.choice(WORDS) for _ in range(r.randrange(1, k)))
    chunks, shards = {}, set()
    for i in range(n):
        cid = f"{r.choice(['doc', 'doc', 'bible-summary', 'verse'])}:{i}:{r.randrange(4)}"
        d = only or r.choice([*L.DOMAINS, None])
        c = {"chunk_id": cid, "doc_id": f"d{i}", "title": some(4), "url": "u" if i % 9 else "", "text": "t", "domain": d, "library": r.choice([None, "own", *L.OPTIONAL]), "section": some(3) if i % 3 else None, "search_text": some(8), "keywords": [some(3)] if i % 2 else None, "events": [some(2)] if i % 4 == 0 else None}
        if c["library"] == "seneksar":
            c["keywords"] = [some(2), "seneksar-date:" + r.choice(["09-10", "02-29"])]
        chunks[cid] = c
        shards |= {(cid, f"lexical:domain:{d}")} if d and i % 5 else set()
        shards |= {(cid, search.METADATA_SHARD)} if i % 6 else set()
        if i % 4 == 1:
            shards.add((cid, "lexical:facet:" + r.choice(["sermon", "verse", "bible-summary-detail", "fathers", "cartoon", "seneksar"])))
    vectors = {c: [r.gauss(0, 1) for _ in range(4)] for c in chunks if r.random() < 0.8}
    texts = [some(6) for _ in range(30)] + ["من هو هابيل", "مين واضع القداس", "يوسف", "today", "tomorrow مار", "unknown words only", "", None, "لحن", "آية تكوين 1 2", "school"]
    queries = [(i, t, None if i % 4 == 0 else list(vectors[r.choice(list(vectors))]) if i % 3 else [r.gauss(0, 1) for _ in range(4)]) for i, t in enumerate(texts)]
    return chunks, vectors, shards, queries


NOON = datetime.datetime(2027, 9, 10, 9, tzinfo=datetime.timezone.utc)
SEEN = {k: set() for k in ("discover", "lexical", "expand", "metadata")}


@pytest.mark.parametrize("seed, only, o", [(3, "taqs", search.Options(now=NOON)), (1, None, search.Options(now=NOON)), (2, None, search.Options(frozenset(L.OPTIONAL), True, 4, 9, ("lexical:domain", "lexical:facet:sermon"), NOON))])
def test_retrieval_equals_plain_python(spark, seed, only, o):
    chunks, vectors, shards, queries = world(seed, 20 if only else 70, only)
    df = spark.createDataFrame(queries, "query_id long, text string, vector array<double>")
    table = spark.createDataFrame([tuple(c[k.split()[0]] for k in CHUNK.split(", ")) for c in chunks.values()], CHUNK)
    vec = spark.createDataFrame(list(vectors.items()), "chunk_id string, embedding array<double>")
    member = spark.createDataFrame(sorted(shards), "chunk_id string, shard string")
    found = search.retrieve(df, table, vec, member, o=o)
    own = router.routed(df.select("query_id", search.postings.normal_value(F.coalesce("text", F.lit(""))).alias("text")), router.rule_table(spark))
    route = {r.query_id: (r.scores, list(r.domains), r.strict) for r in own.collect()}
    want = {i: reference((t, v), route[i], chunks, vectors, shards, o) for i, t, v in queries}
    gates = {r.query_id: {k: r[k] for k in SEEN} for r in found.gates.select("query_id", *SEEN).collect()}
    for i, (g, _) in want.items():
        assert gates[i] == g, (queries[i], route[i])
        for k, v in g.items():
            SEEN[k].add(v)
    got = {}
    for r in sorted(found.results.select("query_id", "rank", "chunk_id").collect()):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for i, (_, ids) in want.items():
        assert got.get(i, []) == ids, (queries[i], route[i], gates[i])


def test_each_gate_was_open_and_shut():
    assert SEEN == {k: {True, False} for k in SEEN}


def test_empty_tables(spark):
    q = spark.createDataFrame([], "query_id long, text string, vector array<double>")
    c = spark.createDataFrame([], CHUNK)
    v, s = spark.createDataFrame([], "chunk_id string, embedding array<double>"), spark.createDataFrame([], "chunk_id string, shard string")
    assert search.retrieve(q, c, v, s).results.count() == 0
    one = spark.createDataFrame([(1, "genesis", [1.0])], "query_id long, text string, vector array<double>")
    assert search.retrieve(one, c, v, s).results.count() == 0


@pytest.mark.parametrize("date, key", [("2026-07-16", "07-16"), ("2027-09-12", "09-11"), ("2028-02-29", "02-28"), ("2027-09-11", "02-29"), ("2028-03-01", "03-01"), ("2028-01-01", "12-31"), ("2100-01-05", "01-05"), (None, None)])
def test_day_keys(spark, date, key):
    df = spark.createDataFrame([(date,)], "d string").select(calendar.day_key(F.to_date("d")))
    assert df.first()[0] == key


def test_days_are_those_of_the_zone(spark):
    late = F.lit(datetime.datetime(2026, 7, 15, 22, 30, tzinfo=datetime.timezone.utc))
    row = spark.range(1).select(calendar.local_date(late), calendar.local_date(late, 1), calendar.local_date(late, 0, "America/Los_Angeles")).first()
    assert [str(x) for x in row] == ["2026-07-16", "2026-07-17", "2026-07-15"]
