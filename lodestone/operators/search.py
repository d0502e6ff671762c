"""The whole retrieval of a table of queries: routing, vector, lexical and metadata candidates behind gates, fusion, hydration.

Each query's decisions are columns of one gate table; a branch joins only the queries that its gate lets through, so lexical
and metadata scoring cost nothing for queries that their vector hits satisfy:

    discover   no domain scores and the query asks who someone is or looks like a name: the metadata of all chunks may move the
               domains
    lexical    vector hits are missing, weak or off the routed domains, or the query has the shape of a title, rite or lesson
    expand     neither vector hits nor lexical candidates: the lexical search is repeated with the domains' fallbacks
    metadata   metadata candidates take part in the fusion

Chunks: (chunk_id, doc_id, title, url, text, domain, library, and any field that `scoring` weighs). A chunk without one of the five
required fields is never returned, but takes its place among candidates. Vectors: (chunk_id, embedding); domain and library of
its chunk filter them. Queries: (query_id, text, vector); a null vector has no vector hits; a null text is empty, and an empty
one finds no words. Equal scores go by the chunk's id; equal fused scores by the source (vector, lexical, metadata) and rank that first named the chunk.
Repeated chunk ids count as one chunk each; query ids must differ. Empty tables give an empty result.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import lexicon as L
from lodestone.functions import text as T
from lodestone.operators import best, calendar, nearest, postings, retrieval, router
from lodestone.sources.files import stored

# Limits of the gates.
LOW_VECTOR, STRONG_LEXICAL, STRONG_METADATA, WEAK_METADATA = 0.65, 30, 65, 8
DISCOVER_LEAST, DISCOVER_NEAR, NAME_BONUS, DAY_BONUS = 30, 12, 80, 1000
STRICT_VECTOR = 1.3
METADATA_SHARD, DAY_BOOK = "lexical:metadata", "seneksar"


@dataclass(frozen=True)
class Options:
    """What a deployment switches on. `libraries`: the optional libraries in use; `keys`: the lexical shards ("lexical:domain"
    stands for those of the routed domains); `now`: the instant that "today" means."""

    libraries: frozenset[str] = frozenset()
    hymns: bool = False
    top_k: int = 5
    candidate_k: int = 30
    keys: tuple[str, ...] = ("lexical:domain",)
    now: datetime.datetime | None = None
    stop: frozenset[str] = field(default_factory=L.stop_words)


def names(q: Column, listed: str) -> Column:
    """Whether a query holds any of the words."""
    out = F.lit(False)
    for w in L.words(listed):
        out = out | F.contains(q, F.lit(w))
    return out


def in_domains(name: str, domains: str = "domains") -> Column:
    return F.array_contains(domains, name)


def points(domain: str) -> Column:
    return F.coalesce(F.col("scores")[domain], F.lit(0))


def eligible(library: str, o: Options, domains: str = "domains") -> Column:
    """Whether a query may look into an optional library."""
    q = F.col("q")
    asked = {"cartoon": names(q, L.CARTOON), "aqwal": names(q, L.SAYINGS), "coptic": in_domains("coptic", domains), "about": in_domains("school", domains), "seneksar": in_domains("saints", domains) | names(q, L.DAY_BOOK)}
    return F.lit(library in o.libraries) & asked[library]


def enabled(domains: Column, o: Options) -> Column:
    """domains without the hymns', unless they are on or asked for; the default ones where none is left."""
    left = F.when(F.lit(o.hymns) | names(F.col("q"), L.HYMN), domains).otherwise(F.array_remove(domains, "al7an"))
    return F.when(F.size(left) > 0, left).otherwise(F.array(*map(F.lit, L.DEFAULT_DOMAINS)))


def lexical_keys(o: Options, domains: str) -> Column:
    """The shards that a query looks into, in their order."""
    teaching = in_domains("ta3lim", domains) & (points("ta3lim") >= 2) & (points("bible") <= 0)
    own = F.transform(F.filter(domains, lambda d: ~teaching | (d != "bible")), lambda d: F.concat(F.lit("lexical:domain:"), d))
    verse = names(F.col("q"), L.VERSE) | F.col("q").rlike(r"(?:^|\s)(?:[1-3]\s+)?\p{L}+\s+\d+\s+\d+(?:\s|$)")
    more = lambda on, key: F.when(on, F.array(F.lit(f"lexical:facet:{key}"))).otherwise(F.array().cast("array<string>"))
    facets = [more(teaching, "sermon"), more(in_domains("bible", domains), "bible-summary-detail"), more(in_domains("bible", domains) & verse, "verse")]
    facets += [more(eligible(n, o, domains), key) for n, key in (("aqwal", "fathers"), ("cartoon", "cartoon"), ("seneksar", "seneksar"))]
    parts = [F.concat(own, *facets) if k == "lexical:domain" else F.array(F.lit(k)) for k in o.keys]
    return F.array_distinct(F.concat(*parts))


def is_bible(chunk_id: Column, domain: Column) -> Column:
    return F.coalesce(domain == "bible", F.lit(False)) | chunk_id.startswith("bible-summary:")


def overlap() -> Column:
    """The largest share of a query's words that the title of a vector hit holds."""
    shares = F.transform("hits", lambda h: F.when(F.size("words") > 0, F.size(F.array_intersect(h["title_words"], F.col("words"))) / F.size("words")).otherwise(0.0))
    return F.coalesce(F.array_max(shares), F.lit(0.0))


def exact_title() -> Column:
    """Whether all of a vector hit's title stands in a query that is no longer than it."""
    return F.exists("hits", lambda h: (F.size(h["title_words"]) > 0) & (F.size(F.array_except(h["title_words"], F.col("words"))) == 0) & ((F.col("q") == h["title"]) | (F.col("raw") <= h["title_raw"])))


def exact_intent() -> Column:
    off = F.exists("hits", lambda h: is_bible(h["chunk_id"], h["domain"]))
    return exact_title() | ((F.col("raw") <= 3) & (overlap() < 0.25)) | ((points("bible") <= 0) & off) | ((points("bible") > 0) & (overlap() < 0.25)) | (in_domains("ta3lim") & (overlap() < 0.5))


def wants_lexical() -> Column:
    none = (F.col("vectors") == 0) | (F.size("hits") == 0)
    people = in_domains("tari5") | in_domains("saints")
    routed = F.exists("hits", lambda h: F.coalesce(F.array_contains("domains", h["domain"]), F.lit(False)))
    known = F.exists("hits", lambda h: h["domain"].isNotNull())
    weak = F.coalesce(F.col("best_vector") < LOW_VECTOR, F.lit(False))
    by_people = F.when(F.col("raw") >= 4, True).when(exact_intent(), True).when(routed, False).when(known, True)
    first = F.when(none, True).when(points("ta3lim") > 0, True).when(in_domains("taqs") & names(F.col("q"), L.BOUNDARY), True).when(people, by_people)
    return F.coalesce(first, weak | exact_intent())


def wants_metadata() -> Column:
    by_route = F.when(in_domains("saints"), True).when(points("ta3lim") >= 2, False).otherwise(in_domains("tari5") | in_domains("bible"))
    return (F.col("preloaded") > 0) | (F.col("vectors") == 0) | by_route | F.coalesce(F.col("best_vector") < LOW_VECTOR, F.lit(False))


def wants_discovery() -> Column:
    shape = (F.col("raw") <= 3) & F.exists("words", lambda w: F.length(T.strip_article(w)) >= 5)
    return ~F.exists(F.map_values("scores"), lambda s: s > 0) & (names(F.col("q"), L.IDENTITY) | shape)


def routes(queries: DataFrame, rules: DataFrame, o: Options) -> DataFrame:
    """Features, scores and enabled domains of queries (query_id, text, vector)."""
    asked = postings.features(queries, o.stop)
    own = asked.drop("text").withColumnRenamed("q", "text")
    out = router.routed(own, rules).withColumnRenamed("text", "q")
    return out.withColumn("domains", enabled(F.col("domains"), o)).withColumn("discover", wants_discovery())


def vector_candidates(asked: DataFrame, vectors: DataFrame, chunks: DataFrame, o: Options, keep=stored) -> DataFrame:
    """(query_id, chunk_id, score, rank): nearest vectors by cosine within a query's domains, without libraries it mayn't see."""
    shut = F.array_compact(F.array(*[F.when(~eligible(n, o), F.lit(n)) for n in L.OPTIONAL]))
    own = asked.select("query_id", "vector", "domains", shut.alias("shut"))
    near = nearest.nearest(own, vectors.join(chunks.select("chunk_id", "domain", "library"), "chunk_id"), o.candidate_k, keep)
    return retrieval.top_k(near, o.candidate_k, "chunk_id")


def hydrated(candidates: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The first k candidates (query_id, chunk_id, score, rank) whose chunk has all required fields, ranked anew."""
    whole = chunks
    for c in ("doc_id", "chunk_id", "title", "url", "text"):
        whole = whole.filter(F.length(F.col(c).cast("string")) > 0)
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = candidates.join(whole.select("chunk_id"), "chunk_id", "left_semi")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def lexical_candidates(asked: DataFrame, keys: str, ready: DataFrame, shards: DataFrame, o: Options, keep=stored) -> DataFrame:
    """(query_id, chunk_id, score, structured, rank) within the shards of a column; a chunk of several shards stands in the ranking
    once for each, as each shard holds it."""
    wanted = shards.filter(F.col("shard") != METADATA_SHARD) if METADATA_SHARD not in o.keys else shards
    found = best.best(asked, ready, o.candidate_k, o.stop, wanted, keys, keep=keep).drop("n")
    return postings.marked(found, asked, ready).select("query_id", "chunk_id", "score", "structured", "rank")


def metadata_candidates(asked: DataFrame, bare: DataFrame, held: DataFrame, chunks: DataFrame, o: Options, keep=stored) -> DataFrame:
    """(query_id, chunk_id, score, structured, domain, library, rank): chunks of the metadata shard (held: their ids) by their fields
    but the text, with a bonus for the query's own name and for the day that it asks for."""
    day = calendar.day_of_query(F.col("q"), o.now)
    asked = asked.withColumn("_day", F.concat(F.lit(f"{DAY_BOOK}-date:"), day))
    keywords = F.col("keywords") if "keywords" in chunks.columns else F.array().cast("array<string>")
    source = F.col("source_ref").cast("string") if "source_ref" in chunks.columns else F.lit("")
    names = [F.array_join(keywords, " "), source, *[F.col(c) if c in chunks.columns else F.lit("") for c in ("title", "section")]]
    texts = chunks.select("chunk_id", "domain", "library", keywords.alias("keywords"), *[postings.normal_value(F.coalesce(x, F.lit(""))).alias(f"_{n}") for n, x in enumerate(names)])
    named = F.filter(F.array(*[F.struct(F.col(f"_{n}").alias("v"), T.loose(F.col(f"_{n}")).alias("l")) for n in range(len(names))]), lambda x: x["v"] != "")
    about = texts.select("chunk_id", "domain", "library", "keywords", named.alias("_names"))
    days = chunks.select("chunk_id", F.when(F.col("library") == DAY_BOOK, F.filter(keywords, lambda x: x.startswith(f"{DAY_BOOK}-date:"))).alias("_days"))
    rows = bare.join(held, "chunk_id", "left_semi").join(days, "chunk_id")
    found = best.best(asked, rows, o.candidate_k, o.stop, day="_day", days=F.col("_days"), bonus=(float(NAME_BONUS), float(DAY_BONUS)), keep=keep)
    whole = found.join(asked.select("query_id", "tokens", "_day"), "query_id").join(about, "chunk_id")
    dated = F.coalesce((F.col("library") == DAY_BOOK) & F.array_contains("keywords", F.col("_day")), F.lit(False))
    own = F.exists(F.filter("tokens", lambda t: F.length(t["t"]) >= 4), lambda t: F.exists("_names", lambda x: F.contains(x["v"], t["t"]) | F.contains(x["l"], t["l"])))
    return whole.select("query_id", "chunk_id", "score", (dated | own).alias("structured"), "domain", "library", "rank")


def discovered(asked: DataFrame, metadata: DataFrame, o: Options) -> DataFrame:
    """asked with the domains of its best metadata candidates, where the best one has `DISCOVER_LEAST` points."""
    known = metadata.filter(F.col("domain").isin(*L.DOMAINS)).select("query_id", "rank", "domain", "score")
    best = metadata.groupBy("query_id").agg(F.max("score").alias("_best"), F.count("*").alias("preloaded"))
    near = known.join(best.select("query_id", "_best"), "query_id").filter((F.col("_best") >= DISCOVER_LEAST) & (F.col("score") >= F.greatest(F.lit(float(DISCOVER_LEAST)), F.col("_best") - DISCOVER_NEAR)))
    found = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "domain"))).alias("_d"))  # candidate_k at most
    out = asked.join(best.select("query_id", "preloaded"), "query_id", "left").join(found, "query_id", "left")
    return out.withColumn("domains", F.when(F.col("_d").isNotNull(), enabled(F.array_distinct("_d.domain"), o)).otherwise(F.col("domains"))).withColumn("preloaded", F.coalesce("preloaded", F.lit(0))).drop("_d")


def fused(parts: list[tuple[DataFrame, str]], gates: DataFrame) -> DataFrame:
    """Reciprocal ranks summed, with a thousandth of lexical and metadata scores; strict routes count ranks alone, vector ranks
    1.3 times."""
    rows = None
    for n, (frame, name) in enumerate(parts):
        raw = F.lit(0.0) if name == "vector" else F.when(F.col("strict"), 0.0).otherwise(F.col("score") * 0.001)
        weight = F.when(F.col("strict"), STRICT_VECTOR).otherwise(1.0) if name == "vector" else F.lit(1.0)
        part = frame.join(gates.select("query_id", "strict"), "query_id").select("query_id", "chunk_id", F.lit(n).alias("_source"), "rank", F.col("score").cast("double").alias("raw"), (weight / (60 + F.col("rank")) + raw).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    total = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("fused"), F.max("raw").alias("score"), F.min(F.struct("_source", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), "first", "chunk_id")
    return total.select("query_id", "chunk_id", "score", F.row_number().over(w).cast("long").alias("rank"))


@dataclass
class Found:
    """The gates of each query and what the branches found, as tables."""

    gates: DataFrame
    vectors: DataFrame
    lexical: DataFrame
    metadata: DataFrame
    results: DataFrame


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, shards: DataFrame, rules: DataFrame | None = None, o: Options = Options(), keep=stored) -> Found:
    """The first `top_k` chunks of each query. shards: (chunk_id, shard). `keep` cuts the lineage of small tables that several
    branches read (gates, candidates) and of the index."""
    spark = queries.sparkSession
    rules = router.rule_table(spark) if rules is None else rules
    chunks = chunks.dropDuplicates(["chunk_id"])
    ready = keep(postings.prepared(chunks, o.stop))
    held = keep(shards.filter(F.col("shard") == METADATA_SHARD).join(ready.filter(F.size("fields") > 0), "chunk_id", "left_semi").select("chunk_id").distinct())
    bare = keep(postings.prepared(chunks, o.stop, leave=("search_text",)))
    asked = keep(routes(queries, rules, o))
    early = keep(metadata_candidates(asked.filter("discover"), bare, held, chunks, o, keep))
    asked = discovered(asked, early, o)
    near = keep(vector_candidates(asked, vectors, chunks, o, keep))
    first = hydrated(near, chunks, o.top_k)
    hits = first.join(ready.select("chunk_id", "title", "title_words", "title_raw"), "chunk_id").join(chunks.select("chunk_id", "domain"), "chunk_id")
    hits = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "domain", "title", "title_words", "title_raw"))).alias("hits"))  # top_k at most
    seen = near.groupBy("query_id").agg(F.count("*").alias("vectors"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best_vector"))
    gates = asked.join(seen, "query_id", "left").join(hits, "query_id", "left")
    none = F.array().cast("array<struct<rank:bigint,chunk_id:string,domain:string,title:string,title_words:array<string>,title_raw:int>>")
    gates = gates.withColumn("vectors", F.coalesce("vectors", F.lit(0))).withColumn("hits", F.coalesce("hits", none))
    gates = gates.withColumn("lexical", wants_lexical()).withColumn("metadata", F.col("lexical") & wants_metadata()).withColumn("keys", lexical_keys(o, "domains"))
    more = F.create_map(*[x for d, f in L.FALLBACKS.items() for x in (F.lit(d), F.array(*map(F.lit, f)))])
    wide = F.array_distinct(F.concat(F.col("domains"), F.flatten(F.transform(F.filter("domains", lambda d: F.map_contains_key(more, d)), lambda d: F.element_at(more, d)))))
    gates = keep(gates.withColumn("wide", wide))
    words = keep(lexical_candidates(gates.filter("lexical"), "keys", ready, shards, o, keep))
    some = words.select("query_id").distinct()
    empty = gates.filter(F.col("lexical") & (F.size("hits") == 0) & (F.size("wide") > F.size("domains"))).join(some, "query_id", "left_anti")
    again = keep(lexical_candidates(empty.withColumn("keys", lexical_keys(o, "wide")), "keys", ready, shards, o, keep))
    words = words.unionByName(again)
    gates = gates.join(empty.select("query_id", F.lit(True).alias("expand")), "query_id", "left").withColumn("expand", F.coalesce("expand", F.lit(False)))
    late = metadata_candidates(gates.filter("metadata and not discover"), bare, held, chunks, o, keep)
    meta = early.join(gates.filter("metadata").select("query_id"), "query_id", "left_semi").unionByName(late)
    meta = quiet(meta, gates, o)
    strict = gates.join(words.select("query_id", F.lit(True).alias("_w")).distinct(), "query_id", "left").select("query_id", "strict", "domains", (F.size("hits") > 0).alias("_h"), F.coalesce("_w", F.lit(False)).alias("_w"))
    ok = ~F.col("strict") | (~F.col("_h") & ~F.col("_w") & F.coalesce(F.array_contains("domains", F.col("domain")), F.lit(False)))
    meta = keep(strong(meta.join(strict, "query_id").filter(ok).select(*meta.columns)))
    top = gates.select("query_id", F.coalesce(~is_bible(F.get("hits", F.lit(0))["chunk_id"], F.get("hits", F.lit(0))["domain"]), F.lit(False)).alias("_other"))
    bible = F.col("chunk_id").startswith("bible-summary:") | F.col("chunk_id").startswith("verse:")
    firm = (F.col("score") >= STRONG_LEXICAL) & F.col("structured")
    words = keep(words.join(top, "query_id").filter(~(F.col("_other") & bible & ~firm)).drop("_other"))
    open_ = gates.filter("lexical").select("query_id")
    joined = fused([(near.join(open_, "query_id", "left_semi"), "vector"), (words, "lexical"), (meta, "metadata")], gates)
    done = hydrated(joined, chunks, o.top_k).unionByName(first.join(open_, "query_id", "left_anti"))
    return Found(gates, near, words, meta, done)


def quiet(meta: DataFrame, gates: DataFrame, o: Options) -> DataFrame:
    """Metadata candidates without weak ones of libraries that are off, and without weak hymns that nobody asked for."""
    off = [n for n in L.OPTIONAL if n not in o.libraries]
    asked = gates.select("query_id", names(F.col("q"), L.HYMN).alias("_hymn"))
    weak = F.col("score") < STRONG_METADATA
    library = F.coalesce(F.col("library").isin(off), F.lit(False)) & weak if off else F.lit(False)
    hymn = ~(F.lit(o.hymns) | F.col("_hymn")) & F.coalesce(F.col("domain") == "al7an", F.lit(False)) & weak & ~F.col("structured")
    return meta.join(asked, "query_id").filter(~library & ~hymn).drop("_hymn")


def strong(meta: DataFrame) -> DataFrame:
    """Candidates of at least `STRONG_METADATA` where a query has one, else of at least `WEAK_METADATA`; ranks stay."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return meta.withColumn("_b", best).filter(F.col("score") >= F.when(F.col("_b") >= STRONG_METADATA, STRONG_METADATA).otherwise(WEAK_METADATA)).drop("_b")
