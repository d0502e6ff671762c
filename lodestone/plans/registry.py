"""Registered queries over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import admission, answers, evaluate, ingest, observability, retrieval, routing, scoring
from lodestone.plans import retrieval_queries

LEXICAL = [(1, "the and"), (2, "license cc by"), (3, "de la")]
CUTOFF = "2024-01-20 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("chunk_id"), F.element_at(F.split("text", "\n"), 1).alias("title"), "text", F.col("lang").alias("domain"), F.col("source").alias("library"))


def lexical_topk(spark, d):
    return retrieval.lexical_candidates(corpus(spark, d), LEXICAL, 5).select("query_id", "chunk_id", "score", "rank")


_SCORES = "".join(
    f"{' UNION ALL ' if n else ''}SELECT {i}::BIGINT AS query_id, chunk_id, (CASE WHEN contains(x, '{q}') THEN 12 ELSE 0 END + CASE WHEN contains(t, '{q}') THEN 20 ELSE 0 END"
    + "".join(f" + CASE WHEN contains(t, '{w}') THEN 8 ELSE 0 END + least(8, (length(x) - length(replace(x, '{w}', ''))) // {len(w)})" for w in q.split())
    + ")::BIGINT AS score FROM n"
    for n, (i, q) in enumerate(LEXICAL)
)
_NORM = r"WITH n AS (SELECT doc_id AS chunk_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}]+', ' ', 'g')) AS t, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS x FROM documents), s AS (" + _SCORES + ")"
_LEX = _NORM + ", l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::BIGINT AS rank FROM s WHERE score > 0)"


def rrf_fusion(spark, d):
    lex = retrieval.lexical_candidates(corpus(spark, d), LEXICAL, 30)
    meta = lex.select("query_id", "chunk_id", (F.lit(1000) - F.col("chunk_id") % 997).alias("score"))
    meta = retrieval.top_k(meta, 30, "chunk_id")
    return retrieval.fuse((meta, "vector", 1.3), (lex, "lexical", 1.0), k=10).select("query_id", "chunk_id", "score", "raw_score", "rank")


def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("label").alias("q_label"))
    return retrieval.vector_candidates(e, F.broadcast(q) if q.count() <= 10_000 else q, 5, "label").select("query_id", "vec_id", "score", "rank")


def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


def url_slug(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), T.safe_name(F.col("url")).alias("file_name"))


def ngram_phrases(spark, d):
    t = table(spark, d, "benchmark").select("item_id", T.words(retrieval.simple_norm(F.col("text"))).alias("w"))
    return t.select("item_id", F.explode(T.phrases(F.col("w"))).alias("phrase"))


def chunk_split(spark, d):
    return ingest.chunks(table(spark, d, "documents"), 1200, 60)


def shard_fanout(spark, d):
    return ingest.shard_rows(corpus(spark, d), ["src0", "src1", "src2"]).groupBy("shard_key").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_chunk"))


def manifest_delta(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    before = docs.filter("quality is null or quality = 1").select("doc_id", F.when(F.col("quality") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    now = docs.filter("toxic is null or toxic = 0")
    return ingest.delta(ingest.manifest(before, "doc_id", "text"), ingest.manifest(now, "doc_id", "text")).groupBy("change").agg(F.count("*").alias("keys"), F.sum("key").alias("key_sum"))


def events(spark, d) -> DataFrame:
    """Events as query events: errors are fallbacks, the k of props is a rating, value a cost."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select("event_id", "ts", "user_id", "event_type", F.round("value", 2).alias("cost"), (F.col("event_type") != "error").alias("answered"), F.when(F.col("k") % 3 == 0, "up").when(F.col("k") % 3 == 1, "down").alias("rating"), "k")


_EVENTS = "WITH e AS (SELECT event_id, ts, user_id, event_type, round(value, 2) AS cost, event_type <> 'error' AS answered, CASE (props->>'$.k')::INT % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS rating, (props->>'$.k')::INT AS k FROM events)"


def feedback_mirror(spark, d):
    """Each document with the last rating that arrived for it (arrival order, not time): ratings are labels, arrivals events."""
    e = events(spark, d).filter("rating is not null").groupBy(F.col("user_id").alias("doc_id")).agg(F.max_by("rating", "event_id").alias("rating"))
    return table(spark, d, "documents").select("doc_id").join(e, "doc_id", "left")


def followup_query(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    u = table(spark, d, "conversations").filter("role = 'user'")
    return u.select("conv_id", "turn", F.concat_ws("\n", F.lag("text").over(w), "text").alias("retrieval_query"))


def retrieval_eval(spark, d):
    return evaluate.holders(table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")), table(spark, d, "documents"))


def quota_admission(spark, d):
    e = events(spark, d).select("event_id", "ts", F.col("user_id").alias("actor"), (F.col("user_id") % 11).alias("network"))
    return admission.reserve(e, (3, 30, 250), one_network=True)


def leaky_rpm(spark, d):
    return admission.leaky(events(spark, d).select("event_id", F.col("user_id").alias("key"), "ts"), 1)


def asof_rating(spark, d):
    e = events(spark, d)
    return observability.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type <> 'purchase'").select("user_id", "ts", F.col("k").alias("last_k")).groupBy("user_id", "ts").agg(F.max("last_k").alias("last_k")), "user_id", "ts", "last_k").select("event_id", "last_k")


def with_preview(spark, d):
    return observability.retention(events(spark, d).select("event_id", "ts", F.concat("event_type", F.lit(":"), "k").alias("preview")), CUTOFF).select("event_id", "preview", "expired")



SCORED = [(1, "the order of"), (2, "que de la")]


def weighted_score(spark, d):
    c = corpus(spark, d).select("chunk_id", "title", F.col("text").alias("search_text"), "domain")
    got = scoring.scored(c, SCORED, normal=retrieval.simple_norm)
    return retrieval.top_k(got.withColumn("score", F.round("score", 6)), 10, "chunk_id").select("query_id", "chunk_id", "score", "structured", "rank")


def _scored_sql() -> str:
    """Written from the rules, with words and phrases taken by SQL; the queries have no Arabic words, so no loose forms."""
    asked = ", ".join(f"({i}::BIGINT, '{raw}')" for i, raw in SCORED)
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"""WITH q AS (SELECT *, string_split(q, ' ') AS w FROM (VALUES {asked}) v(query_id, q)),
p AS (SELECT query_id, list(DISTINCT array_to_string(w[i:i + n - 1], ' ')) AS p FROM q, (SELECT unnest(range(1, 9)) AS i), (SELECT unnest([2, 3, 4]) AS n) WHERE i + n - 1 <= len(w) GROUP BY 1),
c AS (SELECT doc_id AS chunk_id, {norm("coalesce(split_part(text, chr(10), 1), '')")} AS t, {norm("coalesce(text, '')")} AS x, {norm("coalesce(lang, '')")} AS g FROM documents),
f AS (SELECT chunk_id, t AS v, 20 AS weight FROM c UNION ALL SELECT chunk_id, x, 12 FROM c UNION ALL SELECT chunk_id, g, 8 FROM c),
a AS (SELECT query_id, chunk_id, sum(CASE WHEN contains(v, q) THEN weight ELSE 0 END
    + len(list_filter(w, lambda y: contains(v, y))) * greatest(0.25, floor(weight / 4))
    + len(list_filter(p, lambda y: contains(v, y))) * greatest(2, floor(weight / 2))
    + len(list_filter(p, lambda y: contains(replace(v, ' ', ''), replace(y, ' ', '')))) * greatest(2, floor(weight / 3))) AS points
  FROM f, q JOIN p USING (query_id) GROUP BY ALL),
b AS (SELECT query_id, chunk_id, q, t, w, list_filter(list_distinct(string_split(t, ' ')), lambda y: length(y) > 1) AS words, len(list_filter(w, lambda y: contains(t, y) OR contains(x, y) OR contains(g, y))) AS met FROM c, q),
m AS (SELECT *, len(list_filter(words, lambda y: list_contains(w, y))) AS mine FROM b),
s AS (SELECT query_id, chunk_id, round(points + met * 12 + CASE WHEN met = len(w) THEN 80 WHEN met >= 0.75 * len(w) THEN 28 ELSE 0 END
    + CASE WHEN len(words) = 0 THEN 0 WHEN mine = len(words) THEN 40 WHEN 2 * mine >= len(words) THEN 18 * mine::DOUBLE / len(words) ELSE 0 END
    + CASE WHEN len(words) > 0 AND (contains(q, t) OR mine = len(words)) THEN 15.0::DOUBLE / (chunk_id + 1) ELSE 0 END, 6) AS score, false AS structured FROM a JOIN m USING (query_id, chunk_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::BIGINT AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


ROUTES = [("help", "license"), ("help", "email"), ("prose", "the"), ("prose", "and"), ("french", " les "), ("german", " und "), ("german", "nicht"), ("spanish", " que ")]


def routed_turns(spark, d):
    """Domains of every user turn by a term table."""
    c = table(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), retrieval.simple_norm(F.col("text")).alias("q"))
    got = routing.routed(c, ROUTES, ["prose", "help"])
    return got.select("query_id", F.array_join("domains", ",").alias("domains"), F.aggregate(F.map_values("scores"), F.lit(0), lambda a, x: a + x).cast("long").alias("points"))


def _routed_sql() -> str:
    terms = ", ".join(f"('{a}', '{b}', {3 if len(b) > 4 else 2})" for a, b in ROUTES)
    return f"""WITH q AS (SELECT conv_id || ':' || turn AS query_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS q FROM conversations WHERE role = 'user'),
r(domain, term, n) AS (VALUES {terms}), s AS (SELECT query_id, domain, sum(n) AS n FROM q, r WHERE contains(q, term) GROUP BY ALL),
b AS (SELECT query_id, max(n) AS best, sum(n)::BIGINT AS points FROM s GROUP BY 1),
k AS (SELECT query_id, string_agg(domain, ',' ORDER BY domain) AS domains FROM s JOIN b USING (query_id) WHERE n >= greatest(2, best - 1) GROUP BY 1)
SELECT query_id, CASE WHEN coalesce(best, 0) < 2 THEN 'prose,help' ELSE domains END AS domains, coalesce(points, 0) AS points FROM q LEFT JOIN b USING (query_id) LEFT JOIN k USING (query_id)"""


STOP = ["the", "and", "of", "to", "de", "la", "und", "der"]


def answer_validation(spark, d):
    """Assistant turns as model answers that cite the turn before them and one that was never retrieved."""
    c = table(spark, d, "conversations")
    key = F.concat_ws(":", "conv_id", F.col("turn") - 1)
    earlier = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("turn") - 1)), lambda i: F.concat_ws(":", "conv_id", i))
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit("ANSWERED").alias("status"), F.col("text").alias("answer"), F.lit("odd").alias("confidence"), F.array(key, F.lit("none"), key).alias("cited_chunk_ids"))), F.lit("\n```"))
    rows = answers.parse_answers(c.filter("role = 'assistant'").select("conv_id", "turn", raw.alias("raw"), earlier.alias("retrieved")))
    return answers.validate(rows, stop=STOP).select("conv_id", "turn", "confidence", F.array_join("citations", ",").alias("citations"), "valid")


def passage_report(spark, d):
    """hit@5 and hit@1 of ranking documents by the number of five-word shingles they share with a passage."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.array_join(F.slice(w, i, 5), " ")))
    b = table(spark, d, "benchmark").select("item_id", words("text").alias("w")).filter("size(w) >= 5").select("item_id", F.explode(grams(F.col("w"))).alias("g"))
    docs = table(spark, d, "documents").select("doc_id", words("text").alias("w")).filter("size(w) >= 5").select("doc_id", F.explode(grams(F.col("w"))).alias("g"))
    score = docs.join(b, "g").groupBy(F.col("item_id").alias("query_id"), "doc_id").agg(F.count("*").alias("score"))
    hits = retrieval.top_k(score, 5, "doc_id").select("query_id", "doc_id", "rank")
    expected = retrieval_eval(spark, d).select(F.col("item_id").alias("query_id"), F.col("first_doc").alias("doc_id"))
    return evaluate.hit_report(evaluate.expected_rank(hits, expected))


QUERIES = {
    "weighted_score": weighted_score,
    "routed_turns": routed_turns,
    "answer_validation": answer_validation,
    "passage_report": passage_report,
    "lexical_topk": lexical_topk,
    "rrf_fusion": rrf_fusion,
    "vector_topk": vector_topk,
    "hydrate": lambda s, d: retrieval.hydrate(retrieval.lexical_candidates(corpus(s, d), LEXICAL, 30), corpus(s, d).join(table(s, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select("chunk_id", "title", "text"), 5).select("query_id", "chunk_id", "score", "rank"),
    "html_to_text": html_to_text,
    "url_slug": url_slug,
    "ngram_phrases": ngram_phrases,
    "chunk_split": chunk_split,
    "shard_fanout": shard_fanout,
    "manifest_delta": manifest_delta,
    "obs_totals": lambda s, d: observability.totals(events(s, d)),
    "obs_groups": lambda s, d: observability.top_groups(events(s, d).filter("not answered or rating = 'down'"), ["user_id", "event_type"], 25),
    "obs_cpu": lambda s, d: observability.lower_percentile(events(s, d), "event_type", "cost", 0.95),
    "usage_counters": lambda s, d: observability.usage_counters(events(s, d)),
    "quota_guarded": lambda s, d: observability.guarded(events(s, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day", "user_id"], 2, ["ts", "event_id"]).select("event_id", "admitted"),
    "budget_alerts": lambda s, d: observability.budget_alerts(events(s, d), 5),
    "feedback_mirror": feedback_mirror,
    "followup_query": followup_query,
    "retrieval_eval": retrieval_eval,
    "retention": with_preview,
    "session_windows": lambda s, d: observability.sessions(events(s, d), 43_200),
    "asof_rating": asof_rating,
    "quota_admission": quota_admission,
    "leaky_rpm": leaky_rpm,
}

_CLEAN = "html"
for _p, _r, _o in [(T.BREAK, "\n", "gi"), (f"</({T.BLOCK_TAGS})>", "\n", "gi"), ("<[^>]+>", "", "g")]:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_r}', '{_o}')"
for _a, _b in T.ENTITIES:
    _CLEAN = f"replace({_CLEAN}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
for _p, _r in T.TIDY:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_r}', 'g')"

ORACLE_SQL = {
    "weighted_score": _scored_sql(),
    "routed_turns": _routed_sql(),
    "answer_validation": f"""WITH a AS (SELECT conv_id, turn, nullif(trim(text), '') AS answer FROM conversations WHERE role = 'assistant'),
t AS (SELECT *, trim(regexp_replace(trim(regexp_replace(answer, '\\s+', ' ', 'g')), '[*_`#>]+$', '')) AS x FROM a), w AS (SELECT *, lower(regexp_extract_all(x, '[\\p{{L}}\\p{{M}}]+')[-1]) AS last FROM t)
SELECT conv_id, turn, 'medium' AS confidence, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) ELSE '' END AS citations,
  answer IS NOT NULL AND turn > 0 AND x <> '' AND right(x, 1) NOT IN (',', ';', ':', '،', '؛', '…', '-') AND right(x, 3) <> '...' AND coalesce(last NOT IN ({", ".join(f"'{w}'" for w in STOP)}), true) AS valid FROM w""",
    "passage_report": r"""WITH w AS (SELECT 1 AS k, item_id AS id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark UNION ALL SELECT 2, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') FROM documents),
g AS (SELECT DISTINCT k, id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT k, id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
s AS (SELECT b.id AS item_id, d.id AS doc_id, count(*) AS n FROM g b JOIN g d ON b.k = 1 AND d.k = 2 AND b.g = d.g GROUP BY ALL),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM s) WHERE rank <= 5),
e AS (SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
r AS (SELECT e.item_id, rank FROM e LEFT JOIN h USING (item_id, doc_id))
SELECT count(*) AS items, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_k, round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_1, hit_at_k >= 0.8 AS passed FROM r""",
    "lexical_topk": _LEX + " SELECT query_id, chunk_id, score, rank FROM l WHERE rank <= 5",
    "rrf_fusion": _LEX
    + """, a AS (SELECT * FROM l WHERE rank <= 30), m AS (SELECT query_id, chunk_id, 1000 - chunk_id % 997 AS score, row_number() OVER (PARTITION BY query_id ORDER BY 1000 - chunk_id % 997 DESC, chunk_id) AS rank FROM a),
p AS (SELECT query_id, chunk_id, 0 AS n, rank, score::DOUBLE AS raw, 1.3::DOUBLE / (60 + rank) AS part FROM m UNION ALL SELECT query_id, chunk_id, 1, rank, score::DOUBLE, 1.0::DOUBLE / (60 + rank) + score * 0.001::DOUBLE FROM a),
f AS (SELECT query_id, chunk_id, round(sum(part), 9) AS score, max(raw) AS raw_score, min(n * 1000 + rank) AS first FROM p GROUP BY ALL)
SELECT query_id, chunk_id, score, raw_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id)::BIGINT AS rank FROM f) WHERE rank <= 10""",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id AND q.label = e.label)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank FROM s) WHERE rank <= 5""",
    "hydrate": _LEX + """, h AS (SELECT query_id, chunk_id, score FROM l WHERE rank <= 30 AND chunk_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND chunk_id IN (SELECT doc_id FROM documents WHERE length(split_part(text, chr(10), 1)) > 0))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::BIGINT AS rank FROM h) WHERE rank <= 5""",
    "html_to_text": f"SELECT page_id, {_CLEAN} AS text FROM pages",
    "url_slug": r"""WITH u AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*|/+$', '', 'g'), '/')[-1] AS last, '&' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS asked FROM pages),
i AS (SELECT *, regexp_extract(asked, '&id=([^&]*)', 1) AS id, regexp_extract(asked, '&q=([^&]*)', 1) AS q FROM u)
SELECT page_id, CASE WHEN last = 'generateVerse.php' AND regexp_full_match(id, '[0-9]+') THEN 'verse-' || id WHEN lower(last) = 'seneksar.php' AND regexp_full_match(q, '[0-9]+') THEN 'day-' || q
  WHEN last = '.php' THEN last ELSE regexp_replace(last, '\.php$', '') END AS slug,
  regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS file_name FROM i""",
    "ngram_phrases": r"""WITH w AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: length(x) >= 2) AS w FROM benchmark),
g AS (SELECT item_id, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([2, 3, 4]) AS n)))
SELECT DISTINCT item_id, phrase FROM g""",
    "shard_fanout": """WITH k AS (SELECT doc_id, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'lexical:facet:' || source ELSE 'lexical:domain:' || coalesce(lang, 'default') END AS shard_key FROM documents UNION ALL SELECT doc_id, 'lexical:metadata' FROM documents)
SELECT shard_key, count(*) AS chunks, min(doc_id) AS first_chunk FROM k GROUP BY 1""",
    "manifest_delta": """WITH d AS (SELECT doc_id, text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT doc_id, sha256(CASE WHEN quality = 1 THEN text || '!' ELSE text END) AS old FROM d WHERE quality IS NULL OR quality = 1), n AS (SELECT doc_id, sha256(text) AS new FROM d WHERE toxic IS NULL OR toxic = 0),
c AS (SELECT doc_id, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' WHEN old <> new THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN n USING (doc_id))
SELECT change, count(*) AS keys, sum(doc_id)::BIGINT AS key_sum FROM c GROUP BY 1""",
    "obs_totals": _EVENTS + " SELECT count(*) AS total, count(*) FILTER (answered) AS answered, count(*) FILTER (NOT answered) AS fallbacks, count(*) FILTER (rating = 'up') AS likes, count(*) FILTER (rating = 'down') AS dislikes, count(*) FILTER (rating IS NULL) AS unrated FROM e",
    "obs_groups": _EVENTS + """ SELECT user_id, event_type, count(*) AS "count" FROM e WHERE NOT answered OR rating = 'down' GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 25""",
    "obs_cpu": _EVENTS + ", r AS (SELECT event_type, cost, row_number() OVER (PARTITION BY event_type ORDER BY cost) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM e WHERE cost IS NOT NULL) SELECT event_type, n, cost FROM r WHERE r = floor((n - 1) * 0.95) + 1",
    "usage_counters": _EVENTS + """, k AS (SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, user_id, cost FROM e)
SELECT 'day' AS period_type, day AS period_key, 'global' AS scope, 'all' AS usage_key, count(*) AS queries, round(sum(cost), 2) AS cost FROM k GROUP BY day
UNION ALL SELECT 'month', month, 'global', 'all', count(*), round(sum(cost), 2) FROM k GROUP BY month
UNION ALL SELECT 'day', day, 'device', user_id::VARCHAR, count(*), round(sum(cost), 2) FROM k GROUP BY day, user_id""",
    "quota_guarded": "SELECT event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id ORDER BY ts, event_id) <= 2 AS admitted FROM events",
    "budget_alerts": """WITH u AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS used FROM events)
SELECT user_id, day, t::BIGINT AS threshold, used, event_id FROM u, (SELECT unnest([80, 90, 100]) AS t) WHERE used * 100 >= t * 5 AND (used - 1) * 100 < t * 5""",
    "feedback_mirror": _EVENTS + ", f AS (SELECT user_id AS doc_id, max_by(rating, event_id) AS rating FROM e WHERE rating IS NOT NULL GROUP BY 1) SELECT doc_id, rating FROM documents LEFT JOIN f USING (doc_id)",
    "followup_query": "SELECT conv_id, turn, concat_ws(chr(10), lag(text) OVER (PARTITION BY conv_id ORDER BY turn), text) AS retrieval_query FROM conversations WHERE role = 'user'",
    "retrieval_eval": "SELECT item_id, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1",
    "retention": _EVENTS + f" SELECT event_id, CASE WHEN ts >= '{CUTOFF}' THEN event_type || ':' || k END AS preview, ts < '{CUTOFF}' AS expired FROM e",
    "session_windows": """WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 43200000000 THEN 0 ELSE 1 END AS new FROM events),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM s)
SELECT user_id, session_no, count(*) AS events, min(ts) AS started, max(ts) AS ended FROM n GROUP BY 1, 2""",
    "asof_rating": _EVENTS + ", r AS (SELECT user_id, ts, max(k) AS last_k FROM e WHERE event_type <> 'purchase' GROUP BY ALL) SELECT p.event_id, r.last_k FROM e p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.ts >= r.ts WHERE p.event_type = 'purchase'",
}
QUERIES |= retrieval_queries.QUERIES
ORACLE_SQL |= retrieval_queries.ORACLE_SQL
