"""Domain routing of queries by an ordered table of rules.

A rule applies where a query holds one of its terms (and one of `also`, if it has any; where its `needs` domain scores; and not
where the terms of the rule `unless` are held too, which tells the same intent in another way).
Rules apply in the order of `step`; each changes the scores of its domains:

    add    adds points; terms of a domain's own list are rules of their own: 3 points for more than four letters, else 2
    floor  raises a score to the points at least
    lift   sets all its domains to the highest of their scores plus points
    zero   sets scores to 0
    strict, wide  raise a flag of the route

The rules are a table; `default_rules` builds the built-in one. Below a best score of 2 the default domains hold. Else those
within 1 of the best, and at 2 at least, are taken (with the wide flag those of 3 and more); then both domains of a pair whose
scores are positive, and the second of a pair whose first one scores up to 3 alone. Domains come in the order of the list. A
null query holds no term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import lexicon as L
from lodestone.functions import text as T

RULE = "step int, kind string, domains array<string>, terms array<string>, also array<string>, needs string, points int, unless int"


def default_rules() -> list[tuple]:
    """The built-in rules, as rows of `RULE`."""
    w = lambda listed: L.words(listed, T.INGEST_DIACRITICS)
    ambiguous = set(w(L.AMBIGUOUS))
    rules = []

    def add(kind, domains, terms, points=0, also=(), needs=None, unless=None):
        rules.append((len(rules), kind, list(domains), list(terms), list(also), needs, points, unless))

    for domain in L.DOMAINS:
        for term in w(L.TERMS[domain]):
            if not (domain == "ta3lim" and term in ambiguous):
                add("add", [domain], [term], 3 if len(term) > 4 else 2)
    add("floor", ["ta3lim"], sorted(ambiguous), 1)
    add("add", ["saints"], w(L.COMMEMORATION), 6)
    add("add", ["saints"], w(L.DEPARTURE), 6, w(L.SAINT_TITLES), unless=len(rules) - 1)
    add("wide", [], w(L.FEASTS))
    add("add", ["taqs", "bible", "ta3lim"], w(L.FEASTS), 3)
    add("add", ["ta3lim"], w(L.INTERPRETATION), 3, needs="taqs")
    add("add", ["tari5"], w(L.EUCHARIST), 8)
    add("add", ["tari5"], w(L.ORTHODOXY), 3, w(L.LOOKUP))
    add("add", ["tari5"], [""], 2, needs="coptic")
    for terms, points, also in ((L.MONASTIC, 6, ()), (L.OFFICES, 5, ()), (L.WHO, 5, w(L.EPITHET))):
        add("lift", ["tari5", "saints"], w(terms), points, also)
    add("lift", ["tari5", "saints"], w(L.AUTHORSHIP), 8, needs="taqs")
    add("strict", [], w(L.AUTHORSHIP), needs="taqs")
    add("zero", ["taqs"], w(L.AUTHORSHIP), needs="taqs")
    return rules


def rule_table(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(default_rules() if rules is None else rules, RULE)


def routed(queries: DataFrame, rules: DataFrame, domains=L.DOMAINS, default=L.DEFAULT_DOMAINS, pairs=(("bible", "ta3lim"),)) -> DataFrame:
    """queries (query_id, text, ...) with `scores` (a map of all domains), `domains`, `strict`. The rule table has a few hundred
    rows; it reaches the queries as one row."""
    names = list(domains)
    every = F.array(*map(F.lit, names))
    row = rules.agg(F.array_sort(F.collect_list(F.struct("step", "kind", "domains", "terms", "also", "needs", "points", "unless"))).alias("_rules"))
    q = F.coalesce(T.normalize_ingest(F.col("text")), F.lit(""))
    said = queries.withColumn("_q", q).crossJoin(F.broadcast(row))  # one row
    holds = lambda terms: F.exists(terms, lambda t: F.contains(F.col("_q"), t))
    told = F.filter("_rules", lambda r: holds(r["terms"]) & ((F.size(r["also"]) == 0) | holds(r["also"])))
    said = said.withColumn("_told", told)
    said = said.withColumn("_told", F.filter("_told", lambda r: r["unless"].isNull() | ~F.array_contains(F.col("_told.step"), r["unless"])))

    def score(scores: Column, name: Column) -> Column:
        return F.element_at(scores, F.array_position(every, name).cast("int"))

    def applied(state: Column, r: Column) -> Column:
        scores = state["scores"]
        on = r["needs"].isNull() | (score(scores, F.coalesce(r["needs"], F.lit(names[0]))) > 0)
        best = F.array_max(F.transform(r["domains"], lambda d: score(scores, d)))
        changed = F.zip_with(every, scores, lambda d, s: F.when(
            on & F.array_contains(r["domains"], d),
            F.when(r["kind"] == "add", s + r["points"]).when(r["kind"] == "floor", F.greatest(s, r["points"])).when(r["kind"] == "lift", best + r["points"]).when(r["kind"] == "zero", F.lit(0)).otherwise(s),
        ).otherwise(s))
        return F.struct(changed.alias("scores"), (state["strict"] | (on & (r["kind"] == "strict"))).alias("strict"), (state["wide"] | (on & (r["kind"] == "wide"))).alias("wide"))

    start = F.struct(F.array(*[F.lit(0) for _ in names]).alias("scores"), F.lit(False).alias("strict"), F.lit(False).alias("wide"))
    out = said.withColumn("_s", F.aggregate("_told", start, applied))
    at = lambda name: F.col("_s.scores")[names.index(name)]
    best = F.array_max("_s.scores")
    taken = F.when(F.col("_s.wide"), F.lit(3)).otherwise(F.greatest(F.lit(2), best - 1))
    joined = F.array().cast("array<string>")
    for a, b in pairs:
        joined = F.concat(joined, F.when((at(a) > 0) & (at(b) > 0), F.array(F.lit(a), F.lit(b))).when((at(a) > 0) & (at(a) <= 3), F.array(F.lit(b))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_joined", joined).withColumn("_least", taken)
    chosen = F.filter(every, lambda d: (score(F.col("_s.scores"), d) >= F.col("_least")) | F.array_contains("_joined", d))
    return out.select(*queries.columns, F.map_from_arrays(every, F.col("_s.scores")).alias("scores"), F.when(best < 2, F.array(*map(F.lit, default))).otherwise(chosen).alias("domains"), F.col("_s.strict").alias("strict"))


def oracle_sql(rules: list[tuple], texts: str, default=L.DEFAULT_DOMAINS) -> str:
    """SQL that gives the same rows for `texts`, a query of (query_id, text); written rule by rule."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    norm = rf"trim(regexp_replace(translate(regexp_replace(nfc_normalize(coalesce(text, '')), '{T.INGEST_DIACRITICS}', '', 'g'), '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    any_ = lambda terms: "(" + " OR ".join(f"contains(q, {quote(t)})" for t in terms) + ")"
    steps, conditions = [], {}
    for step, kind, domains, terms, also, needs, points, unless in rules:
        on = any_(terms) + (f" AND {any_(also)}" if also else "")
        conditions[step] = on
        on = on + (f" AND NOT ({conditions[unless]})" if unless is not None else "") + (f" AND {needs} > 0" if needs else "")
        value = {"add": lambda d: f"{d} + {points}", "floor": lambda d: f"greatest({d}, {points})", "lift": lambda d: f"greatest({', '.join(domains)}) + {points}", "zero": lambda d: "0", "strict": lambda d: "true", "wide": lambda d: "true"}[kind]
        sets = [f"CASE WHEN {on} THEN {value(d)} ELSE {d} END AS {d}" for d in (domains or [kind])]
        # additions to one domain that look at no score are one expression
        if steps and kind == "add" and not needs and steps[-1][0] == (kind, tuple(domains)):
            steps[-1][1].append((on, points))
        elif kind == "add" and not needs:
            steps.append(((kind, tuple(domains)), [(on, points)]))
        else:
            steps.append(((kind, None), sets))
    out = f"WITH s0 AS (SELECT query_id, lower({norm}) AS q, {', '.join(f'0 AS {d}' for d in L.DOMAINS)}, false AS strict, false AS wide FROM ({texts}))"
    for n, ((kind, domains), parts) in enumerate(steps):
        sets = parts if domains is None else [f"{d} + " + " + ".join(f"CASE WHEN {on} THEN {p} ELSE 0 END" for on, p in parts) + f" AS {d}" for d in domains]
        out += f",\ns{n + 1} AS (SELECT * REPLACE ({', '.join(sets)}) FROM s{n})"
    top = f"greatest({', '.join(L.DOMAINS)})"
    pick = " || ".join(
        f"CASE WHEN {d} >= (CASE WHEN wide THEN 3 ELSE greatest(2, {top} - 1) END)" + (" OR (bible > 0 AND ta3lim > 0)" if d in ("bible", "ta3lim") else "") + (" OR (bible > 0 AND ta3lim = 0 AND bible <= 3)" if d == "ta3lim" else "") + f" THEN '{d} ' ELSE '' END"
        for d in L.DOMAINS
    )
    return out + f"\nSELECT query_id, trim(CASE WHEN {top} < 2 THEN '{' '.join(default)}' ELSE {pick} END) AS domains, {', '.join(f'{d}::BIGINT AS {d}' for d in L.DOMAINS)}, strict FROM s{len(steps)}"
