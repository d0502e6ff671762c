"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Null and empty texts have no words, so they fail the base rule. Lines and words of any length are handled whole.
Every row is judged alone: repeated rows get equal results, an empty table an empty result, other columns pass through
`with_quality` untouched (the columns it adds replace columns of the same names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, let

# Common function words of the four corpus languages.
STOP_WORDS = sorted(
    set(
        "the of and to in a is that for it was on are with this be or by at as an from "
        "le la les de des du et un une que en dans pour est au avec sur pas par "
        "der die das und in den von zu mit sich ist des im dem nicht ein eine als auch auf für "
        "el la los las de que y en un una por con para no se del al es lo como su".split()
    )
)

#: (rule, numerator, denominator, least, most); a ratio with denominator 0 counts as 0.
THRESHOLDS = [
    ("mean_word_length", "word_chars", "n_words", 1.5, 25.0),
    ("symbol_ratio", "n_symbols", "n_words", 0.0, 0.25),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.01, 1.0),
    ("dup_line_ratio", "n_dup_lines", "n_lines", 0.0, 0.4),
]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BLANKS = " \t\n\u000b\f\r"


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that are found twice or more; windows compare by a 64-bit hash of their words."""
    window = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True))
            starts = F.array_sort(F.transform(at, lambda k: F.get(s, k)["i"]))
            return let(starts, lambda d: F.aggregate(F.sequence(F.lit(1), F.size(d)), F.lit(0), lambda acc, k: acc + F.coalesce(F.least(F.lit(3), F.get(d, k) - F.get(d, k - 1)), F.lit(3))))

        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered, of_sorted))

    return F.when(n < 3, 0).otherwise(let(window(words), covered))


def measures(text: Column) -> Column:
    """One struct of all counts that the rules use."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(w, n).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)


def with_quality(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """docs with the counts, base_failed, kept and first failed rule (`failed_rule`, null if none)."""
    m = F.col("_quality")
    counts = {c: m[c] for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words")} | {"n_lines": m["lines"]["n"], "n_dup_lines": m["lines"]["dup"]}
    out = docs.withColumn("_quality", measures(F.col("text"))).withColumns(counts).drop("_quality")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.when(base, "base")
    for name, over, under, least, most in thresholds:
        ratio = F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(0.0)
        failed = failed.when(~ratio.between(least, most), name)
    return out.withColumns({"base_failed": base, "failed_rule": failed}).withColumn("kept", F.col("failed_rule").isNull())


def query(docs: DataFrame) -> DataFrame:
    return with_quality(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rules = " AND ".join(f"(CASE WHEN {u} > 0 THEN {o}::DOUBLE / {u} ELSE 0 END) BETWEEN {a} AND {b}" for _, o, u, a, b in THRESHOLDS)
    blank = r"'[\x20\x09-\x0D]'"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, {blank}, '', 'g')) > 0) AS ls FROM d),
g AS (SELECT rid, i, concat_ws(chr(10), ws[i], ws[i + 1], ws[i + 2]) AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, {blank}, '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
  coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN p USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND {rules} AS kept
FROM m"""
