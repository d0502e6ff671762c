"""Requests, contexts and answers: parsing, evidence checks, response rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANSWER = "status string, answer string, confidence string, cited_chunk_ids array<string>"
REQUEST = "message string, session_id string, retrieval_query string, cited_chunk_ids array<string>"
# Marks that trail an answer without being part of it, and ends that leave it open.
MARKS, TRAILING = r"[*_`#>]+\z", r"([,;:،؛…-]|\.\.\.)\z"


def text_within(x: Column, most: int) -> Column:
    """The trimmed text, null when blank or longer than allowed (never cut)."""
    return F.when(F.length(F.trim(x)).between(1, most), F.trim(x))


def parse_requests(rows: DataFrame, column: str = "body") -> DataFrame:
    m = F.from_json(column, REQUEST)
    cited = F.slice(F.array_distinct(F.filter(F.coalesce(m["cited_chunk_ids"], F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) > 0)), 1, 4)
    return rows.withColumns({"message": text_within(m["message"], 800), "session_id": text_within(m["session_id"], 120), "retrieval_query": text_within(m["retrieval_query"], 1600), "cited": cited})


def parse_answers(rows: DataFrame, column: str = "raw") -> DataFrame:
    """Model output without its code fence, as columns; status and confidence default to ANSWERED and medium."""
    bare = F.regexp_replace(F.trim(column), r"(?is)^```(?:json)?\s*|\s*```$", "")
    m = F.from_json(bare, ANSWER)
    status = F.when(m["status"].isin("ANSWERED", "NOT_FOUND_IN_BATCH"), m["status"]).otherwise("ANSWERED")
    confidence = F.when(m["confidence"].isin("low", "medium", "high"), m["confidence"]).otherwise("medium")
    return rows.withColumns({"status": status, "answer": F.nullif(F.trim(m["answer"]), F.lit("")), "confidence": confidence, "cited": F.coalesce(m["cited_chunk_ids"], F.array().cast("array<string>"))})


def incomplete(answer: Column, stop: list[str]) -> Column:
    """Blank once trailing marks are off, or ends in a comma, colon, hyphen or ellipsis, or its last word, whatever its case and
    what follows it, is one that no sentence ends with. Null is incomplete."""
    x = F.trim(F.regexp_replace(F.trim(F.regexp_replace(answer, r"(?U)\s+", " ")), MARKS, ""))
    last = F.lower(F.try_element_at(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), F.lit(-1)))
    return F.coalesce((x == "") | x.rlike(TRAILING) | F.coalesce(last.isin(list(stop) or [""]), F.lit(False)), F.lit(True))


def validate(answers: DataFrame, retrieved: str = "retrieved", aliases: str | None = None, stop: list[str] = ()) -> DataFrame:
    """Citations kept in order when retrieved; valid with an answer, a citation and a complete sentence."""
    cited = F.col("cited") if aliases is None else F.transform("cited", lambda c: F.coalesce(F.try_element_at(F.col(aliases), c), c))
    kept = F.array_intersect(cited, F.col(retrieved))
    return answers.withColumn("citations", kept).withColumn("valid", F.col("answer").isNotNull() & (F.size("citations") > 0) & ~incomplete(F.col("answer"), list(stop)))


def unique_by(rows: DataFrame, key: str, by: str, *order: str) -> DataFrame:
    """The first row of each (by, key) in the given order."""
    w = Window.partitionBy(by, key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merge_evidence(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Follow-up evidence first, then retrieved chunks, each chunk once; both (query_id, chunk_id, pos)."""
    rows = cited.withColumn("src", F.lit(0)).unionByName(retrieved.withColumn("src", F.lit(1)))
    first = unique_by(rows, "chunk_id", "query_id", "src", "pos")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("src", "pos")).cast("long"))


def batches(ranked: DataFrame, sizes: tuple[int, ...] = (1, 2, 2)) -> DataFrame:
    """The context batch of each rank; ranks beyond the last batch have none."""
    batch, end = F.lit(None).cast("int"), 0
    case = None
    for n, s in enumerate(sizes):
        end += s
        case = F.when(F.col("rank") <= end, n) if case is None else case.when(F.col("rank") <= end, n)
    return ranked.withColumn("batch", case if case is not None else batch)


def unless_url_seen(citations: DataFrame) -> DataFrame:
    return unique_by(citations, "url", "query_id", "rank")


def preview(answer: Column, most: int = 1200) -> tuple[Column, Column]:
    return F.substring(F.trim(answer), 1, most), F.length(F.trim(answer)) > most


def fallback_message(reason: Column, mode: Column) -> Column:
    quota = F.when(mode == "sources", "The answer limit is reached; here are the sources.").otherwise("The answer limit is reached.")
    return F.when(reason.endswith("quota"), quota).when(reason == "retrieval_error", "Search failed.").otherwise("No answer could be given.")
