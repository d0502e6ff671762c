"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and works on all rows its predecessor kept.

quality and toxicity drop the documents that they reject, dedup keeps one row of each group of linked ones (the smallest id's), mixing
drops documents outside the mix and repeats rows that it takes more than once, tokens returns ids' digests.
Null texts fail the quality rules. Dedup goes by text: an id with several texts keeps them, rows without an id link too,
null and blank texts stand alone. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, mixing, quality_rules, sentencepiece_codec, toxicity
from lodestone.llm.common import WORD, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = quality_rules.with_quality(docs.select(F.struct(*docs.columns).alias("_row"), "text")).filter("kept")
    return kept.select("_row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return toxicity.scored(rows, model).filter("predicted = 0").select("_row.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(jaccard_join.classes(docs.select("doc_id", "text")).filter("label is not null"))
    keep = found.groupBy("label").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "mark")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.mark").alias("_mark"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_mark"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("_set"))
    kept = rows.filter("_set").alias("r").join(keep.alias("k"), F.col("r._id").eqNullSafe(F.col("k._id")) & (F.col("r._mark") == F.col("k._mark")), "left_semi").dropDuplicates(["_id", "_mark"])
    return kept.union(rows.filter("not _set")).select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("_row"), "text", "source")
    sized = mixing.sized(rows, "doc_id", "_row")
    taken = mixing.mixed(sized).filter("taken > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), CACHE_BYTES)


CACHE_BYTES = 40_000_000  # of the tokens' part caches: the stages share their workers, which keep what they once took
STAGES = [("quality", quality), ("toxicity", toxic), ("dedup", dedup), ("mixing", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
