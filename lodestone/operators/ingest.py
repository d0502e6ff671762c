"""Corpus building: chunking, shard keys, manifests and their differences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOIN = "\n\n"


def pack(parts: list[str], most: int, joiner: str) -> list[str]:
    """Neighbours joined while they fit; an oversize part stands alone."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(joiner) + len(p) <= most:
            out[-1] += joiner + p
        else:
            out.append(p)
    return out


def split_text(text: str | None, most: int = 7000) -> list[str]:
    """Headings of level 1 to 5, then paragraphs, then sentences; only oversize parts are cut further."""
    cuts = [(rf"(?m)^(?=#{{{n}}}(?!#)\s)", JOIN) for n in range(1, 6)] + [(r"\n\s*\n", JOIN), (r"(?<=[.!؟])\s+", " ")]

    def level(part: str, k: int) -> list[str]:
        part = part.strip()
        if len(part) <= most or k == len(cuts):
            return [part] if part else []
        pieces = [p.strip() for p in re.split(cuts[k][0], part) if p.strip()]
        if len(pieces) <= 1:
            return level(part, k + 1)
        return pack([x for p in pieces for x in level(p, k + 1)], most, cuts[k][1])

    return level(text or "", 0)


def chunks(docs: DataFrame, most: int = 7000, least: int = 60) -> DataFrame:
    """(doc_id, chunk_id, chunk_no, text): parts under `least` characters go before parts are numbered."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [p for p in split_text(t, most) if len(p) >= least])

    rows = docs.select("doc_id", F.posexplode(split("text")).alias("chunk_no", "text"))
    return rows.select("doc_id", F.concat_ws(":", F.lit("doc"), "doc_id", "chunk_no").alias("chunk_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "text")


def shard_rows(chunks: DataFrame, own_shards: list[str]) -> DataFrame:
    """One row for each shard that a chunk belongs to: its library's alone if that is one of `own_shards`, else its domain's, and
    always the metadata shard."""
    own = F.when(F.col("library").isin(own_shards), F.array(F.concat(F.lit("lexical:facet:"), "library")))
    keys = F.concat(F.coalesce(own, F.array(F.concat(F.lit("lexical:domain:"), F.coalesce("domain", F.lit("default"))))), F.array(F.lit("lexical:metadata")))
    return chunks.select("chunk_id", "library", "domain", F.explode(keys).alias("shard_key"))


def manifest(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.select(F.col(key).alias("key"), F.sha2(F.col(value).cast("binary"), 256).alias("sha256"))


def delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """(key, change): added, changed, deleted or same."""
    b, n = before.select("key", F.col("sha256").alias("old")), now.select("key", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return b.join(n, "key", "full_outer").select("key", change.alias("change"))
