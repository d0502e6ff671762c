"""Readers and writers of the corpus's file formats."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(name, extension, body) of whole text files, without byte-order marks."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    file = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.regexp_replace(file, r"\.[^.]+$", "").alias("name"), F.regexp_extract(file, r"\.([^.]+)$", 1).alias("extension"), F.regexp_replace("value", "^﻿", "").alias("body"))


def read_lookup(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """Rows of one JSON object {key: value}."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value_schema}>").alias("m"))
    return rows.select(F.explode("m").alias("key", "value"))


def merge_last(*frames: DataFrame, key: str) -> DataFrame:
    """Union in which the last frame that has a key wins."""
    rows = None
    for n, f in enumerate(frames):
        part = f.withColumn("_n", F.lit(n))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    cols = [c for c in rows.columns if c != "_n"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "_n").alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet into the folder that driver and executors share (spark.checkpoint.dir) and read again: cuts the
    lineage and survives lost executors. Where the setting is unset, a session on one machine gets a temporary folder; a
    cluster's session raises."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
