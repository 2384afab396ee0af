"""Sinks: CSV with list columns as JSON, JSON lines in order, rule documents, keyed corpus shards."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new name in the folder of ``spark.checkpoint.dir``. Only in local mode, where there are no other machines, a temporary one serves if none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="voxmill-")
    return f"{base}/voxmill-{label}-{uuid.uuid4().hex}"


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; arrays, maps and structs become JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, ArrayType | MapType | StructType) else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.mode(mode).option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str, *order: str, mode: str = "errorifexists") -> None:
    """JSON lines, range-sorted if an order is given: part files in name order are the whole in order."""
    (rows.orderBy(*order) if order else rows).write.mode(mode).json(path)


def write_document(spark: SparkSession, doc: dict, path: str) -> None:
    """One JSON document (bounded: a rule table), through Spark so that any store works."""
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_corpus(rows: DataFrame, path: str, shards: int) -> None:
    """Leaf corpus as Parquet by shard of the sample's hash; rows keep explicit keys, so no offsets are needed.

    Each task of ``rows`` adds its own files to the shards: a shard as a whole never lies in one task.
    """
    rows.withColumn("shard", F.pmod(F.xxhash64("sid"), F.lit(shards)).cast("int")).write.partitionBy("shard").mode("overwrite").parquet(path)


def shards_before_gap(numbers: DataFrame, column: str = "shard") -> DataFrame:
    """Shards 0, 1, ... up to the first that is missing: the smallest number without a successor bounds them."""
    n = numbers.select(F.col(column).alias("n")).distinct()
    nxt = n.select((F.col("n") - 1).alias("n")).withColumn("more", F.lit(True))
    last = n.join(nxt, "n", "left").where("more is null").agg(F.min("n").alias("last"))
    has_first = n.agg(F.bool_or(F.col("n") == 0).alias("ok"))
    return n.join(F.broadcast(last)).join(F.broadcast(has_first)).where("ok and n <= last").select("n")
