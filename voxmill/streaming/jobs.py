"""Structured Streaming jobs: event windows, sessions, log metrics, distinct codes seen so far."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.readers import parse_log
from ..sources.writers import shared_folder


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its result table.

    ``append`` writes a Parquet sink: windows behind the watermark are written once and leave the state.
    ``complete`` replaces the table after each batch, so the last one stands; only for keys of a bounded number.
    """
    spark = stream.sparkSession
    home = shared_folder(spark, label)
    out = f"{home}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def closed(events: DataFrame, spark: SparkSession, label: str, far: str = "2100-01-01 00:00:00") -> DataFrame:
    """The stream and, after it, one row of null fields at ``far``: the end of a finished input. It moves the watermark past all windows, so that append mode writes every one of them; the row itself stays in the state."""
    home = shared_folder(spark, f"{label}-end")
    end = spark.range(1).select(*(F.lit(far).cast("timestamp").alias(f.name) if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))
    end.write.parquet(home)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(home))


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 16) -> DataFrame:
    """The events table as a file stream, with event time ``at``."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are dropped."""
    window = F.window("at", width, slide) if slide else F.window("at", width)
    g = events.withWatermark("at", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    g = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def log_metrics(lines: DataFrame) -> DataFrame:
    """Running metrics by step of a stream of training-log lines."""
    return parse_log(lines).groupBy("step").agg(F.count("*").alias("n"), F.max("oor_ratio").alias("high"), F.avg("oor_ratio").alias("mean"))


def distinct_so_far(rows: DataFrame, key: str, code: str) -> DataFrame:
    """(key, batch's new codes, distinct so far) whenever a key gets rows: the set of codes is the state (bounded by the codebook)."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        before = len(seen)
        for b in batches:
            seen.update(int(v) for v in b[code].dropna().unique())
        state.update((sorted(seen),))
        yield pd.DataFrame({key: [k[0]], "new_codes": [len(seen) - before], "distinct_codes": [len(seen)]})

    out = f"{key} {rows.schema[key].dataType.simpleString()}, new_codes bigint, distinct_codes bigint"
    return rows.select(key, code).groupBy(key).applyInPandasWithState(update, out, "codes array<bigint>", "append", GroupStateTimeout.NoTimeout)


Job = Callable[[SparkSession, str], DataFrame]
