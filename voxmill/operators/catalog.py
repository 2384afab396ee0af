"""Catalog upkeep: update merges, funnels, pending work, unions of partial results, sampling, shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import shared_folder


def update_merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Only known columns of known keys change, and only where the right side isn't null. The right side's rows must be unique by key."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    new = right.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in shared))
    return left.join(new, key, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in shared else F.col(c) for c in left.columns))


def funnel(rows: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each filter in turn, counted in one pass."""
    total, so_far = [F.count("*").alias("s0")], None
    for i, (_, test) in enumerate(steps):
        so_far = test if so_far is None else so_far & test
        total.append(F.count_if(so_far).alias(f"s{i + 1}"))
    wide = rows.agg(*total)
    names = ["all", *(n for n, _ in steps)]
    return wide.select(F.posexplode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"s{i}").alias("rows")) for i, n in enumerate(names)))).alias("step", "s")).select("step", "s.name", "s.rows")


def split_existing(work: DataFrame, present: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(already there, still to do)."""
    return work.join(present, key, "left_semi"), work.join(present, key, "left_anti")


def first_of(rows: DataFrame, key: Sequence[str] | Column, order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """The first row of each key: a minimum of structs, so partial results combine before the shuffle."""
    keys = [key] if isinstance(key, Column) else [F.col(k) for k in key]
    ordered = F.struct(*(o if isinstance(o, Column) else F.col(o) for o in order))
    best = F.min_by(F.struct(*columns), ordered).alias("b")
    return rows.groupBy(*keys).agg(best)


def union_ragged(*parts: DataFrame) -> DataFrame:
    """Union by name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def resolve(frame: DataFrame, *names: str) -> Column:
    """First non-null of the columns that exist."""
    there = [F.col(n) for n in names if n in frame.columns]
    return F.coalesce(*there) if there else F.lit(None)


def require(frame: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return frame


def hash_order(*key: str) -> Column:
    """A fixed pseudo-random order of rows that no partitioning changes."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key)))


def sample_rows(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """n rows least by hash (a bounded top-n: nothing is sorted whole)."""
    return rows.orderBy(hash_order(*key), *key).limit(n)


def sample_within(rows: DataFrame, group: Sequence[str], n: int, *key: str) -> DataFrame:
    """At most n rows of each group, least by hash."""
    w = Window.partitionBy(*group).orderBy(hash_order(*key), *key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def numbered(rows: DataFrame, bucket: Column, *order: str | Column, name: str = "row") -> DataFrame:
    """Global row numbers (from 0) without a global window: ``bucket`` must rise with the order.

    Counts of buckets in front are added to places inside. The buckets themselves are range-partitioned and
    written, so that their running counts are taken a partition at a time, with the partitions' own sums in front.
    """
    placed = rows.withColumn("_b", bucket)
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_n")).repartitionByRange("_b")
    sizes = _written(sizes.withColumn("_p", F.spark_partition_id()))
    parts = sizes.groupBy("_p").agg(F.sum("_n").alias("_s"))  # one row a partition
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_p", before("_s", Window.orderBy("_p")).alias("_far"))
    near = before("_n", Window.partitionBy("_p").orderBy("_b"))
    starts = sizes.withColumn("_near", near).join(F.broadcast(parts), "_p").select("_b", (F.col("_far") + F.col("_near")).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return placed.withColumn("_i", inside).join(starts, "_b").withColumn(name, (F.col("_ahead") + F.col("_i")).cast("long")).drop("_b", "_i", "_ahead")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, repeats counted, with the ``side`` that has them; none: the tables are equal as bags."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def _written(rows: DataFrame) -> DataFrame:
    path = shared_folder(rows.sparkSession, "buckets")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, ranks: int, mode: str, place: str = "place") -> DataFrame:
    """Numbered rows in equal shares for ``ranks``: the first rows again behind the last (``pad``), or without the ragged end (``drop``)."""
    total = F.broadcast(rows.agg(F.count("*").alias("_n")))
    met = rows.join(total)
    if mode == "drop":
        return met.where(F.col(place) < F.col("_n") - F.col("_n") % ranks).drop("_n")
    again = met.where(F.col(place) < (ranks - F.col("_n") % ranks) % ranks).withColumn(place, F.col(place) + F.col("_n"))
    return met.unionByName(again).drop("_n")


def shard_of(row: Column, total: Column, shards: int) -> Column:
    """Contiguous shards by ceiling division."""
    return F.floor(row / F.ceil(total / shards)).cast("int")


def balanced_shard_of(row: Column, total: Column, shards: int) -> Column:
    """Contiguous shards that differ by a row at most: shard r holds rows floor(n r / k) to floor(n (r + 1) / k) - 1."""
    return (F.floor(((row + 1) * shards - 1) / total)).cast("int")
