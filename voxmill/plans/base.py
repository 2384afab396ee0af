"""Table access, the shared voxel and word relations, and the registry of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import space

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of lineitem that one task of ``voxels`` takes (about 16 samples).
TASK_ROWS = 1 << 18


def tasks_for(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the voxels: they grow with lineitem (its rows come from the file footers), so that no task's share does."""
    return max(spark.sparkContext.defaultParallelism, table(spark, sf_dir, "lineitem").count() // TASK_ROWS + 1)


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, x, y, z, tok) on 32^3 grids, made from lineitem: a sample for each 4096 order keys, so that samples grow in number and not in size.

    Rows are dealt by sample once, so that grouping and windows by sample need no further shuffle.
    """
    cell = lambda c: (F.col(c) % 32).cast("int")
    li = table(spark, sf_dir, "lineitem").select((F.floor(F.col("l_orderkey") / 4096) + 1).cast("int").alias("sid"), cell("l_orderkey").alias("x"), cell("l_partkey").alias("y"), cell("l_suppkey").alias("z"), "l_quantity")
    return li.repartition(tasks_for(spark, sf_dir), "sid").groupBy("sid", "x", "y", "z").agg((F.min("l_quantity").cast("int") % 16).alias("tok"))


V = """v as (select cast(l_orderkey // 4096 + 1 as int) as sid, cast(l_orderkey % 32 as int) as x, cast(l_partkey % 32 as int) as y, cast(l_suppkey % 32 as int) as z,
  cast(min(l_quantity) as int) % 16 as tok from lineitem group by 1, 2, 3, 4)"""

#: Z-order key of (x, y, z) in SQL.
MORTON = "(" + " | ".join(f"((({c}::bigint >> {i}) & 1) << {3 * i + k})" for i in range(5) for k, c in enumerate("xyz")) + ")"

#: Voxels with their place in Z-order.
VM = V + f""", m as (select *, {MORTON} as code from v), s as (select *, row_number() over (partition by sid order by code) - 1 as rk from m)"""


def in_z_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with their Z-order code."""
    return voxels(spark, sf_dir).withColumn("code", space.morton())


def z_window() -> Window:
    return Window.partitionBy("sid").orderBy("code")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, w): lower-case words of every document."""
    docs = table(spark, sf_dir, "documents")
    cut = F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda t: t != "")
    return docs.select("doc_id", F.posexplode(cut).alias("pos", "w"))


W = r"""w as (select doc_id, pos - 1 as pos, w from (select doc_id, unnest(l) as w, generate_subscripts(l, 1) as pos
  from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda t: t <> '') as l from documents)))"""
