"""Finding data sets in listings: nearest catalogs, paths from identifiers, marked folders, CT cases, registered catalogs.

A listing is a table of paths (of ``readers.list_files`` or any other source), so that discovery is joins and
groupings over rows, however many files there are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column, levels: int) -> Column:
    """The folder itself and up to ``levels`` folders above it, nearest first."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.least(F.lit(levels), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"))


def nearest_catalog(paths: DataFrame, catalogs: DataFrame, levels: int = 12, path: str = "path") -> DataFrame:
    """``paths`` with the nearest catalog (path) in their folder or up to ``levels`` above it, and how far up it is; null if there is none."""
    of = catalogs.select(folder_of(F.col("path")).alias("_folder"), F.col("path").alias("catalog")).groupBy("_folder").agg(F.min("catalog").alias("catalog"))
    up = paths.select(path).distinct().select(path, F.posexplode(ancestors(folder_of(F.col(path)), levels)).alias("levels_up", "_folder"))
    near = up.join(of, "_folder").groupBy(path).agg(F.min(F.struct("levels_up", "catalog")).alias("n")).select(path, "n.levels_up", "n.catalog")
    return paths.join(near, path, "left")


def paths_of(rows: DataFrame, identifier: str, listing: DataFrame, prefix: str = "objects/") -> DataFrame:
    """``rows`` with the path that their identifier names (a leading ``prefix`` goes) and whether the listing has it."""
    there = listing.select(F.col("path").alias("local_path")).distinct().withColumn("exists", F.lit(True))
    named = rows.withColumn("local_path", F.regexp_replace(identifier, f"^{prefix}", ""))
    return named.join(there, "local_path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def folders_with(listing: DataFrame, name: str) -> DataFrame:
    """Folders that directly hold a file of that name, with their number of files."""
    got = listing.groupBy(folder_of(F.col("path")).alias("folder")).agg(F.count("*").alias("files"), F.bool_or(F.regexp_replace("path", "^.*/", "") == name).alias("hit"))
    return got.where("hit").select("folder", "files")


def datasets(listing: DataFrame, markers: Mapping[str, str], depth: int = 5) -> DataFrame:
    """(folder, kind): folders not deeper than ``depth`` that hold a marker file (name -> kind, by the order of the mapping); none below another one is searched."""
    name = F.regexp_replace("path", "^.*/", "")
    kind = F.coalesce(*(F.when(name == m, F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"))) for i, (m, k) in enumerate(markers.items())))
    found = listing.select(folder_of(F.col("path")).alias("folder"), kind.alias("k")).where("k is not null").groupBy("folder").agg(F.min("k").alias("k"))
    found = found.where(F.size(F.split("folder", "/")) <= depth).select("folder", "k.kind")
    above = found.select("folder", F.explode(F.slice(ancestors(F.col("folder"), depth), 2, depth)).alias("up"))
    inside = above.join(found.select(F.col("folder").alias("up")), "up", "left_semi").select("folder").distinct()
    return found.join(inside, "folder", "left_anti")


def preferred_instances(instances: DataFrame, order: Sequence[str] = ("mask", "window"), case: str = "case_id", label: str = "label") -> DataFrame:
    """One instance for each label of a case; cases that have any of the first mode use only that one."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("mode"))
    ranked = instances.where(rank > 0).withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(Window.partitionBy(case)))
    once = Window.partitionBy(case, label).orderBy("path")
    return ranked.where("_rank = _best").withColumn("_i", F.row_number().over(once)).where("_i = 1").drop("_rank", "_best", "_i")


def shape_of_name(path: Column) -> Column:
    """The numbers of the last bracketed group in a file name, such as mask_(1, 512, 512, 90).npz."""
    inner = F.regexp_extract(path, r"\(([\d,\s]+)\)[^()]*$", 1)
    return F.when(inner != "", F.transform(F.filter(F.split(inner, r"\s*,\s*"), lambda t: F.trim(t) != ""), lambda t: F.trim(t).cast("int")))


def read_registered(spark: SparkSession, registry: Mapping[str, str], *names: str) -> DataFrame:
    """The catalogs (CSV or Parquet, on any store Spark reads) registered under ``names`` (all, if none is given), with the column ``dataset``."""
    out = None
    for name in names or registry:
        if name not in registry:
            raise KeyError(f"no catalog is registered as {name}; known: {', '.join(sorted(registry))}")
        uri = registry[name]
        rows = spark.read.option("header", True).option("inferSchema", True).csv(uri) if uri.endswith(".csv") else spark.read.parquet(uri)
        rows = rows.withColumn("dataset", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


Step = Callable[[DataFrame], DataFrame]


class Dataset:
    """Plug-in points of a data set: filters of its catalog, what makes an instance of a row, how instances form batches."""

    def __init__(self, filters: Sequence[Step] = (), instance: Step | None = None, collate: Step | None = None):
        self.filters, self.instance, self.collate = list(filters), instance, collate

    def rows(self, catalog: DataFrame) -> DataFrame:
        for step in (*self.filters, self.instance, self.collate):
            catalog = step(catalog) if step is not None else catalog
        return catalog


def quarantined(rows: DataFrame, tests: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their errors): a bad row is set aside with all it fails, where a loader would draw another at random."""
    errors = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items())), lambda e: e.isNotNull())
    marked = rows.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)
