"""Ordered operators: moving averages, trends, fits, cube tests, gaps, sampling along geometry."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
#: Decimal digits of the largest weight in a block of ``trend``; values of a hundred digits still fit a double beside it.
LARGEST_WEIGHT = 200


def moving_average(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, width: int, name: str = "ma") -> DataFrame:
    """Trailing mean over ``width`` rows; the first rows all have the mean of the first ``width``."""
    base = Window.partitionBy(*key).orderBy(*order)
    trailing, start = F.avg(value).over(base.rowsBetween(-width + 1, 0)), F.avg(F.when(F.col("_i") <= width, F.col(value))).over(Window.partitionBy(*key))
    numbered = rows.withColumn("_i", F.row_number().over(base))
    return numbered.withColumn(name, F.when(F.col("_i") < width, start).otherwise(trailing)).drop("_i")


def rolling_percentile(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, width: int, q: float, name: str = "pct") -> DataFrame:
    """Percentile of the last ``width`` rows, once that many are there."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-width + 1, 0)
    return rows.withColumn(name, F.when(F.count(value).over(w) >= width, F.percentile(value, F.lit(q)).over(w)))


def trend(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, alpha: float, name: str = "trend", block: int = 64) -> DataFrame:
    """Exponential trend s = alpha s + (1 - alpha) v of each key's rows in order, from the first value.

    Rows are cut into blocks. Inside a block the trend is a weighted running sum; what a block inherits is the
    weighted sum of the ends of those before, of which only as many count as still reach double precision. Weights in a
    block go up to alpha to the power 1 - block, so a small alpha has shorter blocks. ``alpha`` is at least 0 and below 1.
    """
    if not 0 <= alpha < 1:
        raise ValueError("alpha must be at least 0 and below 1")
    block = max(1, min(block, int(LARGEST_WEIGHT / -math.log10(alpha)))) if alpha else 1
    w = Window.partitionBy(*key).orderBy(*order)
    out = rows.withColumn("_i", F.row_number().over(w) - 1)
    out = out.withColumns({"_k": F.floor(F.col("_i") / block), "_j": F.col("_i") % block})
    weighed = F.col(value) * F.when(F.col("_i") == 0, 1.0).otherwise(1 - alpha) * F.pow(F.lit(alpha), -F.col("_j"))
    inside = F.sum(weighed).over(Window.partitionBy(*key, "_k").orderBy("_j")) * F.pow(F.lit(alpha), F.col("_j"))
    out = out.withColumn("_in", inside)
    step = alpha**block
    reach = 1 if step < 1e-18 else max(1, math.ceil(math.log(1e-18) / math.log(step)))
    ends = out.where(F.col("_j") == block - 1).select(*key, "_k", F.col("_in").alias("_end"))
    before = F.collect_list("_end").over(Window.partitionBy(*key).orderBy("_k").rowsBetween(-reach + 1, 0))
    carried = ends.select(*key, (F.col("_k") + 1).alias("_k"), F.aggregate(before, F.lit(0.0), lambda s, e: s * step + e).alias("_from"))
    met = out.join(carried, [*key, "_k"], "left")
    return met.withColumn(name, F.col("_in") + F.coalesce("_from", F.lit(0.0)) * F.pow(F.lit(alpha), F.col("_j") + 1)).drop("_i", "_k", "_j", "_in", "_from")


def pair_geometry(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Consecutive voxels: share face-adjacent, share 26-adjacent, mean and median distance."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = rows.select(*key, *((F.lead(c).over(w) - F.col(c)).alias(f"d{c}") for c in XYZ)).where("dx is not null")
    l1 = F.abs("dx") + F.abs("dy") + F.abs("dz")
    top = F.greatest(F.abs("dx"), F.abs("dy"), F.abs("dz"))
    dist = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).cast("double"))
    return d.groupBy(*key).agg(F.avg((l1 == 1).cast("double")).alias("face"), F.avg(((top <= 1) & (l1 > 0)).cast("double")).alias("near"), F.avg(dist).alias("dist_mean"), F.percentile(dist, F.lit(0.5)).alias("dist_median"))


def _cube(span: Sequence[Column], distinct: Column) -> Column:
    return (distinct == 8) & (span[0] == 1) & (span[1] == 1) & (span[2] == 1)


def cubes_in_groups(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of consecutive groups of eight voxels (a ragged tail is left out): how many are exact 2 x 2 x 2 cubes.

    Where each axis spans two planes, voxels differ just if the parities of their coordinates do, so that a byte of
    corners met counts the distinct ones and no rows are kept for it.
    """
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    parity = [F.pmod(F.col(c), F.lit(2)).cast("int") for c in XYZ]
    corner = F.call_function("shiftleft", F.lit(1), 4 * parity[0] + 2 * parity[1] + parity[2])
    g = rows.withColumn("g", F.floor(place / 8)).groupBy(*key, "g").agg(F.count("*").alias("n"), F.bit_count(F.bit_or(corner)).alias("distinct"), *((F.max(c) - F.min(c)).alias(f"s{c}") for c in XYZ)).where("n = 8")
    return g.groupBy(*key).agg(F.count("*").alias("groups"), F.count_if(_cube([F.col(f"s{c}") for c in XYZ], F.col("distinct"))).alias("cubes"))


def cubes_sliding(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The same test for every window of eight."""
    base = Window.partitionBy(*key).orderBy(*order)
    w = base.rowsBetween(0, 7)
    d = rows.select(*key, F.count("*").over(w).alias("n"), F.size(F.array_distinct(F.collect_list(F.struct(*XYZ)).over(w))).alias("distinct"), *((F.max(c).over(w) - F.min(c).over(w)).alias(f"s{c}") for c in XYZ)).where("n = 8")
    return d.groupBy(*key).agg(F.count("*").alias("windows"), F.count_if(_cube([F.col(f"s{c}") for c in XYZ], F.col("distinct"))).alias("cubes"))


def farthest_points(rows: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """n voxels of each sample by farthest-point sampling from its first (in x, y, z order); ties to the first.

    A sample's grid bounds its rows, so a group fits a task.
    """

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(list(XYZ)).reset_index(drop=True)
        p = g[list(XYZ)].to_numpy(np.int64)
        chosen, dist = [0], ((p - p[0]) ** 2).sum(axis=1)
        while len(chosen) < min(n, len(p)):
            k = int(dist.argmax())
            chosen.append(k)
            dist = np.minimum(dist, ((p - p[k]) ** 2).sum(axis=1))
        out = g.iloc[chosen].copy()
        out["nth"] = np.arange(len(chosen), dtype=np.int64)
        return out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(*key).applyInPandas(pick, f"{fields}, nth bigint")


def balanced_groups(loads: list[tuple[int, float]], groups: int) -> list[tuple[int, int]]:
    """Longest-processing-time grouping of (id, load): by falling load into the lightest group (ties: first). A driver-side plan for a bounded list of shards."""
    total, out = [0.0] * groups, []
    for i, load in sorted(loads, key=lambda t: (-t[1], t[0])):
        g = min(range(groups), key=lambda k: (total[k], k))
        total[g] += load
        out.append((i, g))
    return out


def linear_fit(rows: DataFrame, key: Sequence[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def reduce_leaves(rows: DataFrame, key: Sequence[str], special: dict | None = None) -> DataFrame:
    """(key, path, value) of flattened records (path, v): the mean of each leaf, or the aggregate that ``special`` names for the last part of its path."""
    name = F.element_at(F.split("path", r"\."), -1)
    value = None
    for leaf, f in (special or {}).items():
        value = F.when(F.max(name) == leaf, f("v")) if value is None else value.when(F.max(name) == leaf, f("v"))
    value = F.avg("v") if value is None else value.otherwise(F.avg("v"))
    return rows.groupBy(*key, "path").agg(value.alias("value"))
