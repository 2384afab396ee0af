"""Resampling, tests and controls over per-sample results."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Multiplier and modulus of the hash of integer keys (Lehmer), which SQL can repeat.
LEHMER, PRIME = 48271, 2147483647


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from an integer key and a seed, the same on any partitioning."""
    h = F.pmod(key * 7919 + F.lit(seed) * 104729 + 12345, F.lit(PRIME))
    for _ in range(3):
        h = F.pmod(h * LEHMER + 1, F.lit(PRIME))
    return h / float(PRIME)


def poisson_limits() -> list[float]:
    """Cumulative probabilities of a Poisson(1) count below 8."""
    out, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        out.append(total)
        p /= k + 1
    return out


def bootstrap_cells(rows: DataFrame, cell: Sequence[str], value: str, key: Column, draws: int = 200, seed: int = 17) -> DataFrame:
    """Of each cell: n, the mean of ``value``, its 95 % interval by the Poisson bootstrap, and the values above and below 0.

    Each row weighs in with a Poisson(1) count for each draw; counts come from ``uniform`` of (key * 1000 + draw), so
    results don't depend on partitions, and rows of one key weigh the same in all cells. A task folds its rows into
    ``draws`` partial sums for each cell; only these are shuffled. Cells must be few: a task holds their sums.
    """
    limits = np.array(poisson_limits())
    names = list(cell)

    def partial(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            k = b["_k"].to_numpy(np.int64)[:, None] * 1000 + np.arange(1, draws + 1)
            h = (k * 7919 + seed * 104729 + 12345) % PRIME
            for _ in range(3):
                h = (h * LEHMER + 1) % PRIME
            count = np.searchsorted(limits, h / float(PRIME), side="left")
            weighed = count * b["_v"].to_numpy(np.float64)[:, None]
            groups = b.groupby(names, sort=False).indices if names else {(): np.arange(len(b))}
            for c, at in groups.items():
                own = sums.setdefault(c if isinstance(c, tuple) else (c,), np.zeros((2, draws)))
                own += (count[at].sum(axis=0), weighed[at].sum(axis=0))
        for c, (w, wv) in sums.items():
            yield pd.DataFrame({**dict(zip(names, c, strict=True)), "b": np.arange(1, draws + 1), "w": w, "wv": wv})

    named = rows.select(*names, key.cast("long").alias("_k"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), "b int, w double, wv double"])
    sums = named.mapInPandas(partial, schema).groupBy(*names, "b").agg(F.try_divide(F.sum("wv"), F.sum("w")).alias("m"))
    ends = sums.groupBy(*names).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    means = named.groupBy(*names).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.count_if(F.col("_v") > 0).alias("positive"), F.count_if(F.col("_v") < 0).alias("negative"))
    return means.join(ends, names) if names else means.join(F.broadcast(ends))


def bootstrap_mean(rows: DataFrame, value: str, key: Column, draws: int = 200, seed: int = 17) -> DataFrame:
    """Mean with a 95 % interval by the Poisson bootstrap. For paired results, give the differences."""
    out = bootstrap_cells(rows, [], value, key, draws, seed)
    return out.select("mean", "low", "high")


def _sign_p(pos: int, neg: int) -> float:
    """Twice the lower binomial tail at 1/2, at most 1. Terms fall off from the largest, so as many are added as still count: about the square root of the trials."""
    total, k = pos + neg, min(pos, neg)
    if not total:
        return 1.0
    first = math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) - total * math.log(2)
    tail, term = 1.0, 1.0
    for i in range(k, 0, -1):
        term *= i / (total - i + 1)
        tail += term
        if term < 1e-17 * tail:
            break
    return min(1.0, 2 * math.exp(first + math.log(tail)))


def with_sign_test(counted: DataFrame) -> DataFrame:
    """Add p, the two-sided exact sign test of the columns positive and negative; ties leave no trace."""

    def run(batches):
        for b in batches:
            yield b.assign(p=[_sign_p(int(x), int(y)) for x, y in zip(b["positive"], b["negative"], strict=True)])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema)
    return counted.mapInPandas(run, f"{kinds}, p double")


def sign_test(rows: DataFrame, delta: str) -> DataFrame:
    """Two-sided exact sign test of the deltas: (positive, negative, p)."""
    return with_sign_test(rows.agg(F.count_if(F.col(delta) > 0).alias("positive"), F.count_if(F.col(delta) < 0).alias("negative")))


def shuffled(rows: DataFrame, key: Sequence[str], columns: Sequence[str], seed: int) -> DataFrame:
    """Control: ``columns`` dealt anew within each sample, by places in a hash order."""
    h = lambda s: F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(s)), *(F.col(c).cast("string") for c in rows.columns)))
    a = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(h(0), *rows.columns)))
    b = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(h(1), *rows.columns))).select(*key, "_i", *(F.col(c).alias(f"_{c}") for c in columns))
    return a.join(b, [*key, "_i"]).select(*(F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def cell_key(bits: int = 10) -> Column:
    """An integer for each voxel of a sample."""
    return ((F.col("sid").cast("long") * (1 << bits) + F.col("x")) * (1 << bits) + F.col("y")) * (1 << bits) + F.col("z")


def noisy(rows: DataFrame, value: str, vocab: int, rate: float, seed: int) -> DataFrame:
    """Tokens replaced at ``rate`` by others drawn by hash."""
    other = F.floor(uniform(cell_key(), seed + 1) * vocab)
    return rows.withColumn(value, F.when(uniform(cell_key(), seed) < rate, other.cast(rows.schema[value].dataType)).otherwise(F.col(value)))


def thinned(rows: DataFrame, rate: float, seed: int) -> DataFrame:
    """Rows dropped at ``rate`` by hash."""
    return rows.where(uniform(cell_key(), seed) >= rate)


def permuted(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Axes exchanged: x, y, z get the values of the named columns."""
    return rows.select(*(F.col(dict(zip("xyz", order, strict=True)).get(c, c)).alias(c) for c in rows.columns))


def translated(rows: DataFrame, shift: tuple[int, int, int]) -> DataFrame:
    return rows.withColumns({c: F.col(c) + s for c, s in zip(("x", "y", "z"), shift, strict=True)})


def fold_of(key: Column, folds: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)).cast("int")


def forms(rows: DataFrame, value: str, vocab: int, noise: float = 0.05, drop: float = 0.05, seed: int = 3, shift: tuple[int, int, int] = (3, 1, 2), order: str = "zxy") -> DataFrame:
    """Each voxel (sid, x, y, z, value) once for each transform that keeps it, with the column ``form``: as it is, with token noise, thinned, moved, with exchanged axes, and in split halves by x. One pass over the rows."""
    kind = rows.schema[value].dataType
    noisy_value = F.when(uniform(cell_key(), seed) < noise, F.floor(uniform(cell_key(), seed + 1) * vocab).cast(kind)).otherwise(F.col(value))

    def form(name: str, xyz=("x", "y", "z"), v=None, kept=None) -> Column:
        s = F.struct(F.lit(name).alias("form"), *(F.col(c).alias(n) if isinstance(c, str) else c.cast("int").alias(n) for n, c in zip("xyz", xyz, strict=True)), (F.col(value) if v is None else v).alias(value))
        return s if kept is None else F.when(kept, s)

    every = F.array(
        form("none"), form("noise", v=noisy_value), form("drop", kept=uniform(cell_key(), seed) >= drop), form("translate", [F.col(c) + s for c, s in zip("xyz", shift, strict=True)]),
        form("permute", order), form("first_half", kept=F.col("x") % 2 == 0), form("second_half", kept=F.col("x") % 2 == 1),
    )
    return rows.select("sid", F.explode(F.filter(every, lambda s: s.isNotNull())).alias("f")).select("sid", "f.*")
