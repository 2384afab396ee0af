"""Operators over voxel tables (sample key columns, x, y, z, ...)."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import space

KEY = ("sid",)
XYZ = ("x", "y", "z")


def shifted(voxels: DataFrame, rows: Sequence[tuple[int, int, int]]) -> DataFrame:
    """A row for each voxel and offset, with dx, dy, dz and the neighbour's coordinates nx, ny, nz."""
    out = voxels.withColumn("o", F.explode(space.offsets(rows)))
    return out.select(*voxels.columns, "o.dx", "o.dy", "o.dz", *((F.col(c) + F.col(f"o.d{c}")).alias(f"n{c}") for c in XYZ))


#: Thickness along x of the slabs in which ``neighbours`` looks: a sample's slab is in one task.
SLAB = 64


def neighbours(voxels: DataFrame, rows: Sequence[tuple[int, int, int]] = space.FACES, value: str = "tok", key: Sequence[str] = KEY) -> DataFrame:
    """Pairs of voxels at an offset: the first's columns, dx, dy, dz, and the second's value as ``other``.

    One pass over each sample's slabs of ``SLAB`` planes, ordered by a number in which an offset is a fixed step: the window of
    exactly that step holds the neighbours (their coordinates are compared, as far ones may share a number). Rows already dealt
    by sample aren't shuffled; others are once, with a copy for the next slab only at its face.
    """
    code = lambda x, y, z: x * (1 << 31) + y * (1 << 16) + z
    x, y, z = (F.col(c).cast("long") for c in XYZ)
    slabs = F.sequence(F.floor((x - max(0, *(o[0] for o in rows))) / SLAB), F.floor((x - min(0, *(o[0] for o in rows))) / SLAB))
    known = [F.col(c).isNotNull() for c in (*key, *XYZ)]
    placed = voxels.where(functools.reduce(Column.__and__, known)).select(*voxels.columns, F.explode(slabs).alias("_slab")).withColumn("_code", code(x, y, z))
    by = Window.partitionBy(*key, "_slab").orderBy("_code")
    near = lambda d: F.collect_list(F.struct(*XYZ, F.col(value).alias("other"))).over(by.rangeBetween(code(*d), code(*d)))
    named = placed.withColumns({f"_n{i}": near(d) for i, d in enumerate(rows)}).where(F.floor(x / SLAB) == F.col("_slab"))
    here = lambda d: lambda m: (m["x"] == F.col("x") + d[0]) & (m["y"] == F.col("y") + d[1]) & (m["z"] == F.col("z") + d[2])
    pair = lambda d: lambda m: F.struct(*(F.lit(v).alias(f"d{c}") for c, v in zip(XYZ, d, strict=True)), m["other"].alias("other"))
    each = [F.transform(F.filter(f"_n{i}", here(d)), pair(d)) for i, d in enumerate(rows)]
    met = named.select(*voxels.columns, F.explode(F.concat(*each)).alias("_m")).select(*voxels.columns, "_m.*")
    return met.select(*voxels.columns, "dx", "dy", "dz", *((F.col(c) + F.col(f"d{c}")).alias(f"n{c}") for c in XYZ), "other")


def ranked(voxels: DataFrame, order: Column, name: str = "rank", key: Sequence[str] = KEY) -> DataFrame:
    """Place (from 0) of each voxel in its sample under an order; ties by coordinates.

    A sample's grid bounds its rows, so a window task stays bounded as the corpus grows.
    """
    return voxels.withColumn(name, (F.row_number().over(Window.partitionBy(*key).orderBy(order, *XYZ)) - 1).cast("long"))


def downsample(voxels: DataFrame, factor: int, value: str = "tok", zero_based: bool = False, key: Sequence[str] = KEY) -> DataFrame:
    """Mean of ``value`` over the voxels of each coarse cell; ``zero_based`` divides by one more, as a mean that starts from a zero does."""
    cells = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in XYZ]
    n = F.count(value) + (1 if zero_based else 0)
    return voxels.groupBy(*key, *cells).agg((F.sum(F.col(value).cast("double")) / n).alias("mean"), F.count("*").alias("n"))


def block_pack(voxels: DataFrame, side: int, value: str = "tok", key: Sequence[str] = KEY) -> DataFrame:
    """Blocks of side^3 children as a fixed array of values (null: empty) and the number filled."""
    place = F.col("x") % side * side * side + F.col("y") % side * side + F.col("z") % side
    cells = [F.floor(F.col(c) / side).cast("int").alias(f"b{c}") for c in XYZ]
    packed = voxels.groupBy(*key, *cells).agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("k"), F.col(value).alias("v")))).alias("m"))
    slots = F.sequence(F.lit(0), F.lit(side**3 - 1))
    return packed.select(*key, "bx", "by", "bz", F.transform(slots, lambda i: F.try_element_at(F.col("m"), i)).alias("packed"), F.size("m").alias("filled"))


def unpack(packed: DataFrame, side: int, key: Sequence[str] = KEY) -> DataFrame:
    """Voxels of packed blocks."""
    rows = packed.select(*key, "bx", "by", "bz", F.posexplode("packed").alias("k", "tok")).where("tok is not null")
    s = side
    return rows.select(*key, (F.col("bx") * s + F.floor(F.col("k") / (s * s))).cast("int").alias("x"), (F.col("by") * s + F.floor(F.col("k") / s) % s).cast("int").alias("y"), (F.col("bz") * s + F.col("k") % s).cast("int").alias("z"), "tok")


def subdivide(voxels: DataFrame) -> DataFrame:
    """The eight children of each voxel on the doubled grid, with the parent's other columns."""
    rest = [c for c in voxels.columns if c not in XYZ]
    out = voxels.withColumn("o", F.explode(space.offsets(space.CORNERS)))
    return out.select(*rest, *((F.col(c) * 2 + F.col(f"o.d{c}")).cast("int").alias(c) for c in XYZ))


def coarse(voxels: DataFrame, factor: int, key: Sequence[str] = KEY) -> DataFrame:
    """Distinct coarse cells."""
    return voxels.select(*key, *(F.floor(F.col(c) / factor).cast("int").alias(c) for c in XYZ)).distinct()


def dilate(voxels: DataFrame, radius: int, resolution: int, key: Sequence[str] = KEY) -> DataFrame:
    """Cells within a cube of ``radius`` around any voxel, inside the grid.

    Cells of a column are met as bits of words of up to 64, so that a task keeps a row for each word and not for each cell.
    """
    steps, word = range(-radius, radius + 1), min(64, resolution)
    grown = shifted(voxels.select(*key, *XYZ), [(a, b, c) for a in steps for b in steps for c in steps])
    inside = [F.col(f"n{c}").between(0, resolution - 1) for c in XYZ]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("nz") % word).cast("int"))
    columns = grown.where(inside[0] & inside[1] & inside[2]).groupBy(*key, F.col("nx").alias("x"), F.col("ny").alias("y"), F.floor(F.col("nz") / word).alias("_w")).agg(F.bit_or(bit).alias("_met"))
    cells = F.filter(F.sequence(F.lit(0), F.lit(word - 1)), lambda i: F.getbit("_met", i) == 1)
    return columns.select(*key, "x", "y", "_w", F.explode(cells).alias("_i")).select(*key, "x", "y", (F.col("_w") * word + F.col("_i")).cast(grown.schema["nz"].dataType).alias("z"))


def bounds(voxels: DataFrame, pad: int = 0, resolution: int | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """Axis-aligned box of each sample, padded and clamped."""
    low, high = lambda c: F.min(c) - pad, lambda c: F.max(c) + pad
    if resolution is not None:
        low, high = lambda c: F.greatest(F.min(c) - pad, F.lit(0)), lambda c: F.least(F.max(c) + pad, F.lit(resolution - 1))
    return voxels.groupBy(*key).agg(*(low(c).alias(f"{c}_low") for c in XYZ), *(high(c).alias(f"{c}_high") for c in XYZ))


def in_bounds(voxels: DataFrame, boxes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Voxels inside their sample's box. Boxes: one row a sample, joined by key."""
    inside = [F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high")) for c in XYZ]
    return voxels.join(boxes, list(key)).where(inside[0] & inside[1] & inside[2]).select(*voxels.columns)


def unless_empty(filtered: DataFrame, original: DataFrame) -> DataFrame:
    """``filtered``, or all of ``original`` if nothing passed."""
    return filtered if filtered.limit(1).count() else original


def classify(output: DataFrame, truth: DataFrame, flag: str = "sharp", key: Sequence[str] = KEY) -> DataFrame:
    """Output voxels as inside, sharp (inside and flagged in the truth), extra, or out_of_range (their sample has no truth)."""
    keys = [*key, *XYZ]
    known = truth.select(*key).distinct().withColumn("has_truth", F.lit(True))
    met = output.join(truth.select(*keys, F.col(flag).alias("flag"), F.lit(True).alias("met")), keys, "left").join(known, list(key), "left")
    region = F.when(F.col("has_truth").isNull(), "out_of_range").when(F.col("met").isNull(), "extra").when(F.col("flag"), "sharp").otherwise("inside")
    return met.withColumn("region", region).drop("flag", "met", "has_truth")


def mid_slices(voxels: DataFrame, at: int) -> DataFrame:
    """Voxels of the three orthogonal planes at ``at``, named by axis."""
    planes = F.array(*(F.when(F.col(c) == at, F.lit(c)) for c in XYZ))
    return voxels.withColumn("plane", F.explode(F.filter(planes, lambda p: p.isNotNull())))


def chunks_with_halo(voxels: DataFrame, size: int, pad: int, key: Sequence[str] = KEY) -> DataFrame:
    """Chunks of ``size`` with a halo of ``pad`` (< size): a voxel goes to each chunk whose padded box holds it, in that chunk's coordinates."""
    own = {c: F.floor(F.col(c) / size).cast("int") for c in XYZ}
    out = voxels.withColumn("o", F.explode(space.offsets(space.CUBE)))
    out = out.withColumns({f"c{c}": own[c] + F.col(f"o.d{c}") for c in XYZ})
    near = [F.col(c).between(F.col(f"c{c}") * size - pad, F.col(f"c{c}") * size + size + pad - 1) & (F.col(f"c{c}") >= 0) for c in XYZ]
    out = out.where(near[0] & near[1] & near[2])
    rest = [c for c in voxels.columns if c not in XYZ]
    return out.select(*rest, "cx", "cy", "cz", *((F.col(c) - F.col(f"c{c}") * size + pad).cast("int").alias(c) for c in XYZ))


def join_chunks(chunked: DataFrame, size: int, pad: int) -> DataFrame:
    """Global coordinates again, without the halos."""
    inside = [F.col(c).between(pad, pad + size - 1) for c in XYZ]
    rest = [c for c in chunked.columns if c not in (*XYZ, "cx", "cy", "cz")]
    return chunked.where(inside[0] & inside[1] & inside[2]).select(*rest, *((F.col(c) + F.col(f"c{c}") * size - pad).cast("int").alias(c) for c in XYZ))
