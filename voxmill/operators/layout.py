"""Layouts of sparse samples: batches, blocks, patches, octrees, offset arrays, equal slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import catalog
from .voxel import KEY, XYZ


def _cell(c: str, factor: int) -> Column:
    return F.floor(F.col(c) / factor).cast("int")


def upsample(coarse: DataFrame, children: DataFrame, factor: int, value: str, key: Sequence[str] = KEY) -> DataFrame:
    """The parent's value at each of the fine voxels that the coarse table was made from (nearest neighbour)."""
    up = coarse.select(*key, *(F.col(c).alias(f"p{c}") for c in XYZ), value)
    return children.select(*key, *XYZ).withColumns({f"p{c}": _cell(c, factor) for c in XYZ}).join(up, [*key, *(f"p{c}" for c in XYZ)]).select(*key, *XYZ, value)


def expand_blocks(packed: DataFrame, side: int, key: Sequence[str] = KEY) -> DataFrame:
    """All side^3 children of each packed block, empty ones with a null value."""
    rows = packed.select(*key, "bx", "by", "bz", F.posexplode("packed").alias("k", "tok"))
    place = (F.floor(F.col("k") / (side * side)), F.floor(F.col("k") / side) % side, F.col("k") % side)
    return rows.select(*key, *((F.col(f"b{c}") * side + p).cast("int").alias(c) for c, p in zip(XYZ, place, strict=True)), "tok")


def full_grid(boxes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Every cell of each box (key, x_low .. z_high, both ends included)."""
    out = boxes
    for c in XYZ:
        out = out.withColumn(c, F.explode(F.sequence(F.col(f"{c}_low"), F.col(f"{c}_high"))))
    return out.select(*key, *XYZ)


def patch_channel(channel: Column, size: int) -> Column:
    """Channel of a voxel after its patch of size^3 is folded into channels."""
    return channel * size**3 + F.col("x") % size * size * size + F.col("y") % size * size + F.col("z") % size


def patchify(voxels: DataFrame, size: int, channel: str = "channel") -> DataFrame:
    return voxels.select(*(c for c in voxels.columns if c not in (*XYZ, channel)), patch_channel(F.col(channel), size).alias(channel), *(_cell(c, size).alias(c) for c in XYZ))


def unpatchify(patches: DataFrame, size: int, channel: str = "channel") -> DataFrame:
    """Inverse of ``patchify``; also the three-dimensional pixel shuffle by ``size``."""
    inner = F.col(channel) % size**3
    place = (F.floor(inner / (size * size)), F.floor(inner / size) % size, inner % size)
    rest = [c for c in patches.columns if c not in (*XYZ, channel)]
    return patches.select(*rest, F.floor(F.col(channel) / size**3).cast("int").alias(channel), *((F.col(c) * size + p).cast("int").alias(c) for c, p in zip(XYZ, place, strict=True)))


def elementwise(a: DataFrame, b: DataFrame, value: str = "tok", key: Sequence[str] = KEY) -> DataFrame:
    """Sum, difference, product and quotient (null by zero) of two samples' values at equal coordinates."""
    met = a.select(*key, *XYZ, F.col(value).alias("_a")).join(b.select(*key, *XYZ, F.col(value).alias("_b")), [*key, *XYZ])
    p, q = F.col("_a"), F.col("_b")
    return met.select(*key, *XYZ, (p + q).alias("sum"), (p - q).alias("difference"), (p * q).alias("product"), F.try_divide(p.cast("double"), q.cast("double")).alias("quotient"))


def ordinals(rows: DataFrame, sample: str = "sid", name: str = "ordinal") -> DataFrame:
    """(sample, ordinal): samples numbered from 0 in their order."""
    return catalog.numbered(rows.select(sample).distinct(), F.floor(F.col(sample) / 4096), sample, name=name)


def concat_batches(parts: Sequence[DataFrame], sample: str = "sid") -> DataFrame:
    """Tensors joined along the batch: each part's samples are numbered from 0 and moved behind the parts before."""
    out, ahead = None, None
    for part in parts:
        numbers = ordinals(part, sample, "batch")
        total = numbers.agg(F.count("*").alias("_n"))
        if ahead is not None:
            numbers = numbers.join(F.broadcast(ahead)).select(sample, (F.col("batch") + F.col("_n")).alias("batch"))
            total = total.unionByName(ahead).agg(F.sum("_n").alias("_n"))
        ahead = total
        rows = part.join(numbers, sample)
        out = rows if out is None else out.unionByName(rows)
    return out


def slice_batches(rows: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Samples ``wanted`` (by batch number), numbered anew in that order; a number named twice comes twice."""
    order = F.filter(F.array(*(F.when(F.col("batch") == old, F.lit(new)) for new, old in enumerate(wanted))), lambda i: i.isNotNull())
    return rows.withColumn("_to", F.explode(order)).withColumn("batch", F.col("_to").cast("long")).drop("_to")


def collate(rows: DataFrame, size: int, resolution: Column, sample: str = "sid") -> DataFrame:
    """Batches of ``size`` consecutive samples: batch, batch_idx, rows. Samples of differing resolution in one batch raise."""
    numbered = rows.join(ordinals(rows, sample), sample).withColumns({"batch": F.floor(F.col("ordinal") / size), "batch_idx": F.col("ordinal") % size})
    seen = numbered.groupBy("batch").agg(F.min(resolution).alias("_low"), F.max(resolution).alias("_high"))
    one = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.raise_error(F.concat(F.lit("resolutions differ in batch "), F.col("batch").cast("string"))).cast("int"))
    return numbered.join(seen.select("batch", one.alias("resolution")), "batch").drop("ordinal")


def _field(items: Column, name: str) -> Column:
    return F.transform(items, lambda e: e[name])


def to_csr(rows: DataFrame, shard: Column, order: Column, sample: str = "sid") -> DataFrame:
    """A row for each shard (a bounded number of samples): samples, offsets (one more), and the flat tokens and coordinates between them."""
    inside = rows.groupBy(shard.alias("shard"), sample).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), *XYZ, "tok"))).alias("v"))
    s = inside.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(sample, "v"))).alias("s"))
    sizes = F.transform("s", lambda e: F.size(e["v"]))
    offsets = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    flat = F.flatten(F.transform("s", lambda e: e["v"]))
    return s.select("shard", F.transform("s", lambda e: e[sample]).alias("samples"), offsets.alias("offsets"), *(_field(flat, c).alias(c) for c in (*XYZ, "tok")))


def from_csr(shards: DataFrame, sample: str = "sid") -> DataFrame:
    """The rows again. Raises if the last offset isn't the number of tokens."""
    whole = F.when(F.element_at("offsets", -1) == F.size("tok"), F.col("samples")).otherwise(F.raise_error(F.lit("offsets don't cover the tokens")).cast(shards.schema["samples"].dataType))
    each = shards.select(F.posexplode(whole).alias("i", sample), "offsets", *XYZ, "tok")
    cut = lambda c: F.slice(c, F.get("offsets", F.col("i")) + 1, F.get("offsets", F.col("i") + 1) - F.get("offsets", F.col("i")))
    return each.select(sample, F.explode(F.arrays_zip(*(cut(c).alias(c) for c in (*XYZ, "tok")))).alias("v")).select(sample, "v.*")


def equal_slices(values: Column, ranks: int, pad: Column) -> Column:
    """``ranks`` slices of an array, all of the length ceil(size / ranks), filled up with ``pad``."""
    size = F.ceil(F.size(values) / ranks).cast("int")
    part = lambda r: F.slice(values, r * size + 1, size)
    return F.transform(F.sequence(F.lit(0), F.lit(ranks - 1)), lambda r: F.concat(part(r), F.array_repeat(pad, size - F.size(part(r)))))


def octree_sums(voxels: DataFrame, levels: int, value: str = "tok", key: Sequence[str] = KEY) -> DataFrame:
    """(level, x, y, z, children, total) of all inner nodes: level 1 sums voxels, each further level the one below."""
    below = voxels.select(*key, *XYZ, F.col(value).cast("long").alias("total"))
    out = None
    for level in range(1, levels + 1):
        below = below.groupBy(*key, *(_cell(c, 2).alias(c) for c in XYZ)).agg(F.count("*").alias("children"), F.sum("total").alias("total"))
        rows = below.select(*key, F.lit(level).alias("level"), *XYZ, "children", "total")
        out = rows if out is None else out.unionByName(rows)
        below = below.drop("children")
    return out


#: Sides of the cells by which ``nearest_l1`` narrows far pairs down to voxels.
SIDES = (64, 16, 4, 1)


def nearest_l1(a: DataFrame, b: DataFrame, reach: int, key: str = "sid") -> DataFrame:
    """Least city-block distance, at most ``reach``, between two footprints of each sample.

    Most samples have an equal or touching pair, found by an equi-join on face neighbours. The others go down through cells
    of falling sides: of the pairs of cells only those stay that may hold a pair as near as the best one surely is. The plan
    has a fixed size, however far the footprints are apart.
    """
    from ..functions import space
    from .bpe3d import Cut

    cut = Cut(a.sparkSession)
    around = [(0, 0, 0), *space.FACES, *(tuple(-v for v in f) for f in space.FACES)]
    grown = a.withColumn("o", F.explode(space.offsets(around)))
    grown = grown.select(key, *((F.col(c) + F.col(f"o.d{c}")).alias(c) for c in XYZ), (F.abs("o.dx") + F.abs("o.dy") + F.abs("o.dz")).alias("l1"))
    hits = cut(grown.join(b.select(key, *XYZ).hint("merge"), [key, *XYZ]).groupBy(key).agg(F.min("l1").alias("l1")))
    rest = {s: cut(rows.select(key, *XYZ).join(hits.select(key), key, "left_anti")) for s, rows in (("a", a), ("b", b))}
    kept = None
    for parent, side in zip((None, *SIDES), SIDES):
        cells = {s: rows.select(key, *(_cell(c, side).alias(f"{s}{c}") for c in XYZ), *([_cell(c, parent).alias(f"{s}p{c}") for c in XYZ] if parent else [])).distinct() for s, rows in rest.items()}
        if kept is None:
            pairs = cells["a"].join(cells["b"], key)
        else:
            up = kept.select(key, *(F.col(f"{s}{c}").alias(f"{s}p{c}") for s in "ab" for c in XYZ))
            pairs = up.join(cells["a"], [key, *(f"ap{c}" for c in XYZ)]).join(cells["b"], [key, *(f"bp{c}" for c in XYZ)])
        apart = [F.abs(F.col(f"a{c}") - F.col(f"b{c}")) * side for c in XYZ]
        low, high = sum((F.greatest(d - (side - 1), F.lit(0)) for d in apart), F.lit(0)), sum((d + (side - 1) for d in apart), F.lit(0))
        pairs = pairs.select(key, *(f"{s}{c}" for s in "ab" for c in XYZ), low.alias("low"), high.alias("high"))
        best = pairs.groupBy(key).agg(F.min("high").alias("best"))
        kept = pairs.join(best, key).where("low <= best")
    far = best.select(key, F.col("best").cast("int").alias("l1")).where(F.col("l1") <= reach)
    return hits.unionByName(far)


def bounds_of_bands(voxels: DataFrame, resolution: int, extra: float, seed_scale: int | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """Padded boxes: of a wide band (pad: a quarter of ``extra``, 1 at least), or of coarse seeds, each of which covers seed_scale^3 cells (pad: ``extra``)."""
    import math

    scale = seed_scale or 1
    pad = math.ceil(extra) if seed_scale else max(1, math.ceil(extra * 0.25))
    low = lambda c: F.greatest(F.min(c) * scale - pad, F.lit(0))
    high = lambda c: F.least(F.max(c) * scale + scale - 1 + pad, F.lit(resolution - 1))
    return voxels.groupBy(*key).agg(*(low(c).alias(f"{c}_low") for c in XYZ), *(high(c).alias(f"{c}_high") for c in XYZ))


def fit_limit(voxels: DataFrame, limit: int, policy: str, order: Column, key: Sequence[str] = KEY) -> DataFrame:
    """Samples of over ``limit`` voxels dropped, or thinned by farthest-point sampling; places by ``order`` and the raw size."""
    from .sequence import farthest_points

    n = voxels.groupBy(*key).agg(F.count("*").alias("raw"))
    rows = voxels.join(n, list(key))
    fits = rows.where(F.col("raw") <= limit)
    if policy == "fps":
        fits = fits.unionByName(farthest_points(rows.where(F.col("raw") > limit), key, limit).drop("nth"))
    elif policy != "drop":
        raise ValueError(f"unknown policy {policy}")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order, *XYZ)) - 1
    return fits.withColumn("place", place.cast("long"))


def csr_cells(rows: DataFrame, key: str, shape: str = "shape", indptr: str = "indptr", indices: str = "indices", data: str = "data") -> DataFrame:
    """(key, c0, c1, ..., value, error): the stored cells of compressed sparse row matrices in array columns, by their place in the full shape.

    Row r of a matrix has the elements from indptr[r] to indptr[r + 1]; rows are the first side of ``shape`` (four
    sides), columns the others in C order. A matrix whose pointers or indices don't fit gives one row with its error.
    """
    ptr, ind, val, sides = F.col(indptr), F.col(indices), F.col(data), F.col(shape)
    n = F.size(ptr) - 1
    width = F.aggregate(F.slice(sides, 2, 3), F.lit(1).cast("long"), lambda a, b: a * b)
    falls = F.exists(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(indptr, i + 1) < F.get(indptr, i))
    problem = (
        F.when(sides.isNull() | ptr.isNull() | ind.isNull() | val.isNull(), "missing part")
        .when(F.size(sides) != 4, "no shape of four sides")
        .when(n != F.get(shape, F.lit(0)), "as many pointers as rows and one more are needed")
        .when((F.get(indptr, F.lit(0)) != 0) | falls, "pointers must rise from 0")
        .when((F.get(indptr, n) != F.size(ind)) | (F.size(ind) != F.size(val)), "the last pointer must be the number of elements")
        .when(F.exists(ind, lambda i: i.isNull() | (i < 0) | (i >= width)), "column beyond the shape")
    )
    # one pass: a matrix becomes its elements or its error, so that neither the check nor the arrays are repeated for each row
    element = lambda row, i, v, error: F.struct(row.cast("int").alias("c0"), i.cast("long").alias("i"), v.cast("double").alias("v"), error.cast("string").alias("error"))
    none = F.lit(None)
    span = lambda a, r: F.slice(a, F.get(indptr, r) + 1, F.get(indptr, r + 1) - F.get(indptr, r))
    stored = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.zip_with(span(ind, r), span(val, r), lambda i, v: element(r, i, v, none))))
    each = F.when(problem.isNotNull(), F.array(element(none, none, none, problem))).when(n > 0, stored)
    e = rows.select(key, shape, F.explode(each).alias("e"))
    i, d, w = F.col("e.i"), F.get(shape, F.lit(2)), F.get(shape, F.lit(3))
    place = (F.floor(i / (d * w)), F.floor(i / w) % d, i % w)
    return e.select(key, "e.c0", *(c.cast("int").alias(f"c{j + 1}") for j, c in enumerate(place)), F.col("e.v").alias("value"), "e.error")


def sample_views(points: DataFrame, maps: DataFrame, key: Sequence[str], side: int) -> DataFrame:
    """(key, views, feature): mean over the views of each point of its view's feature map, read between cells.

    ``points`` (key, pose, u, v) has places in [0, 1) of the map's width and height, ``maps`` (pose, views, cells) the number of
    views with that pose and the sums of their side x side cells, in rows (null: 0). Reading is linear in the cells, so views under
    which a point has one place count through their sum, and a point has one row for each pose. Cell centres lie at (i + 1/2) / side; a
    place takes its four nearest ones with bilinear weights, those beyond the map counting as 0.
    """
    at = {c: F.col(c) * side - 0.5 for c in "uv"}
    rows = points.join(maps, "pose").select(*key, "views", "cells", *(F.floor(x).cast("int").alias(f"{c}0") for c, x in at.items()), *((x - F.floor(x)).alias(f"{c}f") for c, x in at.items()))
    total = F.lit(0.0)
    for i in (0, 1):
        for j in (0, 1):
            col, row = F.col("u0") + i, F.col("v0") + j
            weight = (F.col("uf") if i else 1 - F.col("uf")) * (F.col("vf") if j else 1 - F.col("vf"))
            cell = F.when(col.between(0, side - 1) & row.between(0, side - 1), F.get("cells", row * side + col))
            total = total + weight * F.coalesce(cell, F.lit(0.0))
    rows = rows.select(*key, "views", total.alias("total"))
    return rows.groupBy(*key).agg(F.sum("views").alias("views"), (F.sum("total") / F.sum("views")).alias("feature"))
