"""Small value operators: names of organs, packed distances, angles, low-discrepancy points, cameras, nested records, sizes in text."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Units of the packed integer distances in one unit of length.
DISTANCE_UNITS = 10_000_000


def clean_name(name: Column) -> Column:
    """Lower case, blanks and hyphens as underscores."""
    return F.lower(F.translate(name, " -", "__"))


def channel_name(channel: Column, names: Column) -> Column:
    """Name of a mask channel (from 0) in a map of labels: label channel + 1, else label channel, else organ_<channel>."""
    label = lambda i: F.try_element_at(names, i.cast("string"))
    return F.coalesce(label(channel + 1), label(channel), F.concat(F.lit("organ_"), channel.cast("string")))


def pad_amounts(sizes: Sequence[Column], target: Column) -> list[Column]:
    """Cells to fill at the end of each side; a side beyond the target raises, as nothing is scaled down."""
    return [F.when(s <= target, target - s).otherwise(F.raise_error(F.lit("a side is larger than the target")).cast("int")) for s in sizes]


def cropped(voxels: DataFrame, sizes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Voxels inside their case's own size (key, size_x, size_y, size_z): what padding added goes."""
    inside = [F.col(c) < F.col(f"size_{c}") for c in "xyz"]
    return voxels.join(sizes, list(key)).where(inside[0] & inside[1] & inside[2]).select(*voxels.columns)


def pack_distance(distance: Column, inside: Column) -> Column:
    """Integer distance shifted left by one, with the lowest bit for the inside."""
    return F.shiftleft((distance * DISTANCE_UNITS).cast("long"), 1).bitwiseOR(inside.cast("long"))


def unpack_distance(packed: Column, reach: Column) -> Column:
    """Signed distance (negative inside) over the band's width, clamped to [-1, 1]."""
    d = F.shiftright(packed, 1) / float(DISTANCE_UNITS)
    signed = F.when(packed.bitwiseAND(F.lit(1).cast("long")) == 1, -d).otherwise(d)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), signed / reach))


def angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Degrees between two normals given as colours in [0, 1]; null where one has no length."""
    p, q = [2 * c - 1 for c in a], [2 * c - 1 for c in b]
    norm = F.sqrt(sum((c * c for c in p[1:]), p[0] * p[0])) * F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    dot = sum((x * y for x, y in zip(p[1:], q[1:], strict=True)), p[0] * q[0])
    return F.when(norm > 1e-9, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (norm + 1e-9))))))


def radical_inverse(n: Column, base: int, digits: int) -> Column:
    """Digits of n (at most ``digits``) mirrored at the point."""
    terms = F.transform(F.sequence(F.lit(0), F.lit(digits - 1)), lambda i: F.floor(n / F.pow(F.lit(float(base)), i)) % base / F.pow(F.lit(float(base)), i + 1))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def sphere_point(n: Column, total: Column, offset: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    """(phi, theta) of the n-th of ``total`` Hammersley points on the sphere."""
    u = n / total + offset[0] / total
    v = radical_inverse(n, 2, 32) + offset[1]
    u = F.when(u < 0.25, 2 * u).otherwise(2 / 3 * u + 1 / 3)
    return v * (2 * math.pi), F.acos(1 - 2 * u) - math.pi / 2


def camera(share: Column, fov_min: float = 10, fov_max: float = 70) -> tuple[Column, Column]:
    """(radius, field of view) for a share in [0, 1) of the inverse squared radii: near views are as frequent as their solid angle."""
    near, far = (math.sqrt(3) / 2 / math.sin(f / 360 * math.pi) for f in (fov_max, fov_min))
    k = F.lit(1 / far**2) + share * (1 / near**2 - 1 / far**2)
    radius = 1 / F.sqrt(k)
    return radius, 2 * F.asin(math.sqrt(3) / 2 / radius)


def flattened(rows: DataFrame, separator: str = ".") -> DataFrame:
    """Struct columns spread into columns with joined names, at any depth."""

    def leaves(schema: StructType, at: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema:
            path = (*at, f.name)
            if isinstance(f.dataType, StructType):
                out += leaves(f.dataType, path)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)))
        return out

    return rows.select(*leaves(rows.schema, ()))


def merged_maps(a: Column, b: Column) -> Column:
    """Union of two maps; a key in both raises."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.when(F.size(both) == 0, F.map_from_entries(F.concat(F.map_entries(a), F.map_entries(b)))).otherwise(F.raise_error(F.concat(F.lit("keys in both: "), F.array_join(both, ", "))).cast("map<string,string>"))


def size_text(n_bytes: Column) -> Column:
    """GiB with two decimals, TiB from 1024 GiB on; null: n/a."""
    gib = n_bytes / float(1 << 30)
    return F.when(n_bytes.isNull(), "n/a").when(gib >= 1024, F.format_string("%.2f TiB", gib / 1024)).otherwise(F.format_string("%.2f GiB", gib))


def size_text_compact(n_bytes: Column) -> Column:
    gib = n_bytes / float(1 << 30)
    return F.when(n_bytes.isNull(), "?").when(gib >= 1024, F.format_string("%.2fT", gib / 1024)).when(gib >= 100, F.format_string("%.0fG", gib)).otherwise(F.format_string("%.1fG", gib))


def training_memory(points: Column, samples: Column) -> Column:
    """Bytes that an in-memory trainer's corpus takes: 32 a point, 8192 a sample (fixed values)."""
    return points * 32 + samples * 8192
