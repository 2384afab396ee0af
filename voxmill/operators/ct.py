"""Windowed CT values, organ statistics, mask formats, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import quantiles

#: Fixed values of the window table: name, width, level in Hounsfield units.
WINDOWS = (("lung", 1500, -600), ("bone", 1500, 300), ("soft_tissue", 400, 50), ("brain", 80, 35))
#: Fixed keyword lists, tried in this order; what fits none is soft tissue.
KEYWORDS = (
    ("lung", ("lung", "bronchus", "bronchi", "airway", "trachea", "肺", "支气管", "气管")),
    ("bone", ("bone", "vertebra", "vertebrae", "rib", "spine", "femur", "tibia", "humerus", "skull", "pelvis", "骨", "椎", "肋", "脊柱", "股骨", "胫骨", "肱骨", "颅骨", "骨盆")),
    ("brain", ("brain", "cerebr", "cerebellum", "brainstem", "脑", "小脑", "脑干")),
)
RESOLUTIONS = (512, 1024)


def low(width: int, level: int) -> float:
    return level - width / 2


def binarise(hu: Column, width: Column, level: Column) -> Column:
    """1 inside the window, both ends included."""
    return hu.between(level - width / 2, level + width / 2).cast("int")


def scale(hu: Column, width: Column, level: Column) -> Column:
    """Position in the window, clipped to [0, 1]; 0 for a window without width."""
    place = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (hu - (level - width / 2)) / F.when(width > 0, width)))
    return F.coalesce(place, F.lit(0.0))


def window_of(organ: Column) -> Column:
    """Window name by keyword."""
    name = F.lower(organ)
    out = None
    for window, words in KEYWORDS:
        test = name.rlike("|".join(words))
        out = F.when(test, window) if out is None else out.when(test, window)
    return out.otherwise("soft_tissue")


def window_file(name: Column, width: Column, level: Column) -> Column:
    return F.format_string("%s_w%d_l%d.npy", name, width.cast("int"), level.cast("int"))


def organ_stats(voxels: DataFrame, *key: str, hu: str = "hu") -> DataFrame:
    """Count, share of the case, mean, population deviation, extremes and quartiles by organ (keys aren't null)."""
    v = F.col(hu)
    out = voxels.groupBy(*key).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    out = out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key[0])))
    return out.join(quantiles(voxels, key, hu, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), list(key), "left")


def foreground_norm(voxels: DataFrame, case: str, hu: str = "hu") -> DataFrame:
    """By case: quantiles, mean and deviation of the values above the case's mean (all values if none is above)."""
    mean = voxels.groupBy(case).agg(F.avg(hu).alias("_mean"), F.max(hu).alias("_top"))
    above = voxels.join(mean, case).where((F.col(hu) > F.col("_mean")) | (F.col("_top") <= F.col("_mean")))
    out = above.groupBy(case).agg(F.avg(hu).alias("mean"), F.stddev_pop(hu).alias("std"))
    return out.join(quantiles(above, [case], hu, {"low": 0.0005, "high": 0.9995}), case)


def mask_format(mask: DataFrame, case: str = "case_id") -> DataFrame:
    """Format of each case's mask (case_id, channels, channel, x, y, z, value): by number of channels and largest overlap."""
    per_voxel = mask.groupBy(case, "channels", "x", "y", "z").agg(F.sum((F.col("value") > 0).cast("int")).alias("overlap"))
    top = per_voxel.groupBy(case, "channels").agg(F.max("overlap").alias("overlap"))
    kind = F.when(F.col("channels") == 0, "single_label_3d").when(F.col("channels") == 1, "single_channel_4d").when(F.col("overlap") <= 1.1, "one_hot").otherwise("multi_channel")
    return top.select(case, "channels", F.col("overlap").cast("long").alias("overlap"), kind.alias("format"))


def argmax_labels(mask: DataFrame, case: str = "case_id") -> DataFrame:
    """Label of each voxel: the first channel of the largest value (so background and channel 0 are both 0)."""
    return mask.groupBy(case, "x", "y", "z").agg(F.max_by("channel", F.struct("value", -F.col("channel"))).alias("label"))


def target_resolution(largest: Column, strict: bool = True) -> Column:
    """Smallest supported resolution that holds the largest side; else an error (or null)."""
    out = None
    for r in RESOLUTIONS:
        out = F.when(largest <= r, r) if out is None else out.when(largest <= r, r)
    return out.otherwise(F.raise_error(F.concat(F.lit("no resolution holds "), largest.cast("string"))).cast("int") if strict else F.lit(None))
