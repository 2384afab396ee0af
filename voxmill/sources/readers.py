"""Scans: catalogs, listings, JSON lines, voxel archives, training logs."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .discovery import shape_of_name


def read_catalog(spark: SparkSession, roots: str | Sequence[str], schema: str | None = None, name: str = "metadata.csv") -> DataFrame:
    """CSV catalogs of one or more roots (a comma list or a sequence), with the column ``root``; ragged columns are filled with nulls."""
    out = None
    for root in roots.split(",") if isinstance(roots, str) else roots:
        reader = spark.read.option("header", True)
        part = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(f"{root.strip()}/{name}").withColumn("root", F.lit(root.strip()))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def list_files(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """(path, relpath, sha256 of relpath, length) of files below ``root`` with one of the extensions; contents aren't read."""
    pattern = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    rel = F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.lit(root.rstrip("/").split("://")[-1]), F.lit(r"/\E")), 2), -1)
    return files.select("path", rel.alias("relpath"), "length").withColumn("sha256", F.sha2("relpath", 256))


def pair_by_case(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with their labels by case id (the file name up to the first underscore); images without one stay."""
    case = F.split(F.regexp_replace("path", r"^.*/|\.nii(\.gz)?$", ""), "_")[0]
    return images.withColumn("case_id", case).join(labels.select(case.alias("case_id"), F.col("path").alias("label_path")), "case_id", "left")


def path_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, path) rows of a JSON document that maps keys to paths."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "path"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_voxel_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, z, sdf, edge, error) from .npz files with sparse_sdf and sparse_index (edge_mask may be missing), or of the older layout with a dense sdf grid, of which cells below 1 are kept.

    Indices beyond the file's own resolution are an error. One file at a time is decoded in an Arrow task; a broken file gives one row with its error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                try:
                    z = np.load(io.BytesIO(bytes(content)))
                    if "sparse_index" in z.files:
                        xyz, sdf = z["sparse_index"].astype(np.int32), z["sparse_sdf"].reshape(-1).astype(np.float32)
                    else:
                        grid = z["sdf"].astype(np.float32)
                        xyz = np.argwhere(np.abs(grid) < 1).astype(np.int32)
                        sdf = grid[tuple(xyz.T)]
                    if "resolution" in z.files and len(xyz) and xyz.max() >= int(z["resolution"].reshape(-1)[0]):
                        raise ValueError(f"index {xyz.max()} beyond the resolution {int(z['resolution'].reshape(-1)[0])}")
                    edge = z["edge_mask"].astype(bool) if "edge_mask" in z.files else np.zeros(len(sdf), bool)
                    yield pd.DataFrame({"path": p, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "sdf": sdf, "edge": edge, "error": None})
                except Exception as e:  # noqa: BLE001 - what is wrong with a file is data here
                    yield pd.DataFrame({"path": [p], "x": [None], "y": [None], "z": [None], "sdf": [None], "edge": [None], "error": [f"{type(e).__name__}: {e}"[:200]]})

    return files.mapInPandas(run, "path string, x int, y int, z int, sdf float, edge boolean, error string")


#: Fixed value: the pattern of a training log's loss line.
LOSS_LINE = r"\[LOSS-SUMMARY\]\s*step=(\d+)\s*\|\s*n_in=(\d+)\s*\|\s*n_sharp=(\d+)\s*\|\s*n_extra=(\d+)\s*\|\s*n_oor=(\d+)"


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Counters and out-of-range ratio of each loss line; lines without output voxels are dropped. Works on streams as well."""
    names = ("step", "n_in", "n_sharp", "n_extra", "n_oor")
    rest = [c for c in lines.columns if c != value]
    hit = lines.where(F.col(value).rlike(LOSS_LINE)).select(*rest, *(F.regexp_extract(value, LOSS_LINE, i + 1).cast("long").alias(n) for i, n in enumerate(names)))
    hit = hit.withColumn("m_out", F.col("n_in") + F.col("n_sharp") + F.col("n_extra") + F.col("n_oor")).where("m_out > 0")
    return hit.withColumn("oor_ratio", F.col("n_oor") / F.col("m_out"))


class _TooLong(Exception):
    pass


def foreach_instance(rows: DataFrame, func, schema: str, seconds: float | None = None) -> DataFrame:
    """``func(row as dict) -> dict or None`` for each row in Arrow tasks; an exception becomes the column ``error``, and so does a row that takes more than ``seconds``."""
    fields = [f.split()[0].strip("`") for f in schema.split(",")]

    def run(batches):
        import signal

        def alarm(*_):
            raise _TooLong(f"took more than {seconds} s")

        if seconds:
            signal.signal(signal.SIGALRM, alarm)
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    if seconds:
                        signal.setitimer(signal.ITIMER_REAL, seconds)
                    got = func(row)
                    if got is not None:
                        out.append({**{k: got.get(k) for k in fields}, "error": None})
                except Exception as e:  # noqa: BLE001
                    out.append({**{k: row.get(k) for k in fields}, "error": f"{type(e).__name__.strip('_')}: {e}"[:200]})
                finally:
                    if seconds:
                        signal.setitimer(signal.ITIMER_REAL, 0)
            yield pd.DataFrame(out, columns=[*fields, "error"])

    return rows.mapInPandas(run, f"{schema}, error string")


def read_csr_masks(spark: SparkSession, path: str) -> DataFrame:
    """(path, channel, x, y, z, value, error): non-zero cells of compressed sparse row masks (.npz with indptr, indices, data), whose full shape stands in the file name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path).select("path", F.coalesce(shape_of_name(F.regexp_replace("path", "%20", " ")), F.array().cast("array<int>")).alias("shape"), "content")

    def run(batches):
        for b in batches:
            for p, shape, content in zip(b["path"], b["shape"], b["content"], strict=True):
                try:
                    if len(shape) != 4:
                        raise ValueError("no shape of four sides in the file name")
                    z = np.load(io.BytesIO(bytes(content)))
                    row = np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
                    flat = row.astype(np.int64) * int(np.prod(shape[1:])) + z["indices"] if len(z["indptr"]) - 1 == shape[0] else row.astype(np.int64) * int(np.prod(shape) // (len(z["indptr"]) - 1)) + z["indices"]
                    c, x, y, zz = np.unravel_index(flat, tuple(int(s) for s in shape))
                    yield pd.DataFrame({"path": p, "channel": c, "x": x, "y": y, "z": zz, "value": z["data"].astype(np.float64), "error": None})
                except Exception as e:  # noqa: BLE001 - what is wrong with a file is data here
                    yield pd.DataFrame({"path": [p], "channel": [None], "x": [None], "y": [None], "z": [None], "value": [None], "error": [f"{type(e).__name__}: {e}"[:200]]})

    return files.mapInPandas(run, "path string, channel int, x int, y int, z int, value double, error string")
