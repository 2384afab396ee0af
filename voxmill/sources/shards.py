"""A Spark data source for voxel shards in .npz files: ``spark.read.format("voxel_shards")`` and ``df.write.format("voxel_shards")``.

Two layouts, chosen by the option ``layout``:

* ``csr``: many samples a file, as flat arrays ``x``, ``y``, ``z``, ``tok`` with ``sids`` and ``offsets`` (sample i has
  the rows from offsets[i] to offsets[i + 1]).
* ``sdf``: one sample a file, ``sparse_index`` (n x 3) and ``sparse_sdf`` (n x 1) with ``edge_mask`` and ``resolution``;
  files without ``edge_mask`` have no edges, files with a dense ``sdf`` grid give their cells below 1. The sample's number
  is in the file's name.

Reading: files are dealt to partitions by size, each read by one task, file by file. A broken file fails
its task with the file's name. Writing commits in two phases: tasks write their files into a folder of the job, and only when all
have succeeded does the driver move them to their names and write ``_SUCCESS``; a failed job removes its
folder, so no task leaves a shard behind. A task holds one shard of about ``rows`` voxels (or one sample). Rows of a sample must
come together: ``write_shards`` deals and sorts them so.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMAS = {"csr": "sid int, x int, y int, z int, tok int", "sdf": "sid int, x int, y int, z int, sdf float, edge boolean"}
#: Bytes of files that a reading task takes together; voxels of a written shard.
GROUP, ROWS = 64 << 20, 1 << 20


def _files(path: str):
    """(file system, path on it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:/", path) else (fs.LocalFileSystem(), path)


def _read(system, path: str) -> dict[str, np.ndarray]:
    with system.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as z:
        return {k: z[k] for k in z.files}


def csr_rows(z: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    sids, offsets = z["sids"], z["offsets"]
    if len(offsets) != len(sids) + 1 or offsets[0] != 0 or (np.diff(offsets) < 0).any() or offsets[-1] != len(z["tok"]):
        raise ValueError("offsets don't fit the samples")
    return {"sid": np.repeat(sids, np.diff(offsets)).astype(np.int32), **{c: z[c].astype(np.int32) for c in ("x", "y", "z", "tok")}}


def sdf_rows(z: dict[str, np.ndarray], sid: int) -> dict[str, np.ndarray]:
    if "sparse_index" in z:
        xyz, sdf = z["sparse_index"].astype(np.int32).reshape(-1, 3), z["sparse_sdf"].reshape(-1).astype(np.float32)
    else:
        grid = z["sdf"].astype(np.float32)
        xyz = np.argwhere(np.abs(grid) < 1).astype(np.int32)
        sdf = grid[tuple(xyz.T)]
    if len(xyz) != len(sdf):
        raise ValueError("as many values as indices are needed")
    if "resolution" in z and len(xyz) and xyz.max() >= int(z["resolution"].reshape(-1)[0]):
        raise ValueError("index beyond the resolution")
    edge = z["edge_mask"].reshape(-1).astype(bool) if "edge_mask" in z else np.zeros(len(sdf), bool)
    return {"sid": np.full(len(sdf), sid, np.int32), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "sdf": sdf, "edge": edge}


@dataclass
class FileGroup(InputPartition):
    paths: list[str]


@dataclass
class Moves(WriterCommitMessage):
    """Files that a task has written, each with its final name."""

    files: list[tuple[str, str]]


class ShardReader(DataSourceReader):
    def __init__(self, path: str, layout: str, schema: StructType, group: int):
        self.path, self.layout, self.schema, self.group = path, layout, schema, group

    def partitions(self) -> list[InputPartition]:
        """Files in name order, grouped up to ``group`` bytes."""
        from pyarrow import fs

        system, base = _files(self.path)
        found = sorted((i.path, i.size) for i in system.get_file_info(fs.FileSelector(base, recursive=False)) if i.is_file and i.path.endswith(".npz"))
        out: list[InputPartition] = []
        paths, held = [], 0
        for p, size in found:
            if paths and held + size > self.group:
                out.append(FileGroup(paths))
                paths, held = [], 0
            paths, held = [*paths, p], held + size
        return [*out, *([FileGroup(paths)] if paths else [])] or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _files(self.path)
        schema = to_arrow_schema(self.schema)
        for path in partition.paths:
            try:
                z = _read(system, path)
                rows = csr_rows(z) if self.layout == "csr" else sdf_rows(z, int(re.search(r"(\d+)\.npz$", path)[1]))
            except Exception as e:
                raise ValueError(f"{path}: {type(e).__name__}: {e}") from e
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, layout: str, rows: int, overwrite: bool):
        self.path, self.layout, self.rows, self.overwrite, self.job = path, layout, rows, overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moves:
        """Shards of whole samples into the job's folder; rows of a sample must come together."""
        from pyspark import TaskContext

        system, base = _files(self.path)
        task = TaskContext.get()
        folder, files, held = f"{base}/{self.job}", [], []
        system.create_dir(folder, recursive=True)

        def put(name: str, arrays: dict[str, np.ndarray]) -> None:
            temporary = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(files)}.npz"
            out = io.BytesIO()
            np.savez_compressed(out, **arrays)
            with system.open_output_stream(temporary) as f:
                f.write(out.getvalue())
            files.append((temporary, name))

        def flush(rows: dict[str, np.ndarray]) -> None:
            if self.layout == "sdf":
                xyz = np.stack([rows[c] for c in "xyz"], axis=1)
                put(f"{rows['sid'][0]}.npz", {"sparse_index": xyz, "sparse_sdf": rows["sdf"][:, None], "edge_mask": rows["edge"], "resolution": np.array([int(xyz.max(initial=0)) + 1])})
            else:
                begins = np.flatnonzero(np.diff(rows["sid"], prepend=rows["sid"][:1] - 1))
                put(f"part-{task.partitionId():05d}-{len(files):05d}.npz", {"sids": rows["sid"][begins], "offsets": np.append(begins, len(rows["sid"])), **{c: rows[c] for c in ("x", "y", "z", "tok")}})

        for batch in iterator:
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
            rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]
            ends = np.append(np.flatnonzero(np.diff(rows["sid"])) + 1, len(rows["sid"]))  # ends of samples; the last may go on
            done = 0
            for e in ends[:-1]:
                if self.layout == "sdf" or e - done >= self.rows:
                    flush({c: v[done:e] for c, v in rows.items()})
                    done = e
            held = [{c: v[done:] for c, v in rows.items()}] if done < len(rows["sid"]) else []
        if held:
            flush({c: np.concatenate([h[c] for h in held]) for c in held[0]})
        return Moves(files)

    def commit(self, messages: list[Moves | None]) -> None:
        from pyarrow import fs

        system, base = _files(self.path)
        if self.overwrite:
            for i in system.get_file_info(fs.FileSelector(base, recursive=False, allow_not_found=True)):
                if i.is_file:
                    system.delete_file(i.path)
        names = []
        for m in messages:
            for temporary, name in m.files if m else ():
                system.move(temporary, f"{base}/{name}")
                names.append(name)
        self._clear(system, base)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/_SUCCESS") as f:
            f.write(json.dumps({"layout": self.layout, "shards": len(names)}).encode())

    def abort(self, messages: list[Moves | None]) -> None:
        self._clear(*_files(self.path))

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")


class VoxelShards(DataSource):
    """Options: ``path``, ``layout`` (csr or sdf), ``rows`` (voxels of a written shard), ``group`` (bytes a reading task takes)."""

    @classmethod
    def name(cls) -> str:
        return "voxel_shards"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("layout", "csr")]

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options["path"], self.options.get("layout", "csr"), schema, int(self.options.get("group", GROUP)))

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], self.options.get("layout", "csr"), int(self.options.get("rows", ROWS)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VoxelShards)


def write_shards(rows: DataFrame, path: str, layout: str = "csr", shards: int = 8, voxels: int = ROWS, mode: str = "append") -> None:
    """``rows`` as voxel shards: samples are dealt by hash to ``shards`` tasks and come together there, in order."""
    register(rows.sparkSession)
    names = [f.split()[0] for f in SCHEMAS[layout].split(", ")]
    dealt = rows.select(*names).repartition(shards, "sid").sortWithinPartitions("sid", "x", "y", "z")
    dealt.write.format("voxel_shards").option("layout", layout).option("rows", voxels).mode(mode).save(path)


def read_shards(spark: SparkSession, path: str, layout: str = "csr", group: int = GROUP) -> DataFrame:
    register(spark)
    return spark.read.format("voxel_shards").option("layout", layout).option("group", group).load(path)
