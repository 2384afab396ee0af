"""Shared helpers: table access and lineage cuts in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read by Spark alone (the path may be on any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only in local mode, where there are no other machines, a temporary one is made if none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="voxmill-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


class Written:
    """Tables written to the shared folder in order to cut lineage; ``drop`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/voxmill-{label}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it again: what follows no longer depends on its lineage."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._voxmill_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._voxmill_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def hash_share(rows: DataFrame, n: int, key: str = "doc_id", total: int | None = None) -> DataFrame:
    """About 2 n + 1000 rows, those of the least hashes of ``key``: what a top-n after it gathers doesn't grow with the input. ``total`` may overstate the rows."""
    total = rows.count() if total is None else total
    span = 1 << 40
    return rows.where(F.pmod(F.xxhash64(key), F.lit(span)) < min(span, (2 * n + 1000) * span // max(1, total)))


def hash_sample(rows: DataFrame, n: int, *ties: str, key: str = "doc_id", total: int | None = None) -> DataFrame:
    """The n rows least by the hash of ``key`` (ties by the other columns named)."""
    return hash_share(rows, n, key, total).orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 40)), key, *ties).limit(n)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the rows (crc32 of the id as text) that no fitting may read; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def add_columns(df: DataFrame, inputs: list[str], fields: dict[str, str], make, drop: tuple[str, ...] = ()) -> DataFrame:
    """One narrow Arrow pass that appends computed columns; the others travel untouched as Arrow data.

    ``make()`` is called once for each partition and returns a function from one list of Python values
    for each input to one list for each field. Columns of ``df`` that clash with a field are replaced.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    carried = [c for c in df.columns if c not in fields and c not in drop]
    made = _parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in fields.items()))
    schema = StructType([*(df.schema[c] for c in carried), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(made)
        of = make()
        for b in batches:
            if not b.num_rows:
                continue
            out = of(*(b.column(c).to_pylist() for c in inputs))
            arrays = [*(b.column(c) for c in carried), *(pa.array(x, f.type) for x, f in zip(out, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *fields])

    return df.select(*dict.fromkeys([*carried, *inputs])).mapInArrow(run, schema)
