"""The voxel shard source and sink: both layouts, broken files, jobs that fail."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import layout
from voxmill.sources import shards as S


def voxels(spark, n=6):
    rows = [(s, i % 7, i // 7 % 7, i // 49, (s + i) % 5) for s in range(n) for i in range(40 * s + 1)]
    return spark.createDataFrame(rows, "sid int, x int, y int, z int, tok int")


def test_round_trip_in_small_shards_and_groups(spark, tmp_path):
    v = voxels(spark)
    S.write_shards(v, f"{tmp_path}/a", shards=3, voxels=50)
    names = sorted(os.listdir(f"{tmp_path}/a"))
    assert "_SUCCESS" in names and not [n for n in names if n.startswith("_job")] and len(names) > 4
    for group in (1, 1 << 30):
        got = S.read_shards(spark, f"{tmp_path}/a", group=group)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, v.collect()))
    assert S.read_shards(spark, f"{tmp_path}/a", group=1).rdd.getNumPartitions() > 3
    for f in (n for n in names if n.endswith(".npz")):
        with np.load(f"{tmp_path}/a/{f}") as z:
            assert z["offsets"][0] == 0 and z["offsets"][-1] == len(z["tok"]) and len(set(z["sids"])) == len(z["sids"])


def test_overwrite_replaces_and_an_empty_table_has_no_rows(spark, tmp_path):
    S.write_shards(voxels(spark), f"{tmp_path}/a", shards=2)
    S.write_shards(voxels(spark, 2), f"{tmp_path}/a", shards=1, mode="overwrite")
    assert S.read_shards(spark, f"{tmp_path}/a").count() == 42
    S.write_shards(voxels(spark).limit(0), f"{tmp_path}/b")
    assert S.read_shards(spark, f"{tmp_path}/b").count() == 0


def test_a_failed_task_leaves_no_shard(spark, tmp_path):
    bad = voxels(spark).repartition(3, "sid").withColumn("tok", F.when((F.col("sid") == 5) & (F.col("x") == 3), F.raise_error(F.lit("broken row")).cast("int")).otherwise(F.col("tok")))
    S.register(spark)
    with pytest.raises(Exception, match="broken row"):
        bad.write.format("voxel_shards").mode("append").save(f"{tmp_path}/a")
    left = [f for _, _, files in os.walk(f"{tmp_path}/a") for f in files]
    assert not left


def test_archives_of_both_layouts(spark, tmp_path):
    rows = spark.createDataFrame([(s, i, 2 * i, s, 0.1 * i, i % 2 == 0) for s in range(4) for i in range(s + 1)], "sid int, x int, y int, z int, sdf float, edge boolean")
    S.write_shards(rows, f"{tmp_path}/s", "sdf", shards=2)
    assert sorted(n for n in os.listdir(f"{tmp_path}/s") if n.endswith("npz")) == [f"{i}.npz" for i in range(4)]
    assert sorted(map(tuple, S.read_shards(spark, f"{tmp_path}/s", "sdf").collect())) == sorted(map(tuple, rows.collect()))
    grid = np.full((3, 3, 3), 2.0, np.float32)
    grid[1, 2, 0] = -0.5
    np.savez(f"{tmp_path}/s/77.npz", sdf=grid)
    np.savez(f"{tmp_path}/s/78.npz", sparse_index=np.array([[1, 1, 1]]), sparse_sdf=np.array([0.5]))
    got = [tuple(r) for r in S.read_shards(spark, f"{tmp_path}/s", "sdf").where("sid > 70").orderBy("sid").collect()]
    assert got == [(77, 1, 2, 0, -0.5, False), (78, 1, 1, 1, 0.5, False)]


@pytest.mark.parametrize(("name", "arrays", "error"), [
    ("1.npz", {"sparse_index": [[9, 0, 0]], "sparse_sdf": [0.1], "resolution": [4]}, "beyond the resolution"),
    ("2.npz", {"sparse_index": [[1, 0, 0]], "sparse_sdf": [0.1, 0.2]}, "as many values"),
])
def test_broken_archives_name_their_file(spark, tmp_path, name, arrays, error):
    np.savez(f"{tmp_path}/{name}", **{k: np.array(v) for k, v in arrays.items()})
    with pytest.raises(Exception, match=error) as e:
        S.read_shards(spark, str(tmp_path), "sdf").collect()
    assert name in str(e.value)


def test_csr_cells_and_their_errors(spark):
    rows = [
        (1, [2, 1, 2, 2], [0, 1, 3], [3, 0, 2], [1.0, 2.0, 3.0]), (2, [2, 1, 2, 2], [0, 0, 0], [], []), (3, [2, 2], [0, 1], [0], [1.0]), (4, [2, 1, 2, 2], [0, 1], [0], [1.0]), (5, [2, 1, 2, 2], [0, 2, 1], [0], [1.0]),
        (6, [2, 1, 2, 2], [0, 1, 2], [0], [1.0]), (7, [2, 1, 2, 2], [0, 0, 1], [4], [1.0]), (8, [2, 1, 2, 2], None, [4], [1.0]), (9, [2, 1, 2, 2], [1, 1, 1], [0], [1.0]), (10, [0, 1, 2, 2], [0], [], []),
    ]
    got = layout.csr_cells(spark.createDataFrame(rows, "k int, shape array<int>, indptr array<int>, indices array<int>, data array<double>"), "k").collect()
    assert sorted(tuple(r)[:6] for r in got if r.error is None) == [(1, 0, 0, 1, 1, 1.0), (1, 1, 0, 0, 0, 2.0), (1, 1, 0, 1, 0, 3.0)]
    errors = {r.k: r.error for r in got if r.error}
    assert sorted(errors) == [3, 4, 5, 6, 7, 8, 9] and "beyond" in errors[7] and "rise" in errors[5] and "rise" in errors[9] and "last pointer" in errors[6] and errors[8] == "missing part"


def test_csr_cells_expand_in_one_pass(spark):
    df = spark.createDataFrame([(1, [2, 1, 2, 2], [0, 1, 1], [3], [1.0])], "k int, shape array<int>, indptr array<int>, indices array<int>, data array<double>")
    plan = layout.csr_cells(df, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and "Union" not in plan  # no copy of the arrays for each row of a matrix
