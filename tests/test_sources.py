import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import catalog, sequence
from voxmill.sources import readers as R
from voxmill.sources import writers as W


def test_catalogs_of_several_roots(spark, tmp_path):
    for i, head in enumerate(("sha256,score", "sha256,score,extra")):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}" / "metadata.csv").write_text(head + "\na,1" + (",x" if i else "") + "\n")
    got = R.read_catalog(spark, f"{tmp_path}/r0,{tmp_path}/r1")
    assert got.count() == 2 and "extra" in got.columns
    with pytest.raises(ValueError, match="local_path"):
        catalog.require(got, "sha256", "local_path")


def test_listing_pairs_and_maps(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("a/c1_img.nii", "a/c2_img.nii", "a/skip.txt"):
        (tmp_path / n).write_text("x")
    files = R.list_files(spark, str(tmp_path), ["nii"])
    assert sorted(r.relpath for r in files.collect()) == ["a/c1_img.nii", "a/c2_img.nii"]
    labels = spark.createDataFrame([("/l/c1_seg.nii",)], "path string")
    paired = {r.case_id: r.label_path for r in R.pair_by_case(files, labels).collect()}
    assert paired == {"c1": "/l/c1_seg.nii", "c2": None}
    (tmp_path / "m.json").write_text(json.dumps({"k": "v", "q": "w"}))
    assert {(r.key, r.path) for r in R.path_map(spark, f"{tmp_path}/m.json").collect()} == {("k", "v"), ("q", "w")}


def test_archives_and_bad_files(spark, tmp_path):
    np.savez(tmp_path / "a.npz", sparse_sdf=np.array([[0.5], [1.0]], np.float32), sparse_index=np.array([[1, 2, 3], [4, 5, 6]], np.int32))
    np.savez(tmp_path / "b.npz", sparse_sdf=np.array([[0.5]], np.float32), sparse_index=np.array([[1, 2, 3]], np.int32), edge_mask=np.array([True]))
    (tmp_path / "c.npz").write_bytes(b"no zip")
    rows = R.read_voxel_archives(spark, str(tmp_path)).collect()
    assert sum(r.error is None for r in rows) == 3 and sum(r.error is not None for r in rows) == 1 and sum(bool(r.edge) for r in rows) == 1


def test_log_and_jsonl(spark, tmp_path):
    line = "[LOSS-SUMMARY] step=61 | n_in=82566 | n_sharp=12898 | n_extra=375113 | n_oor=20433519 | ..."
    rows = R.parse_log(spark.createDataFrame([(line,), ("noise",), ("[LOSS-SUMMARY] step=1 | n_in=0 | n_sharp=0 | n_extra=0 | n_oor=0",)], "value string")).collect()
    assert len(rows) == 1 and rows[0].step == 61 and rows[0].m_out == 82566 + 12898 + 375113 + 20433519
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in R.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int").collect() if r.a is not None) == [1, 2]


def test_foreach_keeps_errors(spark):
    def half(row):
        return None if row["a"] == 3 else {"a": 10 // row["a"]}

    got = R.foreach_instance(spark.createDataFrame([(2,), (0,), (3,)], "a bigint"), half, "a bigint").collect()
    assert sorted((r.a, r.error is not None) for r in got) == [(0, True), (5, False)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, ["a", "b"]), (1, [])], "k int, l array<string>")
    W.write_csv(df, f"{tmp_path}/csv")
    assert sorted(r.l for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()) == ['["a","b"]', "[]"]
    W.write_jsonl(df, f"{tmp_path}/jsonl", "k")
    assert spark.read.json(f"{tmp_path}/jsonl").count() == 2
    W.write_document(spark, {"a": [1, 2]}, f"{tmp_path}/doc")
    assert W.read_document(spark, f"{tmp_path}/doc") == {"a": [1, 2]}
    n = spark.createDataFrame([(0,), (1,), (3,)], "shard int")
    assert sorted(r.n for r in W.shards_before_gap(n).collect()) == [0, 1]
    assert W.shards_before_gap(n.where("shard > 0")).count() == 0
    leaves = spark.createDataFrame([(i % 5, i, 0, 0, 1) for i in range(20)], "sid int, x int, y int, z int, token bigint")
    W.write_corpus(leaves, f"{tmp_path}/corpus", 3)
    assert spark.read.parquet(f"{tmp_path}/corpus").count() == 20


def test_small_operators(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    assert [r.row for r in catalog.numbered(df, F.floor(F.col("id") / 4), "id").orderBy("id").collect()] == list(range(10))
    assert sequence.balanced_groups([(1, 5.0), (2, 4.0), (3, 3.0), (4, 3.0)], 2) == [(1, 0), (2, 1), (3, 1), (4, 0)]


def test_older_archives_masks_and_time_limits(spark, tmp_path):
    """A dense grid is read as its band; masks take their shape from the file name; a row that takes too long is an error."""
    import time

    import numpy as np

    from voxmill.sources import readers

    grid = np.ones((4, 4, 4), np.float32)
    grid[1, 2, 3] = -0.5
    (tmp_path / "npz").mkdir()
    np.savez(tmp_path / "npz" / "old.npz", sdf=grid)
    np.savez(tmp_path / "npz" / "new.npz", sparse_index=np.array([[0, 1, 9]]), sparse_sdf=np.array([0.25]), resolution=np.array([8]))
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.read_voxel_archives(spark, str(tmp_path / "npz")).collect()}
    assert (got["old.npz"].x, got["old.npz"].y, got["old.npz"].z, got["old.npz"].sdf, got["old.npz"].edge) == (1, 2, 3, -0.5, False)
    assert "beyond the resolution" in got["new.npz"].error
    mask = np.zeros((2, 3, 4, 5))
    mask[1, 2, 3, 4] = 7
    flat = mask.reshape(2, -1)
    (tmp_path / "masks").mkdir()
    cols = np.nonzero(flat[1])[0]
    np.savez(tmp_path / "masks" / "mask_(2, 3, 4, 5).npz", indptr=np.array([0, 0, 1]), indices=cols, data=flat[1][cols])
    np.savez(tmp_path / "masks" / "mask.npz", indptr=np.array([0]), indices=np.array([]), data=np.array([]))
    rows = readers.read_csr_masks(spark, str(tmp_path / "masks")).collect()
    assert sorted((r.channel, r.x, r.y, r.z, r.value) for r in rows if r.error is None) == [(1, 2, 3, 4, 7.0)] and sum(r.error is not None for r in rows) == 1

    def slow(row):
        time.sleep(3 if row["id"] == 1 else 0)
        return {"id": row["id"]}

    out = {r.id: r.error for r in readers.foreach_instance(spark.range(3), slow, "id bigint", seconds=1.0).collect()}
    assert out[0] is None and out[2] is None and "took more than" in out[1]


def test_csv_holds_whole_lists(spark):
    from voxmill.plans.registry import QUERIES

    from .oracle import SF

    got = QUERIES["csv_lists"](spark, SF).collect()
    assert len(got) == len({r.k for r in got})  # a row for each key, its list uncut
    assert sum(r.n for r in got) == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_a_shard_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(4000).selectExpr("cast(id % 40 as int) as sid", "id as tok").repartition(4)
    W.write_corpus(rows, f"{tmp_path}/corpus", 2)
    assert len(list(tmp_path.glob("corpus/shard=0/*.parquet"))) == 4
    assert spark.read.parquet(f"{tmp_path}/corpus").count() == 4000
