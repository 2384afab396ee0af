"""Every page takes part in the join of paths with the catalog."""

from voxmill.plans.registry import QUERIES


def test_every_page_takes_part(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.example.com/en/{i // 2}") for i in range(90, 310)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, QUERIES["inner_paths_whole"](spark, str(tmp_path)).collect()))
    assert got == sorted({(i, u) for i, _ in rows for j, u in rows if i // 2 == j // 2})
