from pyspark.sql import functions as F

from voxmill.llm import url_filter as U
from voxmill.llm.common import Written


def test_parts_and_rules(spark):
    rows = [
        ("http://A.example.com/en/1?x=/es/", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://x.www.example.com/en/2#f", "x.www.example.com", "/en/2", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://x.net/es/a", "x.net", "/es/a", "net/es/", "block"),
        ("http://x.net/ES/a", "x.net", "/ES/a", None, "allow"),
        ("http://com", "com", "", None, "allow"),
        ("http://spam-farm.example.org?q", "spam-farm.example.org", "", None, "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("x://a://b/c", "a:", "//b/c", None, "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], "x", "y") for i, r in enumerate(rows)], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("spam-farm.example.org",), ("spam-farm.example.org",), (None,), ("www.example.com",), ("not.seen",)], "host string")
    for limit in (U.MAX_BYTES, 1):  # one part, and several
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, listed, max_bytes=limit).collect()}
        assert got == {i: r[1:] for i, r in enumerate(rows)}
    assert U.judge(df.where("false"), listed).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(3000).select(F.concat(F.lit("host"), "id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(7)) == 0).alias("listed"))
    c = U.build_cascade(keys, Written(spark, "test"))
    assert len(c.levels) > 1
    assert keys.where(c.contains(F.col("key")) != F.col("listed")).count() == 0


def test_many_parts_equal_one(spark):
    """A list unrelated to the pages' planted hosts, larger than a part may be: the same verdicts by several cascades."""
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 700, F.lit(".test/x")).alias("url"))
    listed = spark.range(0, 900, 3).select(F.concat(F.lit("h"), "id", F.lit(".test")).alias("host"))
    want = {(i, "block" if i % 700 % 3 == 0 else "allow") for i in range(2000)}
    for limit in (U.MAX_BYTES, 100):
        assert {(r.page_id, r.verdict) for r in U.judge(pages, listed, max_bytes=limit).collect()} == want
