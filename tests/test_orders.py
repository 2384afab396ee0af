import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions import space
from voxmill.operators import bpe3d as B
from voxmill.operators import orders, stats, voxel
from voxmill.plans.study_queries import ORDERS

CODES = {"raster": lambda x, y, z: (x * 32 + y) * 32 + z, "transposed": lambda x, y, z: space.morton_codes(y, x, z)}
COLUMNS = {"raster": lambda: space.raster((32, 32, 32)), "transposed": lambda: space.morton("y", "x", "z")}


@pytest.fixture
def leaves(spark):
    r = random.Random(11)
    places = {(s, r.randrange(9), r.randrange(4), r.randrange(4)): r.randrange(2) for s in range(5) for _ in range(80)}
    return spark.createDataFrame([(*p, t) for p, t in places.items()], "sid int, x int, y int, z int, token bigint")


def test_codes_of_arrays_equal_columns(spark):
    grid = spark.range(32**3).select(*((F.floor(F.col("id") / 32**k) % 32).cast("int").alias(c) for k, c in enumerate("xyz")))
    columns = {"morton": space.morton(), "hilbert": space.hilbert(), "raster": space.raster((32, 32, 32)), "zyx": space.raster((32, 32, 32), "z", "y", "x"), "transposed": space.morton("y", "x", "z")}
    got = grid.select("x", "y", "z", *(c.alias(n) for n, c in columns.items())).toPandas()
    at = [got[c].to_numpy(np.int64) for c in "xyz"]
    assert set(ORDERS) == set(columns)
    for name, (code, _) in ORDERS.items():
        assert (code(*at) == got[name].to_numpy()).all(), name


def test_panel_equals_tables_without_joins_or_windows(spark, leaves):
    """one pass a round trains all orders and one counts gaps and distances, as the table operators do order by order."""
    corpus = B.Corpus(leaves)
    rules = corpus.learn(2, 3, last=False)
    learned = orders.train(corpus, CODES, 2, 2)
    panel = orders.panel(corpus, CODES, rules, learned)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    got = {tuple(r[:4]): r.n for r in panel.collect()}
    want: Counter = Counter()
    owned = B.owners(B.encode(leaves, rules), rules, 2)
    for i, (name, column) in enumerate(COLUMNS.items()):
        seq = voxel.ranked(leaves, column(), "pos").select("sid", "pos", "token", F.array(F.struct("x", "y", "z")).alias("cells"))
        assert learned[i] == B.train_1d(seq.select("sid", "pos", "token"), 2, 2)[0] and len(learned[i]) == 2
        for rule in learned[i]:
            seq, dist = B.merge_1d_traced(seq, *rule)
            want.update((name, "1d", "l1", r.l1) for r in dist.collect())
        one = seq.select("sid", F.explode("cells").alias("c"), "pos").select("sid", "c.*", "pos")
        anchors = voxel.ranked(B.encode(leaves, rules), column(), "pos").select("sid", F.struct("x", "y", "z", "token").alias("own"), "pos")
        for encoder, places in (("1d", one), ("3d", owned.join(anchors, ["sid", "own"]).drop("own"))):
            want.update((name, encoder, "gap", abs(r.other - r.pos)) for r in voxel.neighbours(places, value="pos").collect())
        want[(name, "3d", "l1", 1)] = leaves.count() - B.encode(leaves, rules).count()
    assert got == want


def test_weighted_quantiles_equal_unfolded_rows(spark):
    rows = spark.createDataFrame([("a", 3, 4), ("a", 9, 1), ("a", 5, 2), ("b", 1, 1), ("b", None, 7)], "k string, v int, n bigint")
    asked = {"p50": 0.5, "p90": 0.9}
    unfolded = rows.select("k", "v", F.explode(F.sequence(F.lit(1), "n")))
    assert sorted(stats.quantiles(rows, ["k"], "v", asked, weight="n").collect()) == sorted(stats.quantiles(unfolded, ["k"], "v", asked).collect())
