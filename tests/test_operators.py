"""Operators against numpy and plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions import space
from voxmill.operators import bpe3d, catalog, layout, sequence, stats, values, voxel, vq


def test_quantiles_equal_numpy(spark):
    r = random.Random(2)
    rows = [(k, r.choice((r.gauss(0, 1), float(r.randrange(3)), 1e6 * r.random()))) for k in "abc" for _ in range(400)] + [("one", 5.0), ("same", 2.0), ("same", 2.0), ("none", None)]
    asked = {"q0": 0.0, "q1": 0.013, "q5": 0.5, "q9": 0.987, "top": 1.0}
    got = {x.k: x for x in stats.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", asked, ranges=16).collect()}
    assert set(got) == {"a", "b", "c", "one", "same"}
    for k, row in got.items():
        own = [v for x, v in rows if x == k and v is not None]
        assert [row[n] for n in asked] == pytest.approx(list(np.quantile(own, list(asked.values()))))
    assert stats.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", asked).count() == 0


@pytest.mark.parametrize("alpha", [0.0, 1e-200, 1e-9, 0.5, 0.9, 0.99])
def test_trend_equals_recursion(spark, alpha):
    r = random.Random(1)
    rows = [(k, i, r.random() * 10) for k in (1, 2) for i in range(700 if k == 1 else 3)]
    got = {(x.k, x.i): x.trend for x in sequence.trend(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], ["i"], "v", alpha).collect()}
    for k in (1, 2):
        s = None
        for _, i, v in (x for x in rows if x[0] == k):
            s = v if s is None else alpha * s + (1 - alpha) * v
            assert got[k, i] == pytest.approx(s, rel=1e-9)


@pytest.mark.parametrize("alpha", [-0.1, 1.0, 1.5])
def test_trend_refuses_other_weights(spark, alpha):
    with pytest.raises(ValueError):
        sequence.trend(spark.createDataFrame([], "k int, i int, v double"), ["k"], ["i"], "v", alpha)


def test_numbered_is_the_global_order(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([(r.randrange(10**6),) for _ in range(3000)], "v long").repartition(7)
    got = catalog.numbered(rows, F.floor(F.col("v") / 1000), "v").orderBy("row").collect()
    assert [x.row for x in got] == list(range(3000)) and [x.v for x in got] == sorted(x.v for x in got)


def plain_train(samples, base, merges):
    """Rule by rule: all touching pairs counted anew, the most frequent key merged sample by sample in Z-order."""
    slots = [{i: (t, p, {p}) for i, (p, t) in enumerate(s.items())} for s in samples]
    rules = []
    for k in range(merges):
        n = Counter()
        found = []
        for s in slots:
            at = {c: i for i, (_, _, cells) in s.items() for c in cells}
            pairs = {(i, at[q]) for c, i in at.items() for d in space.FACES if (q := tuple(map(sum, zip(c, d, strict=True)))) in at and at[q] != i}
            keyed = defaultdict(list)
            for i, j in pairs:
                keyed[s[i][0], s[j][0], tuple(b - a for a, b in zip(s[i][1], s[j][1], strict=True))].append((i, j))
            found.append(keyed)
            n.update({key: len(v) for key, v in keyed.items()})
        if not n or max(n.values()) < 2:
            break
        key = min(n, key=lambda x: (-n[x], x))
        rules.append((key, base + k))
        for s, keyed in zip(slots, found, strict=True):
            used = set()
            for i, j in sorted(keyed.get(key, []), key=lambda p: bpe3d._key(s[p[0]][1])):
                if i not in used and j not in used:
                    used |= {i, j}
                    (_, p, a), (_, q, b) = s[i], s.pop(j)
                    s[i] = (base + k, min(p, q), a | b)
    return rules, [sorted((p, t) for t, p, _ in s.values()) for s in slots]


def test_training_and_encoding_equal_plain_python(spark):
    r = random.Random(11)
    samples = [{(x, y, z): r.randrange(3) for x in range(5) for y in range(5) for z in range(5) if r.random() < 0.8} for _ in range(3)]
    rows = [(i, *p, t) for i, s in enumerate(samples) for p, t in s.items()]
    leaves = spark.createDataFrame(rows, "sid int, x int, y int, z int, token long")
    rules = bpe3d.train(leaves, 3, 8)
    want, left = plain_train(samples, 3, 8)
    assert [((q.a, q.b, tuple(q.rel)), q.new_id) for q in rules] == want
    got = bpe3d.encode(leaves, rules).collect()
    assert [sorted(((x.x, x.y, x.z), x.token) for x in got if x.sid == i) for i in range(3)] == left
    back = bpe3d.decode(bpe3d.encode(leaves, rules), rules, 3).collect()
    assert sorted((x.sid, x.x, x.y, x.z, x.token) for x in back) == sorted(rows)


def test_training_stops(spark):
    """No pair at all, no pair of the least frequency, or the number of rules."""
    lone = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 2, 2, 2, 1)], "sid int, x int, y int, z int, token long")
    assert bpe3d.train(lone, 4, 3) == []
    pair = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 1, 0, 0, 2)], "sid int, x int, y int, z int, token long")
    assert bpe3d.train(pair, 4, 3) == [] and len(bpe3d.train(pair, 4, 3, min_freq=1)) == 1


def test_blocks_in_texts(spark):
    mesh = lambda *p: "<mesh_start>" + "".join(f"<morton_{m}><mesh_{i}>" for m, i in p) + "<mesh_end>"
    rule = bpe3d.with_leaves([bpe3d.Rule(0, 8, 1, 2, (1, 0, 0))])
    block = mesh((0, 1), (1, 2), (7, 5))
    rows = [(1, f"a {block} b {block}"), (2, "no block"), (3, None), (4, "<mesh_start><mesh_end>"), (5, block)]
    got = {x.id: x.text for x in bpe3d.apply_to_texts(spark.createDataFrame(rows, "id int, text string"), "text", rule, 8).collect()}
    new = mesh((0, 8), (7, 5))
    assert got == {1: f"a {new} b {new}", 2: "no block", 3: None, 4: "<mesh_start><mesh_end>", 5: new}
    broken = spark.createDataFrame([(1, "<mesh_start><mesh_3><mesh_end>")], "id int, text string")
    with pytest.raises(Exception, match="no valid pairs"):
        bpe3d.apply_to_texts(broken, "text", rule, 8).collect()


def test_texts_are_dealt_over_tasks_that_grow_with_characters(spark):
    """every shuffle of blocks, codes and texts has the number of tasks that the characters ask for; copies in many texts, repeated and lone places, and order stay right."""
    mesh = lambda *p: "<mesh_start>" + "".join(f"<morton_{m}><mesh_{i}>" for m, i in p) + "<mesh_end>"
    rule = bpe3d.with_leaves([bpe3d.Rule(0, 8, 1, 2, (1, 0, 0))])
    common, own = mesh((1, 2), (0, 1), (7, 5), (7, 4)), lambda k: mesh((k, 3), (k + 1, 9))
    rows = [(k, f"{k} {common}\n{own(k)} - {common if k % 2 else ''}") for k in range(60)] + [(60, ""), (61, "<mesh_start> <mesh_end>")]
    new = mesh((0, 8), (7, 4))
    want = {k: t.replace(common, new).replace(own(k), mesh((k, 3))) for k, t in rows}
    texts = spark.createDataFrame(rows, "id int, text string").repartition(3)
    done = bpe3d.apply_to_texts(texts, "text", rule, 8, chars=500)
    assert {r.id: r.text for r in done.collect()} == want
    n = sum(len(t) for _, t in rows) // 500 + 1
    plan = done._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(\w+#\d+L?, (\d+)\)", plan)
    assert n > 8 and dealt and set(dealt) == {str(n)} and "ENSURE_REQUIREMENTS" not in plan


def test_distances_between_footprints(spark):
    a = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 0), (3, 5, 5, 5), (4, 1, 1, 1)], "sid int, x int, y int, z int")
    b = spark.createDataFrame([(1, 0, 0, 1), (1, 9, 9, 9), (2, 10, 10, 3), (3, 5, 5, 5)], "sid int, x int, y int, z int")
    assert sorted((r.sid, r.l1) for r in layout.nearest_l1(a, b, 93).collect()) == [(1, 1), (2, 23), (3, 0)]


def test_distances_of_far_footprints(spark):
    r = random.Random(3)
    clouds = {s: [(k, r.randrange(20) + (70 * k if s == "b" else 0), r.randrange(20), r.randrange(-9, 9)) for k in range(4) for _ in range(30)] for s in "ab"}
    a, b = (spark.createDataFrame(clouds[s], "sid int, x int, y int, z int") for s in "ab")
    want = {k: min(sum(abs(i - j) for i, j in zip(p[1:], q[1:], strict=True)) for p in clouds["a"] for q in clouds["b"] if p[0] == q[0] == k) for k in range(4)}
    assert {x.sid: x.l1 for x in layout.nearest_l1(a, b, 500).collect()} == want
    assert {x.sid for x in layout.nearest_l1(a, b, want[2]).collect()} == {0, 1, 2}


def test_layout_errors(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 1, 32), (2, 0, 0, 0, 1, 64)], "sid int, x int, y int, z int, tok int, res int")
    with pytest.raises(Exception, match="resolutions differ"):
        layout.collate(rows, 2, F.col("res")).collect()
    with pytest.raises(ValueError, match="unknown policy"):
        layout.fit_limit(rows, 1, "cut", space.morton())
    with pytest.raises(Exception, match="larger than the target"):
        spark.range(1).select(*values.pad_amounts([F.lit(600)], F.lit(512))).collect()
    with pytest.raises(Exception, match="keys in both"):
        spark.range(1).select(values.merged_maps(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2")))).collect()


def test_small_values(spark):
    row = spark.range(1).select(values.angle([F.lit(1.0), F.lit(0.5), F.lit(0.5)], [F.lit(0.5), F.lit(1.0), F.lit(0.5)]).alias("right"), values.angle([F.lit(0.5)] * 3, [F.lit(1.0)] * 3).alias("none"), values.radical_inverse(F.lit(6), 2, 32).alias("r"), values.size_text(F.lit(None).cast("long")).alias("s")).first()
    assert row.right == pytest.approx(90) and row.none is None and row.r == 0.375 and row.s == "n/a"
    assert vq.kmeans(spark.createDataFrame([], "i long, p array<double>"), "i", "p", 3, 2).count() == 0


def test_views_need_no_shuffle_of_corners(spark):
    points = spark.createDataFrame([(1, 0, 0.5, 0.5), (2, 0, 0.0, 0.25), (3, 9, 0.5, 0.5)], "k int, pose int, u double, v double")
    maps = spark.createDataFrame([(0, 2, [1.0, 2.0, 3.0, None])], "pose int, views long, cells array<double>")
    got = layout.sample_views(points, F.broadcast(maps), ["k"], 2)
    assert {r.k: (r.views, r.feature) for r in got.collect()} == {1: (2, 0.75), 2: (2, 0.25)}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_of_dealt_samples_need_no_shuffle(spark):
    """neighbours come from one pass over each sample; across slabs, far apart, below zero, repeated."""
    from voxmill.operators import voxel

    r = random.Random(5)
    side = [[0, 63, 64, -1, -64, 2000000000], [0, 65536, -3, 1], [0, 1, 65536, 65537]]
    rows = [(r.randrange(2), *(r.choice([*s, r.randrange(4)]) for s in side), r.randrange(9)) for _ in range(200)] + [(0, None, 0, 0, 1), (None, 0, 0, 0, 1)]
    df = spark.createDataFrame(rows, "sid int, x int, y int, z int, tok int").repartition(3, "sid")
    found = voxel.neighbours(df, [(1, 0, 0), (-1, 1, 0)])
    whole = [a for a in rows if None not in a]
    want = [(*a, *d, *(p + q for p, q in zip(a[1:4], d)), b[4]) for a in whole for d in ((1, 0, 0), (-1, 1, 0)) for b in whole if a[0] == b[0] and tuple(p + q for p, q in zip(a[1:4], d)) == b[1:4]]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.select("sid")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the dealing itself


def test_cubes_in_groups_equal_brute_force_without_a_row_for_each_voxel(spark):
    """rows that repeat, that leave the cube or have a null coordinate, and cubes below zero; no aggregate has the coordinates as keys."""
    cube = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    moved = lambda d: [tuple(a + b for a, b in zip(v, d, strict=True)) for v in cube]
    groups = [cube, moved((5, 7, 2)), moved((-3, -1, -8)), [*cube[:7], cube[0]], [*cube[:7], (3, 1, 1)], [*cube[:7], (None, 1, 1)], [(x, 0, 0) for x in range(8)], cube[:4] * 2]
    rnd = random.Random(3)
    groups += [[tuple(rnd.randrange(2) for _ in range(3)) for _ in range(8)] for _ in range(300)] + [cube[:5]]
    rows = [(i % 3, i * 8 + j, *v) for i, g in enumerate(groups) for j, v in enumerate(g)]
    out = sequence.cubes_in_groups(spark.createDataFrame(rows, "sid int, code long, x int, y int, z int"), ["sid"], ["code"])
    want = {s: (sum(len(g) == 8 for g in groups[s::3]), sum(sorted(g) == sorted(set(g)) and len(g) == 8 and all(max(a) - min(a) == 1 for a in zip(*g, strict=True)) for g in groups[s::3] if all(None not in v for v in g))) for s in range(3)}
    assert {r.sid: (r.groups, r.cubes) for r in out.collect()} == want and sum(c for _, c in want.values()) >= 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Aggregate\(keys=\[([^]]*)\]", plan)
    assert keys and not any(re.search(r"\bx#", k) for k in keys)


@pytest.mark.parametrize(("radius", "resolution"), [(1, 32), (2, 64), (3, 100), (0, 1)])
def test_dilation_equals_brute_force_without_a_row_for_each_cell(spark, radius, resolution):
    """voxels at and beyond the grid's edges, repeated ones and nulls; no aggregate has the three coordinates as keys."""
    rnd = random.Random(5)
    place = lambda: rnd.choice([-radius - 1, -radius, -1, 0, 1, 31, 32, 63, 64, resolution - 1, resolution, resolution + radius, rnd.randrange(resolution)])
    rows = [(i % 3, place(), place(), place()) for i in range(60)]
    rows += rows[:5] + [(1, None, 0, 0), (1, 0, None, 0), (1, 0, 0, None), (None, 0, 0, 0)]
    out = voxel.dilate(spark.createDataFrame(rows, "sid int, x int, y int, z int"), radius, resolution)
    steps = range(-radius, radius + 1)
    want = {(s, x + a, y + b, z + c) for s, x, y, z in rows if None not in (x, y, z) for a in steps for b in steps for c in steps}
    want = {w for w in want if all(0 <= v < resolution for v in w[1:])}
    got = [tuple(r) for r in out.collect()]
    assert out.dtypes == [("sid", "int"), ("x", "int"), ("y", "int"), ("z", "int")] and len(got) == len(set(got)) and set(got) == want
    keys = re.findall(r"Aggregate\(keys=\[([^]]*)\]", out._jdf.queryExecution().executedPlan().toString())
    assert keys and not any(re.search(r"\bn?z#", k) for k in keys)
