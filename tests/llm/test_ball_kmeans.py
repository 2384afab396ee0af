import hashlib

import numpy as np
import pytest

from voxmill.llm import ball_kmeans as B

from ..oracle import SF, connect, same

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def lloyd(rows, k, rounds, dims, scale):
    """(vec_id, cluster, distance) by plain loops over (vec_id, vector)."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[1]))
    centres = [v for _, v in order[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for n in range(rounds + 1):
        of = [min((away(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if n < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, c) in zip(kept, of, strict=True) if c == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    inertia = [sum(d for d, c in of if c == j) for j in range(len(centres))]
    return sorted(repr((i, c, d, inertia[c], sum(inertia), digest[c])) for (i, _), (d, c) in zip(kept, of, strict=True))


def clustered(spark, rows, k, rounds=3, dims=4, scale=64.0):
    found = B.cluster(B.quantised(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA), dims=dims, scale=scale), k, rounds)
    return sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in found.collect())


def test_query_equals_sql(spark):
    same(B.op12_ball_kmeans(spark, SF), connect(), B.OP12_SQL)


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_loops_with_ties_and_odd_rows(spark, seed):
    rng = np.random.default_rng(seed)
    step = (0.25, 1.0, 0.01, 0.5)[seed]  # coarse grids: many equal distances
    rows = [(int(i), (np.round(rng.normal(size=4) / step) * step).tolist()) for i in rng.permutation(300)]
    rows += rows[:40] + [(None, rows[0][1]), (None, rows[1][1]), (900, None), (901, [1.0]), (902, []), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan")] * 4), (905, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(1000, [0.5, 0.5, 0.5, 0.5])] * 200  # one vector with a third of the rows
    assert clustered(spark, rows, 7) == lloyd(rows, 7, 3, 4, 64.0)


def test_few_or_no_vectors(spark):
    rows = [(1, [0.0, 0.0, 1.0, 1.0]), (2, [5.0, 0.0, 1.0, 1.0])]
    assert clustered(spark, rows, 16) == lloyd(rows, 16, 3, 4, 64.0)
    assert clustered(spark, [(3, None)], 16) == []
    assert clustered(spark, rows[:1] * 9, 3) == lloyd(rows[:1] * 9, 3, 3, 4, 64.0)  # equal centroids: the smaller number, empty ones stay


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="beyond the range"):
        B.quantised(spark.createDataFrame([(1, [3e7, 0.0, 0.0, 0.0], "x", 1)], SCHEMA), dims=4).collect()


def test_balls_spare_comparisons_and_agree_with_full_ones():
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (12, 8))
    x = np.concatenate([c + rng.integers(-60, 60, (200, 8)) for c in centres])
    own, _ = B.assign_all(x, centres)
    moved = np.array([x[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else centres[j] for j in range(12)])
    between = np.stack([B.squared(moved, c) for c in moved])
    label, distance, compared = B.reassign(x, own, moved, between)
    full = B.assign_all(x, moved)
    assert (label == full[0]).all() and (distance == full[1]).all()
    assert compared < len(x) * 12 / 3
    # a member beyond half the way to a neighbour is compared with it, one on the very middle too
    line = np.array([[0], [4], [5], [6], [10]])
    label, distance, compared = B.reassign(line, np.array([1, 1, 1, 1, 1]), np.array([[0], [10]]), np.array([[0, 100], [100, 0]]))
    assert label.tolist() == [0, 0, 0, 1, 1] and distance.tolist() == [0, 16, 25, 16, 0] and compared == 5 + 3
