import numpy as np
import pytest

from voxmill.llm import topk as T


def brute(ids, m, q, own, k):
    s = m[:, : len(q)] @ q[: m.shape[1]]
    rows = sorted((-int(s[i]), int(ids[i])) for i in range(len(ids)) if ids[i] != own)[:k]
    return [(-a, b) for a, b in rows]


@pytest.mark.parametrize("kind", ["dense", "sparse", "ties", "negative", "skew"])
def test_shard_search_is_exact(kind):
    r = np.random.default_rng(3)
    n, d = 5000, 24
    m = np.rint(r.normal(0, 40, (n, d))).astype(np.int64)
    if kind == "sparse":
        m[r.random((n, d)) < 0.9] = 0
    if kind == "ties":
        m = r.integers(-1, 2, (n, d))
    if kind == "negative":
        m = -np.abs(m)
    if kind == "skew":
        m = (m * np.logspace(0, -2, d)).astype(np.int64)
    ids = r.permutation(n).astype(np.int64)
    s = T.Shard(ids, m)
    for i in range(25):
        q = m[i] if kind != "negative" else np.abs(m[i])
        a, b = s.search(q, int(ids[i]), 5)
        assert [(int(x), int(y)) for x, y in zip(a, b, strict=True)] == brute(ids, m, q, ids[i], 5)


@pytest.mark.parametrize("kind", ["dense", "sparse", "ties", "negative", "skew", "wide"])
@pytest.mark.parametrize("floor", [False, True])
def test_block_search_is_exact(kind, floor):
    r = np.random.default_rng(4)
    n, d = 5000, 24
    m = np.rint(r.normal(0, 40, (n, d))).astype(np.int64)
    if kind == "sparse":
        m[r.random((n, d)) < 0.9] = 0
    if kind == "ties":
        m = r.integers(-1, 2, (n, d))
    if kind == "skew":
        m = (m * np.logspace(0, -2, d)).astype(np.int64)
    if kind == "wide":
        m *= 1 << 20  # beyond what doubles hold exactly
    ids = r.permutation(n).astype(np.int64)
    q = np.abs(m[:60]) if kind == "negative" else m[:60]
    m = -np.abs(m) if kind == "negative" else m
    want = [brute(ids, m, q[i], ids[i], 5) for i in range(60)]
    floors = np.array([w[-1][0] - (i % 2) if floor else -(1 << 62) for i, w in enumerate(want)], np.int64)
    row, score, found = T.Shard(ids, m).search_block(q, ids[:60], 5, floors)
    for i in range(60):
        assert [(int(a), int(b)) for a, b in zip(score[row == i], found[row == i], strict=True)] == want[i]


def test_search_edge_cases(spark):
    rows = [(0, [1.0, 2.0], 1), (50, [0.5, 0.1], 2), (1, None, 3), (2, [], 4), (3, [float("nan"), 1.0], 5), (4, [None, 1.0], 6), (5, [1.0, 2.0], 7), (6, [float("inf"), 1.0], 8), (100, [0.0, 0.0], 9), (7, [3.0], 10), (5, [1.0, 2.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    v = T.quantised(df)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.search(v, v.where("vec_id % 50 = 0"), 5, shard=2, block=1).collect())
    usable = [(i, [np.floor(256.0 * float(np.float32(x))) for x in e]) for i, e, _ in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for qi, q in usable:
        if qi % 50 == 0:
            s = sorted((-int(sum(a * b for a, b in zip(q, c))), ci) for ci, c in usable if ci != qi)[:5]  # noqa: B905
            want += [(qi, n + 1, ci, -sc) for n, (sc, ci) in enumerate(s)]
    assert got == sorted(want)
    assert T.search(v.where("false"), v.where("false"), 5).count() == 0


@pytest.mark.parametrize("floor", [0, 1, -5])
def test_a_floor_loses_nothing(floor):
    r = np.random.default_rng(5)
    m = r.integers(-9, 10, (6000, 8))
    s = T.Shard(np.arange(6000), m)
    for i in range(0, 200, 10):
        best = brute(np.arange(6000), m, m[i], i, 5)
        a, b = s.search(m[i], i, 5, best[-1][0] + min(0, floor))
        assert [(int(x), int(y)) for x, y in zip(a, b, strict=True)] == best
        a, _ = s.search(m[i], i, 5, best[0][0] + 1)
        assert len(a) == 0


def test_repeated_query_ids_are_ranked_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])]
    v = T.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in T.search(v, v.where("vec_id = 0"), 3, shard=2).collect())
    assert got == sorted([(0, 1, 1, 65536), (0, 2, 2, 0), (0, 3, 2, 0), (0, 1, 2, 65536), (0, 2, 2, 65536), (0, 3, 1, 0)])


@pytest.mark.parametrize("x", [1e30, 1e16])
def test_scores_never_wrap(spark, x):
    v = T.quantised(spark.createDataFrame([(0, [x, 1.0]), (1, [x, 1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="beyond"):
        T.search(v, v.where("vec_id = 0"), 1).collect()


@pytest.mark.parametrize("share", [0.9, 0.5, 0.0])
def test_only_candidates_of_essential_postings_are_scored(share):
    """Of sparse vectors most are never scored; no vector outside a query's essential postings ever is, and no query scores more than it meets there."""
    r = np.random.default_rng(11)
    n, d = 3000, 32
    m = np.rint(r.normal(0, 40, (n, d)) * np.logspace(0, -1.5, d)).astype(np.int64)
    m[r.random((n, d)) < share] = 0
    ids, q = np.arange(n), m[:40]
    want = [brute(ids, m, q[i], i, 5) for i in range(40)]
    floors = np.array([w[-1][0] for w in want], np.int64)
    shard, probed = T.Shard(ids, m), []
    row, score, found = shard.search_block(q, ids[:40], 5, floors, probed)
    for i in range(40):
        assert [(int(a), int(b)) for a, b in zip(score[row == i], found[row == i], strict=True)] == want[i]
    needed = shard.essential(q, floors.astype(float) - 1)
    met = ((m[None, :, :] * q[:, None, :] > 0) & needed[:, None, :]).any(axis=2)
    assert not needed.all() and needed.any(axis=1).all()
    pairs = [(i, x) for rows, x in probed for i, x in zip(rows, x, strict=True)]
    assert pairs and all(met[i, x] or floors[i] <= 0 for i, x in pairs) and len(set(pairs)) == len(pairs)  # a score of 0 needs no posting
    pairs = [(i, x) for i, x in pairs if met[i, x]]
    assert len(pairs) < 0.5 * met.sum() if share else len(pairs) <= met.sum()
