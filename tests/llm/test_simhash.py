import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from voxmill.llm import simhash as S
from voxmill.llm.common import Written


def brute_components(ids, fps, budget=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(ids)):
        r = find(i)
        low[r] = min(low.get(r, ids[i]), ids[i])
    return [low[find(i)] for i in range(len(ids))]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_matches_definition():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        t = " ".join(r.choice(["a", "B", "é", "cc"]) for _ in range(n))
        assert S.fingerprint(t) == plain_fingerprint(t)
    assert S.fingerprint(None) == 0


def test_spark_hash_is_the_same(spark):
    got = spark.sql("select xxhash64('the quick brown') h").first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest("the quick brown", 42)


@pytest.mark.parametrize("cap", [4096, 6])
def test_links_and_components_against_brute_force(spark, cap):
    r = random.Random(7)
    fps = []
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.append(x)
            for _ in range(r.randint(0, 2)):
                x ^= 1 << r.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([Row(fp=f - (1 << 64) if f >> 63 else f) for f in fps])
    kept = Written(spark, "test")
    got = {row.node % (1 << 64): row.root % (1 << 64) for row in S.components(S.links(df, kept, cap=cap), kept).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups, groups_got = {}, {}
    for f, w in zip(fps, want, strict=True):
        groups.setdefault(w, set()).add(f)
        groups_got.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, groups_got.values()))


def test_documents_edge_cases(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [(5, base), (3, base), (3, base), (9, None), (8, ""), (7, " \t\n"), (None, "x y"), (1, "another text entirely, nothing shared with the rest"), (2, "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    ids, fps = zip(*[(i, plain_fingerprint(t)) for i, t in rows if i is not None], strict=True)
    want = sorted([*zip(ids, brute_components(list(ids), list(fps)), strict=True), (None, None)], key=str)
    assert got == want
    one = S.keep_one(df.select("doc_id", "text"))
    assert sorted((r.doc_id for r in one.collect()), key=str) == sorted([3, 7, None, 1, 2], key=str)
    empty = df.where("false")
    assert S.near_duplicates(empty).count() == 0


def test_walk_large_cluster():
    r = np.random.default_rng(0)
    keys = np.unique(np.uint64(12345) ^ np.array([sum(1 << int(b) for b in set(r.integers(0, 40, 3))) for _ in range(3000)], dtype=np.uint64))
    i, j = S.walk(keys, [np.array([0]), np.array([len(keys)])] * 2, 0, 2)
    assert (np.bitwise_count(keys[i] ^ keys[j]) <= 2).all()
    root = S._forest(len(keys), i, j)
    assert len(set(root)) == len(set(brute_components(list(range(len(keys))), [int(k) for k in keys])))
