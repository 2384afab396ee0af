"""Targets, copies and positions on small sources."""

import pytest

from voxmill.llm import mixing as M


def level(sizes: dict, budget: float = M.BUDGET, cap: float = M.CAP) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target: dict = {}
    left, free = budget * sum(sizes.values()), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 10, "b": 1000, "c": 10}, {"a": 50, "b": 50, "c": 50, "d": 50, None: 50}, {"a": 1, "b": 1, "c": 10000}, {"a": 0, "b": 7}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in M.targets(frame).collect()}
    want = level(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def documents(spark):
    rows = [(i, ("w " * (1 + i * 7 % 40)).strip(), "abc"[i % 3] if i % 11 else None) for i in range(300)]
    return spark.createDataFrame([*rows, (300, None, "a"), (301, "", "b"), (None, "x y", "a"), (5, "dup dup", "c"), (5, "dup dup", "c")], "doc_id bigint, text string, source string")


def test_taken_words_meet_the_targets(spark):
    docs = documents(spark)
    planned = M.plan(docs.select("doc_id", "source", M.n_words().alias("size"))).collect()
    assert len(planned) == 305
    for s in {r.source for r in planned}:
        own = [r for r in planned if r.source == s]
        assert abs(sum(r.size * r._copies for r in own) - own[0].target) <= 40 and all(0 <= r._copies <= M.CAP for r in own)


def test_mix_repeats_rows_in_training_order(spark):
    """Null and empty texts have size 0; repeated rows are rows of their own; clashing names do no harm; the curriculum moves weight from falling to rising sources."""
    docs = documents(spark).withColumnRenamed("text", "size").withColumn("weight", M.F.lit(1)).withColumn("target", M.F.lit("t"))
    got = M.mix(docs, text="size").collect()
    assert got == M.mix(docs.repartition(7), text="size").collect() and got[0].asDict().keys() == {"doc_id", "size", "source", "weight", "target"}
    half = len(got) // 2
    early, late = [sum(r.source == "b" for r in x) for x in (got[:half], got[half:])]
    assert early > late
    assert M.mix(docs.limit(0), text="size").count() == 0
