"""Near copies by five-word Jaccard similarity, against brute force."""

import random

import corpus_pipeline as P
from voxmill.llm import near_dedup as N


def jaccard(a, b):
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    """Copies with a few changed words (similarity 0.8 to 1) go; texts below 0.8 stay."""
    r = random.Random(3)
    texts = []
    for g in range(12):
        first = [f"g{g}w{r.randrange(10**6)}" for _ in range(200)]
        texts.append(" ".join(first))
        for n in (1, 2, 3, 12):
            copy = list(first)
            for at in range(n):
                copy[at * 15 + 10] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert len(set(root)) == 24
    assert sorted(x.doc_id for x in P.drop_near_duplicates(spark, docs, "").collect()) == sorted(set(root))


def test_large_groups_and_rows_of_any_kind(spark):
    """More copies than a bucket's pairs; repeated ids, null ids, null, empty and short texts."""
    base = [f"w{i}" for i in range(300)]
    many = [(100 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(100)]
    rows = [*many, (1, "a b"), (1, " ".join(f"y{i}" for i in range(50))), (2, "A  b"), (3, None), (4, ""), (None, "z z z z z z"), (None, "q"), (7, "r"), (7, "r"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((x.doc_id, x.text) for x in N.keep_one(docs).collect()), key=str)
    assert got == sorted([many[0], rows[100], rows[101], rows[103], rows[105], rows[106], rows[107]], key=str)
    assert N.keep_one(docs.limit(0)).count() == 0
