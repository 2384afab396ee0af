import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voxmill.llm import importance as I

from ..oracle import SF

SCHEMA = "doc_id long, text string, score string, block int"


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) by loops over (doc_id, text) and texts."""

    def grams(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]

    own = [(i, *grams(t)) for i, t in docs]
    s, t = (Counter(b for f in x for b in f) for x in ([f for _, _, f in own], [grams(x)[1] for x in target]))
    all_s, all_t = s.total(), t.total()
    g = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    rows = []
    for i, n, f in own:
        w = sum(g[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for k, r in enumerate(fit[: 25 * len(fit) // 100], 1):
        r[4:] = [-1, k]
    return sorted(repr((*r[:4], r[5] if len(r) == 6 else None)) for r in rows)


def rows(frame):
    return sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in frame.collect())


def test_query_equals_plain_loops(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = [(r.doc_id, r.text) for r in read("documents").select("doc_id", "text").collect()]
    assert rows(I.op11_importance_resampling(spark, SF)) == plain(docs, [r.text for r in read("benchmark").collect()])


@pytest.mark.parametrize("block", [2, 512])
def test_odd_rows_ties_and_hot_words(spark, monkeypatch, block):
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "FULL", 500)
    docs = [(i, f"the hot words of row {i % 7} " * (1 + i % 5) + "and the rest of it all " * 3) for i in range(60)]
    docs += docs[:20] + [(70, None), (71, ""), (72, "!!! ..."), (None, "a null id " * 9), (73, "İstanbul ÇOK {güzel} KK 日本語 x_y z-9 " * 8), (74, "long text goes on " * 40000)]
    target = ["the hot words", None, "", "row 3 and 日本語"]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA).repartition(3)
    got = I.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert rows(got) == plain(docs, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = [(i, "words " * (15 + i)) for i in range(30)]
    assert I.resample(none, none).count() == 0
    assert rows(I.resample(spark.createDataFrame([(i, t, "x", 1) for i, t in some], SCHEMA), none)) == plain(some, [])


def test_blocks_of_postings_are_bounded(spark):
    docs = spark.createDataFrame([(i, "some words here " * 10, "x", 1) for i in range(1200)], SCHEMA).coalesce(1)
    made = I.postings(docs.select("doc_id", "text")).collect()
    assert sorted(len(r.ids) for r in made if r.range == -1) == [176, 512, 512]
    assert all(len(r.buckets) // 2 == len(r.counts) == sum(np.frombuffer(r.docs, "<u4")) for r in made if r.range >= 0)
