"""The model's gradient steps, its bounds and held-out quality."""

import math
import zlib

import numpy as np
import pytest

from voxmill.llm import toxicity as X


def test_constant_without_both_labels():
    assert X.fit_ftrl([])["bias"] == -20.0
    f = np.array([1, 2])
    assert X.fit_ftrl([(f, 1), (f, 1)])["bias"] == 20.0 and len(X.fit_ftrl([(f, 0)])["at"]) == 0


def test_sparse_weights_separate():
    r = np.random.default_rng(0)
    rows = [(np.unique(np.append(r.integers(100, 1000, 20), 7 if y else 8)), y) for y in r.integers(0, 2, 600)]
    m = X.fit_ftrl(rows, bits=10)
    w = dict(zip(m["at"].tolist(), m["w"].tolist(), strict=True))
    assert w[7] > 0.5 and w.get(8, 0.0) < -0.5 and len(w) < 300


def test_features_cover_the_whole_text():
    h = X.Hasher()
    long = "word " * 50000
    assert len(h.features(None)) == len(h.features("")) == len(h.features(" .,! ")) == 0
    assert len(np.setdiff1d(h.features(long + "ending"), h.features(long))) > 0


def test_held_out_quality(spark):
    """Most toxic documents outside the training rows are caught, and clean ones left alone (at 0.1, for smaller tables hold out six toxic documents)."""
    sf = "/root/testdata/sf0.1"
    got = X.op8_toxicity(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    known = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    known = known[known["held_out"]]
    caught, spared = [(known.loc[known["toxic"] == y, "predicted"] == y).mean() for y in (1, 0)]
    assert caught >= 0.75 and spared >= 0.9, (caught, spared)


def test_rows_of_any_kind(spark):
    """Null and empty texts get the bias's score, repeated rows stay, a column of the output's name is replaced."""
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(40)] + [(None, None, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    rows = [(i, f"{'vile awful' if i % 2 else 'kind gentle'} text {i}", "s") for i in range(40)]
    docs = spark.createDataFrame([*rows, (3, "vile again", None), (None, None, "s"), (50, "", "s")], "doc_id bigint, text string, score string")
    model = X.fit(docs.select("doc_id", "text"), labels)
    got = X.score(docs, model).orderBy("doc_id").collect()
    assert len(got) == 43 and abs(got[0].score - got[-1].score) < 1e-12
    assert X.score(docs.limit(0), X.fit(docs.limit(0), labels.limit(0))).count() == 0


def plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    """One coordinate after another, in dictionaries."""
    z, n, zb, nb, rate = {}, {}, 0.0, 0.0, sum(y for _, y in rows) / len(rows)
    bias0 = math.log(rate / (1 - rate))
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    bias = bias0
    for _ in range(epochs):
        for at, y in rows:
            bias = bias0 - zb / ((beta + math.sqrt(nb)) / alpha)
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for i in w:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / alpha * w[i]
            before, nb = nb, nb + g * g
            zb += g - (math.sqrt(nb) - math.sqrt(before)) / alpha * (bias - bias0)
    return {i: weight(i) for i in z if weight(i)}, bias


def test_equals_plain_ftrl():
    r = np.random.default_rng(2)
    rows = [(np.unique(np.append(r.integers(0, 300, 15), 301 if y else 302)), int(y)) for y in r.integers(0, 2, 150)]
    m = X.fit_ftrl(rows, bits=10, epochs=2, l1=0.5)
    want, bias = plain_ftrl(rows, 2, X.ALPHA, X.BETA, 0.5, X.L2)
    assert dict(zip(m["at"].tolist(), m["w"].tolist(), strict=True)) == pytest.approx(want, abs=1e-5) and m["bias"] == pytest.approx(bias)


def test_features_read_for_fitting_are_bounded():
    few = X._few(np.arange(3 * X.MOST))
    assert len(few) == X.MOST and (np.diff(few) > 0).all() and (X._few(few) == few).all()
