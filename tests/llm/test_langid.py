import random

import numpy as np
import pytest

from voxmill.llm import langid as L


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = L._new(rng, 3)
    L._shut(p)
    x = rng.integers(1, 256, (9, 4)).astype(np.uint8)
    x[6:, 1] = L.PAD
    y = np.array([0, 2, 1, 0])
    _, g = L.gradients(p, x, y)
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            if k[0] == "E":
                at = (at[0], int(x[rng.integers(0, 6), rng.integers(0, 4)]))
            eps, old = 1e-2, p[k][at]
            p[k][at] = old + eps
            up, _ = L.gradients(p, x, y)
            p[k][at] = old - eps
            down, _ = L.gradients(p, x, y)
            p[k][at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 5e-3


def corpus(n, seed):
    r = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ße"], "cc": ["eau", "é", "que"]}
    out = []
    for i in range(n):
        lang = r.choice(list(parts))
        out.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60))), lang))
    return out


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(300, 1)
    model = L.train([t for _, t, _ in rows], [g for _, _, g in rows], steps=60)
    test = corpus(100, 2)
    got, scores = L.predict(model, [t for _, t, _ in test])
    assert np.mean([a == b for a, (_, _, b) in zip(got, test, strict=True)]) > 0.97
    assert all(0 <= s <= 1 for s in scores)
    assert L.predict(model, [None, "", "12 %&", "\0\0", "kalo " * 50000])[0][:4] == ["und"] * 4
    # padding and neighbours in a batch don't matter
    alone = [L.predict(model, [t])[1][0] for _, t, _ in test[:10]]
    assert np.allclose(alone, scores[:10], atol=1e-5)
    df = spark.createDataFrame([(1, "kalo milo", "x"), (2, None, "y")], "doc_id long, text string, score string")
    assert {r.doc_id: r.lang_pred for r in L.identify(df, model).collect()} == {1: "aa", 2: "und"}
    assert L.fit(df.selectExpr("doc_id", "text", "cast(null as string) as lang"))["classes"] == []
    assert L.predict({"classes": []}, ["abc"]) == (["und"], [0.0])


def test_prediction_equals_plain_loops():
    """Each position by itself: gates, candidate state, both directions, the mean over all positions of whole texts."""
    r = np.random.default_rng(3)
    p = {"classes": ["a", "b", "c"], **L._new(r, 3)}
    L._shut(p)

    def states(side, raw):
        h, out = np.zeros(L.H), []
        for byte in raw:
            g, a = p["E" + side][:, byte].astype(float), p["U" + side].astype(float) @ h
            z, u = (np.clip(0.5 + (g[i * L.H : (i + 1) * L.H] + a[i * L.H : (i + 1) * L.H]) / 4, 0, 1) for i in (0, 1))
            n = np.tanh(g[2 * L.H :] + u * a[2 * L.H :])
            h = h + z * (n - h)
            out.append(h)
        return out

    texts = ["One short text.", "é" * 50 + " and a longer one, of several segments " * 6, "x"]
    langs, scores = L.predict(p, [*texts, None, "123"])
    for t, lang, score in zip(texts, langs, scores, strict=False):
        raw, total, n = t.encode(), np.zeros(3), 0
        for at in range(0, len(raw), L.T):
            part = raw[at : at + L.T]
            for f, b in zip(states("f", part), states("b", part[::-1])[::-1], strict=True):
                e = p["Wf"].astype(float) @ f + p["Wb"].astype(float) @ b + p["c"][:, 0]
                e = np.exp(e - e.max())
                total += e / e.sum()
                n += 1
        assert lang == p["classes"][int(np.argmax(total))] and score == pytest.approx(total.max() / n, abs=1e-4)
    assert langs[3:] == ["und", "und"] and scores[3:] == [0.0, 0.0]
