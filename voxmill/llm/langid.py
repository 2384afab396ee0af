"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Texts are read as UTF-8 in segments of ``T`` bytes. A GRU runs over each segment forwards, another
backwards; from both states every position gets a probability for each language, and a text's
probabilities are the mean over all its positions. Gates are piecewise linear (clip(1/2 + a/4)), the
candidate state is tanh. Training is backpropagation through time with Adam on segments of a bounded
sample: ``sample`` documents of each language outside the held-out fifth, least by the hash of their id, so
that a rare language is learned as well. Of a long text a piece of WIDE segments from its middle is read for
training, and PIECES segments of that piece.

Whole texts are predicted. A null text or one without a letter is ``und`` with score 0; so is every
text if there was nothing to learn from. Ties go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import add_columns, held_out, table

#: Bytes of a segment, hidden units a direction, sampled documents of a language, segments of a training piece, of these used, training steps, segments a step, segments predicted together.
T, H, SAMPLE, WIDE, PIECES, STEPS, BATCH, TOGETHER = 64, 8, 500, 16, 4, 240, 384, 2048
PAD = 0  # the padding byte keeps the state as it is
_SHUT = np.float32(-1e4)


def _new(rng: np.random.Generator, classes: int) -> dict[str, np.ndarray]:
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p["E" + d] = rng.normal(0, 0.5, (3 * H, 256)).astype(np.float32)
        p["U" + d] = rng.normal(0, 1 / np.sqrt(H), (3 * H, H)).astype(np.float32)
        p["W" + d] = rng.normal(0, 0.3, (classes, H)).astype(np.float32)
    p["c"] = np.zeros((classes, 1), np.float32)
    return p


def _run(table: np.ndarray, u: np.ndarray, x: np.ndarray, keep: bool):
    """States (steps, H, batch) of one direction; with ``keep`` also what its gradient needs."""
    steps, batch = x.shape
    h = np.zeros((H, batch), np.float32)
    states = np.empty((steps, H, batch), np.float32)
    trace = []
    for t in range(steps):
        g = np.take(table, x[t], axis=1)
        a = u @ h
        zr = g[: 2 * H] + a[: 2 * H]
        zr *= 0.25
        zr += 0.5
        np.clip(zr, 0, 1, out=zr)
        z, r = zr[:H], zr[H:]
        n = np.tanh(g[2 * H :] + r * a[2 * H :])
        if keep:
            trace.append((z, r, n, a[2 * H :], h))
        h = h + z * (n - h)
        states[t] = h
    return states, trace


def _back(u: np.ndarray, x: np.ndarray, trace, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and of the recurrent weights."""
    steps, batch = x.shape
    du = np.zeros_like(u)
    dg = np.empty((3 * H, steps, batch), np.float32)
    carry = np.zeros((H, batch), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, n, un, h = trace[t]
        dh = carry + d_states[t]
        dan = dh * z * (1 - n * n)
        daz = dh * (n - h) * 0.25 * ((z > 0) & (z < 1))
        dar = dan * un * 0.25 * ((r > 0) & (r < 1))
        da = np.concatenate([daz, dar, dan * r])
        du += da @ h.T
        carry = dh * (1 - z) + u.T @ da
        dg[:H, t], dg[H : 2 * H, t], dg[2 * H :, t] = daz, dar, dan
    flat = x.ravel()
    dt = np.stack([np.bincount(flat, weights=row.ravel(), minlength=256) for row in dg]).astype(np.float32)
    dt[:, PAD] = 0
    return dt, du


def _shut(p: dict[str, np.ndarray]) -> None:
    for d in "fb":
        p["E" + d][:, PAD] = 0
        p["E" + d][:H, PAD] = _SHUT


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the positions of x (steps, batch) with a label for each segment, and its gradients."""
    hf, tf = _run(p["Ef"], p["Uf"], x, True)
    back = np.ascontiguousarray(x[::-1])
    hb, tb = _run(p["Eb"], p["Ub"], back, True)
    hb = hb[::-1]
    logits = np.einsum("ch,thb->tcb", p["Wf"], hf) + np.einsum("ch,thb->tcb", p["Wb"], hb) + p["c"]
    logits -= logits.max(axis=1, keepdims=True)
    e = np.exp(logits)
    e /= e.sum(axis=1, keepdims=True)
    live = (x != PAD).astype(np.float32)
    n = max(1.0, float(live.sum()))
    at = np.arange(x.shape[1])
    loss = float(-(np.log(e[:, y, at] + 1e-9) * live).sum() / n)
    e[:, y, at] -= 1
    e *= (live / n)[:, None]
    g = {"Wf": np.einsum("tcb,thb->ch", e, hf), "Wb": np.einsum("tcb,thb->ch", e, hb), "c": e.sum(axis=(0, 2))[:, None]}
    g["Ef"], g["Uf"] = _back(p["Uf"], x, tf, np.einsum("ch,tcb->thb", p["Wf"], e))
    g["Eb"], g["Ub"] = _back(p["Ub"], back, tb, np.ascontiguousarray(np.einsum("ch,tcb->thb", p["Wb"], e)[::-1]))
    return loss, g


def segments(raw: bytes) -> np.ndarray:
    """(segments, T) bytes, padded at the end."""
    n = -(-len(raw) // T)
    return np.frombuffer(raw.ljust(n * T, b"\0"), np.uint8).reshape(n, T)


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 7) -> dict:
    """Fit on texts with their languages."""
    classes = sorted(set(langs))
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, lang in zip(texts, langs, strict=True):
        s = segments(text.encode("utf-8", "replace"))
        s = s[rng.permutation(len(s))[:PIECES]]
        xs.append(s)
        ys += [classes.index(lang)] * len(s)
    if not ys:
        return {"classes": []}
    x, y = np.concatenate(xs), np.array(ys)
    p = _new(rng, len(classes))
    _shut(p)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    share = np.bincount(y, minlength=len(classes))
    weight = 1 / np.sqrt(share[y])  # rare languages are drawn more often
    weight /= weight.sum()
    for step in range(1, steps + 1):
        pick = rng.choice(len(y), BATCH, p=weight)
        _, g = gradients(p, np.ascontiguousarray(x[pick].T), y[pick])
        rate = 0.02 * min(1, step / 20) * (0.1 + 0.9 * 0.5 * (1 + np.cos(np.pi * step / steps)))
        for k in p:
            gk = np.clip(g[k], -1, 1)
            m[k] += 0.1 * (gk - m[k])
            v[k] += 0.01 * (gk * gk - v[k])
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        _shut(p)
    return {"classes": classes, **p}


def position_probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """(steps, classes, batch) for x (steps, batch)."""
    hf, _ = _run(model["Ef"], model["Uf"], x, False)
    out = np.matmul(model["Wf"], hf)
    hb, _ = _run(model["Eb"], model["Ub"], np.ascontiguousarray(x[::-1]), False)
    out += np.matmul(model["Wb"], hb)[::-1]
    out += model["c"]
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """(language, score) of each whole text."""
    classes = model["classes"]
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not classes:
        return langs, scores
    totals = np.zeros((len(texts), len(classes)))
    lengths = np.zeros(len(texts))
    parts: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not held:
            return
        x, own = np.concatenate(parts), np.concatenate(owner)
        for a in range(0, len(x), TOGETHER):
            block = np.ascontiguousarray(x[a : a + TOGETHER].T)
            q = position_probabilities(model, block)
            q *= (block != PAD)[:, None]
            pooled = q.sum(axis=0, dtype=np.float64)
            for c in range(len(classes)):
                totals[:, c] += np.bincount(own[a : a + TOGETHER], weights=pooled[c], minlength=len(texts))
        parts.clear()
        owner.clear()
        held = 0

    for i, text in enumerate(texts):
        if text is None or not any(map(str.isalpha, text)):
            continue
        raw = text.encode("utf-8", "replace")
        lengths[i] = len(raw) - raw.count(0)
        s = segments(raw)
        parts.append(s)
        owner.append(np.full(len(s), i))
        held += len(s)
        if held >= 4 * TOGETHER:
            flush()
    flush()
    for i in np.flatnonzero(lengths):
        p = totals[i] / lengths[i]
        k = int(np.argmax(p))
        langs[i], scores[i] = classes[k], float(min(1.0, max(0.0, p[k])))
    return langs, scores


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Train on at most ``sample`` documents (doc_id, text, lang) of each language outside the held-out fifth."""
    known = docs.where(~held_out() & F.col("lang").isNotNull())
    total = known.groupBy("lang").agg(F.count("*").alias("_total"))  # reads no text
    h, span = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), 1 << 40
    width = WIDE * T
    start = F.greatest(F.lit(1), ((F.length("text") - width) / 2).cast("int"))
    near = known.where("text is not null and text <> ''").select("doc_id", "lang", F.substring("text", start, F.lit(width)).alias("text"), h.alias("_h"))
    # a threshold a language first: what its window gathers doesn't grow with the input
    # one row a language, as many as the model has classes: broadcast, so that rows are filtered where they are read
    near = near.join(F.broadcast(total), "lang").where(F.col("_h") < F.lit((2 * sample + 1000) * span) / F.col("_total"))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id", "text")
    got = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).orderBy("lang", "_n").select("text", "lang").toArrow()
    return train(got["text"].to_pylist(), got["lang"].to_pylist())


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Add lang_pred and score of each whole text; nothing but the text is read."""

    def make():
        return lambda texts: predict(model, texts)

    return add_columns(docs, [text], {"lang_pred": "string", "score": "double"}, make)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
