"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are the distinct hashed words, word stems, bigrams, and pairs one and two words
apart of its whole length. Training reads a bounded sample of labelled rows (``sample`` rows, least by the
hash of their id; of each at most ``MOST`` features, least by a hash) in one task, and updates one coordinate
at a time with its own rate; the L1 term leaves few weights, at most 2^``bits``, which reach the driver and
travel to the executors with the task. Scores read whole texts and all their features.

Null and empty texts have no features and get the bias's score; without labels of both kinds the
model is constant (the rate of label 1, or 0).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, hash_sample, held_out, table

#: log2 of the hashed space; labelled rows read; features read of each; passes over them; FTRL's alpha, beta, L1, L2.
DIM_BITS, SAMPLE, MOST, EPOCHS, ALPHA, BETA, L1, L2 = 20, 8000, 4096, 3, 1.0, 1.0, 8.0, 0.1
#: Code points of the stems by which a word also counts: an inflected word shares weights with its kin.
STEMS = (5, 7)
_WORDS = re.compile(r"[^\W_]+")
_MEMO = 1 << 18


class Hasher:
    """Hashed features of texts; remembers the hashes of words."""

    def __init__(self, bits: int = DIM_BITS):
        self.bits, self.memo = bits, {}

    def features(self, text: str | None) -> np.ndarray:
        """Hashed features of the whole text, repeats included."""
        words = _WORDS.findall((text or "").lower())
        if not words:
            return np.empty(0, np.int64)
        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo = self.memo
        both = np.array([memo.get(w) or memo.setdefault(w, self._hash(w)) for w in words], dtype=np.uint64)
        h = both[:, 0]
        return np.concatenate([self._place(h, 0), *(self._place(both[:, i], 3 + i) for i in range(1, 1 + len(STEMS))), *(self._place(h[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:], k) for k in (1, 2, 3) if len(h) > k)])

    @staticmethod
    def _hash(word: str) -> tuple[int, ...]:
        """Of the word and of its stems (the word's first code points)."""
        return tuple(zlib.crc32(x.encode("utf-8", "replace")) | 1 << 32 for x in (word, *(word[:n] for n in STEMS)))

    def _place(self, h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind + 1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)


def fit_ftrl(rows: list[tuple[np.ndarray, int]], bits: int = DIM_BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> dict:
    """Weights of the logistic regression, as sparse arrays; the bias has no penalty."""
    dim = 1 << bits
    z, n = np.zeros(dim), np.zeros(dim)
    zb = nb = bias = 0.0
    rate = sum(y for _, y in rows) / len(rows) if rows else 0.0
    if rate in (0.0, 1.0):
        return {"bits": bits, "at": np.empty(0, np.int64), "w": np.empty(0, np.float32), "bias": 20.0 if rate else -20.0}
    bias0 = float(np.log(rate / (1 - rate)))
    for _ in range(epochs):
        for at, y in rows:
            za, na = z[at], n[at]
            root = np.sqrt(na)
            w = np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + root) / alpha + l2))
            bias = bias0 - zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-min(35.0, max(-35.0, bias + w.sum()))))
            g = p - y
            z[at] = za + g - (np.sqrt(na + g * g) - root) / alpha * w
            n[at] = na + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * (bias - bias0)
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    at = np.flatnonzero(w)
    return {"bits": bits, "at": at, "w": w[at].astype(np.float32), "bias": float(bias)}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = DIM_BITS) -> dict:
    """Fit on at most ``sample`` labelled documents outside the held-out fifth; ``docs`` gives doc_id and text only."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    known = hash_sample(known, sample)

    def make():
        hasher = Hasher(bits)
        return lambda texts: ([_few(np.unique(hasher.features(t))).astype(np.int32).tobytes() for t in texts],)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += [(np.frombuffer(f, np.int32), y) for f, y in zip(b.column("_f").to_pylist(), b.column("_y").to_pylist(), strict=True)]
        m = fit_ftrl(rows, bits)
        yield pa.RecordBatch.from_arrays([pa.array([m["at"].astype(np.int32).tobytes()]), pa.array([m["w"].tobytes()]), pa.array([m["bias"]], pa.float64())], names=["at", "w", "bias"])

    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` ids
    made = add_columns(picked, ["text"], {"_f": "binary"}, make, drop=("text",))
    # repeated ids may give more documents than labels: the bound holds for these as well; the sorted rows are one partition, one task trains
    got = made.orderBy(F.xxhash64("doc_id"), "doc_id", "_f").limit(sample).select("_f", "_y").mapInArrow(train, "at binary, w binary, bias double").first()
    if got is None:  # nothing to train on
        return fit_ftrl([], bits)
    return {"bits": bits, "at": np.frombuffer(got["at"], np.int32).astype(np.int64), "w": np.frombuffer(got["w"], np.float32), "bias": got["bias"]}


def _few(found: np.ndarray) -> np.ndarray:
    """At most MOST of the features, in the same order."""
    if len(found) <= MOST:
        return found
    return found[np.sort(np.argsort((found.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), kind="stable")[:MOST])]


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 for each whole text."""

    def make():
        hasher = Hasher(model["bits"])
        w = np.zeros(1 << model["bits"], np.float32)
        w[model["at"]] = model["w"]
        live = w != 0

        def one(t: str | None) -> float:
            f = hasher.features(t)
            f = np.unique(f[live[f]])
            return 1 / (1 + float(np.exp(-min(35.0, max(-35.0, model["bias"] + float(w[f].sum(dtype=np.float64)))))))

        return lambda texts: ([one(t) for t in texts],)

    return add_columns(docs, [text], {out: "double"}, make)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
