"""Exact top-k inner products by MaxScore over sharded postings.

A vector's components, turned into integers, are its terms: a term is a dimension and a sign, its
postings are the vectors of a shard with that component, in order of their ids, and its bound is the largest magnitude
among them. A query meets positive contributions only in the terms of its own signs, so the sum of their bounds
limits any score. With a threshold from the k best so far, the terms with the smallest bounds whose sum can't
exceed it are non-essential for this query: a vector outside the postings of all others can't enter the result and is
never scored. The postings of the essential terms are traversed; what they meet is a candidate while its partial score and
the bounds of the other terms still exceed the threshold. Only candidates are probed, eight dimensions at a time: for
the other terms, and for contributions of opposite sign. Results of shards are merged by query.

Queries go through in blocks of about ``BLOCK``, whose rows travel with the tasks, and up to ``TOGETHER`` of them share
the traversal of a posting list, each with its own threshold and its own essential terms. Vectors stay where they
are: each Arrow batch of a written partition is a shard, which meets all queries of the block. A first job
over one sample shard gives each query a threshold (its k-th best score there, a lower bound of the final
one), so that every shard prunes from its first vector on. Only the k best of a shard are shuffled.

Vectors that are null, empty or hold null or non-finite components take no part; shorter vectors have
zeros at the end. Repeated rows are candidates of their own; a query's own id, however often it occurs, is
none. Each query row is ranked by itself, also where ids repeat. Scores are exact 64-bit integers: components
of 2^62 or more, and vectors whose products could pass that range, raise an error instead of wrapping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, table

#: Vectors of the sample shard, queries of a block, vectors that a shard scores at a time, and queries with them.
SHARD, BLOCK, STEP, TOGETHER = 8192, 4096, 2048, 256


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; unusable vectors are left out."""
    x = F.col(f"`{vector}`")
    fit = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(fit & F.col(f"`{vec_id}`").isNotNull()).select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(x, lambda c: _in_range(c.cast("double") * scale)).alias("v"))


def _in_range(x: Column) -> Column:
    return F.when(F.abs(x) < float(1 << 62), F.floor(x)).otherwise(F.raise_error(F.lit("component beyond 2^62 after scaling")).cast("long"))


def matrix(rows: list) -> np.ndarray:
    """Rows of integers, filled with zeros to the longest."""
    if len({len(r) for r in rows}) == 1:
        return np.array([np.asarray(r) for r in rows], dtype=np.int64)
    out = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Shard:
    """Postings of a shard's vectors: for each dimension and sign the vectors (by id) with their components, and the bound; ``columns`` has the components for probes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(vectors[order].T)
        self.high, self.low = self.columns.max(axis=1), -self.columns.min(axis=1)
        self.most = max(map(abs, (int(self.columns.max(initial=0)), int(self.columns.min(initial=0)))))
        self.postings = [tuple((at := np.flatnonzero(column > 0 if sign > 0 else column < 0), column[at].astype(np.float64)) for sign in (1, -1)) for column in self.columns]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that each dimension can add to a score of each query."""
        d = queries.shape[1]
        return np.maximum(0, np.where(queries > 0, self.high[:d] * queries, -self.low[:d] * queries))

    def essential(self, queries: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """For each query the dimensions whose postings have to be traversed: all but those of the smallest bounds that don't exceed ``theta`` together."""
        bound = self.bounds(queries)
        order = np.argsort(bound, axis=1, kind="stable")
        out = np.empty(bound.shape, bool)
        np.put_along_axis(out, order, np.cumsum(np.take_along_axis(bound, order, 1), axis=1) > theta[:, None], 1)
        return out

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best, by score, then smaller id; ``floor``: scores below it aren't asked for."""
        d = min(len(query), len(self.columns))
        q = query[:d]
        if d * self.most * max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) >= 1 << 63:
            raise OverflowError("inner products beyond 64-bit integers")
        bound = np.maximum(0, np.where(q > 0, self.high[:d] * q, self.low[:d] * -q))
        terms = np.argsort(-bound, kind="stable")
        terms = terms[q[terms] != 0]
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # bound of the terms from i on
        best_s, best_i = np.empty(0, np.int64), np.empty(0, np.int64)
        for a in range(0, len(self.ids), STEP):
            ids = self.ids[a : a + STEP]
            at = np.flatnonzero(ids != own)
            full = len(best_s) >= k
            theta = int(best_s[-1]) if full else None
            if floor is not None and (theta is None or floor - 1 > theta):  # scores equal to the floor are asked for
                full, theta = True, floor - 1
            # essential terms: those before the first place from which the rest can't reach the threshold
            essential = int(np.searchsorted(-rest, -theta, side="right")) if full and theta > 0 else len(terms)
            essential = min(essential, len(terms))
            block = self.columns[:, a : a + STEP]
            partial = np.zeros(len(at), np.int64)
            met = np.zeros(len(at), bool) if full and theta > 0 else None
            i = 0
            while i < len(terms) and len(at):
                j = min(len(terms), i + 8)
                part = block[terms[i:j]][:, at]
                partial = partial + q[terms[i:j]] @ part
                if met is not None and i < essential:
                    use = part[: max(0, essential - i)]
                    met |= ((use != 0) & (np.sign(use) == np.sign(q[terms[i : i + len(use)]])[:, None])).any(axis=0)
                i = j
                if full:
                    # scores equal to the threshold lose to the smaller ids found before
                    live = partial + rest[i] > theta
                    if met is not None and i >= essential:
                        live &= met
                    if not live.all():
                        at, partial = at[live], partial[live]
                        met = met[live] if met is not None else None
            if len(at):
                s, x = np.concatenate([best_s, partial]), np.concatenate([best_i, ids[at]])
                order = np.lexsort((x, -s))[:k]
                best_s, best_i = s[order], x[order]
        return best_s, best_i

    def search_block(self, queries: np.ndarray, owns: np.ndarray, k: int, floors: np.ndarray, probed: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, score, id) of the k best for each row of ``queries``; ``floors``: scores below aren't asked for (-2^62: none).

        As ``search``, for all queries together and in doubles, where these are exact. ``probed`` gets the (row, id)
        of all pairs that are scored beyond their essential postings.
        """
        d = min(queries.shape[1], len(self.columns))
        q = queries[:, :d]
        if d * self.most * int(np.abs(q).max(initial=0)) >= 1 << 53:
            found = [self.search(row, int(own), k, int(f) if f > -(1 << 62) else None) for row, own, f in zip(queries, owns, floors, strict=True)]
            return np.repeat(np.arange(len(found)), [len(s) for s, _ in found]), *(np.concatenate(x) for x in zip(*found, strict=True))
        bound, qf = self.bounds(q), q.astype(np.float64)
        theta = floors.astype(np.float64) - 1
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        for a in range(0, len(self.ids), STEP):
            ids = self.ids[a : a + STEP]
            needed = self.essential(q, theta)
            partial = self._traversed(np.where(needed, qf, 0.0), a, len(ids))
            rest = np.where(needed, 0, bound)
            # with a threshold below 0 a vector may enter without any positive contribution
            live = (partial + rest.sum(axis=1)[:, None] > theta[:, None]) & ((partial > 0) | (theta < 0)[:, None]) & (ids != owns[:, None])
            row, col, score = self._probed(qf, needed, rest, theta, partial, live, a, None if probed is None else (probed, ids))
            best = tuple(np.concatenate(x) for x in zip(best, (row, np.rint(score).astype(np.int64), ids[col]), strict=True))
            place = np.lexsort((best[2], -best[1], best[0]))
            best = tuple(x[place] for x in best)
            nth = np.arange(len(place)) - np.searchsorted(best[0], best[0])
            last = nth == k - 1
            theta[best[0][last]] = np.maximum(theta[best[0][last]], best[1][last])
            best = tuple(x[nth < k] for x in best)
        return best

    def _traversed(self, asked: np.ndarray, a: int, n: int) -> np.ndarray:
        """Sums (query, vector) of the positive contributions of the postings of vectors a to a + n; ``asked`` has zeros for dimensions that aren't essential."""
        out = np.zeros((n, len(asked)))
        for dim, lists in enumerate(self.postings[: asked.shape[1]]):
            for sign, (at, value) in zip((1, -1), lists, strict=True):
                with_it = np.flatnonzero(asked[:, dim] * sign > 0)
                i, j = np.searchsorted(at, (a, a + n))
                if len(with_it) and i < j:
                    if 2 * len(with_it) > len(asked):  # a row of sums at a time; zeros for the others
                        out[at[i:j] - a] += np.outer(value[i:j], np.where(asked[:, dim] * sign > 0, asked[:, dim], 0.0))
                    else:
                        out[np.ix_(at[i:j] - a, with_it)] += np.outer(value[i:j], asked[with_it, dim])
        return np.ascontiguousarray(out.T)

    def _probed(self, q: np.ndarray, needed: np.ndarray, rest: np.ndarray, theta: np.ndarray, partial: np.ndarray, live: np.ndarray, a: int, trace) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector, score) of the candidates ``live`` that stay competitive through all probes."""
        d = q.shape[1]
        order = np.argsort(-(needed * np.abs(q)).sum(axis=0) - np.abs(q).sum(axis=0) / len(q), kind="stable")
        left = np.concatenate([np.cumsum(rest[:, order][:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1))], axis=1)
        column = np.flatnonzero(live.any(axis=0))
        v = self.columns[np.ix_(order, a + column)].astype(np.float64)
        q, needed, partial, live = q[:, order], needed[:, order], partial[:, column], live[:, column]
        if trace is not None:
            row, col = np.nonzero(live)
            trace[0].append((row, trace[1][column[col]]))
        i = 0
        while i < d and live.mean() > 0.1 if live.size else False:  # many pairs: what they lack, as products of small matrices
            j = min(d, i + 8)
            own = np.where(needed[:, i:j], q[:, i:j], 0.0)
            w = v[i:j]
            partial += np.maximum(own, 0) @ np.minimum(w, 0) + np.minimum(own, 0) @ np.maximum(w, 0) + np.where(needed[:, i:j], 0.0, q[:, i:j]) @ w
            i = j
            live &= partial + left[:, i, None] > theta[:, None]
        row, col = np.nonzero(live)
        score = partial[row, col]
        while i < d and len(row):
            j = min(d, i + 8)
            part = q[row, i:j] * v[i:j, col].T
            part[needed[row, i:j] & (part > 0)] = 0
            score = score + part.sum(axis=1)
            i = j
            keep = score + left[row, i] > theta[row]
            row, col, score = row[keep], col[keep], score[keep]
        return row, column[col], score


def _scan(vectors: DataFrame, queries: list[tuple[int, int, np.ndarray]], k: int, floors: dict[int, int]) -> DataFrame:
    """(_q, query_id, vec_id, score): the k best of each Arrow batch of ``vectors`` for each query (number, id, vector)."""

    numbers, owns = (np.array([q[i] for q in queries], np.int64) for i in (0, 1))
    asked = matrix([q[2] for q in queries]) if queries else np.zeros((0, 0), np.int64)
    least = np.array([floors.get(q[0], -(1 << 62)) for q in queries], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            shard = Shard(batch["vec_id"].to_numpy(np.int64), matrix(list(batch["v"])))
            for a in range(0, len(queries), TOGETHER):
                row, score, found = shard.search_block(asked[a : a + TOGETHER], owns[a : a + TOGETHER], k, least[a : a + TOGETHER])
                yield pd.DataFrame({"_q": numbers[a + row], "query_id": owns[a + row], "vec_id": found, "score": score})

    return vectors.select("vec_id", "v").mapInPandas(run, "_q bigint, query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each row of ``queries``, both (vec_id, v)."""
    kept = Written(vectors.sparkSession, "topk")
    vectors, queries = kept.put(vectors), kept.put(queries.withColumn("_q", F.monotonically_increasing_id()))
    parts = -(-vectors.count() // shard)
    blocks = -(-queries.count() // block)
    sample = vectors.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, parts))) == 0)
    out = None
    for b in range(max(1, blocks)):
        rows = queries.where(F.pmod(F.xxhash64("_q"), F.lit(max(1, blocks))) == b).collect()  # about ``block`` rows
        asked = [(r["_q"], r["vec_id"], np.asarray(r["v"], np.int64)) for r in rows]
        # k rows a query; for all vectors in one shard there is nothing to gain
        floors = {r["_q"]: r["score"] for r in _best(_scan(sample, asked, k, {}), k).where(F.col("rank") == k).collect()} if parts > 1 else {}
        found = _scan(vectors, asked, k, floors)
        out = found if out is None else out.unionByName(found)
    return _best(out, k).select("query_id", "rank", "vec_id", "score")


def op5_topk_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for each vector whose id is divisible by 50."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP5_SQL = """
with v as (
  select vec_id, [floor(256 * x::double) for x in embedding] as v from embeddings
  where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
