"""Ball k-means over integer vectors: exact Lloyd rounds that compare each vector with few centroids.

A cluster's members in one Arrow batch are a ball: its centre is the cluster's centroid, its radius the
largest distance of these members. A centroid farther from the centre than twice the radius can be nearest to
none of them, so only the others are neighbours of the ball. Sorted by their distance D from the centre,
neighbours cut the ball into rings: a member at distance d is in the stable core as long as 2d < D for
all, and lies in the annulus of a neighbour (and of all nearer ones) once 2d >= D. Core members keep their cluster
without a comparison; the others are compared exactly with the neighbours of their annuli. All tests are on squared
64-bit integers (4 d^2 >= D^2), so no rounding decides, and ties go to the smaller number as in a full comparison.

Each round is one narrow pass that rewrites (vec_id, vector, cluster, distance) in the shared folder, and one
aggregate of sums with a partial sum in every task; the driver holds the ``k`` centroids only. The balls are
those of a batch, so no radius has to be gathered first, and a cluster of any size is spread over all tasks.

Vectors that are null, of another length, or hold null or non-finite components take no part. Components beyond
``LARGEST`` after scaling raise an error, as squared distances would leave 64 bits. Repeated rows are vectors of
their own; null ids take part and come last in the order of the first centroids, as do later ones among equal
hashes (by id, then vector). Fewer vectors than ``k`` give as many clusters; none give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, table

#: Clusters, rounds, components of a vector, scale of the integers, seed of the first centroids, largest component.
K, ROUNDS, DIMS, SCALE, SEED, LARGEST = 16, 3, 64, 64.0, 1, 1 << 26


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors of ``dims`` finite components."""
    x = F.col(f"`{vector}`")
    fit = x.isNotNull() & (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(fit).select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(x, lambda c: _in_range(c.cast("double") * scale)).alias("v"))


def _in_range(x: Column) -> Column:
    return F.when(F.abs(x) < float(LARGEST), F.floor(x).cast("int")).otherwise(F.raise_error(F.lit("component beyond the range of exact distances")).cast("int"))


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` from one centre."""
    apart = x - centre
    return np.einsum("nd,nd->n", apart, apart)


def assign_all(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) by comparison with every centroid; ties to the smaller number."""
    best, label = squared(x, centroids[0]), np.zeros(len(x), np.int64)
    for j in range(1, len(centroids)):
        d = squared(x, centroids[j])
        nearer = d < best
        best[nearer], label[nearer] = d[nearer], j
    return label, best


def reassign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact distances computed) of vectors that were in ``own``; ``between``: squared distances of the centroids."""
    label, best, compared = own.astype(np.int64), np.empty(len(x), np.int64), 0
    for i in np.unique(own):
        at = np.flatnonzero(own == i)
        members = x[at]
        d = squared(members, centroids[i])
        compared += len(at)
        near = [j for j in np.argsort(between[i], kind="stable") if j != i and between[i, j] <= 4 * d.max()]
        mine, mine_label = d.copy(), np.full(len(at), i)
        ring = np.arange(len(at))
        for j in near:
            ring = ring[4 * d[ring] >= between[i, j]]  # rings lie inside each other: neighbours come by distance
            if not len(ring):
                break
            other = squared(members[ring], centroids[j])
            compared += len(ring)
            nearer = (other < mine[ring]) | ((other == mine[ring]) & (j < mine_label[ring]))
            mine[ring[nearer]], mine_label[ring[nearer]] = other[nearer], j
        best[at], label[at] = mine, mine_label
    return label, best, compared


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, v, cluster, distance) for ``centroids``, by balls of the clusters that ``vectors`` names, if it does."""
    known = "cluster" in vectors.columns
    between = np.stack([squared(centroids, c) for c in centroids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1).astype(np.int64)
            if known:
                label, distance, _ = reassign(x, b.column("cluster").to_numpy(), centroids, between)
            else:
                label, distance = assign_all(x, centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(label, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "v", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "v", *["cluster"] * known).mapInArrow(run, f"vec_id {kind}, v array<int>, cluster int, distance bigint")


def _moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the clusters (empty ones stay); a row for each cluster comes to the driver."""
    dims = centroids.shape[1]
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k vectors with the least sha256 of ``seed:vec_id``, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(h.asc_nulls_last(), "vec_id", "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each row of (vec_id, v)."""
    spark = vectors.sparkSession
    kept = Written(spark, "balls")
    state = kept.put(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(state, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds + 1):
        if "cluster" in state.columns:
            centroids = _moved(state, centroids)
        before, state = state, kept.put(_assigned(state, centroids))
        kept.drop(before)
    inertia = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(c, d, sum(inertia.values()), digest[c]) for c, d in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of all vectors of ``embeddings``."""
    return cluster(quantised(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    """Lloyd's rounds in SQL, every vector against every centroid."""
    steps = [
        """v as materialized (
  select row_number() over () as r, vec_id, [floor(64 * x::double) for x in embedding] as v from embeddings
  where embedding is not null and len(embedding) = 64 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0)""",
        """c0 as materialized (
  select row_number() over (order by sha256('1:' || vec_id), vec_id, v) - 1 as k, v as c from v
  qualify row_number() over (order by sha256('1:' || vec_id), vec_id, v) <= 16)""",
    ]
    for n in range(ROUNDS + 1):
        if n:
            steps.append(f"""c{n} as materialized (
  select o.k, coalesce(u.c, o.c) as c from c{n - 1} o left join (
    select k, list(x order by i) as c from (
      select k, i, floor(sum(x) / count(*)) as x from (select k, unnest(v) as x, generate_subscripts(v, 1) as i from a{n - 1}) group by k, i) group by k) u on o.k = u.k)""")
        steps.append(f"""a{n} as materialized (
  select r, vec_id, v, k, d from (
    select r, vec_id, v, k, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) as d from v, c{n})
  qualify row_number() over (partition by r order by d, k) = 1)""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, a.k::int as cluster, d::bigint as distance, (sum(d) over (partition by a.k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
       sha256(array_to_string([x::bigint for x in c], ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c on a.k = c.k
"""


OP12_SQL = _sql()
