"""Vector quantisation: nearest codeword, usage, moving-average updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def nearest_code(vectors: DataFrame, codebook: DataFrame, size: int, key: str = "vec_id", vector: str = "vec") -> DataFrame:
    """(key, vector, code, dist): nearest codeword by squared distance, ties to the smallest code.

    The codebook has at most ``size`` rows (a model's fixed number of codes), so it travels whole as one
    array to every task; each vector scans it in place and no pairs are emitted.
    """
    packed = codebook.orderBy("code").limit(size).agg(F.sort_array(F.collect_list(F.struct("code", F.col("vec").alias("cvec")))).alias("codes"))
    best = F.array_min(F.transform("codes", lambda c: F.struct(squared_distance(F.col(vector), c["cvec"]).alias("dist"), c["code"].alias("code"))))
    return vectors.join(F.broadcast(packed)).withColumn("b", best).select(key, vector, F.col("b.code").alias("code"), F.col("b.dist").alias("dist"))


def usage(assigned: DataFrame, group: str, size: int, code: str = "code") -> DataFrame:
    """By group: entropy (nats), perplexity and share of the codebook in use."""
    c = assigned.groupBy(group, code).agg(F.count("*").alias("n"))
    h = F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")
    return c.groupBy(group).agg(h.alias("entropy"), F.count("*").alias("used")).withColumn("perplexity", F.exp("entropy")).withColumn("utilisation", F.col("used") / F.lit(float(size)))


def ema_update(assigned: DataFrame, codebook: DataFrame, decay: float = 0.99, eps: float = 1e-5) -> DataFrame:
    """(code, n, vec): moving averages of cluster size and vector sum, with smoothed sizes; unused codes keep their vector.

    ``assigned``: code, vec; ``codebook``: code, n, w (vector sum), vec.
    """
    dims = assigned.select("code", F.posexplode("vec").alias("d", "x")).groupBy("code", "d").agg(F.sum(F.col("x").cast("double")).alias("s"))
    sums = dims.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("d", "s"))).alias("ds")).select("code", F.transform("ds", lambda t: t["s"]).alias("dw"))
    sizes = assigned.groupBy("code").agg(F.count("*").alias("dn"))
    out = codebook.join(sizes, "code", "left").join(sums, "code", "left")
    out = out.withColumn("n2", F.col("n") * decay + F.coalesce("dn", F.lit(0)) * (1 - decay))
    out = out.withColumn("w2", F.when(F.col("dw").isNull(), F.transform("w", lambda a: a * decay)).otherwise(F.zip_with("w", "dw", lambda a, b: a * decay + b * (1 - decay))))
    total = out.agg(F.sum("n2").alias("total"), F.count("*").alias("k"))
    out = out.join(F.broadcast(total))
    smooth = (F.col("n2") + eps) / (F.col("total") + F.col("k") * eps) * F.col("total")
    return out.select("code", F.col("n2").alias("n"), F.when(F.col("dn").isNull(), F.col("vec")).otherwise(F.transform("w2", lambda a: a / smooth)).alias("vec"))


def mean_std(vectors: DataFrame, sample: str, vector: str = "vec") -> DataFrame:
    """By dimension: mean of the samples' means, and sqrt(E[x^2] - E[x]^2) of those."""
    flat = vectors.select(sample, F.posexplode(vector).alias("d", "x")).groupBy(sample, "d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.avg(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"))
    return flat.groupBy("d").agg(F.avg("m").alias("mean"), F.avg("q").alias("q")).select("d", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("mean") * F.col("mean"))).alias("std"))


def overlay(current: DataFrame, pretrained: DataFrame) -> DataFrame:
    """Codewords of the pretrained book where it has the code, else the current ones."""
    return current.join(pretrained.select("code", F.col("vec").alias("pre")), "code", "left").select("code", F.coalesce("pre", "vec").alias("vec"))


def kmeans(rows: DataFrame, key: str, vector: str, k: int, rounds: int) -> DataFrame:
    """(code, n, vector): k centres after Lloyd's rounds, from the k rows least by the hash of their key (ties by key, then vector); an empty centre stays where it is.

    The centres (k, bounded by the codebook) travel with each round's plan; rows are read once a round and
    only sums are shuffled.
    """
    spark = rows.sparkSession
    first = rows.select(F.md5(F.col(key).cast("string")).alias("h"), key, vector).orderBy("h", key, vector).limit(k).collect()
    centres, counts = [[float(x) for x in r[vector]] for r in first], [None] * len(first)
    for _ in range(rounds):
        if not centres:
            break
        dist = F.array(*(F.struct(sum(((F.get(vector, F.lit(j)) - x) * (F.get(vector, F.lit(j)) - x) for j, x in enumerate(c)), F.lit(0.0)).alias("d"), F.lit(i).alias("code")) for i, c in enumerate(centres)))
        near = rows.select(F.array_min(dist)["code"].alias("code"), vector)
        got = near.groupBy("code").agg(F.count("*").alias("n"), F.array(*(F.avg(F.get(vector, F.lit(j))) for j in range(len(centres[0])))).alias("m")).collect()
        counts = [None] * len(centres)
        for r in got:
            centres[r["code"]], counts[r["code"]] = list(r["m"]), r["n"]
    return spark.createDataFrame([(i, n, c) for i, (c, n) in enumerate(zip(centres, counts, strict=True))], f"code int, n bigint, {vector} array<double>")
