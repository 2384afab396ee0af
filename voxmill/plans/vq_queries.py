"""Queries over vectors and codebooks; the codebook is the embeddings of the 16 lowest ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vq
from .base import V, query, table, voxels

K = 16
CB = f"""e as (select vec_id, embedding as vec, label from embeddings), c as (select row_number() over (order by vec_id) - 1 as code, vec from (select * from e order by vec_id limit {K})),
d as (select e.vec_id, e.label, e.vec, c.code, list_sum(list_transform(list_zip(e.vec, c.vec), lambda t: (t[1]::double - t[2]::double) * (t[1]::double - t[2]::double))) as dist from e, c),
n as (select vec_id, label, vec, code, dist from (select *, row_number() over (partition by vec_id order by dist, code) as r from d) where r = 1)"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def codebook(spark, sf):
    low = vectors(spark, sf).orderBy("vec_id").limit(K).agg(F.sort_array(F.collect_list(F.struct("vec_id", "vec"))).alias("r"))
    return low.select(F.posexplode("r").alias("code", "c")).select(F.col("code").cast("long").alias("code"), F.col("c.vec").alias("vec"))


def assigned(spark, sf):
    v = vectors(spark, sf)
    return vq.nearest_code(v, codebook(spark, sf), K).join(v.select("vec_id", "label"), "vec_id")


@query(f"with {CB} select vec_id, code, round(dist, 4) as dist from n")
def nearest_code(spark, sf):
    return vq.nearest_code(vectors(spark, sf), codebook(spark, sf), K).select("vec_id", "code", F.round("dist", 4).alias("dist"))


@query(f"with {CB}, u as (select label, code, count(*)::double as k from n group by 1, 2), h as (select label, ln(sum(k)) - sum(k * ln(k)) / sum(k) as h, count(*) as used from u group by 1) select label, round(h, 5) as entropy, used, round(exp(h), 5) as perplexity, round(used / {K}.0, 6) as utilisation from h")
def vq_usage(spark, sf):
    u = vq.usage(assigned(spark, sf), "label", K)
    return u.select("label", F.round("entropy", 5).alias("entropy"), "used", F.round("perplexity", 5).alias("perplexity"), F.round("utilisation", 6).alias("utilisation"))


@query(f"""with {CB}, f as (select code, d, sum(x) as s from (select code, unnest(vec)::double as x, generate_subscripts(vec, 1) as d from n) group by 1, 2), z as (select code, count(*) as dn from n group by 1),
b as (select c.code, d, x::double as x, 1.0 * 0.99 + coalesce(dn, 0) * 0.01 as n2, dn from (select code, unnest(vec) as x, generate_subscripts(vec, 1) as d from c) c left join z on z.code = c.code),
t as (select sum(n2) as total, count(*) as k from (select distinct code, n2 from b))
select b.code, b.d::int as d, round(n2::double, 5) as n, round(case when dn is null then x else (x * 0.99 + coalesce(s, 0) * 0.01) / ((n2 + 1e-5) / (total + k * 1e-5) * total) end, 4) as x from b left join f on f.code = b.code and f.d = b.d, t""")
def ema_update(spark, sf):
    book = codebook(spark, sf).withColumn("n", F.lit(1.0)).withColumn("vec", F.transform("vec", lambda x: x.cast("double"))).withColumn("w", F.col("vec"))
    out = vq.ema_update(assigned(spark, sf).select("code", "vec"), book)
    return out.select("code", F.round("n", 5).alias("n"), F.posexplode("vec").alias("d", "x")).select("code", (F.col("d") + 1).alias("d"), "n", F.round("x", 4).alias("x"))


@query("""with f as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as d from embeddings), s as (select label, d, avg(x) as m, avg(x * x) as q from f group by 1, 2)
select d::int as d, round(avg(m), 5) as mean, round(sqrt(greatest(0, avg(q) - avg(m) * avg(m))), 5) as std from s group by d""")
def latent_mean_std(spark, sf):
    out = vq.mean_std(vectors(spark, sf), "label")
    return out.select((F.col("d") + 1).alias("d"), F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(f"with {V}, b as (select sid, avg(tok) as m, stddev_pop(tok) as s from v group by 1) select v.sid, x, y, z, round((tok - m) / s, 5) as t from v join b on v.sid = b.sid")
def batch_broadcast(spark, sf):
    """One row a sample, joined by key: Spark broadcasts it as long as it is small."""
    v = voxels(spark, sf)
    b = v.groupBy("sid").agg(F.avg("tok").alias("m"), F.stddev_pop("tok").alias("s"))
    return v.join(b, "sid").select("sid", "x", "y", "z", F.round((F.col("tok") - F.col("m")) / F.col("s"), 5).alias("t"))


@query(f"with {V} select a.sid, x, y, z, (a.tok + b.tok)::int as t from v a join (select sid % 7 + 1 as sid, x, y, z, tok from v) b using (sid, x, y, z)")
def sparse_add(spark, sf):
    v = voxels(spark, sf)
    b = v.select((F.col("sid") % 7 + 1).cast("int").alias("sid"), "x", "y", "z", F.col("tok").alias("other"))
    return v.join(b, ["sid", "x", "y", "z"]).select("sid", "x", "y", "z", (F.col("tok") + F.col("other")).cast("int").alias("t"))


@query(f"with {CB}, o as (select code, vec from c), p as (select code, [x * 2 for x in vec] as vec from c where code < 10) select o.code, round(list_sum(coalesce(p.vec, o.vec)), 3) as s from o left join p on o.code = p.code")
def codebook_overlay(spark, sf):
    book = codebook(spark, sf).withColumn("vec", F.transform("vec", lambda x: x.cast("double")))
    pre = book.where("code < 10").withColumn("vec", F.transform("vec", lambda x: x * 2))
    return vq.overlay(book, pre).select("code", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 3).alias("s"))
