"""Queries over small value operators, codebook re-estimation and view means."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import ct, stats, values, vq
from .base import V, query, table, voxels


@query("select p_partkey, lower(replace(replace(p_type || '-' || p_brand, ' ', '_'), '-', '_')) as organ from part")
def organ_clean(spark, sf):
    return table(spark, sf, "part").select("p_partkey", values.clean_name(F.concat("p_type", F.lit("-"), "p_brand")).alias("organ"))


@query("select p_partkey, case p_partkey % 6 when 0 then 'liver' when 1 then 'spleen' when 2 then 'spleen' when 3 then 'kidney' when 4 then 'kidney' else 'organ_5' end as organ from part")
def channel_organ(spark, sf):
    names = F.create_map(*(F.lit(x) for x in ("1", "liver", "2", "spleen", "4", "kidney")))
    return table(spark, sf, "part").select("p_partkey", values.channel_name(F.col("p_partkey") % 6, names).alias("organ"))


@query("""with c as (select o_orderkey, (100 + o_orderkey % 400)::int as h, (90 + o_custkey % 500)::int as w, (o_orderkey % 97 * 10 + 1)::int as d from orders), t as (select *, case when greatest(h, w, d) <= 512 then 512 else 1024 end as target from c)
select o_orderkey, target::int as target, (target - h)::int as pad_h, (target - w)::int as pad_w, (target - d)::int as pad_d from t""")
def pad_to_target(spark, sf):
    c = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 400 + 100).cast("int").alias("h"), (F.col("o_custkey") % 500 + 90).cast("int").alias("w"), (F.col("o_orderkey") % 97 * 10 + 1).cast("int").alias("d"))
    c = c.withColumn("target", ct.target_resolution(F.greatest("h", "w", "d")))
    pads = values.pad_amounts([F.col(s) for s in "hwd"], F.col("target"))
    return c.select("o_orderkey", "target", *(p.alias(f"pad_{s}") for p, s in zip(pads, "hwd", strict=True)))


@query(f"with {V}, s as (select sid, max(x) - 3 as sx, max(y) - 1 as sy, max(z) as sz from v group by 1) select v.* from v join s on v.sid = s.sid where x < sx and y < sy and z < sz")
def crop_back(spark, sf):
    v = voxels(spark, sf)
    sizes = v.groupBy("sid").agg((F.max("x") - 3).alias("size_x"), (F.max("y") - 1).alias("size_y"), F.max("z").alias("size_z"))
    return values.cropped(v, sizes, ["sid"])


@query("""with p as (select l_orderkey, l_linenumber, ((l_discount * 10000000)::bigint << 1) | (l_linenumber % 2) as packed from lineitem)
select l_orderkey, l_linenumber, packed, round(greatest(-1.0, least(1.0, (case when packed & 1 = 1 then -1 else 1 end) * (packed >> 1) / 10000000.0 / 0.06)), 6) as sdf from p""")
def sdf_pack(spark, sf):
    p = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", values.pack_distance(F.round("l_discount", 7) + 1e-9, F.col("l_linenumber") % 2 == 1).alias("packed"))
    return p.withColumn("sdf", F.round(values.unpack_distance(F.col("packed"), F.lit(0.06)), 6))


@query("""with n as (select l_returnflag, 2 * l_discount * 5 - 1 as a, 2 * l_tax * 5 - 1 as b, 2 * (l_quantity / 50) - 1 as c, 2 * l_tax * 10 - 1 as d, 2 * l_discount * 8 - 1 as e, 2 * (l_linenumber / 7.0) - 1 as f from lineitem),
m as (select l_returnflag, a * d + b * e + c * f as dot, sqrt(a * a + b * b + c * c) * sqrt(d * d + e * e + f * f) as norm from n)
select l_returnflag as k, count(*) filter (where norm > 1e-9) as n, round(avg(degrees(acos(greatest(-1.0, least(1.0, dot / (norm + 1e-9)))))) filter (where norm > 1e-9), 5) as angle from m group by 1""")
def normal_angle(spark, sf):
    c = lambda name, k: F.col(name) * k
    ang = values.angle([c("l_discount", 5), c("l_tax", 5), F.col("l_quantity") / 50], [c("l_tax", 10), c("l_discount", 8), F.col("l_linenumber") / 7.0])
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count(ang).alias("n"), F.round(F.avg(ang), 5).alias("angle"))


@query(f"""with v as (select o_orderkey as n, (select sum(floor(o_orderkey / pow(2.0, i)) % 2 / pow(2.0, i + 1)) from range(32) r(i)) as r from orders), u as (select n, r, case when (n % 4096) / 4096.0 < 0.25 then 2 * ((n % 4096) / 4096.0) else 2 / 3.0 * ((n % 4096) / 4096.0) + 1 / 3.0 end as u from v)
select n, round(r, 8) as inverse, round((select sum(floor((n % 4096) / pow(2.0, i)) % 2 / pow(2.0, i + 1)) from range(32) q(i)) * 2 * pi(), 6) as phi, round(acos(1 - 2 * u) - pi() / 2, 6) as theta from u""")
def sphere_points(spark, sf):
    n = F.col("o_orderkey")
    phi, theta = values.sphere_point(n % 4096, F.lit(4096.0))
    return table(spark, sf, "orders").select(n.alias("n"), F.round(values.radical_inverse(n, 2, 32), 8).alias("inverse"), F.round(phi, 6).alias("phi"), F.round(theta, 6).alias("theta"))


@query(f"""with k as (select o_orderkey, pow(sin({10 / 360 * math.pi!r}) * 2 / sqrt(3), 2) as lo, pow(sin({70 / 360 * math.pi!r}) * 2 / sqrt(3), 2) as hi, (o_orderkey % 1000) / 1000.0 as s from orders), r as (select o_orderkey, 1 / sqrt(lo + s * (hi - lo)) as radius from k)
select o_orderkey, round(radius, 6) as radius, round(2 * asin(sqrt(3) / 2 / radius), 6) as fov from r""")
def camera_views(spark, sf):
    radius, fov = values.camera(F.col("o_orderkey") % 1000 / 1000.0)
    return table(spark, sf, "orders").select("o_orderkey", F.round(radius, 6).alias("radius"), F.round(fov, 6).alias("fov"))


@query("select o_orderkey as key, o_orderstatus as \"state.code\", o_orderpriority as \"state.more.priority\", o_totalprice as \"state.more.price\", 3::bigint as merged, o_totalprice > 1000 and o_orderkey > 10 as every, o_totalprice > 400000 or o_orderkey < 5 as some from orders")
def nested_records(spark, sf):
    """Nested records flattened, two maps merged, all and any over a record's flags."""
    o = table(spark, sf, "orders")
    more = F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    a = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.col("o_orderpriority"))
    merged = F.size(values.merged_maps(a, F.create_map(F.lit("c"), F.col("o_clerk") if "o_clerk" in o.columns else F.col("o_orderstatus")))).cast("long")
    every = F.forall(F.array(F.col("o_totalprice") > 1000, F.col("o_orderkey") > 10), lambda f: f)
    some = F.exists(F.array(F.col("o_totalprice") > 400000, F.col("o_orderkey") < 5), lambda f: f)
    return values.flattened(o.select(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("code"), more.alias("more")).alias("state"), merged.alias("merged"), every.alias("every"), some.alias("some")))


@query("""with s as (select source, sum(n_chars)::double * 1000000 as b, count(*) as docs, sum(n_chars)::bigint as chars from documents group by 1)
select source, case when b / 1073741824 >= 1024 then printf('%.2f TiB', b / 1073741824 / 1024) else printf('%.2f GiB', b / 1073741824) end as size, case when b / 1073741824 >= 1024 then printf('%.2fT', b / 1073741824 / 1024) when b / 1073741824 >= 100 then printf('%.0fG', b / 1073741824) else printf('%.1fG', b / 1073741824) end as short, chars * 32 + docs * 8192 as memory from s""")
def size_texts(spark, sf):
    s = table(spark, sf, "documents").groupBy("source").agg((F.sum("n_chars").cast("double") * 1000000).alias("b"), F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return s.select("source", values.size_text(F.col("b")).alias("size"), values.size_text_compact(F.col("b")).alias("short"), values.training_memory(F.col("chars"), F.col("docs")).alias("memory"))


@query("""select l_orderkey % 50 as case_id, count(*) as voxels, sum((l_extendedprice - 20000 between -1350 and 150)::int)::bigint as inside from lineitem where l_returnflag = 'R' group by 1""")
def mask_in_window(spark, sf):
    """Voxels of one organ whose value lies in a window: the mask and the window's binary image at once."""
    o = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") % 50).alias("case_id"), (F.col("l_extendedprice") - 20000).alias("hu"))
    return o.groupBy("case_id").agg(F.count("*").alias("voxels"), F.sum(ct.binarise(F.col("hu"), F.lit(1500), F.lit(-600))).alias("inside"))


@query("select l_linenumber as head, round(avg(l_discount), 6) as mean, max(l_discount) as high, min(l_discount) as low, round(avg((l_discount < 0.03)::int), 6) as below from lineitem group by 1")
def attention_stats(spark, sf):
    a = F.col("l_discount")
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("head")).agg(F.round(F.avg(a), 6).alias("mean"), F.max(a).alias("high"), F.min(a).alias("low"), F.round(F.avg((a < 0.03).cast("double")), 6).alias("below"))


@query("select l_orderkey % 64 as sample, l_partkey % 128 as voxel, count(*) as views, round(avg(l_tax), 6) as a, round(avg(l_discount), 6) as b from lineitem group by 1, 2")
def view_means(spark, sf):
    """Mean feature of each voxel over the views that see it, by dimension."""
    seen = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 64).alias("sample"), (F.col("l_partkey") % 128).alias("voxel"), F.array("l_tax", "l_discount").alias("f"))
    return seen.groupBy("sample", "voxel").agg(F.count("*").alias("views"), *(F.round(F.avg(F.col("f")[i]), 6).alias(n) for i, n in enumerate("ab")))


@query("""select distinct cast(trunc((l_discount * 5 - 0.25 + 0.5) * 16) as int) as x, cast(trunc((l_tax * 5 - 0.25 + 0.5) * 16) as int) as y, cast(trunc((l_quantity / 100 - 0.25 + 0.5) * 16) as int) as z from lineitem""")
def occupancy_grid(spark, sf):
    p = table(spark, sf, "lineitem").select((F.col("l_discount") * 5 - 0.25).alias("x"), (F.col("l_tax") * 5 - 0.25).alias("y"), (F.col("l_quantity") / 100 - 0.25).alias("z"))
    return p.select(*(((F.col(c) + 0.5) * 16).cast("int").alias(c) for c in "xyz")).distinct()


@query("""select 'nan' as issue, count(*) as n from events where isnan(value) union all select 'infinite', count(*) from events where isinf(value) union all select 'negative', count(*) from events where value < 0
union all select 'null', count(*) from events where value is null union all select 'one_kind', count(*) from (select user_id from events group by 1 having count(distinct event_type) = 1)""")
def finite_issues(spark, sf):
    v = F.col("value")
    e = table(spark, sf, "events")
    flags = e.agg(F.count_if(F.isnan(v)).alias("nan"), F.count_if(F.abs(v) == float("inf")).alias("infinite"), F.count_if(v < 0).alias("negative"), F.count_if(v.isNull()).alias("null"))
    one = e.groupBy("user_id").agg(F.countDistinct("event_type").alias("k")).where("k = 1").agg(F.count("*").alias("one_kind"))
    return flags.join(F.broadcast(one)).unpivot([], ["nan", "infinite", "negative", "null", "one_kind"], "issue", "n")


def _step_sql(k: int) -> str:
    near = f"a{k} as materialized (select r, any_value(p) as p, arg_min(id, (d, id)) as c from (select e.r, e.p, c.id, pow(e.p[1] - c.p[1], 2) + pow(e.p[2] - c.p[2], 2) + pow(e.p[3] - c.p[3], 2) as d from e, k{k} c) group by 1)"
    return near + f", k{k + 1} as materialized (select k.id, coalesce(any_value(m), any_value(k.p)) as p from k{k} k left join (select c, [avg(p[1]), avg(p[2]), avg(p[3])] as m from a{k} group by 1) n on k.id = n.c group by 1)"


@query(f"""with e as materialized (select row_number() over () as r, l_orderkey * 10 + l_linenumber as i, [l_quantity / 50.0, l_discount * 10.0, l_tax * 12.5]::double[] as p from lineitem), k0 as materialized (select row_number() over (order by h, i, p) - 1 as id, p from (select i, p, md5(i::varchar) as h from e order by h, i, p limit 6)),
{", ".join(_step_sql(k) for k in range(3))} select k.id::int as code, n, round(p[1], 6) as a, round(p[2], 6) as b, round(p[3], 6) as c from k3 k left join (select c, count(*) as n from a2 group by 1) s on k.id = s.c""")
def kmeans_codebook(spark, sf):
    """A codebook re-estimated by three rounds of k-means from rows drawn by hash."""
    e = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 12.5).alias("p"))
    c = vq.kmeans(e, "i", "p", 6, 3)
    return c.select("code", "n", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate("abc")))


@query(f"with {V} select sid, round(quantile_cont(tok * 37 + x, 0.1), 6) as p10, round(quantile_cont(tok * 37 + x, 0.5), 6) as p50, round(quantile_cont(tok * 37 + x, 0.999), 6) as p999 from v group by 1")
def bucket_quantiles(spark, sf):
    """Exact quantiles in two steps, by counts of value ranges first: no task holds a group's values."""
    v = voxels(spark, sf).select("sid", (F.col("tok") * 37 + F.col("x")).alias("value"))
    q = stats.quantiles(v, ["sid"], "value", {"p10": 0.1, "p50": 0.5, "p999": 0.999})
    return q.select("sid", *(F.round(c, 6).alias(c) for c in ("p10", "p50", "p999")))
