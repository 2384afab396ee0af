"""Queries over voxels: orders, neighbours, coarsening, filters, classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import space
from ..operators import voxel
from .base import MORTON, VM, V, in_z_order, query, voxels


@query(f"with {V} select sid, x, y, z, {MORTON} as code from v")
def morton_encode(spark, sf):
    return voxels(spark, sf).select("sid", "x", "y", "z", space.morton(strict=True).alias("code"))


@query(f"with {V} select sid, {MORTON} as code, x, y, z from v")
def morton_decode(spark, sf):
    coded = in_z_order(spark, sf).select("sid", "code")
    return coded.select("sid", "code", *(space.morton_axis("code", i).alias(c) for i, c in enumerate("xyz")))


@query(f"with {VM} select sid, x, y, z, rk as rank from s")
def morton_sort_rank(spark, sf):
    return voxel.ranked(voxels(spark, sf), space.morton()).select("sid", "x", "y", "z", "rank")


@query(f"with {V} select sid, x, y, z, row_number() over (partition by sid order by x * 1024 + y * 32 + z) - 1 as rank from v")
def linear_raster_rank(spark, sf):
    return voxel.ranked(voxels(spark, sf), space.raster((32, 32, 32))).select("sid", "x", "y", "z", "rank")


@query(f"""with {V}, t as (select sid, greatest(max(x), max(y), max(z)) + 1 as top from v group by sid)
select v.sid, x, y, z, ((x * top + y) * top + z)::bigint as code, row_number() over (partition by v.sid order by (x * top + y) * top + z) - 1 as rank from v join t on v.sid = t.sid""")
def packed_lex_rank(spark, sf):
    v = voxels(spark, sf)
    top = v.groupBy("sid").agg((F.greatest(F.max("x"), F.max("y"), F.max("z")) + 1).alias("top"))
    coded = v.join(top, "sid").withColumn("code", space.packed_lex(F.col("top")))
    return voxel.ranked(coded, F.col("code")).select("sid", "x", "y", "z", "code", "rank")


def hilbert_sql(rows: str, bits: int = 5, coords: tuple[str, str, str] = ("x", "y", "z"), tag: str = "h") -> str:
    """Relations of the Hilbert key by Skilling's transpose of (a, b, c): <tag>_code adds the column code to ``rows``."""
    out, at = [f"{tag}0 as (select *, {', '.join(f'{c}::bigint as {n}' for n, c in zip('abc', coords, strict=True))} from {rows})"], 0
    for i in range(bits - 1, 0, -1):
        for n in "abc":
            q, p = 1 << i, (1 << i) - 1
            on = f"{n} & {q} <> 0"
            t = f"(xor(a, {n}) & {p})"
            new = {"a": f"case when {on} then xor(a, {p}) else {'a' if n == 'a' else f'xor(a, {t})'} end"}
            if n != "a":
                new[n] = f"case when {on} then {n} else xor({n}, {t}) end"
            out.append(f"{tag}{at + 1} as (select * exclude ({', '.join(new)}), {', '.join(f'{e} as {c}' for c, e in new.items())} from {tag}{at})")
            at += 1
    out.append(f"{tag}g as (select * exclude (b, c), xor(a, b) as b, xor(c, xor(a, b)) as c from {tag}{at})")
    fold = "0"
    for i in range(bits - 1, 0, -1):
        fold = f"case when c & {1 << i} <> 0 then xor({fold}, {(1 << i) - 1}) else {fold} end" if i == bits - 1 else f"xor({fold}, case when c & {1 << i} <> 0 then {(1 << i) - 1} else 0 end)"
    out.append(f"{tag}t as (select * exclude (a, b, c), xor(a, t) as a, xor(b, t) as b, xor(c, t) as c from (select *, {fold} as t from {tag}g))")
    code = " | ".join(f"((({n} >> {i}) & 1) << {3 * i + 2 - k})" for i in range(bits) for k, n in enumerate("abc"))
    return ", ".join(out) + f", {tag}_code as (select * exclude (a, b, c, t), ({code})::bigint as code from {tag}t)"


@query(f"with {V}, {hilbert_sql('v')} select sid, x, y, z, code, row_number() over (partition by sid order by code, x, y, z) - 1 as rank from h_code")
def hilbert_rank(spark, sf):
    return voxel.ranked(voxels(spark, sf).withColumn("code", space.hilbert()), F.col("code")).select("sid", "x", "y", "z", "code", "rank")


def _rank(name: str, order: str) -> str:
    return f"row_number() over (partition by sid order by {order}, x, y, z) - 1 as {name}"


TRANSPOSED = MORTON.replace("(x::", "(_::").replace("(y::", "(x::").replace("(_::", "(y::")


@query(f"""with {V}, g as (select *, max(x) over (partition by sid) as mx, max(y) over (partition by sid) as my, max(z) over (partition by sid) as mz from v), e as (select sid, x, y, z, tok, (x * 255 // (greatest(mx, my, mz) + 1))::int as ex, (y * 255 // (greatest(mx, my, mz) + 1))::int as ey, (z * 255 // (greatest(mx, my, mz) + 1))::int as ez from g),
{hilbert_sql('e', 8, ('ex', 'ey', 'ez'), 'w')}, {hilbert_sql('v', 5, ('y', 'x', 'z'), 'u')}
select w.sid, w.x, w.y, w.z, {_rank('generic', MORTON).replace('(x::', '(w.x::').replace('(y::', '(w.y::').replace('(z::', '(w.z::').replace('sid', 'w.sid').replace(', x, y, z)', ', w.x, w.y, w.z)')}, row_number() over (partition by w.sid order by {TRANSPOSED.replace('(x::', '(w.x::').replace('(y::', '(w.y::').replace('(z::', '(w.z::')}, w.x, w.y, w.z) - 1 as transposed,
row_number() over (partition by w.sid order by w.code, w.x, w.y, w.z) - 1 as hilbert_scaled, row_number() over (partition by w.sid order by u.code, w.x, w.y, w.z) - 1 as hilbert_transposed, row_number() over (partition by w.sid order by w.z, w.y, w.x) - 1 as zyx
from w_code w join u_code u on w.sid = u.sid and w.x = u.x and w.y = u.y and w.z = u.z""")
def order_ranks(spark, sf):
    """Places under the other orders: Z-order of more bits than needed, Z-order and Hilbert with x and y exchanged, Hilbert on coordinates scaled to eight bits, z-y-x."""
    whole = Window.partitionBy("sid")  # as the places: all windows share the one shuffle by sample
    v = voxels(spark, sf).withColumn("top", F.greatest(*(F.max(c).over(whole) for c in "xyz")) + 1)
    v = v.withColumns({f"e{c}": F.floor(F.col(c) * 255 / F.col("top")).cast("int") for c in "xyz"})
    orders = {"generic": space.morton(bits=10), "transposed": space.morton("y", "x", "z"), "hilbert_scaled": space.hilbert("ex", "ey", "ez", bits=8), "hilbert_transposed": space.hilbert("y", "x", "z"), "zyx": space.raster((32, 32, 32), "z", "y", "x")}
    for name, code in orders.items():
        v = voxel.ranked(v, code, name)
    return v.select("sid", "x", "y", "z", *orders)


@query(f"with {V} select sid, ((((x + 2) // 8) * 8 + ((y + 2) // 8)) * 8 + ((z + 2) // 8))::bigint as win, count(*) as n, sum(tok)::bigint as s from v group by 1, 2")
def window_partition(spark, sf):
    v = voxels(spark, sf).withColumn("win", space.window_id((2, 2, 2), (8, 8, 8), 8))
    return v.groupBy("sid", "win").agg(F.count("*").alias("n"), F.sum("tok").alias("s"))


@query(f"""with {V}, o(dx, dy, dz) as (values (1, 0, 0), (0, 1, 0), (0, 0, 1))
select a.tok as src, b.tok as tgt, dx + 2 * dy + 3 * dz as dir, count(*) as n from v a cross join o join v b on a.sid = b.sid and a.x + dx = b.x and a.y + dy = b.y and a.z + dz = b.z group by 1, 2, 3""")
def face_pairs(spark, sf):
    p = voxel.neighbours(voxels(spark, sf))
    return p.groupBy(F.col("tok").alias("src"), F.col("other").alias("tgt"), (F.col("dx") + 2 * F.col("dy") + 3 * F.col("dz")).alias("dir")).agg(F.count("*").alias("n"))


@query(f"""with {VM}, r(d) as (values (-1), (0), (1)), o as (select p.d dx, q.d dy, t.d dz from r p, r q, r t where p.d <> 0 or q.d <> 0 or t.d <> 0),
g as (select a.sid, abs(a.rk - b.rk) as gap from s a cross join o join s b on a.sid = b.sid and a.x + dx = b.x and a.y + dy = b.y and a.z + dz = b.z)
select sid, count(*) as n, round(avg(gap), 6) as gap_mean, round(quantile_cont(gap, 0.5), 6) as gap_p50, round(quantile_cont(gap, 0.9), 6) as gap_p90 from g group by sid""")
def neighbour26_gap(spark, sf):
    v = voxel.ranked(voxels(spark, sf), space.morton())
    g = voxel.neighbours(v, space.NEIGHBOURS, "rank").withColumn("gap", F.abs(F.col("rank") - F.col("other")))
    q = lambda p: F.round(F.percentile("gap", F.lit(p)), 6)
    return g.groupBy("sid").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 6).alias("gap_mean"), q(0.5).alias("gap_p50"), q(0.9).alias("gap_p90"))


@query(f"with {V} select sid, (x // 4)::int as x, (y // 4)::int as y, (z // 4)::int as z, round(avg(tok), 6) as mean, count(*) as n from v group by 1, 2, 3, 4")
def downsample_mean(spark, sf):
    return voxel.downsample(voxels(spark, sf), 4).withColumn("mean", F.round("mean", 6))


@query(f"with {V} select sid, (x // 4)::int as x, (y // 4)::int as y, (z // 4)::int as z, round(sum(tok) / (count(*) + 1.0), 6) as mean, count(*) as n from v group by 1, 2, 3, 4")
def downsample_mean_with_zero(spark, sf):
    return voxel.downsample(voxels(spark, sf), 4, zero_based=True).withColumn("mean", F.round("mean", 6))


@query(f"""with {V}, k as (select sid, (x // 2)::int bx, (y // 2)::int by_, (z // 2)::int bz, (x % 2) * 4 + (y % 2) * 2 + z % 2 as k, tok from v),
p as (select sid, bx, by_, bz, count(*) as filled, {", ".join(f"coalesce(max(case when k = {i} then tok end)::varchar, '_') as p{i}" for i in range(8))} from k group by 1, 2, 3, 4)
select sid, bx, by_ as by, bz, filled::int as filled, concat_ws(',', {", ".join(f"p{i}" for i in range(8))}) as packed from p""")
def block_pack(spark, sf):
    p = voxel.block_pack(voxels(spark, sf), 2)
    return p.withColumn("packed", F.array_join(F.transform("packed", lambda t: t.cast("string")), ",", "_"))


@query(f"with {V} select sid, x, y, z, tok from v")
def block_unpack(spark, sf):
    return voxel.unpack(voxel.block_pack(voxels(spark, sf), 4), 4)


@query(f"""with {V}, b(d) as (values (0), (1)) select sid, (x * 2 + p.d)::int as x, (y * 2 + q.d)::int as y, (z * 2 + r.d)::int as z, tok from v, b p, b q, b r""")
def subdivide(spark, sf):
    return voxel.subdivide(voxels(spark, sf))


@query(f"with {V} select distinct sid, (x // 8)::int as x, (y // 8)::int as y, (z // 8)::int as z from v")
def coarse_occupancy(spark, sf):
    return voxel.coarse(voxels(spark, sf), 8)


@query(f"""with {V}, d(d) as (values (-1), (0), (1)) select distinct sid, x + p.d as x, y + q.d as y, z + r.d as z from v, d p, d q, d r
where tok < 2 and x + p.d between 0 and 31 and y + q.d between 0 and 31 and z + r.d between 0 and 31""")
def dilate(spark, sf):
    return voxel.dilate(voxels(spark, sf).where("tok < 2"), 1, 32)


@query(f"""with {V}, b as (select sid, greatest(min(x) - 1, 0) xl, least(max(x) + 1, 31) xh, greatest(min(y) - 1, 0) yl, least(max(y) + 1, 31) yh, greatest(min(z) - 1, 0) zl, least(max(z) + 1, 31) zh from v where x between 5 and 20 and y between 4 and 25 and z > 8 group by sid)
select v.* from v join b on v.sid = b.sid where x between xl and xh and y between yl and yh and z between zl and zh""")
def aabb_filter(spark, sf):
    v = voxels(spark, sf)
    box = voxel.bounds(v.where("x between 5 and 20 and y between 4 and 25 and z > 8"), 1, 32)
    return voxel.unless_empty(voxel.in_bounds(v, box), v)


@query(f"with {V} select * from v where exists (select 1 from v p where p.tok = 0 and p.sid = v.sid and p.x // 4 = v.x // 4 and p.y // 4 = v.y // 4 and p.z // 4 = v.z // 4)")
def parent_semi(spark, sf):
    v = voxels(spark, sf)
    cell = {f"p{c}": F.floor(F.col(c) / 4) for c in "xyz"}
    seeds = v.where("tok = 0").select("sid", *(e.alias(n) for n, e in cell.items())).distinct()
    return v.withColumns(cell).join(seeds, ["sid", *cell], "left_semi").select(*v.columns)


@query(f"with {V} select * from v where exists (select 1 from v p where p.tok < 8 and p.sid = v.sid + 1 and p.x = v.x and p.y = v.y and p.z = v.z)")
def key_semi(spark, sf):
    v = voxels(spark, sf)
    keys = v.where("tok < 8").select((F.col("sid") - 1).cast("int").alias("sid"), "x", "y", "z")
    return v.join(keys, ["sid", "x", "y", "z"], "left_semi")


@query("""with v as (select l_orderkey as sid, cast(l_partkey % 32 as int) x, cast(l_suppkey % 32 as int) y, cast(l_linenumber as int) z from lineitem)
select sid, count(*) as n from v where sid not in (select sid from v where x < 2 or y < 2 or x >= 30 or y >= 30 or z < 1 or z >= 31) group by sid""")
def edge_margin_anti(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    v = li.select(F.col("l_orderkey").alias("sid"), *((F.col(c) % 32).cast("int").alias(n) for c, n in (("l_partkey", "x"), ("l_suppkey", "y"))), F.col("l_linenumber").cast("int").alias("z"))
    # one aggregate instead of an anti-join: a sample goes if any voxel is near the edge
    near = (F.col("x") < 2) | (F.col("y") < 2) | (F.col("x") >= 30) | (F.col("y") >= 30) | (F.col("z") < 1) | (F.col("z") >= 31)
    return v.groupBy("sid").agg(F.count("*").alias("n"), F.bool_or(near).alias("near")).where("not near").select("sid", "n")


@query("select l_orderkey as sid, count(*) as n, count(*) filter (where abs(l_discount - 0.05) <= 0.02) as near from lineitem group by 1 having count(*) filter (where abs(l_discount - 0.05) <= 0.02) >= 2")
def band_filter(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    near = F.count_if(F.abs(F.col("l_discount") - 0.05) <= 0.02)
    return li.groupBy(F.col("l_orderkey").alias("sid")).agg(F.count("*").alias("n"), near.alias("near")).where("near >= 2")


GT = f"""{V}, g as (select sid, x, y, z, tok < 4 as sharp from v where (x + y + z) % 3 <> 0 and sid < 6)"""


@query(f"""with {GT}, c as (select v.sid, case when v.sid not in (select sid from g) then 'out_of_range' when g.sid is null then 'extra' when g.sharp then 'sharp' else 'inside' end as region, tok
from v left join g on v.sid = g.sid and v.x = g.x and v.y = g.y and v.z = g.z) select sid, region, count(*) as n, sum(tok)::bigint as s from c group by 1, 2""")
def gt_classify(spark, sf):
    v = voxels(spark, sf)
    truth = v.where("(x + y + z) % 3 <> 0 and sid < 6").select("sid", "x", "y", "z", (F.col("tok") < 4).alias("sharp"))
    return voxel.classify(v, truth).groupBy("sid", "region").agg(F.count("*").alias("n"), F.sum("tok").alias("s"))


@query(f"""with {GT}, c as (select case when g.sid is null then 'extra' when g.sharp then 'sharp' else 'inside' end as region, abs(tok / 16.0 - 0.5) as d
from v left join g on v.sid = g.sid and v.x = g.x and v.y = g.y and v.z = g.z)
select r.region, count(d) as n, round(coalesce(avg(d), 0), 6) as l1, round(coalesce(avg(d * d), 0), 6) as l2, round(coalesce(0.5 * avg(d) + 0.5 * avg(d * d), 0), 6) as mix
from (values ('inside'), ('sharp'), ('extra'), ('none')) r(region) left join c on c.region = r.region group by 1""")
def region_loss(spark, sf):
    v = voxels(spark, sf)
    truth = v.where("(x + y + z) % 3 <> 0 and sid < 6").select("sid", "x", "y", "z", (F.col("tok") < 4).alias("sharp"))
    seen = voxel.classify(v, truth).withColumn("region", F.when(F.col("region") == "out_of_range", "extra").otherwise(F.col("region")))
    d = F.abs(F.col("tok") / 16.0 - 0.5)
    every = spark.createDataFrame([("inside",), ("sharp",), ("extra",), ("none",)], "region string")
    means = seen.groupBy("region").agg(F.count("*").alias("n"), F.avg(d).alias("a"), F.avg(d * d).alias("b"))
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    out = every.join(F.broadcast(means), "region", "left")
    return out.select("region", F.coalesce("n", F.lit(0)).alias("n"), z(F.col("a")).alias("l1"), z(F.col("b")).alias("l2"), z(0.5 * F.col("a") + 0.5 * F.col("b")).alias("mix"))


@query(f"with {V} select sid, x, y, z, tok from v where tok <> 0")
def nonzero_coo(spark, sf):
    return voxels(spark, sf).where("tok <> 0")


@query(f"""with {V}, n as (select sid, count(*) as n, count(*) filter (where abs(tok - 8) <= 1) as b1, count(*) filter (where abs(tok - 8) <= 2) as b2, count(*) filter (where abs(tok - 8) <= 4) as b4,
count(*) filter (where tok > 8) as pos, count(*) filter (where tok < 8) as neg, round(quantile_cont(tok, 0.01), 6) as q01, round(quantile_cont(tok, 0.5), 6) as q50, round(quantile_cont(tok, 0.99), 6) as q99, min(x) as x_low, max(x) as x_high from v group by sid) select * from n""")
def band_diagnostics(spark, sf):
    t = F.col("tok")
    q = lambda p: F.round(F.percentile(t, F.lit(p)), 6)
    near = lambda k: F.count_if(F.abs(t - 8) <= k)
    return voxels(spark, sf).groupBy("sid").agg(F.count("*").alias("n"), near(1).alias("b1"), near(2).alias("b2"), near(4).alias("b4"), F.count_if(t > 8).alias("pos"), F.count_if(t < 8).alias("neg"), q(0.01).alias("q01"), q(0.5).alias("q50"), q(0.99).alias("q99"), F.min("x").alias("x_low"), F.max("x").alias("x_high"))


@query(f"with {V} select sid, plane, count(*) as n, sum(tok)::bigint as s from (select sid, 'x' as plane, tok from v where x = 16 union all select sid, 'y', tok from v where y = 16 union all select sid, 'z', tok from v where z = 16) group by 1, 2")
def mid_slices(spark, sf):
    return voxel.mid_slices(voxels(spark, sf), 16).groupBy("sid", "plane").agg(F.count("*").alias("n"), F.sum("tok").alias("s"))


@query(f"with {V} select sid, (x // 2)::int as x, (y // 2)::int as y, (z // 2)::int as z, tok from v where x % 2 = 0 and y % 2 = 0 and z % 2 = 0")
def stride2(spark, sf):
    even = voxels(spark, sf).where("x % 2 = 0 and y % 2 = 0 and z % 2 = 0")
    return even.select("sid", *(F.floor(F.col(c) / 2).cast("int").alias(c) for c in "xyz"), "tok")


@query(f"with {V} select sid, x, y, z, tok from v")
def chunk_halo_round_trip(spark, sf):
    return voxel.join_chunks(voxel.chunks_with_halo(voxels(spark, sf), 8, 2), 8, 2)


@query(f"""with {V}, d(d) as (values (-1), (0), (1)), c as (select sid, x // 8 + p.d as cx, y // 8 + q.d as cy, z // 8 + r.d as cz, x, y, z from v, d p, d q, d r)
select sid, cx::int as cx, cy::int as cy, cz::int as cz, count(*) as n from c where cx >= 0 and cy >= 0 and cz >= 0 and x between cx * 8 - 2 and cx * 8 + 9 and y between cy * 8 - 2 and cy * 8 + 9 and z between cz * 8 - 2 and cz * 8 + 9 group by 1, 2, 3, 4""")
def chunk_halo_sizes(spark, sf):
    c = voxel.chunks_with_halo(voxels(spark, sf), 8, 2)
    return c.groupBy("sid", "cx", "cy", "cz").agg(F.count("*").alias("n"))


@query(f"with {V} select sid, x, y, z, round((x + 0.5) / 32 - 0.5, 6) as cx, round((y + 0.5) / 32 - 0.5, 6) as cy, round((z + 0.5) / 32 - 0.5, 6) as cz, x as vx from v")
def centres(spark, sf):
    v = voxels(spark, sf).select("sid", "x", "y", "z", *(F.round(space.centre_of(c, 32), 6).alias(f"c{c}") for c in "xyz"))
    return v.withColumn("vx", space.voxel_of("cx", 32))


@query("""with p as (select p_partkey, p_retailprice, min(p_retailprice) over () as lo, max(p_retailprice) over () as hi from part)
select p_partkey, round((p_retailprice - lo) / (hi - lo) - 0.5, 6) as pos, least(greatest(cast(trunc(((p_retailprice - lo) / (hi - lo)) * 64) as int), 0), 63) as cell from p""")
def bbox_rescale(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    ends = part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    unit = (F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return part.join(F.broadcast(ends)).select("p_partkey", F.round(unit - 0.5, 6).alias("pos"), F.least(F.greatest((unit * 64).cast("int"), F.lit(0)), F.lit(63)).alias("cell"))


@query(f"""with {V}, g as (select sid, x, y, z, row_number() over (partition by sid order by x * 1024 + y * 32 + z) - 1 as i from v where (x + y) % 3 <> 0)
select v.sid, v.x, v.y, v.z, coalesce(g.i, -1) as place from v left join g on v.sid = g.sid and v.x = g.x and v.y = g.y and v.z = g.z""")
def lookup_places(spark, sf):
    """Place of each output voxel in its sample's sorted truth keys, -1 where the truth lacks it."""
    v = voxels(spark, sf)
    truth = voxel.ranked(v.where("(x + y) % 3 <> 0"), space.raster((32, 32, 32)), "place").select("sid", "x", "y", "z", "place")
    return v.join(truth, ["sid", "x", "y", "z"], "left").select("sid", "x", "y", "z", F.coalesce("place", F.lit(-1)).cast("long").alias("place"))
