"""Queries over token statistics: entropies, pairs, orders, likelihoods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import space
from ..operators import experiments, sequence, stats, voxel
from .base import VM, V, W, in_z_order, query, voxels, words


def r6(name):
    return F.round(F.col(name), 6).alias(name)


def h_sql(counts, key, log="ln"):
    """Entropy from a relation with key and n."""
    return f"select {key}, round(greatest(0.0, {log}(sum(n)) - sum(n * {log}(n)) / sum(n)), 6) as entropy from {counts} group by {key}"


@query(f"with {V}, c as (select sid, tok, count(*)::double as n from v group by 1, 2) {h_sql('c', 'sid')}")
def entropy_h1(spark, sf):
    return stats.entropy(voxels(spark, sf), ["sid"], "tok").select("sid", r6("entropy"))


@query(f"with {V}, c as (select sid, tok, count(*)::double as n from v group by 1, 2) {h_sql('c', 'sid', 'log2')}")
def entropy_bits(spark, sf):
    return stats.entropy(voxels(spark, sf), ["sid"], "tok", base2=True).select("sid", r6("entropy"))


@query(f"with {V}, c as (select sid, tok, count(*)::double as n from v group by 1, 2) select sid, round(-ln(sum(n * n) / (sum(n) * sum(n))), 6) as renyi2 from c group by sid")
def renyi2(spark, sf):
    return stats.renyi2(voxels(spark, sf), ["sid"], "tok").select("sid", r6("renyi2"))


BI = f"{VM}, b as (select sid, tok as g1, lead(tok) over (partition by sid order by code) as g2, lead(tok, 2) over (partition by sid order by code) as g3 from m)"


def grams(spark, sf, n):
    return stats.ngrams(in_z_order(spark, sf), ["sid"], ["code"], "tok", n)


@query(f"with {BI}, c as (select sid, g1, g2, count(*)::double as n from b where g2 is not null group by 1, 2, 3) {h_sql('c', 'sid')}")
def bigram_entropy(spark, sf):
    return stats.ngram_entropy(grams(spark, sf, 2), ["sid"], 2).select("sid", r6("entropy"))


@query(f"""with {BI}, p as (select sid, g1, g2, count(*)::double as n from b where g2 is not null group by 1, 2, 3), q as (select sid, g1, sum(n) as n from p group by 1, 2),
j as (select sid, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from p group by 1), f as (select sid, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from q group by 1)
select j.sid, round(greatest(0.0, j.h - f.h), 6) as cond_entropy from j join f on j.sid = f.sid""")
def bigram_conditional(spark, sf):
    return stats.conditional_entropy(grams(spark, sf, 2), ["sid"]).select("sid", r6("cond_entropy"))


@query(f"""with {BI}, p as (select sid, g1, g2, g3, count(*)::double as n from b where g3 is not null group by 1, 2, 3, 4), q as (select sid, g1, g2, sum(n) as n from p group by 1, 2, 3),
j as (select sid, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from p group by 1), f as (select sid, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from q group by 1)
select j.sid, round(greatest(0.0, j.h - f.h), 6) as rate from j join f on j.sid = f.sid""")
def ngram_rate(spark, sf):
    return stats.entropy_rate(grams(spark, sf, 3), ["sid"], 3).select("sid", r6("rate"))


@query(f"with {BI}, c as (select sid, g1, g2, g3, count(*) as n from b where g3 is not null group by 1, 2, 3, 4) select sid, round(sum(case when n > 1 then n else 0 end) / sum(n), 6) as repeat_mass, round(count(*) / sum(n), 6) as distinct_rate from c group by sid")
def repeat_mass(spark, sf):
    return stats.repeat_mass(grams(spark, sf, 3), ["sid"], 3).select("sid", r6("repeat_mass"), r6("distinct_rate"))


@query(f"""with {W}, b as (select w as g1, lead(w) over (partition by doc_id order by pos) as g2 from w), c as (select g1, g2, count(*)::double as n from b where g2 is not null group by 1, 2)
select round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 5) as entropy, count(*) as pairs, count(*) filter (where n > 1) as repeated from c""")
def word_bigrams(spark, sf):
    c = stats.counts(stats.ngrams(words(spark, sf), ["doc_id"], ["pos"], "w", 2), [], "g1", "g2")
    h = F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")
    return c.agg(F.round(h, 5).alias("entropy"), F.count("*").alias("pairs"), F.count_if(F.col("n") > 1).alias("repeated"))


@query(f"with {VM}, d as (select sid, code - lag(code) over (partition by sid order by code) as delta from m), c as (select sid, delta, count(*)::double as n from d where delta is not null group by 1, 2) {h_sql('c', 'sid', 'log2')}")
def anchor_delta(spark, sf):
    w = Window.partitionBy("sid").orderBy("code")
    d = in_z_order(spark, sf).select("sid", (F.col("code") - F.lag("code").over(w)).alias("delta")).where("delta is not null")
    return stats.entropy(d, ["sid"], "delta", base2=True).select("sid", r6("entropy"))


PAIRS = f"""{V}, o(dx, dy, dz) as (values (1, 0, 0), (0, 1, 0), (0, 0, 1)), p as (select a.sid, a.tok as s, b.tok as t, dx + 2 * dy + 3 * dz as d, count(*)::double as n
from v a cross join o join v b on a.sid = b.sid and a.x + dx = b.x and a.y + dy = b.y and a.z + dz = b.z group by 1, 2, 3, 4)"""


def _h(name, cols):
    return f"{name} as (select sid, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h, sum(n) as n from (select sid, {cols}, sum(n) as n from p group by sid, {cols}) group by sid)"


@query(f"""with {PAIRS}, {_h('hp', 's, t, d')}, {_h('hs', 's, d')}, {_h('ht', 't')}, {_h('hd', 'd')}
select hp.sid, hp.n::bigint as pairs, round(hp.h, 6) as h_pair, round(hs.h, 6) as h_src_dir, round(ht.h, 6) as h_tgt, round(hd.h, 6) as h_dir, round(greatest(0.0, hp.h - hs.h), 6) as cond,
round(greatest(0.0, ht.h - greatest(0.0, hp.h - hs.h)), 6) as mi from hp join hs on hp.sid = hs.sid join ht on hp.sid = ht.sid join hd on hp.sid = hd.sid""")
def directed_pair_mi(spark, sf):
    p = voxel.neighbours(voxels(spark, sf)).withColumn("dir", F.col("dx") + 2 * F.col("dy") + 3 * F.col("dz"))
    out = stats.directed_pairs(p, ["sid"])
    return out.select("sid", "pairs", *(r6(c) for c in ("h_pair", "h_src_dir", "h_tgt", "h_dir", "cond", "mi")))


@query(f"""with {PAIRS}, q as (select d, s, t, sum(n) as n from p group by 1, 2, 3), a as (select d, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h, sum(n) as n from q group by 1),
b as (select d, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from (select d, s, sum(n) as n from q group by 1, 2) group by 1) select a.d as dir, a.n::bigint as pairs, round(a.h, 6) as h_pair, round(greatest(0.0, a.h - b.h), 6) as cond from a join b on a.d = b.d""")
def pair_stats_by_direction(spark, sf):
    p = voxel.neighbours(voxels(spark, sf)).withColumn("dir", F.col("dx") + 2 * F.col("dy") + 3 * F.col("dz"))
    n = stats.counts(p, ["dir"], "tok", "other")
    pair = stats.entropy_of_counts(n, ["dir"], "h_pair", True)
    src = stats.entropy_of_counts(n.groupBy("dir", "tok").agg(F.sum("n").alias("n")), ["dir"], "h_src", True)
    total = n.groupBy("dir").agg(F.sum("n").alias("pairs"))
    return pair.join(src, "dir").join(total, "dir").select("dir", "pairs", r6("h_pair"), F.round(F.greatest(F.lit(0.0), F.col("h_pair") - F.col("h_src")), 6).alias("cond"))


@query(f"with {V} select r.code, count(v.tok) as n, round(count(v.tok) * 100.0 / (select count(*) from v), 8) as pct from range(24) r(code) left join v on v.tok = r.code group by 1")
def codebook_freq_full(spark, sf):
    n = voxels(spark, sf).groupBy(F.col("tok").cast("long").alias("code")).agg(F.count("*").alias("n"))
    return stats.full_domain(n, 24).withColumn("pct", F.round("pct", 8))


@query(f"with {V} select tok, count(*) as n from v group by 1 order by n desc, tok limit 5")
def topk_codes(spark, sf):
    return voxels(spark, sf).groupBy("tok").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tok").limit(5)


@query(f"with {V} select sid, count(*) as n, count(distinct tok) as n_unique, round(count(distinct tok) / count(*), 6) as ratio from v group by 1")
def unique_codes(spark, sf):
    return voxels(spark, sf).groupBy("sid").agg(F.count("*").alias("n"), F.countDistinct("tok").alias("n_unique"), F.round(F.countDistinct("tok") / F.count("*"), 6).alias("ratio"))


STEP = f"""{VM}, d as (select sid, lead(x) over w - x as dx, lead(y) over w - y as dy, lead(z) over w - z as dz from m window w as (partition by sid order by code)),
e as (select sid, abs(dx) + abs(dy) + abs(dz) as l1, greatest(abs(dx), abs(dy), abs(dz)) as top, sqrt((dx * dx + dy * dy + dz * dz)::double) as dist from d where dx is not null)"""


@query(f"with {STEP} select sid, round(avg((l1 = 1)::int), 6) as face, round(avg((top <= 1 and l1 > 0)::int), 6) as near, round(avg(dist), 6) as dist_mean, round(quantile_cont(dist, 0.5), 6) as dist_median from e group by sid")
def consecutive_stats(spark, sf):
    out = sequence.pair_geometry(in_z_order(spark, sf), ["sid"], ["code"])
    return out.select("sid", *(r6(c) for c in ("face", "near", "dist_mean", "dist_median")))


@query(f"""with {VM}, g as (select sid, rk // 8 as g, count(*) as n, count(distinct (x, y, z)) as dis, max(x) - min(x) as sx, max(y) - min(y) as sy, max(z) - min(z) as sz from s group by 1, 2)
select sid, count(*) as groups, count(*) filter (where dis = 8 and sx = 1 and sy = 1 and sz = 1) as cubes from g where n = 8 group by sid""")
def cube8(spark, sf):
    return sequence.cubes_in_groups(in_z_order(spark, sf), ["sid"], ["code"])


@query(f"""with {VM}, g as (select sid, count(*) over w as n, max(x) over w - min(x) over w as sx, max(y) over w - min(y) over w as sy, max(z) over w - min(z) over w as sz from m window w as (partition by sid order by code rows between current row and 7 following))
select sid, count(*) as windows, count(*) filter (where sx = 1 and sy = 1 and sz = 1) as cubes from g where n = 8 group by sid""")
def cube8_sliding(spark, sf):
    return sequence.cubes_sliding(in_z_order(spark, sf), ["sid"], ["code"])


ORDER_SQL = """{V}, k as (select *, {code} as code from v), d as (select sid, tok, lead(tok) over w as nt, lead(x) over w - x as dx, lead(y) over w - y as dy, lead(z) over w - z as dz from k window w as (partition by sid order by code))"""


def _order_sql(code, name):
    return f"""select '{name}' as sort_order, d.sid, round(avg((abs(dx) + abs(dy) + abs(dz) = 1)::int), 6) as face, round(avg((greatest(abs(dx), abs(dy), abs(dz)) <= 1)::int), 6) as near
from (select sid, lead(x) over w - x as dx, lead(y) over w - y as dy, lead(z) over w - z as dz from (select *, {code} as code from v) window w as (partition by sid order by code)) d where dx is not null group by 2"""


@query(f"with {V} {_order_sql('x * 1024 + y * 32 + z', 'raster')} union all {_order_sql('z * 1024 + y * 32 + x', 'batch_zyx')}")
def order_compare(spark, sf):
    v = voxels(spark, sf)
    orders = {"raster": space.raster((32, 32, 32)), "batch_zyx": space.raster((32, 32, 32), "z", "y", "x")}
    out = None
    for name, code in orders.items():
        rows = sequence.pair_geometry(v.withColumn("code", code), ["sid"], ["code"]).select(F.lit(name).alias("sort_order"), "sid", r6("face"), r6("near"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""with {V}, e as (select sid, tok, count(*) as n from v group by 1, 2), c as (select quantile_cont(n, 1 / 3.0) as a, quantile_cont(n, 2 / 3.0) as b from e)
select case when n <= a then 'low' when n <= b then 'mid' else 'high' end as stratum, count(*) as keys, sum(n)::bigint as rows from e, c group by 1""")
def tertiles(spark, sf):
    n = voxels(spark, sf).groupBy("sid", "tok").agg(F.count("*").alias("n"))
    cuts = n.agg(F.percentile("n", F.lit(1 / 3)).alias("a"), F.percentile("n", F.lit(2 / 3)).alias("b"))
    stratum = F.when(F.col("n") <= F.col("a"), "low").when(F.col("n") <= F.col("b"), "mid").otherwise("high")
    return n.join(F.broadcast(cuts)).groupBy(stratum.alias("stratum")).agg(F.count("*").alias("keys"), F.sum("n").alias("rows"))


@query(f"""with {VM}, o(dx, dy, dz) as (values (1, 0, 0), (0, 1, 0), (0, 0, 1)), g as (select a.sid, abs(b.rk - a.rk) as gap from s a cross join o join s b on a.sid = b.sid and a.x + dx = b.x and a.y + dy = b.y and a.z + dz = b.z)
select sid, count(*) as edges, round(avg(gap), 6) as gap_mean, round(quantile_cont(gap, 0.5), 6) as p50, round(quantile_cont(gap, 0.9), 6) as p90, round(quantile_cont(gap, 0.99), 6) as p99, round(avg((gap = 1)::int), 6) as next_ratio from g group by sid""")
def rank_gap(spark, sf):
    v = voxel.ranked(voxels(spark, sf), space.morton())
    g = voxel.neighbours(v, value="rank").withColumn("gap", F.abs(F.col("other") - F.col("rank")))
    q = lambda p: F.round(F.percentile("gap", F.lit(p)), 6)
    return g.groupBy("sid").agg(F.count("*").alias("edges"), F.round(F.avg("gap"), 6).alias("gap_mean"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.round(F.avg((F.col("gap") == 1).cast("double")), 6).alias("next_ratio"))


@query(f"""with {V}, o(dx, dy, dz) as (values (1, 0, 0), (0, 1, 0), (0, 0, 1)), e as (select a.sid, count(*) filter (where dx = 1) as ex, count(*) filter (where dy = 1) as ey, count(*) filter (where dz = 1) as ez
from v a cross join o join v b on a.sid = b.sid and a.x + dx = b.x and a.y + dy = b.y and a.z + dz = b.z group by 1)
select v.sid, count(*) as n, count(distinct tok) as types, ((max(x) - min(x) + 1) * (max(y) - min(y) + 1) * (max(z) - min(z) + 1))::bigint as box, any_value(coalesce(ex, 0)) as ex, any_value(coalesce(ey, 0)) as ey, any_value(coalesce(ez, 0)) as ez from v left join e on v.sid = e.sid group by v.sid""")
def sample_rows(spark, sf):
    v = voxels(spark, sf)
    side = lambda c: F.max(c) - F.min(c) + 1
    base = v.groupBy("sid").agg(F.count("*").alias("n"), F.countDistinct("tok").alias("types"), (side("x") * side("y") * side("z")).cast("long").alias("box"))
    e = voxel.neighbours(v).groupBy("sid").agg(*(F.count_if(F.col(f"d{c}") == 1).alias(f"e{c}") for c in "xyz"))
    return base.join(e, "sid", "left").select("sid", "n", "types", "box", *(F.coalesce(f"e{c}", F.lit(0)).alias(f"e{c}") for c in "xyz"))


@query(f"""with {VM}, d as (select sid, tok, code - lag(code) over w as delta, lead(tok) over w as nt from m window w as (partition by sid order by code)),
a as (select sid, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h, sum(n) as r from (select sid, tok, count(*)::double as n from d group by 1, 2) group by 1),
b as (select sid, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from (select sid, delta, count(*)::double as n from d where delta is not null group by 1, 2) group by 1),
c as (select sid, greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n) - (select log2(sum(m)) - sum(m * log2(m)) / sum(m) from (select sid, tok, count(*)::double as m from d where nt is not null group by 1, 2) f where f.sid = g.sid)) as h from (select sid, tok, nt, count(*)::double as n from d where nt is not null group by 1, 2, 3) g group by 1)
select a.sid, round(a.h + b.h + c.h + 2.0 / a.r, 5) as cost from a join b on a.sid = b.sid join c on a.sid = c.sid""")
def lm_proxy(spark, sf):
    """Cost a leaf: r (H(token) + H(code step) + H(next | token)) + 2 / leaves, with r tokens a leaf (1 before any merge)."""
    z = in_z_order(spark, sf)
    w = Window.partitionBy("sid").orderBy("code")
    step = z.select("sid", (F.col("code") - F.lag("code").over(w)).alias("delta")).where("delta is not null")
    n = z.groupBy("sid").agg(F.count("*").alias("n"))
    parts = [stats.entropy(z, ["sid"], "tok", name="a", base2=True), stats.entropy(step, ["sid"], "delta", name="b", base2=True), stats.conditional_entropy(stats.ngrams(z, ["sid"], ["code"], "tok", 2), ["sid"], "c")]
    for p in parts:
        n = n.join(p, "sid")
    return n.select("sid", F.round(F.col("a") + F.col("b") + F.col("c") + 2.0 / F.col("n"), 5).alias("cost"))


@query(f"""with {V}, f as (select *, (x + y + z) % 5 as fold from v), k as (select * from range(5) r(fold)),
tr as (select k.fold, f.sid, f.tok, count(*) as n from k join f on f.fold <> k.fold group by 1, 2, 3), sz as (select fold, sid, sum(n) as total, count(*) as types from tr group by 1, 2),
te as (select fold, sid, tok, count(*) as m from f group by 1, 2, 3)
select te.fold::int as fold, te.sid, round(sum(-m * log2((coalesce(n, 0) + 1)::double / (total + types))) / sum(m), 6) as nll, sum(m)::bigint as tested from te join sz on te.fold = sz.fold and te.sid = sz.sid left join tr on tr.fold = te.fold and tr.sid = te.sid and tr.tok = te.tok group by 1, 2""")
def kfold_nll(spark, sf):
    v = voxels(spark, sf).withColumn("own", (F.col("x") + F.col("y") + F.col("z")) % 5)
    # a training row counts in every fold but its own: counts by own fold first, then folded out
    n = v.groupBy("own", "sid", "tok").agg(F.count("*").alias("k"))
    train = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold <> own").groupBy("fold", "sid", "tok").agg(F.sum("k").alias("n"))
    sizes = train.groupBy("fold", "sid").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    asked = n.select(F.col("own").alias("fold"), "sid", "tok", F.col("k").alias("m"))
    j = asked.join(train, ["fold", "sid", "tok"], "left").join(sizes, ["fold", "sid"])
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("types"))
    return j.groupBy("fold", "sid").agg(F.round(F.sum(-F.col("m") * F.log2(p)) / F.sum("m"), 6).alias("nll"), F.sum("m").alias("tested"))


@query(f"""with {V}, tr as (select sid, tok, count(*) as n from v where x >= 8 group by 1, 2), sz as (select sid, sum(n) as total, count(*) as types from tr group by 1), te as (select sid, tok, count(*) as m from v where x < 8 group by 1, 2)
select te.sid, round(sum(-m * log2((coalesce(n, 0) + 1)::double / (total + types))) / sum(m), 6) as nll, sum(m)::bigint as tested from te join sz on te.sid = sz.sid left join tr on tr.sid = te.sid and tr.tok = te.tok group by 1""")
def held_out_nll(spark, sf):
    v = voxels(spark, sf)
    return stats.additive_nll(v.where("x < 8"), v.where("x >= 8"), ["sid"], "tok").withColumn("nll", F.round("nll", 6))


@query(f"with {W}, c as (select w, count(*) as n from w group by 1) select w, n, row_number() over (order by n desc, w) as rank, round(log2(n), 6) as log2_n from c")
def zipf(spark, sf):
    """Ranks over all distinct words without a global window: buckets of equal counts and first letters carry the offset."""
    n = words(spark, sf).groupBy("w").agg(F.count("*").alias("n"))
    from ..operators import catalog

    out = catalog.numbered(n, F.struct((-F.col("n")).alias("neg"), F.substring("w", 1, 3).alias("head")), "w", name="rank")
    return out.select("w", "n", (F.col("rank") + 1).alias("rank"), F.round(F.log2(F.col("n").cast("double")), 6).alias("log2_n"))


def uniform_sql(key: str, seed: int) -> str:
    h = f"((({key}) * 7919 + {seed * 104729 + 12345}) % 2147483647)"
    for _ in range(3):
        h = f"(({h} * 48271 + 1) % 2147483647)"
    return f"({h} / 2147483647.0::double)"


def bootstrap_sql(rows: str, draws: int = 200) -> str:
    """Mean and interval of ``rows`` (k, v)."""
    limits = "[" + ", ".join(f"{x!r}::double" for x in experiments.poisson_limits()) + "]"
    return f"""w as (select b, v, len(list_filter({limits}, lambda t: t < {uniform_sql('k * 1000 + b', 17)})) as w from {rows}, range(1, {draws + 1}) r(b)), m as (select b, sum(w * v) / sum(w) as m from w group by 1)
select round((select avg(v) from {rows}), 6) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m"""


@query(f"with {V}, q as (select sid * 32 + x as k, count(distinct tok) / count(*) as v from v group by sid, x), {bootstrap_sql('q')}")
def bootstrap_ratio(spark, sf):
    n = voxels(spark, sf).groupBy("sid", "x").agg((F.countDistinct("tok") / F.count("*")).alias("ratio"))
    return experiments.bootstrap_mean(n, "ratio", F.col("sid") * 32 + F.col("x")).select(r6("mean"), r6("low"), r6("high"))


@query(f"with {V}, q as (select sid * 32 + x as k, avg(tok) filter (where y < 16) - avg(tok) filter (where y >= 16) as v from v group by sid, x having count(*) filter (where y < 16) > 0 and count(*) filter (where y >= 16) > 0), {bootstrap_sql('q')}")
def paired_bootstrap(spark, sf):
    """Interval of the mean difference between the two halves of each slice."""
    half = lambda t: F.avg(F.when(t, F.col("tok")))
    d = voxels(spark, sf).groupBy("sid", "x").agg((half(F.col("y") < 16) - half(F.col("y") >= 16)).alias("delta")).where("delta is not null")
    return experiments.bootstrap_mean(d, "delta", F.col("sid") * 32 + F.col("x")).select(r6("mean"), r6("low"), r6("high"))


@query(f"""with {V}, d as (select sid, x, avg(tok) - 7.5 as d from v group by 1, 2), n as (select count(*) filter (where d > 0) as positive, count(*) filter (where d < 0) as negative from d), t as (select *, (positive + negative)::double as n from n)
select positive, negative, case when n = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(n + 1) - lgamma(i + 1.0) - lgamma(n - i + 1) - n * ln(2.0))) from range((select least(positive, negative) + 1 from n)) r(i))) end as p from t""")
def sign_test(spark, sf):
    n = voxels(spark, sf).groupBy("sid", "x").agg((F.avg("tok") - 7.5).alias("delta"))
    return experiments.sign_test(n, "delta")


def _shuffle_sql(columns: str, kept: str) -> str:
    h = lambda s: f"row_number() over (partition by sid order by md5(concat_ws('|', '5', '{s}', sid, x, y, z, tok)), sid, x, y, z, tok)"
    return f"a as (select *, {h(0)} as i from v), b as (select *, {h(1)} as i from v), sh as (select a.sid, {kept}, {columns} from a join b on a.sid = b.sid and a.i = b.i)"


PAIR_H = "pr as (select a.sid, a.tok as s, b.tok as t, count(*)::double as n from sh a cross join (values (1, 0, 0), (0, 1, 0), (0, 0, 1)) o(dx, dy, dz) join sh b on a.sid = b.sid and a.x + dx = b.x and a.y + dy = b.y and a.z + dz = b.z group by 1, 2, 3)"


@query(f"with {V}, {_shuffle_sql('b.tok', 'a.x, a.y, a.z')}, {PAIR_H} {h_sql('pr', 'sid')}")
def control_token_shuffle(spark, sf):
    """Control: entropy of face pairs after the tokens of each sample are dealt anew."""
    mixed = experiments.shuffled(voxels(spark, sf), ["sid"], ["tok"], 5)
    return stats.entropy(voxel.neighbours(mixed), ["sid"], "tok", "other").select("sid", r6("entropy"))


@query(f"with {V}, {_shuffle_sql('b.x, b.y, b.z', 'a.tok')}, {PAIR_H} {h_sql('pr', 'sid')}")
def control_coord_shuffle(spark, sf):
    """Control: the same after the places of each sample are dealt anew."""
    mixed = experiments.shuffled(voxels(spark, sf), ["sid"], ["x", "y", "z"], 5)
    return stats.entropy(voxel.neighbours(mixed), ["sid"], "tok", "other").select("sid", r6("entropy"))


CELL = "((sid::bigint * 1024 + x) * 1024 + y) * 1024 + z"
TRANSFORMS = {
    "none": "select sid, x, y, z, tok from v",
    "noise": f"select sid, x, y, z, case when {uniform_sql(CELL, 3)} < 0.05 then floor({uniform_sql(CELL, 4)} * 16)::int else tok end as tok from v",
    "drop": f"select sid, x, y, z, tok from v where {uniform_sql(CELL, 3)} >= 0.05",
    "translate": "select sid, x + 3 as x, y + 1 as y, z + 2 as z, tok from v",
    "permute": "select sid, z as x, x as y, y as z, tok from v",
    "first_half": "select sid, x, y, z, tok from v where x % 2 = 0",
    "second_half": "select sid, x, y, z, tok from v where x % 2 = 1",
}


def _robust_sql(name: str) -> str:
    return f"""select '{name}' as transform, a.sid, a.entropy as h1, b.entropy as h_pair from ({h_sql(f"(select sid, tok, count(*)::double as n from t_{name} group by 1, 2)", 'sid')}) a join ({h_sql(f"(select a.sid, a.tok as s, b.tok as t, count(*)::double as n from t_{name} a cross join (values (1, 0, 0), (0, 1, 0), (0, 0, 1)) o(dx, dy, dz) join t_{name} b on a.sid = b.sid and a.x + dx = b.x and a.y + dy = b.y and a.z + dz = b.z group by 1, 2, 3)", 'sid')}) b on a.sid = b.sid"""


@query(f"with {V}, " + ", ".join(f"t_{n} as ({q})" for n, q in TRANSFORMS.items()) + " " + " union all ".join(map(_robust_sql, TRANSFORMS)))
def robustness(spark, sf):
    """Unigram and face-pair entropies under token noise, dropped voxels, moves, exchanged axes, and in split halves."""
    v = voxels(spark, sf)
    forms = {"none": v, "noise": experiments.noisy(v, "tok", 16, 0.05, 3), "drop": experiments.thinned(v, 0.05, 3), "translate": experiments.translated(v, (3, 1, 2)), "permute": experiments.permuted(v, "zxy"), "first_half": v.where("x % 2 = 0"), "second_half": v.where("x % 2 = 1")}
    out = None
    for name, rows in forms.items():
        h = stats.entropy(rows, ["sid"], "tok", name="h1")
        pairs = stats.entropy(voxel.neighbours(rows), ["sid"], "tok", "other", name="h_pair")
        part = h.join(pairs, "sid").select(F.lit(name).alias("transform"), "sid", r6("h1"), r6("h_pair"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""with {V}, n as (select sid, count(*) as n, count(distinct tok) / count(*)::double as r from v group by 1), c as (select quantile_cont(n, 1 / 3.0) as a, quantile_cont(n, 2 / 3.0) as b from n),
g as (select case when n <= a then 'low' when n <= b then 'mid' else 'high' end as stratum, (sid % 2)::int as half, n, r from n, c) select stratum, half, count(*) as samples, round(avg(r), 6) as mean, round(coalesce(stddev_samp(r), 0), 6) as std, sum(n)::bigint as voxels from g group by 1, 2""")
def stability_panel(spark, sf):
    """A ratio's mean and deviation by size stratum and split half: whether it holds across both."""
    n = voxels(spark, sf).groupBy("sid").agg(F.count("*").alias("n"), (F.countDistinct("tok") / F.count("*")).alias("r"))
    cuts = stats.quantiles(n, [], "n", {"a": 1 / 3, "b": 2 / 3})
    stratum = F.when(F.col("n") <= F.col("a"), "low").when(F.col("n") <= F.col("b"), "mid").otherwise("high")
    g = n.join(F.broadcast(cuts)).groupBy(stratum.alias("stratum"), (F.col("sid") % 2).alias("half"))
    return g.agg(F.count("*").alias("samples"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("r"), F.lit(0.0)), 6).alias("std"), F.sum("n").alias("voxels"))
