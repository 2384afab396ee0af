"""Queries over three-dimensional byte-pair encoding and its one-dimensional baseline."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import space
from ..functions import text as T
from ..operators import bpe3d, layout, stats, voxel
from .base import MORTON, VM, V, query, voxels
from .base import in_z_order as z_ordered

#: Base vocabulary and rules of the registered queries.
BASE, MERGES = 16, 4
#: Rules of a long training.
LONG = 32


def leaves(spark, sf):
    return voxels(spark, sf).select("sid", "x", "y", "z", F.col("tok").cast("long").alias("token"))


PAIRS = f"""{V}, o(dx, dy, dz) as (values (1, 0, 0), (0, 1, 0), (0, 0, 1)), p as (select a.sid, a.tok::bigint as a, b.tok::bigint as b, dx, dy, dz, a.x, a.y, a.z
from v a cross join o join v b on a.sid = b.sid and a.x + dx = b.x and a.y + dy = b.y and a.z + dz = b.z),
k as (select a, b, dx, dy, dz, count(*) as n from p group by 1, 2, 3, 4, 5), best as (select * from k order by n desc, a, b, dx, dy, dz limit 1)"""


@query(f"with {PAIRS} select * from k")
def pair_discovery(spark, sf):
    slots = bpe3d.slots_of(leaves(spark, sf))
    return bpe3d.pair_counts(bpe3d.touching(slots, bpe3d.cells_of(slots)))


@query(f"with {PAIRS} select * from best")
def best_pair(spark, sf):
    slots = bpe3d.slots_of(leaves(spark, sf))
    return bpe3d.best_pair(bpe3d.pair_counts(bpe3d.touching(slots, bpe3d.cells_of(slots))))


@query(f"""with {PAIRS}, m as (select p.* from p join best using (a, b, dx, dy, dz)), c as (select *, dx * x + dy * y + dz * z as i from m),
r as (select *, i - row_number() over (partition by sid, x - dx * i, y - dy * i, z - dz * i order by i) as run from c),
h as (select *, row_number() over (partition by sid, x - dx * i, y - dy * i, z - dz * i, run order by i) as nth from r), g as (select * from h where a <> b or nth % 2 = 1),
t as (select v.sid, v.x, v.y, v.z, case when g.sid is not null then {BASE} else v.tok end as token from v left join g on v.sid = g.sid and v.x = g.x and v.y = g.y and v.z = g.z
left join g q on v.sid = q.sid and v.x = q.x + q.dx and v.y = q.y + q.dy and v.z = q.z + q.dz where q.sid is null)
select sid, token::bigint as token, count(*) as n, sum(x + y + z)::bigint as s from t group by 1, 2""")
def merge_once(spark, sf):
    lv = leaves(spark, sf)
    rules = bpe3d.train(lv, BASE, 1)
    slots, _ = bpe3d.merge(bpe3d.slots_of(lv), None, rules[0])
    return slots.groupBy("sid", "token").agg(F.count("*").alias("n"), F.sum(F.col("x") + F.col("y") + F.col("z")).alias("s"))


def bpe_sql(merges: int, leaf: str = "select sid, x, y, z, tok::bigint as token from v", tag: str = "") -> str:
    """The training and encoding of ``merges`` rules, one set of relations a rule: s<k> slots, c<k> cells, r<k> the rule, m<k> its matches (chains of equal tokens: every other one)."""
    cell = "sid::bigint * 1073741824 + x * 1048576 + y * 1024 + z"  # one number for a place of a sample: joins have a single key
    out = [f"s0{tag} as materialized (select sid, {cell} as slot, token, x, y, z from ({leaf}))", f"c0{tag} as materialized (select sid, slot as cell, x, y, z, slot from s0{tag})", "ofs(ox, oy, oz, st) as (values (1, 0, 0, 1048576), (0, 1, 0, 1024), (0, 0, 1, 1))"]
    for k in range(merges):
        p, q = f"{k}{tag}", f"{k + 1}{tag}"
        out.append(f"p{p} as materialized (select distinct a.sid, a.slot as sa, b.slot as sb from (select sid, slot, cell + st as cell from c{p} cross join ofs) a join c{p} b on a.cell = b.cell where a.slot <> b.slot)")
        out.append(f"q{p} as materialized (select p.sid, sa, sb, s.token as a, t.token as b, t.x - s.x as dx, t.y - s.y as dy, t.z - s.z as dz, s.x, s.y, s.z from p{p} p join s{p} s on p.sa = s.slot join s{p} t on p.sb = t.slot)")
        out.append(f"r{p} as materialized (select a, b, dx, dy, dz, count(*) as n from q{p} group by 1, 2, 3, 4, 5 order by n desc, a, b, dx, dy, dz limit 1)")
        out.append(f"h{p} as (select q.*, (case when dx <> 0 then floor(x / dx) when dy <> 0 then floor(y / dy) else floor(z / dz) end)::bigint as i from q{p} q join r{p} r using (a, b, dx, dy, dz))")
        out.append(f"i{p} as (select *, i - row_number() over (partition by sid, x - dx * i, y - dy * i, z - dz * i order by i) as run from h{p})")
        out.append(f"m{p} as materialized (select sid, sa, sb, dx, dy, dz from (select *, row_number() over (partition by sid, x - dx * i, y - dy * i, z - dz * i, run order by i) as nth from i{p}) where a <> b or nth % 2 = 1)")
        low = "(dx, dy, dz) < (0, 0, 0)"
        out.append(f"s{q} as materialized (select s.sid, s.slot, case when m.sid is not null then {BASE + k} else s.token end as token, (s.x + case when {low} then dx else 0 end)::int as x, (s.y + case when {low} then dy else 0 end)::int as y, (s.z + case when {low} then dz else 0 end)::int as z from s{p} s left join m{p} m on s.slot = m.sa where not exists (select 1 from m{p} g where g.sb = s.slot))")
        out.append(f"c{q} as materialized (select c.sid, cell, x, y, z, coalesce(m.sa, c.slot) as slot from c{p} c left join m{p} m on c.slot = m.sb)")
    return ", ".join(out)


def leaves_sql(merges: int) -> str:
    """l: (new_id, token, dx, dy, dz) of every rule's footprint, from those of its two sides."""
    out = [f"l0 as (select i::bigint as id, i::bigint as token, 0 as dx, 0 as dy, 0 as dz from range({BASE}) t(i))"]
    for k in range(merges):
        low = "(r.dx, r.dy, r.dz) < (0, 0, 0)"
        shift = lambda c, own: f"l.d{c} + {f'r.d{c}' if own else '0'} - case when {low} then r.d{c} else 0 end"  # noqa: B023, E731
        side = lambda t, own: f"select {BASE + k}, l.token, {', '.join(shift(c, own) for c in 'xyz')} from l{k} l join r{k} r on l.id = r.{t}"  # noqa: B023, E731
        out.append(f"l{k + 1} as (select * from l{k} union all {side('a', False)} union all {side('b', True)})")
    return ", ".join(out) + f", l as materialized (select id as new_id, token, dx::int as dx, dy::int as dy, dz::int as dz from l{merges} where id >= {BASE})"


TRAINED = f"{V}, {bpe_sql(MERGES)}"


@query(f"with {TRAINED} select sid, x, y, z, token from s{MERGES}")
def encode_k(spark, sf):
    lv = leaves(spark, sf)
    return bpe3d.encode(lv, bpe3d.train(lv, BASE, MERGES))


@query(f"with {V} select sid, x, y, z, tok::bigint as token from v")
def decode_roundtrip(spark, sf):
    lv = leaves(spark, sf)
    rules = bpe3d.train(lv, BASE, MERGES)
    return bpe3d.decode(bpe3d.encode(lv, rules), rules, BASE)


RULES = " union all ".join(f"select {k} as rank, {BASE + k}::bigint as new_id, a, b, dx, dy, dz from r{k}" for k in range(MERGES))


@query(f"""with {TRAINED}, {leaves_sql(MERGES)}, u as ({RULES}), j as (select new_id, '[' || string_agg('{{"token":' || token || ',"dx":' || dx || ',"dy":' || dy || ',"dz":' || dz || '}}', ',' order by dx, dy, dz) || ']' as leaf from l group by 1)
select rank::int as rank, u.new_id, a, b, dx::int as dx, dy::int as dy, dz::int as dz, leaf from u join j on u.new_id = j.new_id""")
def merge_table(spark, sf):
    return bpe3d.rules_frame(spark, bpe3d.train(leaves(spark, sf), BASE, MERGES)).withColumn("leaf", F.to_json("leaf"))


MOTIFS = f"""{leaves_sql(MERGES)}, bx as (select new_id, count(*) as cells, max(dx) - min(dx) + 1 as size_x, max(dy) - min(dy) + 1 as size_y, max(dz) - min(dz) + 1 as size_z from l group by 1),
ed as (select a.new_id, (a.dx, a.dy, a.dz) as p, (b.dx, b.dy, b.dz) as q from l a cross join ofs join l b on a.new_id = b.new_id and a.dx + ox = b.dx and a.dy + oy = b.dy and a.dz + oz = b.dz),
dg as (select new_id, v, count(*) as d from (select new_id, p as v from ed union all select new_id, q from ed) group by 1, 2), sh as (select new_id, (sum(d) / 2)::bigint as edges, max(d) as top_degree from dg group by 1),
mo as (select bx.new_id, cells, size_x, size_y, size_z, cells / (size_x * size_y * size_z) as compactness, edges, top_degree from bx left join sh on bx.new_id = sh.new_id)"""


@query(f"with {TRAINED}, {MOTIFS} select * from mo")
def motif_features(spark, sf):
    return bpe3d.motif_features(bpe3d.rules_frame(spark, bpe3d.train(leaves(spark, sf), BASE, MERGES)))


@query(f"""with {TRAINED}, {MOTIFS}, us as (select token, count(*) as n, count(distinct sid) as samples from s{MERGES} group by 1)
select token, n, samples, mo.* exclude new_id from us join mo on token = new_id order by n desc, cells desc, compactness desc, token limit 9""")
def motif_usage(spark, sf):
    """The most used macros: occurrences, then footprint, then compactness."""
    lv = leaves(spark, sf)
    rules = bpe3d.train(lv, BASE, MERGES)
    used = bpe3d.encode(lv, rules).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("sid").alias("samples"))
    f = bpe3d.motif_features(bpe3d.rules_frame(spark, rules)).withColumnRenamed("new_id", "token")
    return used.join(F.broadcast(f), "token").orderBy(F.col("n").desc(), F.col("cells").desc(), F.col("compactness").desc(), "token").limit(9)


@query(f"with {TRAINED}, n as (select sid, count(*) as leaves from s0 group by 1) " + " union all ".join(f"select {k}::int as k, s.sid, count(*) as tokens, round(any_value(leaves) / count(*), 6) as compression from s{k} s join n on s.sid = n.sid group by s.sid" for k in range(MERGES + 1)))
def sweep_k(spark, sf):
    """Tokens and compression after 0..MERGES rules."""
    lv = leaves(spark, sf)
    rules = bpe3d.train(lv, BASE, MERGES)
    n = lv.groupBy("sid").agg(F.count("*").alias("leaves"))
    out = None
    for k in range(MERGES + 1):
        part = bpe3d.encode(lv, rules[:k]).groupBy("sid").agg(F.count("*").alias("tokens")).join(n, "sid").select(F.lit(k).alias("k"), "sid", "tokens", F.round(F.col("leaves") / F.col("tokens"), 6).alias("compression"))
        out = part if out is None else out.unionByName(part)
    return out


def directed_sql(pairs: str) -> str:
    """Entropies by sample of the relation ``pairs`` (sid, s, t, d): hp of whole pairs, hs of source and direction, ht of targets."""
    h = lambda name, cols: f"{name} as (select sid, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h, sum(n) as n from (select sid, {cols}, count(*)::double as n from {pairs} group by sid, {cols}) group by sid)"
    return ", ".join((h("hp", "s, t, d"), h("hs", "s, d"), h("ht", "t")))


@query(f"""with {V}, {bpe_sql(2)}, ow as materialized (select c.sid, c.cell, c.slot, s.token as tok from c2 c join s2 s on c.slot = s.slot),
bp as (select a.sid, a.tok as s, b.tok as t, d from (select sid, slot, tok, cell + st as cell, ox + 2 * oy + 3 * oz as d from ow cross join ofs) a join ow b on a.cell = b.cell where a.slot <> b.slot), {directed_sql('bp')},
mi as (select hp.sid, hp.n::bigint as pairs, hp.h as h_pair, greatest(0.0, hp.h - hs.h) as cond, greatest(0.0, ht.h - greatest(0.0, hp.h - hs.h)) as mi from hp join hs on hp.sid = hs.sid join ht on hp.sid = ht.sid)
select sid, pairs, round(h_pair, 6) as h_pair, round(cond, 6) as cond, round(mi, 6) as mi, round(coalesce(round(mi, 6) / nullif(round(h_pair, 6), 0), 0), 6) as mi_ratio from mi""")
def boundary_mi(spark, sf):
    """Directed-pair statistics over the boundaries between macros: cells know their macro's anchor, pairs inside one macro are left out."""
    lv = leaves(spark, sf)
    rules = bpe3d.train(lv, BASE, 2)
    p = bpe3d.boundary_pairs(bpe3d.owners(bpe3d.Cut(spark).dealt(bpe3d.encode(lv, rules)), rules, BASE))
    out = stats.directed_pairs(p, ["sid"])
    return out.select("sid", "pairs", *(F.round(c, 6).alias(c) for c in ("h_pair", "cond", "mi"))).withColumn("mi_ratio", F.round(stats.safe_ratio(F.col("mi"), F.col("h_pair")), 6))


ONE_D = f"{VM}, q as (select sid, tok::bigint as a, lead(tok::bigint) over (partition by sid order by code) as b from m), k as (select a, b, count(*) as n from q where b is not null group by 1, 2)"


def sequences(spark, sf):
    w = Window.partitionBy("sid").orderBy("code")
    return z_ordered(spark, sf).select("sid", (F.row_number().over(w) - 1).alias("pos"), F.col("tok").cast("long").alias("token"))


@query(f"with {ONE_D} select * from k order by n desc, a desc, b desc limit 1")
def bpe1d_first(spark, sf):
    return bpe3d.best_pair_1d(bpe3d.pair_counts_1d(sequences(spark, sf)))


@query(f"""with {VM}, q as (select sid, rk, tok, lead(tok) over (partition by sid order by code) as nt from s), h as (select *, coalesce(tok = 3 and nt = 3, false) as hit from q),
i as (select *, rk - row_number() over (partition by sid, hit order by rk) as run from h), j as (select *, hit and row_number() over (partition by sid, hit, run order by rk) % 2 = 1 as take from i),
l as (select *, lag(take) over (partition by sid order by rk) as eaten from j) select sid, count(*) as n, count(*) filter (where take) as merged from l where not coalesce(eaten, false) group by sid""")
def bpe1d_merge_run(spark, sf):
    out = bpe3d.merge_1d(sequences(spark, sf), 3, 3, 99)
    return out.groupBy("sid").agg(F.count("*").alias("n"), F.count_if(F.col("token") == 99).alias("merged"))


def bpe1d_sql(merges: int, leaf: str = "select sid, rk as pos, tok::bigint as token from s") -> str:
    """Adjacent pair merging, one set of relations a rule: t<k> sequences, u<k> the rule."""
    out = [f"t0 as materialized ({leaf})"]
    for k in range(merges):
        out.append(f"n{k} as (select sid, pos, token, lead(token) over (partition by sid order by pos) as nt from t{k})")
        out.append(f"u{k} as materialized (select token as a, nt as b, count(*) as n from n{k} where nt is not null group by 1, 2 order by n desc, a desc, b desc limit 1)")
        out.append(f"w{k} as (select n.*, coalesce(n.token = a and n.nt = b, false) as hit, a = b as same, row_number() over (partition by sid order by pos) as i from n{k} n, u{k})")
        out.append(f"x{k} as (select *, i - row_number() over (partition by sid, hit order by pos) as run from w{k})")
        out.append(f"y{k} as (select *, hit and (not same or row_number() over (partition by sid, hit, run order by pos) % 2 = 1) as take from x{k})")
        out.append(f"z{k} as (select *, coalesce(lag(take) over (partition by sid order by pos), false) as eaten from y{k})")
        out.append(f"t{k + 1} as materialized (select sid, row_number() over (partition by sid order by pos) - 1 as pos, case when take then {BASE + k} else token end as token from z{k} where not eaten)")
    return ", ".join(out)


@query(f"with {VM}, {bpe1d_sql(MERGES)} select sid, count(*) as tokens, max(token) as top from t{MERGES} group by 1")
def bpe1d_compression(spark, sf):
    rules, left = bpe3d.train_1d(sequences(spark, sf), BASE, MERGES)
    return left.groupBy("sid").agg(F.count("*").alias("tokens"), F.max("token").alias("top"))


@query(f"""with {PAIRS}, m as (select sid, count(*) as edges, count(*) filter (where a = b) as same from p group by sid) select sid, edges, (edges // 2)::bigint as halved, round(same / edges, 6) as inside from m""")
def edge_ratios(spark, sf):
    """Edges between equal tokens (inside) against all, and the integer-halved count."""
    p = voxel.neighbours(voxels(spark, sf))
    return p.groupBy("sid").agg(F.count("*").alias("edges"), F.floor(F.count("*") / 2).alias("halved"), F.round(F.count_if(F.col("tok") == F.col("other")) / F.count("*"), 6).alias("inside"))


@query(f"with {V}, f as (select sid, x // 8 as b, list((x, y, z)) as c from v where tok = 1 group by 1, 2) select sid, count(*) as footprints from f group by sid")
def footprints(spark, sf):
    return voxels(spark, sf).where("tok = 1").select("sid", F.floor(F.col("x") / 8).alias("b")).distinct().groupBy("sid").agg(F.count("*").alias("footprints"))


@query(f"""with {V}, a as (select sid, x, y, z from v where tok = 1), b as (select sid, x, y, z from v where tok = 2) select a.sid, min(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z))::int as l1 from a join b on a.sid = b.sid group by 1""")
def footprint_distance(spark, sf):
    """Least city-block distance between two footprints of each sample, by a join on face neighbours, and for samples without one through cells of falling sides."""
    v = bpe3d.Cut(spark)(voxels(spark, sf).where("tok in (1, 2)"))
    return layout.nearest_l1(v.where("tok = 1").drop("tok"), v.where("tok = 2").drop("tok"), 93)


@query(f"""with {TRAINED}, e as (select sid, '<mesh_start>' || string_agg('<morton_' || {MORTON} || '><mesh_' || token || '>', '' order by {MORTON}) || '<mesh_end>' as mesh from s{MERGES} group by sid)
select sid, t as turn, md5('turn ' || t || ' ' || mesh || case when t = 1 then ' and ' || mesh else '' end) as text_md5 from e, range(2) r(t)""")
def jsonl_apply(spark, sf):
    """Mesh blocks in texts replaced by their encoded form: each distinct block is parsed and encoded once, then joined back to where it occurs."""
    lv = leaves(spark, sf)
    rules = bpe3d.train(lv, BASE, MERGES)
    g = voxels(spark, sf).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct(space.morton().alias("morton"), F.col("tok").alias("id")))).alias("pairs"))
    mesh = T.mesh_text(F.col("pairs"))
    turns = g.select("sid", mesh.alias("mesh"), F.explode(F.array(*(F.lit(t).cast("long") for t in range(2)))).alias("turn"))
    rows = turns.select("sid", "turn", F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" "), "mesh", F.when(F.col("turn") == 1, F.concat(F.lit(" and "), "mesh")).otherwise("")).alias("text"))
    out = bpe3d.apply_to_texts(rows, "text", rules, BASE)
    return out.select("sid", "turn", F.md5("text").alias("text_md5"))


@query(f"""with {V}, {bpe_sql(LONG)}, ow as materialized (select c.sid, c.cell, c.slot, s.token as tok from c{LONG} c join s{LONG} s on c.slot = s.slot), la as (select slot as cell, token as tok from s0), aa as (select sid::bigint * 1073741824 + x * 1048576 + y * 1024 + z as cell, token as tok from s{LONG}),
lf as (select a.tok as s, b.tok as t, d from (select tok, cell + st as cell, ox + 2 * oy + 3 * oz as d from la cross join ofs) a join la b on a.cell = b.cell), an as (select a.tok as s, b.tok as t, d from (select tok, cell + st as cell, ox + 2 * oy + 3 * oz as d from aa cross join ofs) a join aa b on a.cell = b.cell),
bo as (select a.tok as s, b.tok as t, d from (select slot, tok, cell + st as cell, ox + 2 * oy + 3 * oz as d from ow cross join ofs) a join ow b on a.cell = b.cell where a.slot <> b.slot),
al as (select 'leaf' as level, d, s, t, count(*)::double as n from lf group by 2, 3, 4 union all select 'anchor', d, s, t, count(*)::double from an group by 2, 3, 4 union all select 'boundary', d, s, t, count(*)::double from bo group by 2, 3, 4),
x as (select level, d, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h, sum(n) as n from al group by 1, 2), y as (select level, d, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from (select level, d, s, sum(n) as n from al group by 1, 2, 3) group by 1, 2)
select x.level, x.d as dir, x.n::bigint as pairs, round(x.h, 6) as h_pair, round(greatest(0.0, x.h - y.h), 6) as cond from x join y on x.level = y.level and x.d = y.d""")
def pair_stats_by_level(spark, sf):
    """Directed-pair entropies by direction over leaves, macro anchors, and cells across macro boundaries, after the rules of a long training."""
    corpus = bpe3d.Corpus(leaves(spark, sf), compact=12)
    corpus.learn(BASE, LONG)
    n = bpe3d.Cut(spark)(bpe3d.level_pairs(corpus))
    corpus.cut.drop()
    pair = stats.entropy_of_counts(n, ["level", "dir"], "h_pair", True)
    src = stats.entropy_of_counts(n.groupBy("level", "dir", "tok").agg(F.sum("n").alias("n")), ["level", "dir"], "h_src", True)
    total = n.groupBy("level", "dir").agg(F.sum("n").alias("pairs"))
    out = pair.join(src, ["level", "dir"]).join(total, ["level", "dir"])
    return out.select("level", "dir", "pairs", F.round("h_pair", 6).alias("h_pair"), F.round(F.greatest(F.lit(0.0), F.col("h_pair") - F.col("h_src")), 6).alias("cond"))


def _cost_sql(k: int) -> str:
    n = lambda cols, where="": f"(select sid, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from (select sid, {cols}, count(*)::double as n from g{k} {where} group by sid, {cols}) group by sid)"
    return f"""select {k}::int as k, a.sid, c.n as tokens, round(c.n / o.n, 6) as ratio, round(c.n / o.n * (a.h + coalesce(b.h, 0) + greatest(0.0, coalesce(p.h, 0) - coalesce(f.h, 0))) + 2.0 / o.n, 5) as cost
from {n('tok')} a join (select sid, count(*) as n from s{k} group by 1) c on a.sid = c.sid join (select sid, count(*) as n from s0 group by 1) o on a.sid = o.sid left join {n('delta', 'where delta is not null')} b on a.sid = b.sid
left join {n('tok, nt', 'where nt is not null')} p on a.sid = p.sid left join {n('tok', 'where nt is not null')} f on a.sid = f.sid"""


@query(f"with {TRAINED}, " + ", ".join(f"g{k} as (select sid, token as tok, lead(token) over w as nt, {MORTON} - lag({MORTON}) over w as delta from s{k} window w as (partition by sid order by {MORTON}, x, y, z))" for k in range(MERGES + 1)) + " " + " union all ".join(_cost_sql(k) for k in range(MERGES + 1)))
def lm_by_k(spark, sf):
    """Formal language-model cost a leaf after 0..MERGES rules: r (H(token) + H(anchor step) + H(next | token)) + 2 / leaves, with r tokens a leaf."""
    lv = leaves(spark, sf)
    rules = bpe3d.train(lv, BASE, MERGES)
    n0 = lv.groupBy("sid").agg(F.count("*").alias("leaves"))
    w = Window.partitionBy("sid").orderBy("code", "x", "y", "z")
    out = None
    for k in range(MERGES + 1):
        z = bpe3d.encode(lv, rules[:k]).withColumn("code", space.morton())
        step = z.select("sid", (F.col("code") - F.lag("code").over(w)).alias("delta")).where("delta is not null")
        part = z.groupBy("sid").agg(F.count("*").alias("tokens")).join(n0, "sid")
        for p in (stats.entropy(z, ["sid"], "token", name="a", base2=True), stats.entropy(step, ["sid"], "delta", name="b", base2=True), stats.conditional_entropy(stats.ngrams(z, ["sid"], ["code", "x", "y", "z"], "token", 2), ["sid"], "c")):
            part = part.join(p, "sid", "left")
        h = F.col("a") + F.coalesce("b", F.lit(0.0)) + F.coalesce("c", F.lit(0.0))
        part = part.select(F.lit(k).alias("k"), "sid", "tokens", F.round(F.col("tokens") / F.col("leaves"), 6).alias("ratio"), F.round(F.col("tokens") / F.col("leaves") * h + 2.0 / F.col("leaves"), 5).alias("cost"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""with {VM}, {bpe_sql(MERGES)}, {bpe1d_sql(MERGES)}, o as (select sid, count(*) as n from v group by 1), a as (select sid, count(*) as n from t{MERGES} group by 1), e as (select sid, count(*) as n from s{MERGES} group by 1)
select o.sid, o.n as leaves, a.n as tokens_1d, e.n as tokens_3d, round(a.n / o.n, 6) as ratio_1d, round(e.n / o.n, 6) as ratio_3d, round((e.n - a.n) / o.n, 6) as gain from o join a on o.sid = a.sid join e on o.sid = e.sid""")
def baseline_1d_3d(spark, sf):
    """Tokens a leaf of the one-dimensional baseline (along Z-order) beside those of the three-dimensional encoder, after as many rules."""
    lv = leaves(spark, sf)
    one = bpe3d.train_1d(sequences(spark, sf), BASE, MERGES)[1].groupBy("sid").agg(F.count("*").alias("tokens_1d"))
    three = bpe3d.encode(lv, bpe3d.train(lv, BASE, MERGES)).groupBy("sid").agg(F.count("*").alias("tokens_3d"))
    n = lv.groupBy("sid").agg(F.count("*").alias("leaves")).join(one, "sid").join(three, "sid")
    r = lambda c: F.round(F.col(f"tokens_{c}") / F.col("leaves"), 6).alias(f"ratio_{c}")
    return n.select("sid", "leaves", "tokens_1d", "tokens_3d", r("1d"), r("3d"), F.round((F.col("tokens_3d") - F.col("tokens_1d")) / F.col("leaves"), 6).alias("gain"))


@query(f"""with {VM}, d as (select sid, rk as pos, tok::bigint as token, [(x, y, z)] as cells from s), t0 as materialized (select * from d)""" + "".join(f""", n{k} as (select *, lead(token) over (partition by sid order by pos) as nt, lead(cells) over (partition by sid order by pos) as nc from t{k}), u{k} as materialized (select token as a, nt as b, count(*) as n from n{k} where nt is not null group by 1, 2 order by n desc, a desc, b desc limit 1),
w{k} as (select n.*, coalesce(n.token = a and n.nt = b, false) as hit, a = b as same, row_number() over (partition by sid order by pos) as i from n{k} n, u{k}), x{k} as (select *, i - row_number() over (partition by sid, hit order by pos) as run from w{k}),
y{k} as (select *, hit and (not same or row_number() over (partition by sid, hit, run order by pos) % 2 = 1) as take from x{k}), z{k} as materialized (select *, coalesce(lag(take) over (partition by sid order by pos), false) as eaten from y{k}),
t{k + 1} as materialized (select sid, row_number() over (partition by sid order by pos) - 1 as pos, case when take then {BASE + k} else token end as token, case when take then list_concat(cells, nc) else cells end as cells from z{k} where not eaten),
g{k} as (select z.sid, z.pos, min(abs(p[1] - q[1]) + abs(p[2] - q[2]) + abs(p[3] - q[3])) as l1 from (select sid, pos, unnest(cells) as p, nc from z{k} where take and not eaten) z, unnest(z.nc) u(q) group by 1, 2)""" for k in range(2)) + " " + " union all ".join(f"select {k}::int as rank, count(*) as merges, max(l1)::int as far, sum(l1)::bigint as total from g{k}" for k in range(2)))
def bpe1d_trace(spark, sf):
    """How far apart in space the footprints are that each one-dimensional merge joins."""
    from ..operators.voxel import ranked

    seq = ranked(voxels(spark, sf), space.morton(), "pos").select("sid", "pos", F.col("tok").cast("long").alias("token"), F.array(F.struct("x", "y", "z")).alias("cells"))
    rules, _ = bpe3d.train_1d(seq.select("sid", "pos", "token"), BASE, 2)
    out = None
    for k, rule in enumerate(rules):
        seq, dist = bpe3d.merge_1d_traced(seq, *rule)
        part = dist.agg(F.count("*").alias("merges"), F.max("l1").alias("far"), F.sum("l1").alias("total")).select(F.lit(k).alias("rank"), "merges", "far", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""with {VM}, {bpe1d_sql(0)}, q as (select token as a, lead(token) over (partition by sid order by pos) as b from t0), k as (select a, b, count(*) as n, md5('5|0|' || a || '|' || b) as h from q where b is not null group by 1, 2 having count(*) >= 2)
select a, b, n from k order by h, a, b limit 1""")
def random_pair_1d(spark, sf):
    """Control: the first rule of the baseline drawn at random among all pairs that occur twice, by a seeded hash."""
    return bpe3d.random_pair_1d(bpe3d.pair_counts_1d(sequences(spark, sf)), 5, 0)


def trained(spark, sf):
    """Leaves, rules, encoded samples (written once, dealt by sample)."""
    lv = leaves(spark, sf)
    rules = bpe3d.train(lv, BASE, MERGES)
    return lv, rules, bpe3d.Cut(spark).dealt(bpe3d.encode(lv, rules))


@query(f"with {TRAINED}, {MOTIFS}, us as (select token, count(*) as n from s{MERGES} where token >= {BASE} group by 1) select size_x, size_y, size_z, count(*) as motifs, sum(n)::bigint as uses, sum(n * cells)::bigint as covered from us join mo on token = new_id group by 1, 2, 3")
def shape_histogram(spark, sf):
    """Macros and their uses by the box of their footprint."""
    _, rules, enc = trained(spark, sf)
    f = F.broadcast(bpe3d.motif_features(bpe3d.rules_frame(spark, rules)).withColumnRenamed("new_id", "token"))
    return enc.groupBy("token").agg(F.count("*").alias("n")).join(f, "token").groupBy("size_x", "size_y", "size_z").agg(F.count("*").alias("motifs"), F.sum("n").alias("uses"), F.sum(F.col("n") * F.col("cells")).alias("covered"))


@query(f"with {TRAINED}, {MOTIFS}, us as (select token, count(*) as n from s{MERGES} group by 1) select token, n, (n * coalesce(cells, 1))::bigint as leaves, round(n * coalesce(cells, 1) / (select count(*) from s0), 6) as share from us left join mo on token = new_id")
def motif_coverage(spark, sf):
    """Share of all leaves that each token of the encoded corpus stands for."""
    lv, rules, enc = trained(spark, sf)
    f = F.broadcast(bpe3d.motif_features(bpe3d.rules_frame(spark, rules)).select(F.col("new_id").alias("token"), "cells"))
    total = F.broadcast(lv.agg(F.count("*").alias("total")))
    covered = F.col("n") * F.coalesce("cells", F.lit(1))
    return enc.groupBy("token").agg(F.count("*").alias("n")).join(f, "token", "left").join(total).select("token", "n", covered.alias("leaves"), F.round(covered / F.col("total"), 6).alias("share"))


def _metric_sql(k: int) -> str:
    return f"select {k}::int as k, sum(n)::bigint as tokens, ln(sum(n)) - sum(n * ln(n)) / sum(n) as h from (select token, count(*)::double as n from s{k} group by 1)"


@query(f"with {TRAINED}, e as ({_metric_sql(0)} union all {_metric_sql(MERGES)}), z as (select *, tokens / (select tokens from e where k = 0) as ratio, h * tokens / (select tokens from e where k = 0) as per_leaf from e) select k, tokens, round(ratio, 6) as ratio, round(h, 6) as h, round(per_leaf, 6) as per_leaf, round(per_leaf - (select per_leaf from z where k = 0), 6) as delta from z")
def bpe_metrics(spark, sf):
    """Compression ratio, entropy and entropy a leaf before and after the rules, with the change."""
    lv, _, enc = trained(spark, sf)
    out = None
    for k, rows in ((0, lv), (MERGES, enc)):
        c = rows.groupBy("token").agg(F.count("*").cast("double").alias("n"))
        part = c.agg(F.lit(k).alias("k"), F.sum("n").cast("long").alias("tokens"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h"))
        out = part if out is None else out.unionByName(part)
    first = F.broadcast(out.where("k = 0").select(F.col("tokens").alias("leaves"), F.col("h").alias("h0")))
    per = F.col("h") * F.col("tokens") / F.col("leaves")
    return out.join(first).select("k", "tokens", F.round(F.col("tokens") / F.col("leaves"), 6).alias("ratio"), F.round("h", 6).alias("h"), F.round(per, 6).alias("per_leaf"), F.round(per - F.col("h0"), 6).alias("delta"))


@query(f"with {TRAINED}, r as (select a.sid, a.n / b.n as r from (select sid, count(*) as n from s0 group by 1) a join (select sid, count(*) as n from s{MERGES} group by 1) b on a.sid = b.sid) select count(*) as samples, round(avg(r), 6) as mean, round(min(r), 6) as low, round(max(r), 6) as high, round(coalesce(stddev_samp(r), 0), 6) as std from r")
def compression_summary(spark, sf):
    """Leaves a token over the samples: mean, extremes, deviation."""
    lv, _, enc = trained(spark, sf)
    n = lambda rows, name: rows.groupBy("sid").agg(F.count("*").alias(name))
    r = n(lv, "a").join(n(enc, "b"), "sid").select((F.col("a") / F.col("b")).alias("r"))
    return r.agg(F.count("*").alias("samples"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.min("r"), 6).alias("low"), F.round(F.max("r"), 6).alias("high"), F.round(F.coalesce(F.stddev_samp("r"), F.lit(0.0)), 6).alias("std"))
