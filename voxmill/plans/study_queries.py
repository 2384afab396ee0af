"""Studies of the 3D byte-pair encoder: incremental and random training, robustness, stability, final metrics, orders, shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import space
from ..operators import bpe3d, experiments, orders, stats, voxel
from .base import MORTON, VM, V, query, voxels
from .bpe_queries import BASE, LONG, MERGES, TRAINED, bpe_sql, directed_sql, leaves, leaves_sql, trained
from .stat_queries import TRANSFORMS, uniform_sql
from .voxel_queries import TRANSPOSED, hilbert_sql

r6 = lambda c: F.round(c, 6).alias(c)
RULE = "rank::int as rank, new_id::bigint as new_id, a, b, dx::int as dx, dy::int as dy, dz::int as dz, n"


def rules_sql(merges: int, tag: str = "") -> str:
    return " union all ".join(f"select {k} as rank, {BASE + k} as new_id, a, b, dx, dy, dz, n from r{k}{tag}" for k in range(merges))


def _rules(spark, rules):
    return spark.createDataFrame([(r.rank, r.new_id, r.a, r.b, *r.rel) for r in rules], "rank int, new_id bigint, a bigint, b bigint, dx int, dy int, dz int")


@query(f"with {V}, {bpe_sql(LONG)}, u as ({rules_sql(LONG)}) select {RULE.removesuffix(', n')} from u")
def train_incremental(spark, sf):
    """The rules of a long training: counts are kept by signed differences, and only the pairs of merged slots are counted again."""
    return _rules(spark, bpe3d.train(leaves(spark, sf), BASE, LONG, compact=12))


STOP = 8


@query(f"with {V}, {bpe_sql(STOP)}, u as ({rules_sql(STOP)}), t as (select max(n) // 2 as least from u), e as (select coalesce(min(rank), {STOP}) as ends from u, t where n < least) select {RULE.removesuffix(', n')} from u, e where rank < ends")
def train_stops(spark, sf):
    """Training that stops as soon as the best key is less than half as frequent as the first one was."""
    return _rules(spark, bpe3d.train(leaves(spark, sf), BASE, STOP, part=2))


# --- random pairs ---------------------------------------------------------------------------------

SEED = 7


def _drawn_sql(key: str) -> str:
    return f"-ln((('0x' || substr(md5(concat_ws('|', '{SEED}', '%d', {key})), 1, 8))::bigint + 0.5) / 4294967296.0) / n, {key}"


def _with_order(sql: str, plain: str, drawn: str, merges: int) -> str:
    """The training of ``sql`` with keys drawn by ``drawn`` (with the step's number) instead of ordered by ``plain``."""
    parts = sql.split(plain)
    assert len(parts) == merges + 1
    return parts[0] + "".join(drawn % k + p for k, p in enumerate(parts[1:]))


def bpe1d_sql(merges: int, leaf: str, tag: str = "") -> str:
    """Adjacent pair merging over (sid, pos, token): t<k> sequences, u<k> the rule."""
    out = [f"t0{tag} as materialized ({leaf})"]
    for k in range(merges):
        p, q = f"{k}{tag}", f"{k + 1}{tag}"
        out.append(f"n{p} as (select sid, pos, token, lead(token) over (partition by sid order by pos) as nt from t{p})")
        out.append(f"u{p} as materialized (select token as a, nt as b, count(*) as n from n{p} where nt is not null group by 1, 2 having count(*) >= 2 order by n desc, a desc, b desc limit 1)")
        out.append(f"w{p} as (select n.*, coalesce(n.token = a and n.nt = b, false) as hit, a = b as same, row_number() over (partition by sid order by pos) as i from n{p} n, u{p})")
        out.append(f"x{p} as (select *, i - row_number() over (partition by sid, hit order by pos) as run from w{p})")
        out.append(f"y{p} as (select *, hit and (not same or row_number() over (partition by sid, hit, run order by pos) % 2 = 1) as take from x{p})")
        out.append(f"z{p} as (select *, coalesce(lag(take) over (partition by sid order by pos), false) as eaten from y{p})")
        out.append(f"t{q} as materialized (select sid, row_number() over (partition by sid order by pos) - 1 as pos, case when take then {BASE + k} else token end as token from z{p} where not eaten)")
    return ", ".join(out)


RANDOM_3D = _with_order(bpe_sql(MERGES, tag="_r"), "order by n desc, a, b, dx, dy, dz", f"having count(*) >= 2 order by {_drawn_sql('a, b, dx, dy, dz')}", MERGES)
RANDOM_1D = _with_order(bpe1d_sql(MERGES, "select sid, rk as pos, tok::bigint as token from s", "_q"), "order by n desc, a desc, b desc", f"order by {_drawn_sql('a, b')}", MERGES)


def _sequences(spark, sf):
    return voxel.ranked(voxels(spark, sf), space.morton(), "pos").select("sid", "pos", F.col("tok").cast("long").alias("token"))


def _draw(counted, step):
    return bpe3d.weighted_pair(counted, SEED, step)


@query(f"""with {VM}, {RANDOM_3D}, {RANDOM_1D}, u as ({rules_sql(MERGES, '_r')})
select '3d' as kind, {RULE.removesuffix(', n')} from u union all {' union all '.join(f"select '1d', {k}::int, {BASE + k}::bigint, a, b, null::int, null::int, null::int from u{k}_q" for k in range(MERGES))}""")
def random_pair_k(spark, sf):
    """Control: rules drawn by frequency at each step of the training, from a seeded hash of the key, in three dimensions and in one."""
    three = _rules(spark, bpe3d.train(leaves(spark, sf), BASE, MERGES, choose=_draw)).withColumn("kind", F.lit("3d"))
    one, _ = bpe3d.train_1d(_sequences(spark, sf), BASE, MERGES, choose=_draw)
    flat = spark.createDataFrame([(k, i, a, b, "1d") for k, (a, b, i) in enumerate(one)], "rank int, new_id bigint, a bigint, b bigint, kind string")
    return three.unionByName(flat, allowMissingColumns=True).select("kind", "rank", "new_id", "a", "b", "dx", "dy", "dz")


def _tokens(kind: str, mode: str, t: str) -> str:
    return f"select '{kind}' as kind, '{mode}' as pairs, (select count(*) from {t}) as tokens"


OFFSETS = ", ofs(ox, oy, oz, st) as (values (1, 0, 0, 1048576), (0, 1, 0, 1024), (0, 0, 1, 1))"


@query(f"""with {VM}, {bpe_sql(MERGES)}, {RANDOM_3D.replace(OFFSETS, '')}, {bpe1d_sql(MERGES, "select sid, rk as pos, tok::bigint as token from s")}, {RANDOM_1D},
e as ({_tokens('3d', 'greedy', f's{MERGES}')} union all {_tokens('3d', 'random', f's{MERGES}_r')} union all {_tokens('1d', 'greedy', f't{MERGES}')} union all {_tokens('1d', 'random', f't{MERGES}_q')})
select kind, pairs, tokens, round(tokens / (select count(*) from v), 6) as ratio from e""")
def random_compression(spark, sf):
    """Tokens a leaf after rules drawn at random, beside those after greedy ones."""
    lv, seq = leaves(spark, sf), _sequences(spark, sf)
    total = lv.agg(F.count("*").alias("leaves"))
    out = None
    for mode, choose in (("greedy", None), ("random", _draw)):
        three = bpe3d.encode(lv, bpe3d.train(lv, BASE, MERGES, choose=choose))
        one = bpe3d.train_1d(seq, BASE, MERGES, choose=choose)[1]
        for kind, rows in (("3d", three), ("1d", one)):
            part = rows.agg(F.lit(kind).alias("kind"), F.lit(mode).alias("pairs"), F.count("*").alias("tokens"))
            out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(total)).select("kind", "pairs", "tokens", F.round(F.col("tokens") / F.col("leaves"), 6).alias("ratio"))


# --- robustness -----------------------------------------------------------------------------------


def replay_sql(merges: int, leaf: str, tag: str) -> str:
    """Rules r<k> replayed over the samples of ``leaf``: s<k><tag> slots."""
    out = [f"s0{tag} as materialized (select sid, sid * 1073741824 + x * 1048576 + y * 1024 + z as slot, token, x, y, z from ({leaf}))"]
    for k in range(merges):
        p, q = f"{k}{tag}", f"{k + 1}{tag}"
        step = "(case when dx <> 0 then floor(s.x / dx) when dy <> 0 then floor(s.y / dy) else floor(s.z / dz) end)::bigint"
        out.append(f"h{p} as (select s.sid, s.slot as sa, t.slot as sb, r.a, r.b, dx, dy, dz, s.x, s.y, s.z, {step} as i from r{k} r join s{p} s on s.token = r.a join s{p} t on t.token = r.b and t.sid = s.sid and t.x = s.x + dx and t.y = s.y + dy and t.z = s.z + dz)")
        out.append(f"i{p} as (select *, i - row_number() over (partition by sid, x - dx * i, y - dy * i, z - dz * i order by i) as run from h{p})")
        out.append(f"m{p} as materialized (select sid, sa, sb, dx, dy, dz from (select *, row_number() over (partition by sid, x - dx * i, y - dy * i, z - dz * i, run order by i) as nth from i{p}) where a <> b or nth % 2 = 1)")
        low = "(dx, dy, dz) < (0, 0, 0)"
        out.append(f"s{q} as materialized (select s.sid, s.slot, case when m.sid is not null then {BASE + k} else s.token end as token, (s.x + case when {low} then dx else 0 end)::int as x, (s.y + case when {low} then dy else 0 end)::int as y, (s.z + case when {low} then dz else 0 end)::int as z from s{p} s left join m{p} m on s.slot = m.sa where not exists (select 1 from m{p} g where g.sb = s.slot))")
    return ", ".join(out)


#: Samples of a transform are numbered from here on, so that one encoding takes all of them.
APART = 1 << 24
FORMS = list(TRANSFORMS)
ROBUST = f"""{TRAINED}, {', '.join(f't_{n} as ({q})' for n, q in TRANSFORMS.items())},
{replay_sql(MERGES, ' union all '.join(f'select {i * APART}::bigint + sid as sid, x, y, z, tok::bigint as token from t_{n}' for i, n in enumerate(FORMS)), '_f')},
ro as (select a.sid // {APART} as form, (a.sid % {APART})::int as sid, leaves, tokens from (select sid, count(*) as leaves from s0_f group by 1) a join (select sid, count(*) as tokens from s{MERGES}_f group by 1) b on a.sid = b.sid)"""
_NAME = f"[{', '.join(repr(n) for n in FORMS)}][form + 1]"


def _robust(spark, sf):
    """(form, sid, leaves, tokens): every transformed corpus under the rules of the plain one, encoded in one shuffle by (transform, sample)."""
    lv = leaves(spark, sf)
    rules = bpe3d.train(lv, BASE, MERGES)
    number = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(FORMS) for x in (n, i))), F.col("form"))
    every = bpe3d.Cut(spark)(experiments.forms(lv, "token", BASE).select((number.cast("long") * APART + F.col("sid")).alias("sid"), "x", "y", "z", "token"))
    n = every.groupBy("sid").agg(F.count("*").alias("leaves")).join(bpe3d.encode(every, rules).groupBy("sid").agg(F.count("*").alias("tokens")), "sid")
    name = F.element_at(F.array(*map(F.lit, FORMS)), (F.floor(F.col("sid") / APART) + 1).cast("int"))
    return n.select(name.alias("form"), (F.col("sid") % APART).cast("int").alias("sid"), "leaves", "tokens")


@query(f"""with {ROBUST} select {_NAME.replace('form', 'r.form')} as form, r.sid, r.leaves, r.tokens, round(r.tokens / r.leaves, 6) as ratio, round(r.tokens / r.leaves - o.tokens / o.leaves, 6) as change
from ro r join ro o on r.sid = o.sid and o.form = 0""")
def robust_compression(spark, sf):
    """Tokens a leaf of each sample under each transform, by rules learned on the plain corpus, and the change against it."""
    r = bpe3d.Cut(spark)(_robust(spark, sf))
    plain = r.where("form = 'none'").select("sid", (F.col("tokens") / F.col("leaves")).alias("own"))
    ratio = F.col("tokens") / F.col("leaves")
    return r.join(plain, "sid").select("form", "sid", "leaves", "tokens", F.round(ratio, 6).alias("ratio"), F.round(ratio - F.col("own"), 6).alias("change"))


@query(f"""with {ROBUST}, h as (select {_NAME} as form, unnest(['all', case when sid % 2 = 0 then 'even' else 'odd' end]) as half, leaves, tokens from ro)
select form, half, count(*) as samples, sum(leaves)::bigint as leaves, sum(tokens)::bigint as tokens, round(sum(tokens) / sum(leaves), 6) as ratio from h group by 1, 2""")
def robust_ratios(spark, sf):
    """The same for the whole corpus and for its two halves of samples."""
    half = F.explode(F.array(F.lit("all"), F.when(F.col("sid") % 2 == 0, "even").otherwise("odd"))).alias("half")
    g = _robust(spark, sf).select("form", half, "leaves", "tokens").groupBy("form", "half")
    return g.agg(F.count("*").alias("samples"), F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.sum("leaves"), 6).alias("ratio"))


# --- stability ------------------------------------------------------------------------------------


def _cost_sql(k: int) -> str:
    h = lambda cols, where="": f"(select sid, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from (select sid, {cols}, count(*)::double as n from g{k} {where} group by sid, {cols}) group by sid)"
    return f"""lm{k} as (select a.sid, c.n as tokens, c.n / o.n * (greatest(0.0, a.h) + greatest(0.0, coalesce(b.h, 0)) + greatest(0.0, coalesce(p.h, 0) - coalesce(f.h, 0))) + 2.0 / o.n as cost
from {h('tok')} a join (select sid, count(*) as n from s{k} group by 1) c on a.sid = c.sid join (select sid, count(*) as n from s0 group by 1) o on a.sid = o.sid left join {h('delta', 'where delta is not null')} b on a.sid = b.sid
left join {h('tok, nt', 'where nt is not null')} p on a.sid = p.sid left join {h('tok', 'where nt is not null')} f on a.sid = f.sid)"""


def lm_cost(tokens, leaves_of):
    """(sid, tokens, cost): language-model cost a leaf of token sequences in Z-order, given (sid, leaves)."""
    w = Window.partitionBy("sid").orderBy("code", "x", "y", "z")
    z = tokens.withColumn("code", space.morton())
    step = z.select("sid", (F.col("code") - F.lag("code").over(w)).alias("delta")).where("delta is not null")
    out = z.groupBy("sid").agg(F.count("*").alias("tokens")).join(leaves_of, "sid")
    for p in (stats.entropy(z, ["sid"], "token", name="a", base2=True), stats.entropy(step, ["sid"], "delta", name="b", base2=True), stats.conditional_entropy(stats.ngrams(z, ["sid"], ["code", "x", "y", "z"], "token", 2), ["sid"], "c")):
        out = out.join(p, "sid", "left")
    bits = F.col("a") + F.coalesce("b", F.lit(0.0)) + F.coalesce("c", F.lit(0.0))
    return out.select("sid", "tokens", (F.col("tokens") / F.col("leaves") * bits + 2.0 / F.col("leaves")).alias("cost"))


SIGN_P = "case when positive + negative = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(positive, negative) + 1), lambda i: exp(lgamma(positive + negative + 1.0) - lgamma(i + 1.0) - lgamma(positive + negative - i + 1.0) - (positive + negative) * ln(2.0))))) end"
LIMITS = "[" + ", ".join(f"{x!r}::double" for x in experiments.poisson_limits()) + "]"


@query(f"""with {TRAINED}, {', '.join(f"g{k} as (select sid, token as tok, lead(token) over w as nt, {MORTON} - lag({MORTON}) over w as delta from s{k} window w as (partition by sid order by {MORTON}, x, y, z))" for k in (0, MERGES))}, {_cost_sql(0)}, {_cost_sql(MERGES)},
ed as (select a.sid, count(*) as leaf_edges, count(*) filter (where a.slot <> b.slot) as edges from (select sid, slot, cell + st as cell from c{MERGES} cross join ofs) a join c{MERGES} b on a.cell = b.cell group by 1),
bx as (select sid, count(*) as leaves, count(distinct tok) as types, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) * (max(z) - min(z) + 1) as box from v group by 1),
pm as (select bx.sid, leaves::double as s_leaves, box::double as s_box, leaves / box as s_occupancy, types::double as s_types, 1 - b.tokens / leaves as d_tokens, a.cost - b.cost as d_cost, coalesce(1 - edges / leaf_edges, 0.0) as d_edges, 1 - leaves / b.tokens as d_footprint
from bx join lm0 a on bx.sid = a.sid join lm{MERGES} b on bx.sid = b.sid left join ed on bx.sid = ed.sid),
st as (select sid, unnest(['leaves', 'box', 'occupancy', 'types']) as stratum, unnest([s_leaves, s_box, s_occupancy, s_types]) as k from pm),
ct as (select stratum, quantile_cont(k, 0.333) as lo, quantile_cont(k, 0.666) as hi from st group by 1),
bu as (select sid, st.stratum, case when k <= lo then 'low' when k <= hi then 'mid' else 'high' end as bucket from st join ct on st.stratum = ct.stratum union all select sid, 'all', 'all' from pm),
ce as (select bu.*, m.metric, m.v from bu join (select sid, unnest(['tokens', 'cost', 'edges', 'footprint']) as metric, unnest([d_tokens, d_cost, d_edges, d_footprint]) as v from pm) m on bu.sid = m.sid),
we as (select sid, b, len(list_filter({LIMITS}, lambda t: t < {uniform_sql('sid * 1000 + b', 17)})) as w from pm, range(1, 201) r(b)),
bo as (select metric, stratum, bucket, b, sum(w * v) / nullif(sum(w), 0) as m from ce join we on ce.sid = we.sid group by 1, 2, 3, 4),
en as (select metric, stratum, bucket, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from bo group by 1, 2, 3),
su as (select metric, stratum, bucket, count(*) as n, avg(v) as mean, count(*) filter (where v > 0) as positive, count(*) filter (where v < 0) as negative from ce group by 1, 2, 3)
select su.metric, su.stratum, su.bucket, n, round(mean, 6) as mean, round(low, 6) as low, round(high, 6) as high, positive, negative, round({SIGN_P}, 6) as p from su join en on su.metric = en.metric and su.stratum = en.stratum and su.bucket = en.bucket""")
def stability_cells(spark, sf):
    """What the rules gain, sample by sample, against no rules: mean difference, bootstrap interval and sign test of tokens a leaf, language-model cost, boundary edges and footprint, in all and by thirds of the samples' size, box, occupancy and token types."""
    lv, rules, enc = trained(spark, sf)
    cut = bpe3d.Cut(spark)
    side = lambda c: F.max(c) - F.min(c) + 1
    base = lv.groupBy("sid").agg(F.count("*").alias("leaves"), F.countDistinct("token").alias("types"), (side("x") * side("y") * side("z")).cast("long").alias("box"))
    n0 = base.select("sid", "leaves")
    owned = bpe3d.owners(enc, rules, BASE)
    edges = voxel.neighbours(owned, value="own").groupBy("sid").agg(F.count("*").alias("leaf_edges"), F.count_if(F.col("own") != F.col("other")).alias("edges"))
    per = base.join(lm_cost(lv, n0).select("sid", F.col("cost").alias("cost0")), "sid").join(lm_cost(enc, n0), "sid").join(edges, "sid", "left")
    ratio = F.col("leaves") / F.col("tokens")
    per = cut(per.select(
        "sid", F.struct(F.col("leaves").cast("double").alias("leaves"), F.col("box").cast("double").alias("box"), (F.col("leaves") / F.col("box")).alias("occupancy"), F.col("types").cast("double").alias("types")).alias("s"),
        F.struct((1 - F.col("tokens") / F.col("leaves")).alias("tokens"), (F.col("cost0") - F.col("cost")).alias("cost"), F.coalesce(1 - F.col("edges") / F.col("leaf_edges"), F.lit(0.0)).alias("edges"), (1 - ratio).alias("footprint")).alias("d"),
    ))
    unfolded = lambda name, fields, key, value: per.select("sid", F.explode(F.array(*(F.struct(F.lit(f).alias(key), F.col(f"{name}.{f}").alias(value)) for f in fields))).alias("e")).select("sid", "e.*")
    strata = unfolded("s", ("leaves", "box", "occupancy", "types"), "stratum", "k")
    cuts = F.broadcast(stats.quantiles(strata, ["stratum"], "k", {"lo": 0.333, "hi": 0.666}))  # four rows
    bucket = F.when(F.col("k") <= F.col("lo"), "low").when(F.col("k") <= F.col("hi"), "mid").otherwise("high")
    buckets = strata.join(cuts, "stratum").select("sid", "stratum", bucket.alias("bucket")).unionByName(per.select("sid", F.lit("all").alias("stratum"), F.lit("all").alias("bucket")))
    cells = buckets.join(unfolded("d", ("tokens", "cost", "edges", "footprint"), "metric", "v"), "sid")
    out = experiments.with_sign_test(experiments.bootstrap_cells(cells, ["metric", "stratum", "bucket"], "v", F.col("sid")))
    return out.select("metric", "stratum", "bucket", "n", r6("mean"), r6("low"), r6("high"), "positive", "negative", r6("p"))


# --- final metrics --------------------------------------------------------------------------------


def _unigram_sql(k: int) -> str:
    return f"(select sum(n) as n, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from (select token, count(*)::double as n from s{k} group by 1))"


@query(f"""with {TRAINED}, ow as materialized (select c.sid, c.cell, c.slot, s.token as tok from c{MERGES} c join s{MERGES} s on c.slot = s.slot),
la as (select slot as cell, token as tok from s0), aa as (select sid::bigint * 1073741824 + x * 1048576 + y * 1024 + z as cell, token as tok from s{MERGES}),
lp as (select 'leaf' as sid, a.tok as s, b.tok as t, d from (select tok, cell + st as cell, ox + 2 * oy + 3 * oz as d from la cross join ofs) a join la b on a.cell = b.cell
union all select 'anchor', a.tok, b.tok, d from (select tok, cell + st as cell, ox + 2 * oy + 3 * oz as d from aa cross join ofs) a join aa b on a.cell = b.cell
union all select 'boundary', a.tok, b.tok, d from (select slot, tok, cell + st as cell, ox + 2 * oy + 3 * oz as d from ow cross join ofs) a join ow b on a.cell = b.cell where a.slot <> b.slot), {directed_sql('lp')},
x as (select hp.sid as level, hp.n as pairs, hp.h as h_pair, greatest(0.0, hp.h - hs.h) as cond, greatest(0.0, ht.h - greatest(0.0, hp.h - hs.h)) as mi from hp join hs on hp.sid = hs.sid join ht on hp.sid = ht.sid),
y as (select l.n as leaves, m.n as tokens, l.h as leaf_h, m.h as macro_h, a.pairs as leaf_pairs, a.h_pair as leaf_pair_h, a.cond as leaf_cond, a.mi as leaf_mi, c.pairs as anchor_pairs, c.mi as anchor_mi, b.pairs as boundary_pairs, b.h_pair as boundary_pair_h, b.cond as boundary_cond, b.mi as boundary_mi
from {_unigram_sql(0)} l, {_unigram_sql(MERGES)} m, (select * from x where level = 'leaf') a, (select * from x where level = 'boundary') b, (select * from x where level = 'anchor') c)
select leaves::bigint as leaves, tokens::bigint as tokens, round(tokens / leaves, 6) as ratio, round(leaf_h, 6) as leaf_h, round(macro_h, 6) as macro_h, round(macro_h * tokens / leaves, 6) as macro_h_per_leaf, leaf_pairs::bigint as leaf_pairs, anchor_pairs::bigint as anchor_pairs, boundary_pairs::bigint as boundary_pairs,
round(leaf_mi, 6) as leaf_mi, round(anchor_mi, 6) as anchor_mi, round(boundary_mi, 6) as boundary_mi, round(coalesce(boundary_mi / nullif(leaf_mi, 0), 0), 6) as boundary_mi_ratio, round(boundary_pairs / leaf_pairs, 6) as boundary_edge_ratio, round(coalesce(boundary_mi / nullif(leaf_mi, 0), 0) * boundary_pairs / leaf_pairs, 6) as weighted_mi_ratio,
round(leaf_h - macro_h, 6) as delta_h, round(leaf_h - macro_h * tokens / leaves, 6) as delta_h_per_leaf, round(leaf_pair_h - boundary_pair_h, 6) as delta_pair_h, round(leaf_cond - boundary_cond, 6) as delta_cond, round(leaf_mi - boundary_mi, 6) as delta_mi from y""")
def final_metrics(spark, sf):
    """The final row of a study: compression, entropies, and mutual information of leaf, anchor and boundary pairs (all levels through the same grouping sets), with their ratios and differences."""
    lv, rules, enc = trained(spark, sf)
    level = lambda rows, name: rows.select(F.lit(name).alias("level"), "dir", "tok", "other")
    touching = lambda rows: voxel.neighbours(rows.withColumnRenamed("token", "tok")).withColumn("dir", F.col("dx") + 2 * F.col("dy") + 3 * F.col("dz"))
    pairs = level(touching(lv), "leaf").unionByName(level(touching(enc), "anchor")).unionByName(level(bpe3d.boundary_pairs(bpe3d.owners(enc, rules, BASE)), "boundary"))
    d = stats.directed_pairs(pairs, ["level"])
    take = lambda name, c, out: F.max(F.when(F.col("level") == name, F.col(c))).alias(out)
    d = d.agg(*(take(n, c, f"{n}_{o}") for n in ("leaf", "anchor", "boundary") for c, o in (("pairs", "pairs"), ("h_pair", "pair_h"), ("cond", "cond"), ("mi", "mi"))))
    for name, rows in (("leaf", lv), ("macro", enc)):
        own = rows.groupBy("token").agg(F.count("*").cast("double").alias("n")).agg(F.sum("n").alias(f"{name}_n"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias(f"{name}_h"))
        d = d.join(F.broadcast(own))  # one row each
    c = F.col
    mi, edge, per = stats.safe_ratio(c("boundary_mi"), c("leaf_mi")), stats.safe_ratio(c("boundary_pairs"), c("leaf_pairs")), c("macro_h") * c("macro_n") / c("leaf_n")
    rounded = {
        "ratio": c("macro_n") / c("leaf_n"), "leaf_h": c("leaf_h"), "macro_h": c("macro_h"), "macro_h_per_leaf": per, "leaf_mi": c("leaf_mi"), "anchor_mi": c("anchor_mi"), "boundary_mi": c("boundary_mi"), "boundary_mi_ratio": mi, "boundary_edge_ratio": edge, "weighted_mi_ratio": mi * edge,
        "delta_h": c("leaf_h") - c("macro_h"), "delta_h_per_leaf": c("leaf_h") - per, "delta_pair_h": c("leaf_pair_h") - c("boundary_pair_h"), "delta_cond": c("leaf_cond") - c("boundary_cond"), "delta_mi": c("leaf_mi") - c("boundary_mi"),
    }
    return d.select(c("leaf_n").cast("long").alias("leaves"), c("macro_n").cast("long").alias("tokens"), "leaf_pairs", "anchor_pairs", "boundary_pairs", *(F.round(v, 6).alias(k) for k, v in rounded.items()))


# --- shapes ---------------------------------------------------------------------------------------

SHAPED = 12


@query(f"""with {V}, {bpe_sql(SHAPED)}, {leaves_sql(SHAPED)}, ce as (select distinct new_id, dx, dy, dz from l), f6(ox, oy, oz) as (values (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
dg as (select a.new_id, a.dx, a.dy, a.dz, count(b.new_id) as d from ce a cross join f6 left join ce b on a.new_id = b.new_id and a.dx + ox = b.dx and a.dy + oy = b.dy and a.dz + oz = b.dz group by 1, 2, 3, 4),
hi as (select new_id, string_agg(d || ':' || n, ',' order by d) as degrees, max(d) as top from (select new_id, d, count(*) as n from dg group by 1, 2) group by 1),
bx as (select new_id, count(*) as cells, least(max(dx) - min(dx), max(dy) - min(dy), max(dz) - min(dz)) + 1 as short, greatest(max(dx) - min(dx), max(dy) - min(dy), max(dz) - min(dz)) + 1 as long from ce group by 1)
select bx.new_id, cells, degrees, case when cells < 2 then 'singleton' else (case when short = 1 and long = cells then 'linear_chain_like' when short = 1 then 'planar_like' else 'volumetric_like' end) || case when top >= 3 then '_branched' else '' end end as shape from bx join hi on bx.new_id = hi.new_id""")
def motif_shapes(spark, sf):
    """Of each macro's footprint: its cells by number of neighbours, and the rank of its shape."""
    s = bpe3d.motif_shapes(bpe3d.rules_frame(spark, bpe3d.train(leaves(spark, sf), BASE, SHAPED)))
    text = F.array_join(F.transform(F.map_entries("degrees"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return s.select("new_id", "cells", text.alias("degrees"), "shape")


# --- one dimension against three, under each order ------------------------------------------------

#: Orders of a sample's voxels: codes of their places and SQL.
ORDERS = {
    "morton": (space.morton_codes, MORTON),
    "hilbert": (space.hilbert_codes, None),
    "raster": (lambda x, y, z: (x * 32 + y) * 32 + z, "(x * 1024 + y * 32 + z)"),
    "zyx": (lambda x, y, z: (z * 32 + y) * 32 + x, "(z * 1024 + y * 32 + x)"),
    "transposed": (lambda x, y, z: space.morton_codes(y, x, z), TRANSPOSED),
}
ROUNDS = 2


def _order_sql(name: str, code: str | None) -> str:
    """1D training along an order with footprints (t<k>, distances g<k>), and each leaf's place in either encoder's sequence (o<name>)."""
    t = f"_{name}"
    by = "code" if code is None else code
    rows = f"h{t}_code" if code is None else "v"
    out = [hilbert_sql("v", tag=f"h{t}"), hilbert_sql(f"s{MERGES}", tag=f"k{t}")] if code is None else []
    out.append(f"t0{t} as materialized (select sid, row_number() over (partition by sid order by {by}, x, y, z) - 1 as pos, tok::bigint as token, [(x, y, z)] as cells from {rows})")
    for k in range(ROUNDS):
        p, q = f"{k}{t}", f"{k + 1}{t}"
        out.append(f"n{p} as (select *, lead(token) over (partition by sid order by pos) as nt, lead(cells) over (partition by sid order by pos) as nc from t{p})")
        out.append(f"u{p} as materialized (select token as a, nt as b, count(*) as n from n{p} where nt is not null group by 1, 2 having count(*) >= 2 order by n desc, a desc, b desc limit 1)")
        out.append(f"w{p} as (select n.*, coalesce(n.token = a and n.nt = b, false) as hit, a = b as same, row_number() over (partition by sid order by pos) as i from n{p} n, u{p})")
        out.append(f"x{p} as (select *, i - row_number() over (partition by sid, hit order by pos) as run from w{p})")
        out.append(f"y{p} as (select *, hit and (not same or row_number() over (partition by sid, hit, run order by pos) % 2 = 1) as take from x{p})")
        out.append(f"z{p} as materialized (select *, coalesce(lag(take) over (partition by sid order by pos), false) as eaten from y{p})")
        out.append(f"t{q} as materialized (select sid, row_number() over (partition by sid order by pos) - 1 as pos, case when take then {BASE + k} else token end as token, case when take then list_concat(cells, nc) else cells end as cells from z{p} where not eaten)")
        out.append(f"g{p} as (select z.sid, z.pos, min(abs(p[1] - q[1]) + abs(p[2] - q[2]) + abs(p[3] - q[3])) as l1 from (select sid, pos, unnest(cells) as p, nc from z{p} where take and not eaten) z, unnest(z.nc) u(q) group by 1, 2)")
    place = f"select slot, row_number() over (partition by sid order by {by}, x, y, z) - 1 as pos from {f'k{t}_code' if code is None else f's{MERGES}'}"
    out.append(f"o{t} as materialized (select '1d' as encoder, sid, p[1] as x, p[2] as y, p[3] as z, pos from (select sid, pos, unnest(cells) as p from t{ROUNDS}{t}) union all select '3d', c.sid, x, y, z, pos from c{MERGES} c join ({place}) s on c.slot = s.slot)")
    distances = " union all ".join(f"select l1 from g{k}{t}" for k in range(ROUNDS))
    out.append(f"d{t} as (select '1d' as encoder, count(*) as merges, avg(l1) as l1, avg((l1 > 1)::int) as far from ({distances}) union all select '3d', (select sum(m) from ({' union all '.join(f'select count(*) as m from m{k}' for k in range(MERGES))})), 1, 0)")
    out.append(f"e{t} as (select a.encoder, abs(b.pos - a.pos) as gap from o{t} a cross join ofs join o{t} b on a.encoder = b.encoder and a.sid = b.sid and a.x + ox = b.x and a.y + oy = b.y and a.z + oz = b.z)")
    out.append(f"f{t} as (select '{name}' as ord, e.encoder, count(*) as edges, avg((gap = 0)::int) as inside, avg(gap) filter (where gap > 0) as gap_mean, quantile_cont(gap, 0.5) filter (where gap > 0) as p50, quantile_cont(gap, 0.9) filter (where gap > 0) as p90, quantile_cont(gap, 0.99) filter (where gap > 0) as p99, avg((gap = 1)::int) as next_ratio, any_value(merges) as merges, any_value(l1) as l1, any_value(far) as far from e{t} e join d{t} d on e.encoder = d.encoder group by 2)")
    return ", ".join(out)


@query(f"""with {TRAINED}, {', '.join(_order_sql(n, c) for n, (_, c) in ORDERS.items())}, al as ({' union all '.join(f'select * from f_{n}' for n in ORDERS)})
select ord as order_name, encoder, edges, round(inside, 6) as inside, round(gap_mean, 6) as gap_mean, round(p50, 6) as p50, round(p90, 6) as p90, round(p99, 6) as p99, round(next_ratio, 6) as next_ratio, merges::bigint as merges, round(l1, 6) as merge_l1, round(far, 6) as nonlocal from al""")
def order_panel(spark, sf):
    """Both encoders under each order: face edges inside one token, how far apart in the sequence the others' tokens are, and how far apart in space the two sides of a merge were."""
    codes = {name: code for name, (code, _) in ORDERS.items()}
    corpus = bpe3d.Corpus(leaves(spark, sf))
    rules = corpus.learn(BASE, MERGES, last=False)
    n = bpe3d.Cut(spark)(orders.panel(corpus, codes, rules, orders.train(corpus, codes, BASE, ROUNDS)))
    corpus.cut.drop()
    key = ["order_name", "encoder"]
    gaps = n.where("kind = 'gap'").withColumn("apart", F.when(F.col("value") > 0, F.col("value")))
    mean = lambda v, w="n": F.sum(v * F.col("n")) / F.sum(w)
    merges = n.where("kind = 'l1'").groupBy(*key).agg(F.sum("n").alias("merges"), mean(F.col("value")).alias("l1"), mean((F.col("value") > 1).cast("int")).alias("far"))
    fixed = spark.createDataFrame([(name, "3d", 0, 1.0, 0.0) for name in ORDERS], "order_name string, encoder string, merges bigint, l1 double, far double")
    q = stats.quantiles(gaps, key, "apart", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, weight="n")
    out = gaps.groupBy(*key).agg(F.sum("n").alias("edges"), mean((F.col("value") == 0).cast("int")).alias("inside"), mean(F.col("value"), F.when(F.col("value") > 0, F.col("n"))).alias("gap_mean"), mean((F.col("value") == 1).cast("int")).alias("next_ratio"))
    merges = merges.unionByName(fixed).groupBy(*key).agg(F.sum("merges").alias("merges"), F.max("l1").alias("l1"), F.max("far").alias("far"))
    out = out.join(q, key, "left").join(F.broadcast(merges), key, "left")  # ten rows
    return out.select("order_name", "encoder", "edges", r6("inside"), r6("gap_mean"), r6("p50"), r6("p90"), r6("p99"), r6("next_ratio"), "merges", F.round("l1", 6).alias("merge_l1"), F.round("far", 6).alias("nonlocal"))
