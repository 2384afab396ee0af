"""Queries over ordered rows: trends, rolling percentiles, fits, farthest points, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence
from .base import V, query, table, voxels
from .layout_queries import fps_sql


def events(spark, sf):
    return table(spark, sf, "events")


@query("""with n as (select user_id, event_id, value, row_number() over w as i, avg(value) over (partition by user_id order by ts, event_id rows between 9 preceding and current row) as t from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, avg(value) filter (where i <= 10) as a from n group by 1) select n.user_id, event_id, round(case when i < 10 then s.a else t end, 6) as ma from n join s on n.user_id = s.user_id""")
def moving_average(spark, sf):
    out = sequence.moving_average(events(spark, sf), ["user_id"], ["ts", "event_id"], "value", 10)
    return out.select("user_id", "event_id", F.round("ma", 6).alias("ma"))


@query("select user_id, event_id, round(p, 6) as p95 from (select user_id, event_id, count(*) over w as n, quantile_cont(value, 0.95) over w as p from events window w as (partition by user_id order by ts, event_id rows between 19 preceding and current row)) where n >= 20")
def ring_p95(spark, sf):
    out = sequence.rolling_percentile(events(spark, sf), ["user_id"], ["ts", "event_id"], "value", 20, 0.95)
    return out.where("pct is not null").select("user_id", "event_id", F.round("pct", 6).alias("p95"))


@query("select event_type, round(regr_slope(value, event_id % 100), 8) as slope, round(regr_intercept(value, event_id % 100), 6) as intercept, count(*) as n from events group by 1")
def linear_fit(spark, sf):
    e = events(spark, sf).withColumn("k", F.col("event_id") % 100)
    fit = sequence.linear_fit(e, ["event_type"], "k", "value")
    return fit.join(e.groupBy("event_type").agg(F.count("*").alias("n")), "event_type").select("event_type", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


@query("""with recursive n as (select user_id % 20 as u, value, row_number() over (partition by user_id % 20, ts::date order by ts, event_id) as i, ts::date as d from events),
r as (select u, d, i, value as s from n where i = 1 union all select n.u, n.d, n.i, 0.9 * r.s + 0.1 * n.value from r join n on n.u = r.u and n.d = r.d and n.i = r.i + 1)
select u, d::varchar as day, count(*)::int as n, round(arg_max(s, i), 6) as last from r group by 1, 2""")
def ema_trend(spark, sf):
    """The last value of each day's trend; windows carry it in blocks, so no key's rows are gathered in one array."""
    e = events(spark, sf).select((F.col("user_id") % 20).alias("u"), F.to_date("ts").cast("string").alias("day"), "ts", "event_id", "value")
    s = sequence.trend(e, ["u", "day"], ["ts", "event_id"], "value", 0.9)
    return s.groupBy("u", "day").agg(F.count("*").cast("int").alias("n"), F.round(F.max_by("trend", F.struct("ts", "event_id")), 6).alias("last"))


@query(f"with {V}, {fps_sql('sid', 16, 'v')} " + " union all ".join(f"select sid, x, y, z, {k}::bigint as nth from f{k}" for k in range(16)))
def farthest_points(spark, sf):
    return sequence.farthest_points(voxels(spark, sf), ["sid"], 16).select("sid", "x", "y", "z", "nth")


@query("""with recursive l as (select o_custkey % 64 as k, round(sum(o_totalprice), 2) as n from orders group by 1), o as (select k, n, row_number() over (order by n desc, k) as i from l),
g as (select 0::bigint as i, null::bigint as k, 0 as grp, [0.0, 0.0, 0.0, 0.0, 0.0]::double[] as t union all
select o.i, o.k, (list_position(g.t, list_min(g.t)) - 1)::int, list_transform(range(5), lambda j: case when j = list_position(g.t, list_min(g.t)) - 1 then g.t[j + 1] + o.n else g.t[j + 1] end) from g join o on o.i = g.i + 1)
select k, grp::bigint as grp from g where k is not null""")
def lpt_groups(spark, sf):
    """Sources (a bounded list of shards) grouped by load."""
    loads = [(int(r["k"]), float(r["n"])) for r in table(spark, sf, "orders").groupBy((F.col("o_custkey") % 64).alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("n")).collect()]
    return spark.createDataFrame(sequence.balanced_groups(loads, 5), "k bigint, grp bigint")


@query("with n as (select o_custkey, o_orderkey, count(*) over (partition by o_custkey order by o_orderkey rows unbounded preceding) - 1 as i from orders) select o_custkey, o_orderkey, i as offset_in from n")
def prefix_offsets(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.count("*").over(w) - 1).alias("offset_in"))


@query("select o_orderpriority as k, round(sum(o_totalprice), 2) as total, max(o_totalprice) as high, min(o_totalprice) as low, count(distinct o_orderstatus) as states from orders group by 1")
def dict_reduce(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.size(F.array_distinct(F.collect_set("o_orderstatus"))).cast("long").alias("states"))


@query("""with r as (select o_orderpriority as k, unnest(['loss.price', 'loss.part.key', 'top', 'low']) as path, unnest([o_totalprice, o_custkey::double, o_orderkey::double, o_orderkey::double]) as v from orders)
select k, path, round(case path when 'top' then max(v) when 'low' then min(v) else avg(v) end, 4) as value from r group by k, path""")
def nested_reduce(spark, sf):
    """Nested records of one run reduced leaf by leaf: the mean, or what the leaf's name asks for."""
    leaves = F.create_map(F.lit("loss.price"), F.col("o_totalprice"), F.lit("loss.part.key"), F.col("o_custkey").cast("double"), F.lit("top"), F.col("o_orderkey").cast("double"), F.lit("low"), F.col("o_orderkey").cast("double"))
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), F.explode(leaves).alias("path", "v"))
    return sequence.reduce_leaves(rows, ["k"], {"top": F.max, "low": F.min}).withColumn("value", F.round("value", 4))
