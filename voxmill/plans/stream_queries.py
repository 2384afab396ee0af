"""Streams over the events table, drained to a table and compared with the same in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs, rings
from .base import query


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_tumbling(spark, sf):
    out = jobs.drain(jobs.tumbling(jobs.closed(jobs.event_stream(spark, sf), spark, "tumbling"), "1 hour", "2 hours", "event_type"), "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("with e as (select date_trunc('hour', ts) - i * interval 1 hour as start, value from events, range(2) r(i)) select start, count(*) as n, round(sum(value), 4) as total from e group by 1")
def stream_sliding(spark, sf):
    out = jobs.drain(jobs.tumbling(jobs.closed(jobs.event_stream(spark, sf), spark, "sliding"), "2 hours", "2 hours", slide="1 hour"), "sliding")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minute then 0 else 1 end as b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, count(*) as n, round(sum(value), 4) as total from s group by user_id, k""")
def stream_sessions(spark, sf):
    out = jobs.drain(jobs.sessions(jobs.closed(jobs.event_stream(spark, sf), spark, "sessions"), "30 minutes", "2 hours", "user_id"), "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""with r as (select event_id % 97 as step, user_id % 5 as n_in, event_id % 7 as n_sharp, event_id % 3 as n_extra, event_id % 11 as n_oor from events), q as (select *, n_in + n_sharp + n_extra + n_oor as m from r)
select step, count(*) as n, round(max(n_oor / m::double), 6) as high, round(avg(n_oor / m::double), 6) as mean from q where m > 0 group by 1""")
def log_stream(spark, sf):
    e = jobs.event_stream(spark, sf)
    line = F.format_string("[LOSS-SUMMARY] step=%d | n_in=%d | n_sharp=%d | n_extra=%d | n_oor=%d", F.col("event_id") % 97, F.col("user_id") % 5, F.col("event_id") % 7, F.col("event_id") % 3, F.col("event_id") % 11)
    out = jobs.drain(jobs.log_metrics(e.select(line.alias("value"))), "log", "complete")
    return out.select("step", "n", F.round("high", 6).alias("high"), F.round("mean", 6).alias("mean"))


@query("select event_type, count(distinct event_id % 64) as distinct_codes from events group by 1")
def cumulative_distinct(spark, sf):
    e = jobs.event_stream(spark, sf).select("event_type", (F.col("event_id") % 64).alias("code"))
    return jobs.drain(jobs.distinct_so_far(e, "event_type", "code"), "distinct").groupBy("event_type").agg(F.max("distinct_codes").alias("distinct_codes"))


@query("""with recursive n as materialized (select user_id, event_id, value, row_number() over w as i, quantile_cont(value, 0.95) over (partition by user_id order by ts, event_id rows between 19 preceding and current row) as p from events window w as (partition by user_id order by ts, event_id)),
r as (select user_id, i, value as s from n where i = 1 union all select n.user_id, n.i, r.s * (6::double / 7) + n.value * (1 - 6::double / 7) from r join n on n.user_id = r.user_id and n.i = r.i + 1)
select n.user_id, event_id, round(case when n.i >= 20 then p end, 6) as p95, round(s, 6) as trend from n join r on n.user_id = r.user_id and n.i = r.i""")
def stream_rings(spark, sf):
    """Percentile of the last twenty values and trend of each user, kept as state of a stream; rows leave it once the watermark has passed them."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, rings.PROVIDER)
    try:
        e = jobs.closed(jobs.event_stream(spark, sf), spark, "rings")
        out = jobs.drain(rings.rings(e, "user_id", "event_id", "value", alpha=6 / 7), "rings")
    finally:
        spark.conf.set(setting, before)
    return out.select("user_id", F.col("number").alias("event_id"), F.round("pct", 6).alias("p95"), F.round("trend", 6).alias("trend"))
