"""Queries over windowed values, organs, masks and logs; prices and discounts stand in for Hounsfield units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ct, stats
from ..sources.readers import parse_log
from .base import V, query, table, voxels

WIN = "win(name, width, level) as (values ('lung', 1500, -600), ('bone', 1500, 300), ('soft_tissue', 400, 50), ('brain', 80, 35), ('flat', 0, 0))"
HU = "p as (select p_partkey, p_retailprice - 1500 as hu, p_brand, p_type from part)"


def windows(spark):
    return F.broadcast(spark.createDataFrame([*ct.WINDOWS, ("flat", 0, 0)], "name string, width int, level int"))


def parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") - 1500).alias("hu"), "p_brand", "p_type")


@query(f"with {WIN}, {HU} select name, count(*) as n, sum((hu between level - width / 2 and level + width / 2)::int)::bigint as inside from p, win group by name")
def window_binarise(spark, sf):
    """All windows in one pass: conditional counts, then unpivoted."""
    all_windows = [*ct.WINDOWS, ("flat", 0, 0)]
    hits = parts(spark, sf).agg(F.count("*").alias("n"), *(F.sum(ct.binarise(F.col("hu"), F.lit(w), F.lit(lv))).alias(name) for name, w, lv in all_windows))
    return hits.unpivot(["n"], [w[0] for w in all_windows], "name", "inside").select("name", "n", "inside")


@query(f"with {WIN}, {HU} select p_partkey, round(greatest(0.0, least(1.0, (hu + 1350) / 1500)), 6) as lung, round(greatest(0.0, least(1.0, (hu + 150) / 400)), 6) as soft, 0.0::double as flat from p")
def window_scale(spark, sf):
    s = lambda w, lv: F.round(ct.scale(F.col("hu"), F.lit(w), F.lit(lv)), 6)
    return parts(spark, sf).select("p_partkey", s(1500, -600).alias("lung"), s(400, 50).alias("soft"), s(0, 0).alias("flat"))


@query("""with o as (select l_linenumber as case_id, l_returnflag as organ, l_extendedprice as hu from lineitem),
g as (select case_id, organ, count(*) as n, avg(hu) as mean, stddev_pop(hu) as std, min(hu) as low, max(hu) as high, quantile_cont(hu, 0.25) as p25, quantile_cont(hu, 0.5) as p50, quantile_cont(hu, 0.75) as p75 from o group by 1, 2)
select case_id, organ, n, round(n / sum(n) over (partition by case_id), 6) as share, round(mean, 4) as mean, round(std, 4) as std, low, high, round(p25, 4) as p25, round(p50, 4) as p50, round(p75, 4) as p75 from g""")
def organ_stats(spark, sf):
    o = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("case_id"), F.col("l_returnflag").alias("organ"), F.col("l_extendedprice").alias("hu"))
    r = ct.organ_stats(o, "case_id", "organ")
    return r.select("case_id", "organ", "n", F.round("share", 6).alias("share"), *(F.round(c, 4).alias(c) for c in ("mean", "std")), "low", "high", *(F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")))


@query("""with o as (select l_linenumber as case_id, l_extendedprice as hu from lineitem), m as (select case_id, avg(hu) as mean from o group by 1)
select o.case_id, round(quantile_cont(hu, 0.0005), 4) as low, round(quantile_cont(hu, 0.9995), 4) as high, round(avg(hu), 4) as mean, round(stddev_pop(hu), 4) as std from o join m on o.case_id = m.case_id where hu > m.mean group by 1""")
def foreground_norm(spark, sf):
    o = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("case_id"), F.col("l_extendedprice").alias("hu"))
    r = ct.foreground_norm(o, "case_id")
    return r.select("case_id", *(F.round(c, 4).alias(c) for c in ("low", "high", "mean", "std")))


ORGANS = ("liver", "Left Lung", "trachea", "rib 7", "Brainstem", "vertebrae L1", "kidney_right", "cerebral cortex", "airway wall")


@query("""with o(organ) as (values ('liver'), ('Left Lung'), ('trachea'), ('rib 7'), ('Brainstem'), ('vertebrae L1'), ('kidney_right'), ('cerebral cortex'), ('airway wall')),
w as (select organ, case when regexp_matches(lower(organ), 'lung|bronch|airway|trachea') then 'lung' when regexp_matches(lower(organ), 'bone|vertebra|rib|spine|femur|tibia|humerus|skull|pelvis') then 'bone'
when regexp_matches(lower(organ), 'brain|cerebr|cerebellum') then 'brain' else 'soft_tissue' end as win from o)
select organ, win, case win when 'lung' then 'lung_w1500_l-600.npy' when 'bone' then 'bone_w1500_l300.npy' when 'brain' then 'brain_w80_l35.npy' else 'soft_tissue_w400_l50.npy' end as file from w""")
def organ_window(spark, sf):
    o = spark.createDataFrame([(x,) for x in ORGANS], "organ string").withColumn("win", ct.window_of(F.col("organ")))
    return o.join(windows(spark), F.col("win") == F.col("name")).select("organ", "win", ct.window_file(F.col("name"), F.col("width"), F.col("level")).alias("file"))


MASK = f"{V}, k as (select sid as case_id, (sid % 4)::int as channels, (case when sid % 4 = 0 then 0 else tok % (sid % 4) end)::int as channel, x, y, z, 1 as value from v union all select sid, 3, 0, x, y, z, 1 from v where sid = 7 and tok > 8)"


def masks(spark, sf):
    v = voxels(spark, sf)
    n = F.col("sid") % 4
    own = v.select(F.col("sid").alias("case_id"), n.cast("int").alias("channels"), F.when(n == 0, 0).otherwise(F.try_mod(F.col("tok"), n)).cast("int").alias("channel"), "x", "y", "z", F.lit(1).alias("value"))
    more = v.where("sid = 7 and tok > 8").select(F.col("sid").alias("case_id"), F.lit(3).alias("channels"), F.lit(0).alias("channel"), "x", "y", "z", F.lit(1).alias("value"))
    return own.unionByName(more)


@query(f"""with {MASK}, o as (select case_id, channels, sum((value > 0)::int) as n from k group by case_id, channels, x, y, z), m as (select case_id, channels, max(n)::bigint as overlap from o group by 1, 2)
select *, case when channels = 0 then 'single_label_3d' when channels = 1 then 'single_channel_4d' when overlap <= 1.1 then 'one_hot' else 'multi_channel' end as format from m""")
def mask_format(spark, sf):
    return ct.mask_format(masks(spark, sf))


@query(f"with {MASK}, a as (select case_id, x, y, z, min(channel) as label from k group by 1, 2, 3, 4) select case_id, label, count(*) as n from a group by 1, 2")
def argmax_labels(spark, sf):
    return ct.argmax_labels(masks(spark, sf)).groupBy("case_id", "label").agg(F.count("*").alias("n"))


@query("select p_partkey, p_size, (case when p_size * 20 <= 512 then 512 when p_size * 20 <= 1024 then 1024 end)::int as r, (case when p_size * 20 <= 512 then 512 when p_size * 20 <= 1024 then 1024 end - p_size * 20)::int as pad from part")
def target_resolution(spark, sf):
    r = ct.target_resolution(F.col("p_size") * 20, strict=False).cast("int")
    return table(spark, sf, "part").select("p_partkey", "p_size", r.alias("r"), (r - F.col("p_size") * 20).cast("int").alias("pad"))


LOG = """r as (select event_id % 97 as step, user_id % 5 as n_in, event_id % 7 as n_sharp, event_id % 3 as n_extra, event_id % 11 as n_oor from events),
q as (select *, n_in + n_sharp + n_extra + n_oor as m from r), l as (select step, n_oor / m::double as ratio from q where m > 0)"""


def log_rows(spark, sf):
    """Training-log lines made from events, then parsed back."""
    e = table(spark, sf, "events")
    line = F.format_string("x [LOSS-SUMMARY] step=%d | n_in=%d | n_sharp=%d | n_extra=%d | n_oor=%d | y", F.col("event_id") % 97, F.col("user_id") % 5, F.col("event_id") % 7, F.col("event_id") % 3, F.col("event_id") % 11)
    return parse_log(e.select(line.alias("value")))


@query(f"with {LOG} select count(*) as n, round(min(ratio), 6) as low, round(max(ratio), 6) as high, round(avg(ratio), 6) as mean, round(stddev_pop(ratio), 6) as std, round(quantile_cont(ratio, 0.25), 6) as p25, round(quantile_cont(ratio, 0.5), 6) as p50, round(quantile_cont(ratio, 0.99), 6) as p99 from l")
def summary_quantiles(spark, sf):
    r = F.col("oor_ratio")
    rows = log_rows(spark, sf)
    all_of = rows.agg(F.count("*").alias("n"), F.round(F.min(r), 6).alias("low"), F.round(F.max(r), 6).alias("high"), F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_pop(r), 6).alias("std"))
    q = stats.quantiles(rows, [], "oor_ratio", {"p25": 0.25, "p50": 0.5, "p99": 0.99})
    return all_of.join(F.broadcast(q.select(*(F.round(c, 6).alias(c) for c in q.columns))))


@query(f"with {LOG} select step, round(max(ratio), 6) as high, round(min(ratio), 6) as low, round(avg(ratio), 6) as mean from l group by step")
def step_max(spark, sf):
    r = F.col("oor_ratio")
    return log_rows(spark, sf).groupBy("step").agg(F.round(F.max(r), 6).alias("high"), F.round(F.min(r), 6).alias("low"), F.round(F.avg(r), 6).alias("mean"))


@query(f"with {LOG}, s as (select step, max(ratio) as m from l group by step) select round(quantile_cont(m, 0.99), 6) as p99, round(quantile_cont(m, 0.95), 6) as p95, round(quantile_cont(m, 0.9), 6) as p90, round(quantile_cont(m, 0.75), 6) as p75, round(quantile_cont(m, 0.5), 6) as p50, round(min(m), 6) as low, round(max(m), 6) as high from s")
def threshold_reco(spark, sf):
    m = log_rows(spark, sf).groupBy("step").agg(F.max("oor_ratio").alias("m"))
    return m.agg(*(F.round(F.percentile("m", F.lit(p / 100)), 6).alias(f"p{p}") for p in (99, 95, 90, 75, 50)), F.round(F.min("m"), 6).alias("low"), F.round(F.max("m"), 6).alias("high"))


@query("select l_returnflag as k, round(avg(l_discount), 6) as mean, round(stddev_samp(l_discount), 6) as std, min(l_discount) as low, max(l_discount) as high, quantile_disc(l_discount, 0.5) as median from lineitem group by 1")
def score_summary(spark, sf):
    d = F.col("l_discount")
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d), 6).alias("std"), F.min(d).alias("low"), F.max(d).alias("high"), F.expr("percentile_disc(0.5) within group (order by l_discount)").alias("median"))


@query("with e as (select *, value - (event_id % 10) as err from events) select event_type, round(avg(abs(err)), 6) as l1, round(avg(err * err), 6) as l2, round(avg(case when abs(err) < 1 then 0.5 * err * err else abs(err) - 0.5 end), 6) as smooth, round(20 * log10(255) - 10 * log10(avg(err * err)), 4) as psnr from e group by 1")
def losses(spark, sf):
    e = F.col("err")
    rows = table(spark, sf, "events").withColumn("err", F.col("value") - F.col("event_id") % 10)
    smooth = F.when(F.abs(e) < 1, 0.5 * e * e).otherwise(F.abs(e) - 0.5)
    return rows.groupBy("event_type").agg(F.round(F.avg(F.abs(e)), 6).alias("l1"), F.round(F.avg(e * e), 6).alias("l2"), F.round(F.avg(smooth), 6).alias("smooth"), F.round(20 * F.log10(F.lit(255.0)) - 10 * F.log10(F.avg(e * e)), 4).alias("psnr"))


