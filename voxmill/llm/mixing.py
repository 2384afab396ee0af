"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions alone.

Targets: sources in code-point order (null last) weigh 3, 1, 2 and so on, share ``budget`` times all
words, and stop at ``cap`` times their own words; what they leave is shared again by weight. The
common level is found in one pass over the sources in the order in which they fill up.

Copies: each document is taken floor(target / source words) times; the rest of the target goes, one
more time each, to the documents that come first by the md5 of their id, as long as they fit. What a long
document leaves open there goes to up to ``FILLS`` others, each the largest that still fits. Only running
sums decide, and these are taken per (source, range of md5) with the ranges' own sums in front, so that no
source's rows meet in one task. All this reads (doc_id, source, size) alone, written once; texts meet their
copies in one join and travel once more for the range sort.

Positions: a source's weight runs linearly from ``start`` to ``end`` of its mean over training time t
in [0, 1]: sources of weight 1 fall, the others rise. Its demand up to t is the integral
D(t) = s t + (e - s) t^2 / 2; a copy whose words end at the share q of the source's taken words is
due where D(t) = q D(1), which is solved for t. Rows are range-sorted by t.

Null texts and texts without words have size 0 and are never moved by the extra copies: they are taken
floor(target / source words) times, with 0 words. A source without words has target 0. Repeated rows
are rows of their own (ties of md5, as of repeated and null ids, fall to size); many rows of one id share
a range of md5 and so a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, table

#: Weights by rank of source, share of all words, cap on repeats; ranges of md5 for each source; first and last weight of a rising source; documents that may fill what is open at the end.
WEIGHTS, BUDGET, CAP, RANGES, START, END, FILLS = (3, 1, 2), 1.5, 2, 4096, 0.5, 1.5, 3


def n_words(text: str = "text") -> Column:
    """Runs of anything but ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): one row for each source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("_cap", F.col("source_size") * float(CAP))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * BUDGET - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / weights)  # if just the sources before this one are full
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level")))).over(everything)
    target = F.least(F.col("_cap"), level["_level"] * F.col("weight"))
    return rows.withColumn("target", F.coalesce(target, F.col("_cap"))).select("source", "source_size", "weight", "target")


def plan(rows: DataFrame) -> DataFrame:
    """Add source_size, target, _copies and the words of the source in front (_before) to (doc_id, source, size, ...), written first."""
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("_md5", md5).withColumn("_range", (F.conv(F.substring("_md5", 1, 6), 16, 10).cast("long") % RANGES).cast("int"))
    rows = Written(rows.sparkSession, "mixing").put(rows.withColumn("_n", F.monotonically_increasing_id()))
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    sizes = sums.groupBy("source").agg(F.sum("_words").alias("source_size"))
    per = targets(sizes).withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per = per.withColumn("_extra", F.col("target") - F.col("_whole") * F.col("source_size"))
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_words").over(ahead), F.lit(0))).drop("_words")
    ranges = sums.join(per.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ranges = ranges.withColumnsRenamed({"source": "_s", "_range": "_r"})
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).drop("_s", "_r")
    own = Window.partitionBy("source", "_range").orderBy("_md5", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.withColumn("_more", (F.col("size") > 0) & (F.col("_before") + F.col("size") <= F.col("_extra")))
    return _filled(rows).withColumn("_copies", F.col("_whole") + F.col("_more").cast("long"))


def _filled(rows: DataFrame) -> DataFrame:
    """_more also for up to FILLS documents of each source: the largest that fits what is open, then a smaller one, and so on (of equal sizes the first)."""
    first = F.min(F.when((F.col("size") > 0) & ~F.col("_more"), F.struct("_md5", "doc_id", "_n")))
    sizes = rows.groupBy("source", "size", "_extra").agg(F.sum(F.when(F.col("_more"), F.col("size"))).alias("_taken"), first.alias("_first"))
    all_of = Window.partitionBy("source")
    sizes = sizes.withColumn("_open", F.col("_extra") - F.coalesce(F.sum("_taken").over(all_of), F.lit(0)))
    picked = F.lit(False)
    below = F.lit(1 << 62)
    for k in range(FILLS):
        fits = F.col("_first").isNotNull() & (F.col("size") <= F.col("_open")) & (F.col("size") < below)
        sizes = sizes.withColumn(f"_fill{k}", F.max(F.when(fits, F.col("size"))).over(all_of))
        below = F.coalesce(F.col(f"_fill{k}"), F.lit(0))
        picked = picked | (F.col("_first").isNotNull() & F.col("size").eqNullSafe(F.col(f"_fill{k}")))
        sizes = sizes.withColumn("_open", F.col("_open") - below)
    picks = sizes.where(picked).select(F.col("_first._n").alias("_n"), F.lit(True).alias("_fills"))
    return rows.join(picks, "_n", "left").withColumn("_more", F.col("_more") | F.coalesce("_fills", F.lit(False))).drop("_fills")


def position(share: Column, rising: Column) -> Column:
    """Training time at which a source has met the share of its demand: D(t) = share * D(1) solved for t."""
    s = F.when(rising, START).otherwise(END)
    e = F.when(rising, END).otherwise(START)
    total = (s + e) / 2
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.sqrt(s * s + 2 * (e - s) * share * total) - s) / (e - s)))


def positions(planned: DataFrame) -> DataFrame:
    """Add _at: the training times of the document's copies, in order (none: not taken).

    A source's copies follow each other round by round: all documents once, then those taken again.
    """
    n = F.col("source_size").cast("double")
    rising = F.col("weight") != 1.0
    due = lambda k: position((n * k + F.col("_before") + F.col("size")) / F.greatest(F.lit(1.0), F.col("target")), rising)
    return planned.withColumn("_at", F.filter(F.transform(F.array(*(F.struct(F.lit(k).alias("k"), due(k).alias("t")) for k in range(CAP + 1))), lambda x: F.when(x["k"] < F.col("_copies"), x["t"])), lambda t: t.isNotNull()))


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mixed corpus: a row for each copy taken, range-sorted by training position, with the columns of ``docs``."""
    row = F.xxhash64(F.lit(1), *(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    planned = positions(plan(docs.select("doc_id", "source", n_words(text).alias("size"), row)))
    # rows equal in every column share _row: each takes its own entry of the list
    planned = planned.groupBy("_row").agg(F.collect_list("_at").alias("_ats"), F.first("_md5").alias("_md5"))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), row)
    held = held.withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy("_row")) - 1)
    rows = held.join(planned.hint("merge"), "_row").select("_doc", "_md5", F.explode(F.get("_ats", F.col("_nth"))).alias("_t"))
    rows = rows.orderBy("_t", "_md5", "_doc.doc_id")
    return rows.select(*(F.col("_doc")[c].alias(c) for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes, and its first training position."""
    docs = table(spark, sf_dir, "documents")
    got = positions(plan(docs.select("doc_id", "source", n_words().alias("size"))))
    got = got.withColumn("taken", F.col("size") * F.col("_copies")).withColumn("position", F.get("_at", F.lit(0)))
    got = got.orderBy("position", "_md5", "doc_id")
    return got.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"))


OP10_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(cast(doc_id as varchar), '')) as h
  from documents),
r as (select *, (('0x' || substr(h, 1, 6))::bigint % 4096) as rg from d),
s as (select source, sum(size)::double as n from d group by source),
w as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3) + 1]::double as weight, 2 * n as cap from s),
l as (select *, (1.5 * sum(n) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as lvl from w),
t as (select source, n, weight, coalesce(least(cap, weight * (select arg_min(lvl, cap / weight) from l where lvl * weight <= cap)), cap) as target from l),
p as (select source, n, weight, target, case when n > 0 then floor(target / n) else 0 end as whole from t),
c as (
  select r.source as s, r.h, r.doc_id, r.size, p.n, p.weight, p.target, p.whole, p.target - p.whole * p.n as extra,
         coalesce(sum(r.size) over (partition by r.source order by r.rg, r.h, r.doc_id, r.size rows between unbounded preceding and 1 preceding), 0) as bef
  from r join p on r.source is not distinct from p.source),
m as (select *, size > 0 and bef + size <= extra as more from c),
z as (select s, size, extra, sum(size) filter (where more) as taken, min((h, doc_id)) filter (where size > 0 and not more) as first from m group by s, size, extra),
z0 as (select *, extra - coalesce(sum(taken) over (partition by s), 0) as o0 from z),
z1 as (select *, coalesce(max(size) filter (where first is not null and size <= o0) over (partition by s), 0) as f1 from z0),
z2 as (select *, coalesce(max(size) filter (where first is not null and size <= o0 - f1 and size < f1) over (partition by s), 0) as f2 from z1),
z3 as (select *, coalesce(max(size) filter (where first is not null and size <= o0 - f1 - f2 and size < f2) over (partition by s), 0) as f3 from z2),
x as (select s, size, first from z3 where first is not null and size in (f1, f2, f3)),
k as (select m.*, (whole + case when more or x.first is not null then 1 else 0 end)::bigint as copies,
             case when weight <> 1 then 0.5 else 1.5 end as ws, case when weight <> 1 then 1.5 else 0.5 end as we
      from m left join x on m.s is not distinct from x.s and m.size = x.size and (m.h, m.doc_id) = x.first)
select doc_id, size, n::bigint as source_size, round(target, 6) as target, size * copies as taken,
       case when copies > 0 then round(least(1.0, greatest(0.0, (sqrt(ws * ws + 2 * (we - ws) * ((bef + size) / greatest(1.0, target)) * ((ws + we) / 2)) - ws) / (we - ws))), 9) end as position
from k
"""
