"""Queries over catalogs: update merges, funnels, pending work, keys, shards, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog
from .base import query, table


@query("""with r as (select doc_id, 'l' || quality as lang, case when toxic = 1 then 'flagged' end as source, 1 as extra from labels)
select d.doc_id, coalesce(r.lang, d.lang) as lang, coalesce(r.source, d.source) as source, d.n_chars from documents d left join r on d.doc_id = r.doc_id""")
def update_merge(spark, sf):
    left = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    right = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("l"), F.col("quality").cast("string")).alias("lang"), F.when(F.col("toxic") == 1, "flagged").alias("source"), F.lit(1).alias("extra"))
    return catalog.update_merge(left, right, "doc_id")


@query("select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id")
def left_results(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query(r"""with p as (select page_id, lower(regexp_replace(regexp_replace(trim(url), '^.*://', ''), '[?#].*$', '')) as k from pages), m as (select k, min(page_id) as first, count(*) as copies from p group by k)
select p.page_id, m.first, m.copies from p join m on p.k = m.k""")
def inner_paths(spark, sf):
    """All paths with the catalog entry of their normalised id (address without scheme, query and fragment, in lower case)."""
    k = F.lower(F.regexp_replace(F.regexp_replace(F.trim("url"), "^.*://", ""), "[?#].*$", ""))
    p = table(spark, sf, "pages").select("page_id", k.alias("k"))
    m = p.groupBy("k").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    return p.join(m, "k").select("page_id", "first", "copies")


@query("""with m as (select distinct url, regexp_replace(trim(url), '^.*/', '') as k from pages)
select p.page_id, m.url from (select page_id, trim(regexp_replace(url, '^.*/', '')) as k from pages) p join m on p.k = m.k""")
def inner_paths_whole(spark, sf):
    """All paths with the catalog entries of the same id: what follows the last slash."""
    p = table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace("url", "^.*/", "")).alias("k"))
    m = table(spark, sf, "pages").select("url", F.regexp_replace(F.trim("url"), "^.*/", "").alias("k")).distinct()
    return p.join(m, "k").select("page_id", "url")


@query("""select 0 as step, 'all' as name, count(*) as rows from documents union all select 1, 'english', count(*) filter (where lang = 'en') from documents
union all select 2, 'long', count(*) filter (where lang = 'en' and n_chars >= 500) from documents union all select 3, 'not_huge', count(*) filter (where lang = 'en' and n_chars >= 500 and n_chars <= 20000) from documents""")
def funnel(spark, sf):
    return catalog.funnel(table(spark, sf, "documents"), [("english", F.col("lang") == "en"), ("long", F.col("n_chars") >= 500), ("not_huge", F.col("n_chars") <= 20000)])


@query("select d.doc_id from documents d left join labels l on d.doc_id = l.doc_id where l.quality is null")
def pending(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("quality is not null").select("doc_id"), "doc_id", "left_anti")


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels where toxic = 1)")
def semi_list(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("select source, count(*) as kept from documents where doc_id not in (select doc_id from labels where quality = 0) group by source")
def anti_block(spark, sf):
    bad = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf, "documents").join(bad, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("kept"))


@query("select source, count(*) as quarantined from documents where doc_id in (select doc_id from labels where quality = 0) group by source")
def quarantine(spark, sf):
    bad = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf, "documents").join(bad, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("quarantined"))


@query("select 'existing' as state, count(*) as n from documents where doc_id in (select doc_id from labels) union all select 'todo', count(*) from documents where doc_id not in (select doc_id from labels)")
def split_existing(spark, sf):
    """One left join serves both sides."""
    present = table(spark, sf, "labels").select("doc_id").distinct().withColumn("there", F.lit(True))
    got = table(spark, sf, "documents").select("doc_id").join(present, "doc_id", "left")
    return got.groupBy(F.when(F.col("there"), "existing").otherwise("todo").alias("state")).agg(F.count("*").alias("n"))


@query("select text_md5, doc_id from (select md5(text) as text_md5, doc_id, row_number() over (partition by text order by doc_id) as r from documents) where r = 1")
def dedup_first(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    return d.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"))


@query(r"""with u as (select page_id, url as p from pages union all select page_id, '/' || replace(substr(url, 8), '/', '//') from pages)
select page_id, p, case when trim(p) like 'http://%' or trim(p) like 'https://%' then regexp_replace(trim(p), '^.*/', '') else regexp_replace(regexp_replace(trim(p), '/{2,}', '/', 'g'), '^/+', '') end as k from u""")
def canonical_key(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("p"))
    both = p.unionByName(p.select("page_id", F.concat(F.lit("/"), F.replace(F.expr("substr(p, 8)"), F.lit("/"), F.lit("//"))).alias("p")))
    return both.select("page_id", "p", T.canonical_key(F.col("p")).alias("k"))


@query(r"select k, arg_min(page_id, page_id) as page_id, count(*) as n from (select page_id, regexp_replace(regexp_extract(url, '://([^/]*)', 1), '^www\.', '') as k from pages) group by k")
def canonical_lookup(spark, sf):
    k = F.regexp_replace(F.regexp_extract("url", r"://([^/]*)", 1), r"^www\.", "")
    return table(spark, sf, "pages").groupBy(k.alias("k")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("select d.doc_id, coalesce(l.toxic = 1, false) as toxic, coalesce(l.quality, -1)::int as quality from documents d left join labels l on d.doc_id = l.doc_id")
def flags_default(spark, sf):
    got = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"), "quality"), "doc_id", "left")
    return got.na.fill(False, ["toxic"]).na.fill(-1, ["quality"])


@query("select doc_id as id, lang as kind, null::varchar as url from documents union all select page_id, null, url from pages")
def union_ragged(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"))
    return catalog.union_ragged(a, table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url"))


@query("select doc_id from documents except select doc_id from labels")
def except_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


CHANGED = "c as (select doc_id, case when doc_id % 7 = 0 then 'xx' else lang end as lang from documents where doc_id % 50 <> 3)"


@query(f"with {CHANGED} select side, count(*) as n from (select 'left' as side, * from (select doc_id, lang from documents except all select * from c) union all select 'right', * from (select * from c except all select doc_id, lang from documents)) group by 1")
def set_equality(spark, sf):
    """Rows that only one of two tables has, here of the documents and a changed copy."""
    a = table(spark, sf, "documents").select("doc_id", "lang")
    b = a.where("doc_id % 50 <> 3").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return catalog.differing(a, b).groupBy("side").agg(F.count("*").alias("n"))


@query("with n as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as row, count(*) over () as total from orders) select o_orderkey, row, (row // ceil(total / 7.0)::bigint)::int as shard, floor(((row + 1) * 7 - 1) / total)::int as even_shard from n")
def shard_slice(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    total = o.agg(F.count("*").alias("total"))
    n = catalog.numbered(o, F.floor(F.col("o_orderkey") / 4096), "o_orderkey").join(F.broadcast(total))
    return n.select("o_orderkey", "row", catalog.shard_of(F.col("row"), F.col("total"), 7).alias("shard"), catalog.balanced_shard_of(F.col("row"), F.col("total"), 7).alias("even_shard"))


@query("""select 'r1' as resolution, round(avg(l_quantity), 6) as points from lineitem where l_quantity is not null union all select 'r2', round(avg(l_extendedprice), 6) from lineitem union all select 'r3', round(avg(l_discount), 6) from lineitem""")
def unpivot_avg(spark, sf):
    """Averages in one pass, then unpivoted: the fact rows aren't multiplied."""
    means = table(spark, sf, "lineitem").agg(F.avg("l_quantity").alias("r1"), F.avg("l_extendedprice").alias("r2"), F.avg("l_discount").alias("r3"))
    return means.unpivot([], ["r1", "r2", "r3"], "resolution", "points").withColumn("points", F.round("points", 6))


@query("select doc_id from documents order by md5(doc_id::varchar), doc_id limit 50")
def sample_k(spark, sf):
    return catalog.sample_rows(table(spark, sf, "documents").select("doc_id"), 50, "doc_id")


@query("select doc_id, source from (select doc_id, source, row_number() over (partition by source order by md5(doc_id::varchar), doc_id) as r from documents) where r <= 3")
def sample_within(spark, sf):
    return catalog.sample_within(table(spark, sf, "documents").select("doc_id", "source"), ["source"], 3, "doc_id")


@query("select lang, count(*) as n from documents group by lang")
def value_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("select doc_id, source from documents where n_chars >= 200 order by doc_id limit 25")
def first_n(spark, sf):
    return table(spark, sf, "documents").where("n_chars >= 200").orderBy("doc_id").limit(25).select("doc_id", "source")


@query("select count(*) as total, count(l.quality) as labelled, coalesce(sum(l.toxic), 0)::bigint as toxic, count(*) filter (where d.n_chars > 1000) as long from documents d left join labels l on d.doc_id = l.doc_id")
def dataset_stats(spark, sf):
    got = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    return got.agg(F.count("*").alias("total"), F.count("quality").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count_if(F.col("n_chars") > 1000).alias("long"))


@query("select doc_id, issue from (select doc_id, unnest([case when n_chars < 50 then 'short' end, case when length(text) <> n_chars then 'length' end, case when lang is null then 'lang' end, case when n_chars > 10000 then 'huge' end]) as issue from documents) where issue is not null")
def validity_issues(spark, sf):
    tests = [(F.col("n_chars") < 50, "short"), (F.length("text") != F.col("n_chars"), "length"), (F.col("lang").isNull(), "lang"), (F.col("n_chars") > 10000, "huge")]
    found = F.filter(F.array(*(F.when(t, F.lit(n)) for t, n in tests)), lambda x: x.isNotNull())
    return table(spark, sf, "documents").select("doc_id", F.explode(found).alias("issue"))


@query("select source, list_aggregate(list(doc_id order by md5(doc_id::varchar), doc_id)[1:5], 'min') as low, count(*) as n from documents group by source")
def reservoir(spark, sf):
    """Five rows of each source by hash order, as a bounded sample that any partitioning reproduces."""
    d = table(spark, sf, "documents").select("source", "doc_id")
    five = catalog.sample_within(d, ["source"], 5, "doc_id").groupBy("source").agg(F.min("doc_id").alias("low"))
    return five.join(d.groupBy("source").agg(F.count("*").alias("n")), "source")


@query("select source, status, count(*) as n, round(avg(points), 6) as points from (select source, case when n_chars >= 100 then 'ok' else 'too_sparse' end as status, case when n_chars >= 100 then n_chars end as points from documents) group by 1, 2")
def task_log(spark, sf):
    ok = F.col("n_chars") >= 100
    return table(spark, sf, "documents").groupBy("source", F.when(ok, "ok").otherwise("too_sparse").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(ok, F.col("n_chars"))), 6).alias("points"))


@query("select source, arg_max(doc_id, n_chars * 1000000 + doc_id) as latest from documents group by source")
def latest_by_number(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("latest"))


@query("with s as (select doc_id, md5('7|' || doc_id) as h from documents), n as (select doc_id, row_number() over (order by h, doc_id) - 1 as i from s) select doc_id, i as place, (i % 4)::int as rank from n")
def resumable_shuffle(spark, sf):
    """A shuffled order dealt in strides; the first hex digits of the hash bucket the ranking."""
    s = table(spark, sf, "documents").select("doc_id", F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))).alias("h"))
    n = catalog.numbered(s, F.substring("h", 1, 3), "h", "doc_id", name="place")
    return n.select("doc_id", "place", (F.col("place") % 4).cast("int").alias("rank"))


@query("select user_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_per_key(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("b")).select("user_id", "b.event_type", "b.ts")


