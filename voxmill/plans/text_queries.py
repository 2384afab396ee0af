"""Queries over text formats: mesh text, chat rows, captions, JSON, hashing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import space
from ..functions import text as T
from .base import MORTON, V, query, table, voxels


@query(f"with {V} select sid, x, md5('<mesh_start>' || string_agg('<morton_' || {MORTON} || '><mesh_' || tok || '>', '' order by {MORTON}) || '<mesh_end>') as mesh, count(*) as n from v group by sid, x")
def mesh_serialise(spark, sf):
    g = voxels(spark, sf).groupBy("sid", "x").agg(F.sort_array(F.collect_list(F.struct(space.morton().alias("morton"), F.col("tok").alias("id")))).alias("pairs"))
    return g.select("sid", "x", F.md5(T.mesh_text(F.col("pairs"))).alias("mesh"), F.size("pairs").cast("long").alias("n"))


@query(f"with {V} select sid, x, count(*) filter (where tok < 12) as pairs, (count(*) filter (where tok >= 12) + 2)::int as dropped, sum({MORTON}) filter (where tok < 12)::bigint as codes from v group by sid, x")
def mesh_parse(spark, sf):
    g = voxels(spark, sf).groupBy("sid", "x").agg(F.sort_array(F.collect_list(F.struct(space.morton().alias("morton"), F.col("tok").alias("id")))).alias("pairs"))
    text = F.concat(F.lit("<morton_5> "), T.mesh_text(F.col("pairs")), F.lit(" x <mesh_3>"))
    got = g.select("sid", "x", T.mesh_pairs(text, 12).alias("p"))
    total = F.aggregate("p.pairs", F.lit(0).cast("long"), lambda s, q: s + q["morton"])
    return got.select("sid", "x", F.size("p.pairs").cast("long").alias("pairs"), F.col("p.dropped").alias("dropped"), F.when(F.size("p.pairs") > 0, total).alias("codes"))


@query(r"select conv_id, turn, regexp_replace(text, '([A-Z][a-z]+)', '<block>\1</block>', 'g') as text from conversations")
def block_mark(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"([A-Z][a-z]+)", "<block>$1</block>").alias("text"))


@query(r"""with b as (select conv_id, turn, text, unnest(regexp_extract_all(text, '[A-Za-z]{4}')) as w from conversations),
u as (select w, row_number() over (order by w) as id from (select distinct w from b)) select conv_id, turn, count(*) as blocks, count(distinct b.w) as kinds, min(b.w) as first from b join u on b.w = u.w group by 1, 2""")
def block_replace(spark, sf):
    """Unique blocks are encoded once and joined back to where they occur."""
    b = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{4}"), F.lit(0))).alias("w"))
    coded = b.select("w").distinct().withColumn("code", F.sha1("w"))
    return b.join(coded, "w").groupBy("conv_id", "turn").agg(F.count("*").alias("blocks"), F.countDistinct("code").alias("kinds"), F.min("w").alias("first"))


@query("""with d as (select doc_id, 'mesh ' || doc_id as mesh, lang as caption from documents), r as (
select doc_id, 0 as row, 2 as turns, mesh || chr(10) || 'Describe it.' as first, caption as last from d union all select doc_id, 1, 2, caption || chr(10) || 'Build it.', mesh from d) select * from r""")
def chat_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("mesh "), F.col("doc_id").cast("string")).alias("mesh"), F.col("lang").alias("caption"))
    r = d.select("doc_id", F.posexplode(T.chat_rows(F.col("mesh"), F.col("caption"), "Describe it.", "Build it.")).alias("row", "m"))
    return r.select("doc_id", "row", F.size("m").alias("turns"), F.col("m")[0]["content"].alias("first"), F.element_at("m", -1)["content"].alias("last"))


@query("select conv_id, count(*) as turns, string_agg(role, '>' order by turn) as roles, sum(length(text))::bigint as chars from conversations group by conv_id")
def chat_fold(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("m"), F.sum(F.length("text")).alias("chars"))
    return g.select("conv_id", "turns", F.array_join(F.transform("m", lambda t: t["role"]), ">").alias("roles"), "chars")


@query("""with d as (select doc_id, lang, case doc_id % 5 when 0 then '["' || lang || '", " ", "x ' || source || ' "]' when 1 then '"' || lang || '"' when 2 then 'not json ' || lang when 3 then '   ' else null end as raw from documents)
select doc_id, case doc_id % 5 when 0 then lang when 1 then lang when 2 then 'not json ' || lang else 'A 3D object.' end as first, (case doc_id % 5 when 0 then 2 else 1 end)::int as n from d""")
def captions_parse(spark, sf):
    k = F.col("doc_id") % 5
    listed = F.concat(F.lit('["'), "lang", F.lit('", " ", "x '), "source", F.lit(' "]'))
    raw = F.when(k == 0, listed).when(k == 1, F.concat(F.lit('"'), "lang", F.lit('"'))).when(k == 2, F.concat(F.lit("not json "), "lang")).when(k == 3, F.lit("   "))
    c = table(spark, sf, "documents").select("doc_id", T.captions(raw).alias("c"))
    return c.select("doc_id", F.col("c")[0].alias("first"), F.size("c").alias("n"))


@query("select doc_id, (('0x' || substr(sha1(doc_id::varchar), 1, 16))::ubigint % 10000)::bigint as bucket, ('0x' || substr(sha1(doc_id::varchar), 1, 16))::ubigint % 10000 < 1000 as validation from documents")
def hash_bucket(spark, sf):
    b = T.stable_bucket(F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", b.alias("bucket"), (b < 1000).alias("validation"))


@query("select event_type, count(*) as n, count(json_extract_string(props, '$.k')) as with_k, count(distinct json_extract_string(props, '$.k')) as kinds from events group by event_type")
def json_props(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.countDistinct(k).alias("kinds"))


@query("select length(t) as chars, md5(t) as digest from (select '<mesh_start>,<mesh_end>,<mesh_empty>,' || string_agg('<morton_' || i || '>', ',' order by i) || ',' || (select string_agg('<mesh_' || j || '>', ',' order by j) from range(512) q(j)) as t from range(32768) r(i))")
def vocab_list(spark, sf):
    return spark.range(1).select(T.vocabulary(512).alias("t")).select(F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


@query("select page_id, regexp_replace(url, '^.*/', '') as base, sha256(url) as digest from pages")
def file_identity(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.base_name(F.col("url")).alias("base"), F.sha2("url", 256).alias("digest"))


@query(r"with d as (select source, len(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda t: t <> '')) as n from documents) select source, count(*) as docs, sum(n)::bigint as total, max(n) as longest, min(n) as shortest, count(*) filter (where n > 500) as over, sum(greatest(n - 500, 0))::bigint as excess from d group by 1")
def sequence_lengths(spark, sf):
    n = F.size(F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda t: t != "")).cast("long")
    d = table(spark, sf, "documents").select("source", n.alias("n"))
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("total"), F.max("n").alias("longest"), F.min("n").alias("shortest"), F.count_if(F.col("n") > 500).alias("over"), F.sum(F.greatest(F.col("n") - 500, F.lit(0))).alias("excess"))


@query(r"""with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda t: t <> '')[1:16] as l from documents)
select doc_id, len(l) as n, array_to_string(list_concat(l, list_transform(range(16 - len(l)), lambda i: '<pad>')), ' ') as padded from d""")
def pad_truncate(spark, sf):
    l = F.slice(F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda t: t != ""), 1, 16)  # noqa: E741
    d = table(spark, sf, "documents").select("doc_id", l.alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n"), F.array_join(F.concat("l", F.array_repeat(F.lit("<pad>"), 16 - F.size("l"))), " ").alias("padded"))
