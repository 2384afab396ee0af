"""Queries that write to the shared folder and read back: CSV catalogs, JSON lines, documents, archives, corpus shards; and rows made from several columns or candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bpe3d, catalog
from ..sources import readers, writers
from .base import V, query, table, voxels


@query("select root, count(*) as n, count(lang) as with_lang, count(toxic) as with_toxic from (select 'a' as root, lang, null as toxic from documents where doc_id % 2 = 0 union all select 'b', null, toxic from labels) group by 1")
def catalog_roots(spark, sf):
    """CSV catalogs of two roots with differing columns, read as one."""
    a, b = writers.shared_folder(spark, "root-a"), writers.shared_folder(spark, "root-b")
    writers.write_csv(table(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id", "lang"), f"{a}/metadata.csv")
    writers.write_csv(table(spark, sf, "labels").select("doc_id", "toxic"), f"{b}/metadata.csv")
    got = catalog.require(readers.read_catalog(spark, f"{a}, {b}"), "doc_id", "lang", "toxic")
    return got.groupBy(F.when(F.col("root") == a, "a").otherwise("b").alias("root")).agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.count("toxic").alias("with_toxic"))


@query("select o_custkey % 50 as k, count(*) as n, md5(string_agg(o_orderkey::varchar, ',' order by o_orderkey)) as digest from orders group by 1")
def csv_lists(spark, sf):
    """Lists kept in CSV as JSON text."""
    path = writers.shared_folder(spark, "csv")
    writers.write_csv(table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("k")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys")), path)
    keys = F.from_json("keys", "array<bigint>")
    back = spark.read.option("header", True).schema("k bigint, keys string").csv(path)
    return back.select("k", F.size(keys).cast("long").alias("n"), F.md5(F.array_join(F.transform(keys, lambda i: i.cast("string")), ",")).alias("digest"))


@query("select conv_id, turn, md5(text) as digest from conversations where role = 'user'")
def jsonl_round_trip(spark, sf):
    """JSON lines written in order and read again; what is no record is left out."""
    path = writers.shared_folder(spark, "jsonl")
    writers.write_jsonl(table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text"), path, "conv_id", "turn")
    spark.createDataFrame([("",), ("no json",)], "value string").write.mode("append").text(path)
    types = dict(table(spark, sf, "conversations").dtypes)
    back = readers.read_jsonl(spark, path, f"conv_id {types['conv_id']}, turn {types['turn']}, text string")
    return back.select("conv_id", "turn", F.md5("text").alias("digest"))


@query(f"with {V} select sid, count(*) as n, sum(tok)::bigint as s from v group by 1")
def corpus_shards(spark, sf):
    """A corpus written as keyed shards and read again."""
    path = writers.shared_folder(spark, "corpus")
    writers.write_corpus(voxels(spark, sf), path, 4)
    return spark.read.parquet(path).groupBy("sid").agg(F.count("*").alias("n"), F.sum("tok").alias("s"))


@query("select i as n from range(5) t(i)")
def shards_before_gap(spark, sf):
    """Shards up to the first that lacks its corpus or its metadata file."""
    listing = spark.createDataFrame([(f"{kind}_{i}.npz",) for kind in ("corpus", "meta") for i in (0, 1, 2, 3, 4, 6, 7)] + [("corpus_5.npz",)], "path string")
    number = F.regexp_extract("path", r"_(\d+)\.npz$", 1).cast("long").alias("shard")
    both = listing.groupBy(number).agg(F.countDistinct(F.split("path", "_")[0]).alias("kinds")).where("kinds = 2")
    return writers.shards_before_gap(both)


@query("select source as key, 'at/' || min(doc_id) as path from documents where source is not null group by 1")
def key_path_map(spark, sf):
    """A JSON document that maps keys to paths (one for each source)."""
    path = writers.shared_folder(spark, "map")
    rows = table(spark, sf, "documents").where("source is not null").groupBy("source").agg(F.min("doc_id").alias("d")).collect()
    writers.write_document(spark, {r["source"]: f"at/{r['d']}" for r in rows}, path)
    return readers.path_map(spark, path)


@query("select o_orderkey, 'img/' || o_orderkey || '_0.nii.gz' as path, case when o_orderkey % 3 = 0 then 'lab/' || o_orderkey || '_seg.nii' end as label_path, o_orderkey::varchar as case_id from orders")
def image_label_pairs(spark, sf):
    """Images beside their labels by case id; images without a label stay."""
    o = table(spark, sf, "orders")
    name = lambda folder, tail: F.concat(F.lit(folder), F.col("o_orderkey").cast("string"), F.lit(tail)).alias("path")
    images = o.select("o_orderkey", name("img/", "_0.nii.gz"))
    labels = o.where("o_orderkey % 3 = 0").select(name("lab/", "_seg.nii"))
    return readers.pair_by_case(images, labels).select("o_orderkey", "path", "label_path", "case_id")


@query("select doc_id, coalesce(n_chars > 500, lang = 'en') as computed, coalesce(lang, source) as name from documents")
def dual_names(spark, sf):
    """One column under a new and an old name, whichever exists and isn't null."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 500).alias("sdf_computed"), (F.col("lang") == "en").alias("sparse_sdf"), "lang", "source")
    return d.select("doc_id", catalog.resolve(d, "sdf_computed", "gone", "sparse_sdf").alias("computed"), catalog.resolve(d, "lang", "source").alias("name"))


@query("""select o_custkey, arg_min(path, r) as path, min(r) as r from (select o_custkey, o_orderkey || '.ply' as path, (case when o_orderkey % 5 = 0 then 1 when o_orderkey % 3 = 0 then 2 end) * 1000000000 + o_orderkey as r from orders) where r is not null group by 1""")
def first_candidate(spark, sf):
    """The first candidate that exists, by rank of its kind and then its number."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_custkey", F.concat(k.cast("string"), F.lit(".ply")).alias("path"), (F.when(k % 5 == 0, 1).when(k % 3 == 0, 2) * 1000000000 + k).alias("r")).where("r is not null")
    return catalog.first_of(o, ["o_custkey"], ["r"], ["path", "r"]).select("o_custkey", "b.path", "b.r")


@query("select rank::int as rank, (16 + rank)::bigint as new_id, a::bigint as a, b::bigint as b, dx::int as dx, dy::int as dy, dz::int as dz from (values (0, 1, 2, 1, 0, 0), (1, 16, 3, 0, -1, 0)) t(rank, a, b, dx, dy, dz)")
def rules_round_trip(spark, sf):
    """A rule table saved as one JSON document and loaded again."""
    path = writers.shared_folder(spark, "rules")
    rules = [bpe3d.Rule(0, 16, 1, 2, (1, 0, 0)), bpe3d.Rule(1, 17, 16, 3, (0, -1, 0))]
    writers.write_document(spark, bpe3d.rules_to_json(rules, 16), path)
    return bpe3d.rules_frame(spark, bpe3d.rules_from_json(writers.read_document(spark, path))).drop("leaf")


@query("select doc_id, case when doc_id % 10 = 3 then null else n_chars * 2 end as twice, case when doc_id % 10 = 3 then 'ValueError: bad row' end as error from documents where doc_id % 10 <> 7")
def instances(spark, sf):
    """A function for each row in Arrow batches: rows without a result are left out, errors become data."""

    def twice(row):
        if row["doc_id"] % 10 == 3:
            raise ValueError("bad row")
        return None if row["doc_id"] % 10 == 7 else {"doc_id": row["doc_id"], "twice": row["n_chars"] * 2}

    got = readers.foreach_instance(table(spark, sf, "documents").select("doc_id", "n_chars"), twice, "doc_id bigint, twice bigint")
    return got.select("doc_id", F.when(F.col("error").isNull(), F.col("twice")).alias("twice"), "error")


@query("with s as (select avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as d from lineitem) select l_orderkey, l_linenumber, round((greatest(2000, least(60000, l_extendedprice)) - m) / d, 6) as z from lineitem, s")
def clip_normalise(spark, sf):
    li = table(spark, sf, "lineitem")
    s = F.broadcast(li.agg(F.avg("l_extendedprice").alias("m"), F.stddev_pop("l_extendedprice").alias("d")))
    clipped = F.greatest(F.lit(2000.0), F.least(F.lit(60000.0), F.col("l_extendedprice")))
    return li.join(s).select("l_orderkey", "l_linenumber", F.round((clipped - F.col("m")) / F.col("d"), 6).alias("z"))


@query("select d.doc_id, case when has then '/data/' || d.doc_id end as local_path from documents d left join (select doc_id, true as has from labels) l on d.doc_id = l.doc_id")
def first_attach(spark, sf):
    """A catalog gets its path column the first time: rows without a file have null."""
    there = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("/data/"), F.col("doc_id").cast("string")).alias("local_path"))
    return table(spark, sf, "documents").select("doc_id").join(there, "doc_id", "left")
