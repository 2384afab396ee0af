"""Queries over listings: nearest catalogs, paths from identifiers, marked folders, CT cases, registered catalogs, quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import discovery
from .base import query, table

#: Listings of the queries: a file for each order, in folders three to five deep.
FILES = """f as (select o_orderkey, 'root/c' || o_custkey % 7 || '/s' || o_custkey % 40 || '/k' || o_orderkey % 90 || '/' || case o_orderkey % 11 when 0 then 'image.npy' when 1 then 'dataset.json' when 2 then 'labels.nii' else 'f' || o_orderkey || '.npz' end as path from orders)"""


def files(spark, sf):
    text = lambda c: F.col(c).cast("string")
    k = F.col("o_orderkey") % 11
    name = F.when(k == 0, "image.npy").when(k == 1, "dataset.json").when(k == 2, "labels.nii").otherwise(F.concat(F.lit("f"), text("o_orderkey"), F.lit(".npz")))
    o = table(spark, sf, "orders").withColumns({"a": F.col("o_custkey") % 7, "b": F.col("o_custkey") % 40, "c": F.col("o_orderkey") % 90})
    return o.select("o_orderkey", F.concat(F.lit("root/c"), text("a"), F.lit("/s"), text("b"), F.lit("/k"), text("c"), F.lit("/"), name).alias("path"))


@query(f"""with {FILES}, c(catalog, folder, up) as (values ('root/metadata.csv', 'root', 3), ('root/c1/metadata.csv', 'root/c1', 2), ('root/c1/s1/metadata.csv', 'root/c1/s1', 1), ('other/metadata.csv', 'other', 9)),
m as (select o_orderkey, path, catalog, c.up, row_number() over (partition by o_orderkey order by c.up) as r from f left join c on path like c.folder || '/%')
select o_orderkey, path, up::int as levels_up, catalog from m where r = 1""")
def nearest_catalog(spark, sf):
    """The nearest metadata file up to twelve folders above each file."""
    catalogs = spark.createDataFrame([("root/metadata.csv",), ("root/c1/metadata.csv",), ("root/c1/s1/metadata.csv",), ("other/metadata.csv",)], "path string")
    return discovery.nearest_catalog(files(spark, sf), catalogs).select("o_orderkey", "path", "levels_up", "catalog")


@query("select source, count(*) as n, count(*) filter (where doc_id in (select doc_id from labels)) as found from documents group by 1")
def identifier_paths(spark, sf):
    """Paths made from identifiers (the prefix objects/ goes), and how many are there, by source."""
    name = lambda: F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".glb"))
    rows = table(spark, sf, "documents").select("source", F.concat(F.when(F.col("doc_id") % 2 == 0, "objects/").otherwise(""), name()).alias("id"))
    got = discovery.paths_of(rows, "id", table(spark, sf, "labels").select(name().alias("path")))
    return got.groupBy("source").agg(F.count("*").alias("n"), F.count_if("exists").alias("found"))


@query(f"with {FILES}, g as (select regexp_replace(path, '/[^/]*$', '') as folder, count(*) as files, bool_or(path like '%/image.npy') as hit from f group by 1) select folder, files from g where hit")
def case_folders(spark, sf):
    return discovery.folders_with(files(spark, sf), "image.npy")


@query(f"""with {FILES}, x as (select path from f union all select * from (values ('root/c2/dataset.json'), ('root/c3/s3/labels.nii'), ('a/b/c/d/e/f/dataset.json'), ('root/c2/s2/image.npy')) t(path)),
m as (select regexp_replace(path, '/[^/]*$', '') as folder, min(case when path like '%/dataset.json' then '0nnunet' when path like '%/image.npy' then '1m3d' when path like '%/labels.nii' then '2nifti' end) as k from x group by 1),
d as (select folder, k from m where k is not null and len(string_split(folder, '/')) <= 5)
select folder, substr(k, 2) as kind from d where not exists (select 1 from d u where d.folder like u.folder || '/%')""")
def find_datasets(spark, sf):
    """Data sets by their marker files, at most five folders deep; below one, none is looked for."""
    more = spark.createDataFrame([("root/c2/dataset.json",), ("root/c3/s3/labels.nii",), ("a/b/c/d/e/f/dataset.json",), ("root/c2/s2/image.npy",)], "path string")
    listing = files(spark, sf).select("path").unionByName(more)
    return discovery.datasets(listing, {"dataset.json": "nnunet", "image.npy": "m3d", "labels.nii": "nifti"})


CASES = "i as (select l_orderkey as case_id, l_linenumber % 3 as label, case l_returnflag when 'A' then 'mask' when 'R' then 'other' else 'window' end as mode, l_orderkey || '/' || l_linenumber as path from lineitem)"


@query(f"""with {CASES}, b as (select *, min(case mode when 'mask' then 1 else 2 end) over (partition by case_id) as best from i where mode <> 'other'),
r as (select *, row_number() over (partition by case_id, label order by path) as n from b where (case mode when 'mask' then 1 else 2 end) = best) select case_id, label, mode, path from r where n = 1""")
def case_instances(spark, sf):
    """One instance for each label of a CT case; window files count only in cases without masks."""
    flag = F.col("l_returnflag")
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") % 3).alias("label"), F.when(flag == "A", "mask").when(flag == "R", "other").otherwise("window").alias("mode"), F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("path"))
    return discovery.preferred_instances(i)


@query("select p_partkey, case when p_partkey % 9 = 0 then null else array_to_string([1, p_size, p_partkey % 500, 7], 'x') end as shape from part")
def shape_from_name(spark, sf):
    """Shapes read from file names; a name without one gives null."""
    text = lambda c: c.cast("string")
    name = F.when(F.col("p_partkey") % 9 == 0, F.lit("mask.npz")).otherwise(F.concat(F.lit("x(a)/mask_(1, "), text(F.col("p_size")), F.lit(","), text(F.col("p_partkey") % 500), F.lit(" , 7).npz")))
    shape = discovery.shape_of_name(name)
    return table(spark, sf, "part").select("p_partkey", F.when(shape.isNotNull(), F.array_join(F.transform(shape, text), "x")).alias("shape"))


@query("select 'docs' as dataset, count(*) as n, count(lang) as with_lang, count(url) as with_url from (select lang, null as url from documents) union all select 'web', count(*), 0, count(url) from pages")
def registered_catalogs(spark, sf):
    got = discovery.read_registered(spark, {"docs": f"{sf}/documents.parquet", "web": f"{sf}/pages.parquet", "unused": "nowhere.csv"}, "docs", "web")
    return got.groupBy("dataset").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.count("url").alias("with_url"))


@query("""with e as (select doc_id, list_filter([case when n_chars < 100 then 'short' end, case when lang is null then 'lang' end], lambda x: x is not null) as errors from documents)
select case when len(errors) = 0 then 'good' else 'bad' end as state, array_to_string(errors, ',') as errors, count(*) as n from e group by 1, 2""")
def quarantine_rows(spark, sf):
    """Rows that fail their tests are set aside with what they fail."""
    flow = discovery.Dataset(filters=[lambda d: d.select("doc_id", "n_chars", "lang")])
    good, bad = discovery.quarantined(flow.rows(table(spark, sf, "documents")), {"short": F.col("n_chars") >= 100, "lang": F.col("lang").isNotNull()})
    both = good.select(F.lit("good").alias("state"), F.lit("").alias("errors")).unionByName(bad.select(F.lit("bad").alias("state"), F.array_join("errors", ",").alias("errors")))
    return both.groupBy("state", "errors").agg(F.count("*").alias("n"))
