"""Corpus pipeline: toxicity, line dedup, near-duplicate removal, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns a
DataFrame; ``run`` writes each as Parquet in the shared folder, hands the reread table on and drops the
table before. All stages but the last return the columns of ``docs``, extra ones included; ``n_chars``
follows the text. No stage takes rows of one id for one document: they are told apart by all their columns.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from voxmill.llm.common import Written, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject (score below 1/2).

    Null and empty texts have no features and stay unless most labelled documents are toxic; repeated rows share
    a score. Labels of null ids, or other than 0 and 1, are not read.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="_vm_score").where("_vm_score < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has (by doc_id, null last); a document of which nothing stays goes.

    Null and empty texts stay, as nothing was taken from them; rows equal in every column are treated alike.
    """
    out = line_dedup.dedup_passages(docs, removed="_vm_removed")
    out = out.where("_vm_removed = 0 or text rlike '[^ \\\\t\\\\n\\\\r]'")
    return out.withColumn("n_chars", F.when(F.col("_vm_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more): the least doc_id (null last), then the least row hash.

    All null and empty texts are one group; texts of fewer than five words are one shingle. Of rows equal in every
    column one stays.
    """
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each time a document is taken, in training order.

    Null and empty texts have no words: they are taken as often as their whole source is. Null sources are a source
    of their own, last in order. Repeated rows are taken each by itself.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row of the mix, as digests, with the digest of the text they decode to (null and empty texts: no ids)."""
    return bpe.encode_digests(docs.select("doc_id", "source", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Byte-pair encoding, the toxicity model and SimHash tries are beyond SQL: the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    kept = Written(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = kept.put(stage(spark, docs, sf_dir))
        if before is not None:
            kept.drop(before)
        before = docs
    return docs
