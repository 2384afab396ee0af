"""Importance resampling towards a target distribution, by inverted postings that are partitioned by bucket.

A document's features (runs of one and two words) fall into ``BUCKETS`` buckets by crc32. One pass over the texts
makes blocks of documents and, for each block and each of ``RANGES`` ranges of buckets, one row of postings:
(document in the block, bucket, count), by document, as three small arrays, written once. A count takes a byte; a
larger one is several postings. From these every task sums
its buckets, so that at most ``BUCKETS`` rows a task are shuffled; the same sums of the target texts are grouped with
them by bucket range, and each bucket's gain is computed there from the two counts. The postings are
shuffled by (range, salt) and meet the gains of their own range, also on each salt; a task streams over its rows and
emits each document's contribution of that range, and contributions are summed by document.

A bucket that every document has is so spread over ``SALTS`` groups and never gathered: rows are streamed, not
collected, and a row holds at most ``BLOCK`` documents or (for a block begun) about ``FULL`` features. Ranks come
from counts by score, a number that takes no more than about 10^5 values, and from an order within one score.

Null texts and texts without words have no features: weight 0. Null ids hash as an empty text and come last among
equal scores. Repeated rows are documents of their own. Without target texts each feature is as rare there as in any
empty corpus; an empty table gives no rows. Columns beyond the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, table

#: Buckets of features; ranges of them; groups of a range; documents and features of a block; words of a document that may be drawn, share drawn in percent, seed.
BUCKETS, RANGES, SALTS, BLOCK, FULL, WORDS, PERCENT, SEED = 10000, 16, 256, 512, 1 << 18, 20, 25, 7

#: In UTF-8 a code point beyond ASCII has bytes from 80 on only, so words can be taken from bytes.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MEMO = 1 << 16
#: Of each row of postings: how many each document of the block has, then the bucket within the range and the count of each.
_KINDS, MOST = {"docs": "<u4", "buckets": "<u2", "counts": "u1"}, 255
_POSTINGS = "block bigint, range int, docs binary, buckets binary, counts binary, ids array<{id}>, n_features array<bigint>, n_words array<bigint>"


def features(text: str | None, memo: dict[bytes, tuple[int, int]]) -> tuple[int, np.ndarray]:
    """(number of words, crc32 of each feature: the words, then the pairs of neighbours)."""
    words = _WORD.findall((text or "").encode().lower())
    if len(memo) > _MEMO:
        memo.clear()
    crc, known, codes, begun = zlib.crc32, memo.get, [], []
    for w in words:
        got = known(w)
        if got is None:
            c = crc(w)
            got = memo[w] = c, crc(b" ", c)
        codes.append(got[0])
        begun.append(got[1])
    codes += map(crc, words[1:], begun)
    return len(words), np.array(codes, np.int64)


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, ranges: int = RANGES) -> DataFrame:
    """Rows of postings by (block, range of buckets); range -1 has the block's documents: ids, features and words."""
    kind = docs.schema[doc_id].dataType.simpleString()
    width = -(-buckets // ranges)
    names = ["block", "range", "docs", "buckets", "counts", "ids", "n_features", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[int, int]] = {}
        block, ids, found, n_words, total, id_type = None, [], [], [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal block, ids, found, n_words, total
            n = len(ids)
            sizes = [len(x) for x in found]
            doc = np.repeat(np.arange(n, dtype=np.int64), sizes)
            bucket = np.concatenate(found) % buckets
            key, count = np.unique((bucket // width * n + doc) * width + bucket % width, return_counts=True)
            if count.max(initial=0) > MOST:
                times = -(-count // MOST)
                rest = count - (times - 1) * MOST
                last = np.cumsum(times) - 1
                key, count = np.repeat(key, times), np.full(times.sum(), MOST)
                count[last] = rest
            within, rest = key % width, key // width
            of, doc = rest // n, rest % n
            edges = np.searchsorted(of, np.arange(ranges + 1))
            spans = [(r, slice(edges[r], edges[r + 1])) for r in range(ranges) if edges[r] < edges[r + 1]]
            column = lambda made: pa.array([None, *made], pa.binary())
            lists = lambda x, kind: pa.array([x, *[None] * len(spans)], pa.list_(kind))
            out = [
                pa.array([block] * (len(spans) + 1), pa.int64()),
                pa.array([-1, *(r for r, _ in spans)], pa.int32()),
                column(np.bincount(doc[s], minlength=n).astype("<u4").tobytes() for _, s in spans),
                column(within[s].astype("<u2").tobytes() for _, s in spans),
                column(count[s].astype("u1").tobytes() for _, s in spans),
                lists(ids, id_type),
                lists(sizes, pa.int64()),
                lists(n_words, pa.int64()),
            ]
            block, ids, found, n_words, total = block + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays(out, names=names)

        for b in batches:
            id_type = b.column("id").type
            for i, part, t in zip(b.column("id").to_pylist(), b.column("part").to_pylist(), map(pa.StringScalar.as_py, b.column("text")), strict=True):
                block = part << 40 if block is None else block
                n, codes = features(t, memo)
                ids.append(i)
                found.append(codes)
                n_words.append(n)
                total += len(codes)
                if len(ids) == BLOCK or total >= FULL:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, _POSTINGS.format(id=kind))


def _arrays(b: pa.RecordBatch, *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
    for row in zip(*(b.column(c) for c in columns), strict=True):
        yield tuple(np.frombuffer(x.as_buffer(), _KINDS[c]) for c, x in zip(columns, row, strict=True))


def sums(rows: DataFrame, name: str, buckets: int = BUCKETS, ranges: int = RANGES) -> DataFrame:
    """(range, bucket, ``name``): features of each bucket that occurs; a task sums its own rows first."""
    width = -(-buckets // ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ranges, width), np.int64)
        for b in batches:
            for r, (within, count) in zip(b.column("range").to_pylist(), _arrays(b, "buckets", "counts"), strict=True):
                total[r] += np.bincount(within, count, width).astype(np.int64)
        r, within = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(within, pa.int32()), pa.array(total[r, within], pa.int64())], names=["range", "bucket", "n"])

    partial = rows.where("range >= 0").select("range", "buckets", "counts").mapInArrow(run, "range int, bucket int, n bigint")
    return partial.groupBy("range", "bucket").agg(F.sum("n").alias(name))


def gain(s: Column, t: Column, all_s: int, all_t: int, buckets: int = BUCKETS) -> Column:
    """Thousand times the log of the smoothed ratio of the two shares, floored."""
    return F.floor(F.log((t + 1).cast("double") * float(all_s + buckets) / ((s + 1).cast("double") * float(all_t + buckets))) * 1000)


def gains(source: DataFrame, target: DataFrame, ranges: int = RANGES, buckets: int = BUCKETS) -> DataFrame:
    """(range, gains): the gains of a range's buckets in order, from the sums of both corpora (two totals come to the driver)."""
    width = -(-buckets // ranges)
    both = source.withColumn("t", F.lit(0).cast("long")).unionByName(target.withColumn("s", F.lit(0).cast("long")))
    both = both.groupBy("range", "bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    at = F.map_from_entries(F.collect_list(F.struct("bucket", gain(F.col("s"), F.col("t"), total["s"], total["t"], buckets).alias("g"))))
    return both.groupBy("range").agg(at.alias("_at")).select("range", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("_at", i), F.lit(0))).alias("gains"))


def _contributions(rows: DataFrame) -> DataFrame:
    """(block, doc, part): what a range's buckets give to each document that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for block, g, (own, within, count) in zip(b.column("block").to_pylist(), b.column("gains"), _arrays(b, "docs", "buckets", "counts"), strict=True):
                worth = g.values.to_numpy()[within] * count
                doc = np.flatnonzero(own)
                begins = (np.cumsum(own, dtype=np.int64) - own)[doc]  # postings come by document
                out.append((np.full(len(doc), block, np.int64), doc.astype(np.int32), np.add.reduceat(worth, begins)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["block", "doc", "part"])

    return rows.select("block", "docs", "buckets", "counts", "gains").mapInArrow(run, "block bigint, doc int, part bigint")


def weights(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, n_words, weight) of each row of ``docs``: the floored mean gain of its features."""
    kept = Written(docs.sparkSession, "importance")
    rows = kept.put(postings(docs, doc_id, text))
    found = gains(sums(rows, "s"), sums(postings(target.withColumn("_no", F.lit(0)), "_no", text), "t"))
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.where("range >= 0").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    parts = _contributions(dealt.join(salted.hint("shuffle_hash"), ["range", "salt"]))
    each = rows.where("range = -1").select("block", F.posexplode(F.arrays_zip("ids", "n_features", "n_words")).alias("doc", "d"))
    each = each.select("block", "doc", F.lit(0).cast("long").alias("part"), F.col("d.ids").alias("doc_id"), "d.n_features", "d.n_words")
    parts = parts.select(*(c if c in parts.columns else F.lit(None).cast(t).alias(c) for c, t in each.dtypes))
    whole = each.unionByName(parts).groupBy("block", "doc").agg(F.sum("part").alias("sum"), *(F.max(c).alias(c) for c in ("doc_id", "n_features", "n_words")))
    mean = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(0).cast("long")
    return whole.select("doc_id", "n_features", "n_words", mean.alias("weight"))


def noise(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """A Gumbel draw by the hash of the id, in thousandths, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Add rank: 1, 2, ... by score, then id, for the best ``percent`` of the rows of at least ``words`` words (else null)."""
    fit = F.col("n_words") >= words
    counts = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    total = scored.where(fit).count()
    draw = percent * total // 100
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("score", above.alias("above")).where(F.col("above") < draw)
    least = counts.agg(F.min("score")).first()[0]
    drawn = fit & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features"))
    best = scored.where(drawn).join(counts, "score").withColumn("rank", F.col("above") + place).drop("above")
    best = best.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("long"))
    return best.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) of each row of ``docs``."""
    scored = weights(docs, target, doc_id, text).withColumn("score", F.col("weight") + noise())
    return ranked(Written(docs.sparkSession, "resample").put(scored))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of ``documents`` drawn towards the texts of ``benchmark``."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.col("n_features").cast("long").alias("n_features"), "weight", "score", "rank")
