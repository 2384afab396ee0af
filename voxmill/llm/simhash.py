"""SimHash fingerprints and near-duplicate components by a self-join of binary tries.

Fingerprints are compared once for each distinct value. The join walks pairs of trie nodes together,
adds a differing bit whenever the two sides branch apart, and drops a pair as soon as it has more
differing bits than the budget. The trie is walked in one rotation for each of ``bits + 1`` blocks:
two fingerprints within the budget agree on at least one whole block, so with that block rotated to
the top the walk starts below equal prefixes and no link is lost. Node pairs that hold more than
``cap`` fingerprints are walked further as a DataFrame (four levels a step); the rest finish in Arrow
tasks that emit a spanning forest of their links, never all pairs. Components come from the links by
alternating large-star and small-star steps with written tables between them.

Null and empty texts have no words: their fingerprint is zero and it links like any other. Repeated
rows keep a row each. A hot fingerprint (all texts without words, say) or a hub of the links meets one
row of the other side in a sort-merge join; adaptive execution splits its rows over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, add_columns, table

#: Bits by which linked fingerprints may differ; fingerprints of a node pair that one task takes; of a task's bucket of node pairs.
BUDGET, CAP, BUCKET, STEP = 2, 4096, 1 << 15, 4
#: Rows of a cluster of which all pairs are compared.
ALL_PAIRS = 8


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles: each XXH64 (seed 42) votes on each bit; a bit is set by more than half."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return h(b" ".join(words), 42)
    join = b" ".join
    votes, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 15):  # blocks, so that very long texts need little memory
        part = words[at : min(n, at + (1 << 15)) + shingle - 1]
        hashes = np.array([h(join(s), 42) for s in zip(*(part[i:] for i in range(shingle)))], dtype=">u8")  # noqa: B905
        votes += _votes(hashes)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def _votes(hashes: np.ndarray) -> np.ndarray:
    """Ones at each bit, highest first."""
    bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
    return bits.sum(axis=0, dtype=np.int64) if len(bits) > 255 else bits.sum(axis=0, dtype=np.uint8).astype(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """Add the fingerprint (as a signed long) and drop the text."""

    def make():
        def of(texts):
            return ([x - (1 << 64) if (x := fingerprint(t, shingle)) >> 63 else x for t in texts],)

        return of

    return add_columns(docs, [text], {out: "bigint"}, make, drop=(text,))


# --- node pairs -----------------------------------------------------------------------------------


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def walk(keys: np.ndarray, groups: list[np.ndarray], start: int, budget: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a forest of them) that differ in at most ``budget`` bits.

    ``keys``: rotated fingerprints (uint64, of which the highest ``width`` bits count), sorted within each node. ``groups``: the first node pairs
    as lo1, hi1, lo2, hi2 (equal ranges: a node with itself), whose keys agree on bits above ``start``.
    """
    n = len(keys)
    fi, fj = np.empty(0, np.int64), np.empty(0, np.int64)
    ones = {}

    def split(d: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        return hi - (ones[d][hi] - ones[d][lo])

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal fi, fj
        fi, fj = np.concatenate([fi, i]), np.concatenate([fj, j])
        if len(fi) > 4 * n + 100_000:  # the forest stands for them all
            root = _forest(n, fi, fj)
            fi = np.flatnonzero(root != np.arange(n))
            fj = root[fi]

    todo = [(start, *groups, np.zeros(len(groups[0]), np.int8))]
    while todo:
        d, lo1, hi1, lo2, hi2, err = todo.pop()
        if len(lo1) > 1 << 17:
            half = len(lo1) // 2
            todo += [(d, *(x[half:] for x in (lo1, hi1, lo2, hi2, err))), (d, *(x[:half] for x in (lo1, hi1, lo2, hi2, err)))]
            continue
        few = ((hi1 - lo1) * (hi2 - lo2) <= 64) | (d >= width)
        if few.any():
            a, b, c = lo1[few], lo2[few], hi2[few] - lo2[few]
            counts = (hi1[few] - a) * c
            of = np.repeat(np.arange(len(a)), counts)
            k = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            i, j = a[of] + k // c[of], b[of] + k % c[of]
            near = (i < j) | (a[of] != b[of])
            i, j = i[near], j[near]
            near = _popcount(keys[i] ^ keys[j]) <= budget
            keep(i[near], j[near])
            more = ~few
            lo1, hi1, lo2, hi2, err = (x[more] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            continue
        m1, m2 = split(d, lo1, hi1), split(d, lo2, hi2)
        apart = lo1 != lo2
        kids = [np.concatenate(x) for x in zip((lo1, m1, lo2, m2, err), (m1, hi1, m2, hi2, err), (lo1, m1, m2, hi2, err + 1), *([x[apart] for x in (m1, hi1, lo2, m2, err + 1)],), strict=True)]
        live = (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= budget)
        todo.append((d + 1, *(x[live] for x in kids)))
    return fi, fj


def _node_pairs(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The rows in order, their keys, where each distinct key of a node begins among them, and the node pairs over these."""
    rows = rows.sort_values(["g", "r", "depth", "a", "b", "right", "k"], kind="stable")
    keys = (rows["k"].to_numpy().astype(np.uint64)) ^ np.uint64(1 << 63)
    node = rows[["g", "r", "a", "b", "depth", "right"]].to_numpy()
    begins = np.concatenate([[True], (node[1:] != node[:-1]).any(axis=1)])
    once = np.flatnonzero(begins | np.concatenate([[True], keys[1:] != keys[:-1]]))
    node, begins = node[once], begins[once]
    lo = np.flatnonzero(begins)
    hi = np.append(lo[1:], len(once))
    own = node[lo, 2] == node[lo, 3]
    pair = np.flatnonzero(~own & (node[lo, 5] == 0))
    pair = pair[pair + 1 < len(lo)]
    pair = pair[(node[lo[pair], :5] == node[lo[pair + 1], :5]).all(axis=1)]
    return rows, keys, once, [np.concatenate([lo[own], lo[pair]]), np.concatenate([hi[own], hi[pair]]), np.concatenate([lo[own], lo[pair + 1]]), np.concatenate([hi[own], hi[pair + 1]])]


def _forest_of_links(start: int, budget: int, width: int):
    def run(_key, rows: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of the links inside a bucket of whole node pairs."""
        rows, keys, once, groups = _node_pairs(rows)
        ids = rows["id"].to_numpy()[once]
        i, j = walk(keys[once], groups, start, budget, width)
        # the same fingerprint may be in several node pairs: close over values before the forest is written
        values, at = np.unique(ids, return_inverse=True)
        root = _forest(len(values), at[i], at[j])
        linked = np.flatnonzero(root != np.arange(len(values)))
        return pd.DataFrame({"u": values[linked], "v": values[root[linked]], "members": None})

    return run


def _pairs_to_compare(start: int, budget: int, width: int):
    def run(_key, rows: pd.DataFrame) -> pd.DataFrame:
        """Of each cluster of linked words: all pairs (u, v) of its ids, or, of a large one, one row with its group (as u) and its sorted members."""
        rows, keys, once, groups = _node_pairs(rows)
        i, j = walk(keys[once], groups, start, budget, width)
        root = _forest(len(once), i, j)
        counts = np.diff(np.append(once, len(rows)))
        cluster = np.repeat(root, counts)  # of each row
        order = np.lexsort((rows["id"].to_numpy(), cluster))
        ids, cluster, group = rows["id"].to_numpy()[order], cluster[order], rows["g"].to_numpy()[order]
        again = np.concatenate([[False], (ids[1:] == ids[:-1]) & (cluster[1:] == cluster[:-1])])
        ids, cluster, group = ids[~again], cluster[~again], group[~again]
        lo = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
        size = np.diff(np.append(lo, len(ids)))
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in np.unique(size[(size > 1) & (size <= ALL_PAIRS)]):
            x, y = np.triu_indices(n, 1)
            members = ids[lo[size == n][:, None] + np.arange(n)]
            u.append(members[:, x].ravel())
            v.append(members[:, y].ravel())
        pairs = pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v), "members": None})
        large = [ids[a : a + n] for a, n in zip(lo[size > ALL_PAIRS], size[size > ALL_PAIRS], strict=True)]
        made = pd.concat([pairs, pd.DataFrame({"u": group[lo[size > ALL_PAIRS]], "v": None, "members": large})]) if large else pairs
        return made.astype({"u": "Int64", "v": "Int64"})

    return run


def _rotated(word: Column, r: int, sizes: list[int], width: int) -> Column:
    """The word with block ``r`` on top, moved to the highest bits of a long whose signed order is the bits' unsigned order."""
    shift = sum(sizes[:r])
    turned = F.shiftleft(word, shift).bitwiseOR(F.shiftrightunsigned(word, width - shift)) if shift else word
    return (F.shiftleft(turned, 64 - width) if width < 64 else turned).bitwiseXOR(F.lit(-(1 << 63)))


def linked_words(words: DataFrame, kept: Written, budget: int = BUDGET, cap: int = CAP, width: int = 64, leaf=_forest_of_links) -> DataFrame:
    """What ``leaf`` makes (u, v, members) of the words (id, g, word) of ``width`` bits that differ in at most ``budget`` bits within their group g."""
    blocks = budget + 1
    sizes = [width // blocks + (i < width % blocks) for i in range(blocks)]
    start = min(sizes)
    turned = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), _rotated(F.col("word"), r, sizes, width).alias("k")) for r in range(blocks))))
    top = lambda k, d: F.shiftrightunsigned(k.bitwiseXOR(F.lit(-(1 << 63))), 64 - d)
    work = words.select("id", "g", turned.alias("t")).select("id", "g", "t.r", "t.k").withColumn("a", top(F.col("k"), start)).withColumn("b", F.col("a")).withColumns({"right": F.lit(0), "err": F.lit(0), "depth": F.lit(start)})
    names, done = ["g", "r", "a", "b", "depth"], []
    depth = start
    work = kept.put(work)
    while True:
        found = work.groupBy(*names).agg(F.count_if(F.col("right") == 0).alias("x"), F.count_if(F.col("right") == 1).alias("y"))
        found = found.where(F.when(F.col("a") == F.col("b"), F.col("x") > 1).otherwise((F.col("x") > 0) & (F.col("y") > 0)))
        found = kept.put(found.withColumn("big", F.col("x") + F.col("y") > (cap if depth + STEP <= width else 1 << 62)))
        done.append(work.join(found.where(~F.col("big")).select(*names), names, "left_semi"))
        if depth + STEP > width or not found.where("big").limit(1).count():
            break
        # a step down: each child pair that the budget still allows
        child = F.shiftrightunsigned(F.col("k").bitwiseXOR(F.lit(-(1 << 63))), 64 - depth - STEP)
        other = F.explode(F.array(*map(F.lit, range(1 << STEP))))
        big = work.join(found.where("big").select(*names), names, "left_semi").withColumn("c", child).withColumn("o", other)
        mine, self_pair = F.col("c").bitwiseAND(F.lit((1 << STEP) - 1)), F.col("a") == F.col("b")
        top_other = F.shiftleft(F.when(F.col("right") == 0, F.col("b")).otherwise(F.col("a")), STEP) + F.col("o")
        big = big.withColumn("err", (F.col("err") + F.bit_count(mine.bitwiseXOR(F.col("o").cast("long")))).cast("int")).where(F.col("err") <= budget)
        side = F.when(self_pair, (F.col("c") > top_other).cast("int")).otherwise(F.col("right"))
        big = big.withColumn("oo", top_other).withColumn("side", side)
        big = big.select("id", "g", "r", "k", F.when(F.col("side") == 0, F.col("c")).otherwise(F.col("oo")).alias("a"), F.when(F.col("side") == 0, F.col("oo")).otherwise(F.col("c")).alias("b"), F.col("side").alias("right"), "err", F.lit(depth + STEP).alias("depth"))
        work = kept.put(big)
        depth += STEP
    leaves = done[0]
    for x in done[1:]:
        leaves = leaves.unionByName(x)
    leaves = kept.put(leaves.select("id", "g", "r", "k", "a", "b", "depth", "right"))
    buckets = max(1, -(-leaves.count() // BUCKET))
    leaves = leaves.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))
    return leaves.groupBy("bucket").applyInPandas(leaf(start, budget, width), "u bigint, v bigint, members array<bigint>")


def links(nodes: DataFrame, kept: Written, budget: int = BUDGET, cap: int = CAP) -> DataFrame:
    """Forest of links (u, v) among the distinct fingerprints ``nodes.fp``."""
    return linked_words(nodes.select(F.col("fp").alias("id"), F.lit(0).alias("g"), F.col("fp").alias("word")), kept, budget, cap).select("u", "v")


def components(edges: DataFrame, kept: Written) -> DataFrame:
    """(node, root) of every node that has a link; the root is the component's smallest node.

    Large-star and small-star steps in turn until the edges no longer change.
    """
    edges = kept.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = kept.put(small)
        now = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        kept.drop(edges)
        edges = new
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def _rooted(rows: DataFrame, kept: Written, budget: int, cap: int) -> DataFrame:
    """(fp, root) of each distinct fingerprint."""
    once = rows.select("fp").distinct()
    roots = components(links(once, kept, budget, cap), kept)
    return once.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, budget: int = BUDGET, cap: int = CAP) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable over links."""
    kept = Written(docs.sparkSession, "simhash")
    rows = kept.put(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), shingle=shingle))
    named = kept.put(rows.groupBy("fp").agg(F.min("doc_id").alias("low")).join(_rooted(rows, kept, budget, cap), "fp"))
    of_root = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = kept.put(named.join(of_root, "root").select("fp", "component_id"))
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def row_of(docs: DataFrame, doc_id: str = "doc_id") -> Column:
    """What tells rows apart and orders them: the id (null last), then a hash of all columns. Only rows equal in every column share it."""
    return F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.lit(1), *(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def take_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose hash is in ``rows`` (row), each once."""
    own = F.xxhash64(F.lit(1), *(F.col(f"`{c}`") for c in docs.columns))
    return docs.withColumn("_vm_row", own).join(rows.select(F.col("row").alias("_vm_row")).hint("merge"), "_vm_row", "left_semi").dropDuplicates(["_vm_row"]).select(*docs.columns)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, budget: int = BUDGET, cap: int = CAP) -> DataFrame:
    """One row of each component of linked fingerprints: that of the least doc_id (null last), then of the least row hash.

    Rows are told apart by the id and a hash of all columns: rows that share an id but not the text are
    documents of their own; of rows equal in every column one stays.
    """
    kept = Written(docs.sparkSession, "simhash")
    rows = docs.select(row_of(docs, doc_id).alias("at"), F.col(f"`{text}`").alias("text"))
    rows = kept.put(fingerprints(rows, shingle=shingle))
    first = rows.groupBy("fp").agg(F.min("at").alias("at")).join(_rooted(rows, kept, budget, cap), "fp")
    return take_rows(docs, kept.put(first.groupBy("root").agg(F.min("at").alias("at")).select("at.row")))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
