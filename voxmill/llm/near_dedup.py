"""One row of each near-duplicate group: five-word shingles, Jaccard similarity of at least 0.8, by SimHash tries.

Two shingle sets of similarity s have a cosine of at least 2 s / (1 + s), so each bit of their SimHash
differs with probability acos(2 s / (1 + s)) / pi: 0.151 at 0.8. Within two bits of one 64-bit fingerprint
hardly any such pair is found. So the fingerprint here is ``WORDS`` x ``WIDTH`` bits, the binary trie
self-join of ``simhash.linked_words`` runs over each word with its budget of two bits, and a pair is a candidate if
any word links it: 0.98 of the pairs at exactly 0.8, 0.999 at 0.85. Candidates are first held against the
whole fingerprint (at most ``FAR`` of its bits may differ, which a pair at 0.8 exceeds once in 10^8), then
by the exact Jaccard similarity of the two texts' shingle sets. Components are formed from the links that hold.

Of the clusters that a word's trie links, those of up to ``simhash.ALL_PAIRS`` members are compared in all
pairs. In larger ones each member is compared with a leader, the cluster's least id, which joins most
of them; the clusters that a group of alike texts has in several words mostly share it, so the same pair is met in all of them. Clusters that still hold several components are taken up again. The largest such cluster of a node is its home:
there it is compared with all members. Both meet in blocks of about ``BLOCK``, and a task compares two blocks, prints first
and then shingle sets, and gives the links alone. Pairs of which neither is in the other's home are compared if a word links
them directly. So no pair that a word links is left out, and a large group of texts that are alike, but not enough, doesn't become a row for each of its pairs.

Texts with equal sets are one node. Texts of fewer than five words are one shingle; null and empty
texts have none and are one node together. Rows are told apart by the id and a hash of all columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, add_columns
from .simhash import CAP, _pairs_to_compare, components, linked_words, row_of, take_rows

SHINGLE, SIMILARITY = 5, 0.8
#: Words of the fingerprint, bits of each, bits of all in which a candidate may differ; bits within a word.
WORDS, WIDTH, FAR, BUDGET = 32, 32, 230, 2
#: Owners and members of a home that one task holds.
BLOCK = 512
_ODD = np.random.default_rng(5).integers(1 << 62, size=WORDS * WIDTH // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    """Sets of hashed shingles; remembers the hashes of words."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.memo = size, {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the word shingles, from the XXH64 of their words in order."""
        import xxhash

        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.memo) > 1 << 18:
            self.memo.clear()
        memo, h = self.memo, xxhash.xxh64_intdigest
        one = np.array([memo[w] if w in memo else memo.setdefault(w, h(w, 42)) for w in words], np.uint64)
        n = max(1, len(one) - self.size + 1)
        out = one[:n].copy()
        for i in range(1, min(self.size, len(one))):
            out = (out ^ (out >> np.uint64(31))) * _BASE + one[i : i + n]
        return np.unique(out)


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash of WORDS * WIDTH bits, as int64: each shingle votes on each bit; a bit is set by more than half."""
    votes = np.zeros(WORDS * WIDTH, np.int64)
    for at in range(0, len(found), 255):  # a block's votes fit in a byte
        x = found[at : at + 255, None] * _ODD
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        votes += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(found)).view(np.int64)


def _describe():
    import xxhash

    shingler = Shingler()

    def of(texts):
        sets = [shingler.of(t) for t in texts]
        nodes = [int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 7)))) if len(s) else 0 for s in sets]
        return nodes, [wide_fingerprint(s).tolist() if len(s) else None for s in sets]

    return of


def _sets():
    shingler = Shingler()
    return lambda texts: ([shingler.of(t).view(np.int64).tolist() for t in texts],)


def bits_apart(a: str, b: str) -> Column:
    """Bits in which two fingerprints differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def nearby(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose whole fingerprints differ in at most FAR bits."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("print").alias(f"p{x}")) for x in "uv")
    return pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").where(bits_apart("pu", "pv") <= FAR).select("u", "v")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets have at least that Jaccard similarity."""
    left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in "uv")
    common = F.size(F.array_intersect("su", "sv"))
    return pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").where(common >= similarity * (F.size("su") + F.size("sv") - common)).select("u", "v")


def _mixed(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members (of, g, node, root) of clusters that hold several components, with the cluster's size, the node's print, its home (its largest such cluster) and all its clusters (one a word at most), and ``apart`` from the cluster's largest component."""
    classes = member.groupBy("of", "root").agg(F.count("*").alias("n"))
    mixed = classes.groupBy("of").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("classes"), F.sum("n").alias("size")).where("classes > 1").drop("classes")
    rows = member.join(mixed, "of").select("node", "root", F.struct("of", "g", "size", (F.col("root") != F.col("main")).alias("apart")).alias("c"))
    each = rows.groupBy("node", "root").agg(F.collect_list("c").alias("c"), F.max(F.struct("c.size", "c.of"))["of"].alias("home"))  # WORDS clusters at most
    each = each.join(nodes.select("node", "print").hint("merge"), "node").withColumn("clusters", F.transform("c", lambda x: x["of"]))
    return each.select("node", "root", "print", "home", "clusters", F.explode("c").alias("c")).select("c.of", "c.g", "node", "root", "c.size", "c.apart", "print", "home", "clusters")


def _links_of_blocks(_key, rows: pd.DataFrame) -> pd.DataFrame:
    """The links (u, v) of a block of owners of a home with a block of its members, of different components so far."""
    rows = rows.sort_values(["owner", "node"], kind="stable")
    node, root, owner, at_home = (rows[c].to_numpy() for c in ("node", "root", "owner", "at_home"))
    prints = np.stack(rows["print"].to_numpy()).astype(np.int64).view(np.uint64)  # of negative numbers numpy counts the bits of the absolute value
    sizes = np.array([len(x) for x in rows["set"]])
    _, flat = np.unique(np.concatenate(rows["set"].to_numpy()).astype(np.int64), return_inverse=True)
    ends = np.cumsum(sizes)
    held = np.zeros(flat.max(initial=0) + 1, bool)
    out = []
    members = np.flatnonzero(~owner)
    for x in np.flatnonzero(owner):
        # two owners meet twice: the smaller one compares
        y = members[(root[members] != root[x]) & ~(at_home[members] & (node[members] < node[x]))]
        y = y[np.bitwise_count(prints[y] ^ prints[x]).sum(axis=1) <= FAR]
        if not len(y):
            continue
        own = flat[ends[x] - sizes[x] : ends[x]]
        held[own] = True
        common = np.array([held[flat[ends[k] - sizes[k] : ends[k]]].sum() for k in y])
        held[own] = False
        out += [(min(node[x], node[k]), max(node[x], node[k])) for k in y[common >= SIMILARITY * (sizes[x] + sizes[y] - common)]]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _home_links(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the nodes of each home with its members; a row of either comes once for each block of the others."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    homes = mixed.where("of = home").groupBy("of").agg(F.count("*").alias("owners"))
    rows = mixed.join(homes, "of").select("of", "node", "root", "print", (F.col("home") == F.col("of")).alias("at_home"), blocks("owners").alias("p"), blocks("size").alias("q"))
    mine = lambda n: F.pmod(F.xxhash64("node", "of"), F.col(n)).cast("int")
    names = ("of", "node", "root", "print", "at_home")
    owners = rows.where("at_home").select(*names, F.lit(True).alias("owner"), mine("p").alias("i"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"))
    members = rows.select(*names, F.lit(False).alias("owner"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), mine("q").alias("j"))
    met = owners.unionByName(members).join(sets.hint("merge"), "node")
    return met.groupBy("of", "i", "j").applyInPandas(_links_of_blocks, "u bigint, v bigint")


def _direct_links(mixed: DataFrame) -> DataFrame:
    """Pairs (u, v) of a cluster's members in different components, neither in the other's home, whose words of group g differ in at most BUDGET bits and whole fingerprints in at most FAR.

    One of the two is outside the cluster's largest component. Words are compared within their cluster by the join itself, so
    only pairs that are near become rows; adaptive execution splits the join where a cluster is large.
    """
    per = 64 // WIDTH
    word = F.expr(f"shiftrightunsigned(print[cast(g div {per} as int)], cast(64 - {WIDTH} * (g % {per} + 1) as int)) & {(1 << WIDTH) - 1}")
    rows = mixed.where("of <> home").select("of", "node", "root", "print", "home", "clusters", "apart", word.alias("word"))  # at home it has met all
    side = lambda x: rows.select("of", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "print", "home", "clusters", "word", "apart")))
    one, other = side("a").where("apart_a").drop("apart_a"), side("b")
    met_at_home = F.array_contains("clusters_b", F.col("home_a")) | F.array_contains("clusters_a", F.col("home_b"))
    near = F.bit_count(F.col("word_a").bitwiseXOR(F.col("word_b"))) <= BUDGET
    linked = near & (F.col("root_a") != F.col("root_b")) & (~F.col("apart_b") | (F.col("node_a") < F.col("node_b"))) & ~met_at_home & (bits_apart("print_a", "print_b") <= FAR)
    met = one.alias("a").join(other.hint("merge").alias("b"), (F.col("a.of") == F.col("b.of")) & linked)
    return met.select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")).distinct()


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", cap: int = CAP) -> DataFrame:
    """One row of each component: the least doc_id (null last), then the least row hash."""
    kept = Written(docs.sparkSession, "near")
    rows = docs.select(row_of(docs, doc_id).alias("at"), F.col(f"`{text}`").alias("text"))
    marked = kept.put(add_columns(rows, ["text"], {"node": "bigint", "print": "array<bigint>"}, _describe, drop=("text",)))
    nodes = kept.put(marked.groupBy("node").agg(F.min("at").alias("at"), F.min("print").alias("print")))
    kept.drop(marked)

    def sets_of(asked: DataFrame) -> DataFrame:
        """(node, set): only texts that are asked for are read again."""
        asked = nodes.join(asked.distinct(), "node").select("node", F.col("at.row").alias("row"))
        texts = rows.select(F.col("at.row").alias("row"), "text").join(asked.hint("merge"), "row").dropDuplicates(["row"]).select("node", "text")
        return kept.put(add_columns(texts, ["text"], {"set": "array<bigint>"}, _sets, drop=("text",)))

    def checked(pairs: DataFrame) -> DataFrame:
        """The links among pairs whose fingerprints are near."""
        sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")))
        out = kept.put(similar(pairs, sets))
        kept.drop(sets)
        return out

    per = 64 // WIDTH
    word = F.posexplode(F.flatten(F.transform("print", lambda x: F.array(*(F.shiftrightunsigned(x, 64 - WIDTH * (i + 1)).bitwiseAND(F.lit((1 << WIDTH) - 1)) for i in range(per))))))
    found = linked_words(nodes.where("print is not null").select(F.col("node").alias("id"), word.alias("g", "word")), kept, BUDGET, cap, WIDTH, _pairs_to_compare)
    found = kept.put(found.withColumn("of", F.monotonically_increasing_id()))
    large = found.where("members is not null").select("of", F.col("u").alias("g"), F.element_at("members", 1).alias("leader"), F.explode("members").alias("node"))
    both = found.where("members is null").select("u", "v").unionByName(large.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")))
    near = kept.put(nearby(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), nodes))
    edges = checked(near)
    kept.drop(near)
    roots = kept.put(components(edges, kept))
    member = kept.put(large.join(roots.hint("merge"), "node", "left").select("of", "g", "node", F.coalesce("root", "node").alias("root")))
    mixed = kept.put(_mixed(member, nodes))
    kept.drop(member, found)
    if mixed.limit(1).count():
        sets = sets_of(mixed.select("node"))
        more = kept.put(_home_links(mixed, sets))
        kept.drop(sets)
        rest = kept.put(_direct_links(mixed).join(edges, ["u", "v"], "left_anti"))
        roots = kept.put(components(edges.unionByName(more).unionByName(checked(rest)), kept))
    kept.drop(mixed)
    named = nodes.select("node", "at").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = kept.put(named.groupBy("root").agg(F.min("at").alias("at")).select("at.row"))
    return take_rows(docs, stay)
