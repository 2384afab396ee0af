"""URL verdicts: longest host and path rule, else exact membership in a blocklist by a cascade of Bloom filters.

The cascade's first level encodes the listed hosts. Level by level the keys of the other kind that
pass are encoded in turn, over the complete universe of the corpus's hosts, until no key passes
wrongly; for every key of the universe the first level that it fails then tells its kind exactly. The
levels are binary literals in a plain expression, so pages are judged without a join or a shuffle.

Literals must stay small, so hosts are dealt by a hash into as many parts as keep each part's cascade near
``max_bytes``: each part has a cascade of its own, which judges the pages of its hosts in a pass of its own.
One list of a few million hosts is one part. The blocklist is a table of hosts, of any size; hosts in it that no
page has do no harm. Everything is DataFrame functions.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up
to ``?``, ``#`` or the end. A null url, or one without ``://``, has both empty, fits no rule and is
allowed unless the empty host is listed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, table

#: (verdict, host, path prefix); a rule fits its host and all subdomains, the longest that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Bits for each key and hashes: of the first level, of the others. Bytes near which a part's levels stay.
FIRST, LATER, MAX_BYTES = (10, 5), (5, 3), 4 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def rule_for(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


# --- the cascade ----------------------------------------------------------------------------------


def _position(key: Column, level: int, i: int, m: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(m))


def _has(bits: bytes, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.lit(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte.cast("long"), (at % 8).cast("int")) == 1


class Cascade:
    """Levels of (bytes, bits, hashes); ``contains`` is exact for every key of the universe that it was built on."""

    def __init__(self, levels: list[tuple[bytes, int, int]]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        out = None
        for n, (bits, m, k) in enumerate(self.levels):
            passes = _has(bits, _position(key, n, 0, m))
            for i in range(1, k):
                passes = passes & _has(bits, _position(key, n, i, m))
            kind = F.lit(n % 2 == 1)  # it fails the filter of listed keys: not listed; that of others: listed
            out = F.when(~passes, kind) if out is None else out.when(~passes, kind)
        return F.lit(False) if out is None else out.otherwise(F.lit(len(self.levels) % 2 == 1))

    @property
    def size(self) -> int:
        return sum(len(b) for b, _, _ in self.levels)


def build_cascade(keys: DataFrame, kept: Written) -> Cascade:
    """From (key, listed), one row for each key of the universe."""
    written: list[DataFrame] = []
    own, other = keys.where("listed").select("key"), keys.where("not listed").select("key")
    levels: list[tuple[bytes, int, int]] = []
    while n := own.count():
        per, k = LATER if levels else FIRST
        m = max(64, -(-n * per // 64) * 64)
        at = F.explode(F.array(*(_position(F.col("key"), len(levels), i, m) for i in range(k))))
        words = own.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("b"))
        bits = bytearray(m // 8)
        for w, b in words.collect():  # m / 64 rows at most: the caller's parts keep m small
            bits[w * 8 : w * 8 + 8] = (b % (1 << 64)).to_bytes(8, "little")
        levels.append((bytes(bits), m, k))
        passes = None
        for i in range(k):
            hit = _has(levels[-1][0], _position(F.col("key"), len(levels) - 1, i, m))
            passes = hit if passes is None else passes & hit
        written.append(kept.put(other.where(passes)))
        own, other = written[-1], own
    kept.drop(*written)
    return Cascade(levels)


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))


def judge(pages: DataFrame, blocklist: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add host, path, rule and verdict; ``blocklist`` has the listed hosts (host; null and repeated rows do no harm).

    Columns of ``pages`` with these names are replaced.
    """
    made = ("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in made), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    kept = Written(pages.sparkSession, "urls")
    bad = blocklist.select(F.col("host").alias("key"), F.lit(True).alias("listed")).where("key is not null").distinct()
    keys = kept.put(rows.select(F.col("host").alias("key")).distinct().join(bad, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    n = keys.agg(F.count_if("listed").alias("own"), F.count("*").alias("all")).first()
    # bits: the listed, then of the others about one in a hundred passes the first level
    bits = FIRST[0] * n["own"] + LATER[0] * (n["all"] - n["own"]) // 50
    parts = max(1, -(-bits // (8 * max(1, max_bytes))))
    rows = rows.withColumn("_vm_rule", rule_for(F.col("host"), F.col("path"), rules))
    out = None
    for p in range(parts):
        hit = build_cascade(keys.where(_part(F.col("key"), parts) == p) if parts > 1 else keys, kept).contains(F.col("host"))
        verdict = F.coalesce(F.col("_vm_rule.verdict"), F.when(hit, F.lit("block")).otherwise(F.lit("allow")))
        own = rows.where(_part(F.col("host"), parts) == p) if parts > 1 else rows
        own = own.withColumn("rule", F.col("_vm_rule.rule")).withColumn("verdict", verdict).drop("_vm_rule")
        out = own if out is None else out.unionByName(own)
    kept.drop(keys)
    return out


def sample_blocklist(pages: DataFrame) -> DataFrame:
    """A stand-in for an external list in the registered query: each sixteenth host of the corpus (by its md5), and hosts that no page has."""
    host, _ = host_and_path(F.col("url"))
    seen = pages.select(host.alias("host")).distinct().where("substring(md5(host), 1, 1) = '0'")
    return seen.unionByName(pages.sparkSession.range(1000).select(F.concat(F.lit("never-seen-"), F.col("id").cast("string"), F.lit(".invalid")).alias("host")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, sample_blocklist(pages)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
with u as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u),
r as (select page_id, coalesce(host, '') as host, coalesce(path, '') as path from h),
m as (select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
    when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
    when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
    when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule from r)
select page_id, host, path, rule,
       case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
            when md5(host)[1:1] = '0' then 'block'
            else 'allow' end as verdict
from m
"""
