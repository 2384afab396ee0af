"""Removal of multi-line passages that repeat across the corpus, with DataFrame functions alone.

Each text is cut into chunks of lines at content-defined places. A line hash is md5; the rolling hash
at a line is the md5 of the hashes of the line and of the one before; the chunk ends after the line
when that falls into ``1 / SPARSE`` of the values, so an insertion moves no boundary but its own.
A line of ``LONG`` words or more is a passage by itself: boundaries lie before and after it.

Chunks of at least two lines with a word, or of one line of ``LONG`` words, whose 64-bit hash occurs
again anywhere are candidates. A candidate is removed when its bytes equal those of the first chunk
with that hash (least doc_id, then least row, then place in the text); that first chunk stays, as do
chunks that only share the hash. What remains of a text is joined by line feeds as before.

Null texts stay null, empty texts stay empty; rows whose every line goes keep an empty text. Ids may be
null (last in order) or repeated: rows are told apart by the id and a hash of all columns, and rows
that are equal in every column are one document, treated alike.

``dedup_passages`` does more than ``dedup_lines``: besides the chunks it takes out every line that lies in a run of ``LONG`` words or more which occurs earlier, wherever the run
begins and ends and however short its lines are, and every text that an earlier row has as a whole.
For that each line with a word begins one window (up to the line of the ``LONG``-th word from there) and
ends one (back to the line of the ``LONG``-th word). A repeated run contains the windows that begin or
end at its lines, these cover it, and they depend on its bytes alone. Each line of a repeated window
is compared by its bytes with the line of the first such window.

A hash that a large share of the rows has (a licence in every document) meets one row of the other side in
each sort-merge join; adaptive execution splits its rows over tasks. Texts travel twice: to their own
candidates, and to what is taken out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Written, table

#: One boundary in so many lines; words of a passage of one line.
SPARSE, LONG = 4, 50
_HEX = "0123"  # first hex digits that end a chunk: 1 in SPARSE


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def _is_long(line: Column) -> Column:
    """At least LONG words (cheap test first: such a line has LONG characters and as many blanks)."""
    return (F.length(line) >= 2 * LONG - 1) & (_words(line) >= LONG)


def chunks(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with _lines, _starts and _ends: the lines, and the 1-based numbers of those at which chunks begin and end.

    Line i begins a chunk if it is the first, if it or the line before is long, or if the line before
    ended one. Arrays that a lambda reads are columns of their own and are named twice, so that the
    optimizer doesn't compute them again for each element.
    """

    def begins(x: Column, i: Column) -> Column:
        before = F.get("_hashes", i - 1)
        rolled = F.md5(F.concat(F.coalesce(F.get("_hashes", i - 2)["h"], F.lit("")), before["h"]))
        return (i == 0) | x["w"] | before["w"] | F.substring(rolled, 1, 1).isin(*_HEX)

    out = docs.withColumn("_lines", F.split(F.col(text), "\n", -1))
    out = out.withColumn("_hashes", F.transform("_lines", lambda x: F.struct(F.md5(x).alias("h"), _is_long(x).alias("w"))))
    out = out.withColumn("_starts", F.filter(F.transform("_hashes", lambda x, i: F.when(begins(x, i), i + 1)), lambda x: x.isNotNull()))
    return out.withColumn("_ends", F.transform("_starts", lambda _, i: F.coalesce(F.get("_starts", i + 1) - 1, F.size("_lines"))))


def _chunk(start: Column, end: Column) -> Column:
    return F.array_join(F.slice(F.col("_lines"), start, end - start + 1), "\n")


def _places() -> Column:
    """(s, e, h) of each chunk that may be a passage."""
    spans = F.transform("_starts", lambda s, i: F.struct(s.alias("s"), F.get("_ends", i).alias("e")))
    fit = F.filter(spans, lambda x: F.when(x["e"] > x["s"], _chunk(x["s"], x["e"]).rlike(WORD)).otherwise(_is_long(F.element_at("_lines", x["s"]))))
    return F.transform(fit, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.xxhash64(_chunk(x["s"], x["e"])).alias("h")))


def _same_row(left: str, right: str) -> Column:
    return (F.col(f"{left}.id").eqNullSafe(F.col(f"{right}.id"))) & (F.col(f"{left}.row") == F.col(f"{right}.row"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", removed: str | None = None) -> DataFrame:
    """``docs`` with the repeated chunks taken out of ``text``; ``removed`` names a column for the number of lines taken out."""
    rest = [c for c in docs.columns if c != text]
    key = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.lit(1), *(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    named = docs.select(key.alias("k"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("doc"), F.col(f"`{text}`").alias("text"))
    cut = chunks(named.where("text is not null").select("k", "text"), "text").select("k", F.explode(_places()).alias("p"))
    kept = Written(docs.sparkSession, "lines")
    seen = kept.put(cut.select("k", "p.s", "p.e", "p.h"))  # narrow; what follows reads it twice
    place = F.struct(F.col("k.id").isNull().alias("n"), F.col("k.id").alias("id"), F.col("k.row").alias("row"), "s")
    again = seen.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h", "first")
    marks = seen.join(again, "h").withColumn("is_first", F.col("first") == place)
    marks = marks.groupBy("k").agg(F.collect_set(F.struct("s", "e", "h", "is_first")).alias("marks"))
    # texts meet their candidates; only the candidates' bytes go on
    # merge hints: candidates grow with the corpus, so neither join may turn into a broadcast on small inputs
    found = named.alias("t").join(marks.hint("merge").alias("m"), _same_row("t.k", "m.k")).select("t.k", F.split("t.text", "\n", -1).alias("_lines"), "m.marks")
    with_bytes = F.transform("marks", lambda m: m.withField("bytes", F.when(m["e"] <= F.size("_lines"), _chunk(m["s"], m["e"]))))
    found = kept.put(found.select("k", F.explode(with_bytes).alias("c")).select("k", "c.*"))
    firsts = found.where("is_first").groupBy("h").agg(F.min("bytes").alias("first_bytes"))
    same = found.where("not is_first").join(firsts, "h").where("bytes = first_bytes")
    gone = kept.put(same.groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("gone")))
    kept.drop(seen, found)
    out = named.alias("t").join(gone.hint("merge").alias("g"), _same_row("t.k", "g.k"), "left").select("t.doc", "t.text", F.col("g.gone").alias("gone"))
    out = out.withColumn("_lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)))
    taken = F.flatten(F.transform("gone", lambda g: F.sequence(g["s"], g["e"])))
    left = F.transform(F.array_except(F.sequence(F.lit(1), F.size("_lines")), taken), lambda i: F.element_at("_lines", i))
    out = out.withColumn("new", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    fields = [F.col("new").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns]
    if removed:
        fields.append(F.coalesce(F.size(taken), F.lit(0)).alias(removed))
    return out.select(*fields)


def _windows() -> list[Column]:
    """Arrays of (s, e, kind): windows that lines begin, windows that lines end, chunks of several lines, and the whole text.

    _word has the line number of each word, _full the lines with a word, _first the place in _word of each one's first word.
    """
    total = F.size("_word")
    last = lambda i: F.coalesce(F.get("_first", i + 1), F.size("_word")) - 1
    span = lambda s, e, kind: F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("kind"))
    begun = F.transform("_full", lambda x, i: F.when(F.get("_first", i) + LONG <= total, span(x, F.get("_word", F.get("_first", i) + LONG - 1), 0)))
    ended = F.transform("_full", lambda x, i: F.when((last(i) >= LONG - 1) & (F.get("_word", last(i) - LONG + 1) < x), span(F.get("_word", last(i) - LONG + 1), x, 1)))
    cut = F.transform("_starts", lambda x, i: F.when((F.get("_ends", i) > x) & F.exists(F.slice("_words", x, F.get("_ends", i) - x + 1), lambda w: w > 0), span(x, F.get("_ends", i), 2)))
    return [begun, ended, cut, F.array(F.when(total > 0, span(F.lit(1), F.size("_lines"), 3)))]


def windows(named: DataFrame) -> DataFrame:
    """(k, s, e, h) of each run of lines that may be a passage."""
    out = chunks(named.where("text is not null").select("k", "text"), "text")
    out = out.withColumn("_codes", F.transform("_lines", lambda x: F.xxhash64(x))).withColumn("_words", F.transform("_lines", _words))
    out = out.withColumn("_word", F.flatten(F.transform("_words", lambda n, i: F.array_repeat(i + 1, n))))
    out = out.withColumn("_first", F.filter(F.transform("_word", lambda x, i: F.when((i == 0) | (F.get("_word", i - 1) != x), i)), lambda x: x.isNotNull()))
    out = out.withColumn("_full", F.transform("_first", lambda p: F.get("_word", p)))
    spans = F.filter(F.concat(*_windows()), lambda x: x.isNotNull())
    out = out.select("k", "_codes", F.explode(spans).alias("p"))
    return out.select("k", "p.s", "p.e", F.xxhash64("p.kind", F.slice("_codes", F.col("p.s"), F.col("p.e") - F.col("p.s") + 1)).alias("h"))


def dedup_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", removed: str | None = None) -> DataFrame:
    """``docs`` with all repeated passages taken out of ``text``; ``removed`` names a column for the number of lines taken out."""
    rest = [c for c in docs.columns if c != text]
    key = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.lit(1), *(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    named = docs.select(key.alias("k"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("doc"), F.col(f"`{text}`").alias("text"))
    kept = Written(docs.sparkSession, "passages")
    seen = kept.put(windows(named))
    place = F.struct(F.col("k.id").isNull().alias("n"), F.col("k.id").alias("id"), F.col("k.row").alias("row"), "s")
    again = seen.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h", "first")
    marks = seen.join(again.hint("merge"), "h").where(F.col("first") != place)
    # lines of each text by the text that has them first and by how far apart the two places are
    first = F.struct(F.col("first.id").alias("id"), F.col("first.row").alias("row"))
    marks = marks.select("k", first.alias("of"), (F.col("first.s") - F.col("s")).alias("d"), "s", "e").groupBy("k", "of", "d").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    spans = F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["e"])))
    marks = kept.put(marks.select("k", "of", "d", F.array_distinct(spans).alias("at")))
    kept.drop(seen)
    sources = marks.select("of", F.explode("at").alias("i"), "d").select("of", (F.col("i") + F.col("d")).alias("i")).distinct().groupBy("of").agg(F.collect_list("i").alias("sources"))
    asked = marks.select("k", F.struct("of", "d", "at").alias("own"), F.lit(None).cast("array<int>").alias("sources"))
    asked = asked.unionByName(sources.select(F.col("of").alias("k"), F.lit(None).cast(asked.schema["own"].dataType).alias("own"), "sources"))
    asked = asked.groupBy("k").agg(F.collect_list("own").alias("own"), F.first("sources", True).alias("sources"))
    found = named.alias("t").join(asked.hint("merge").alias("m"), _same_row("t.k", "m.k")).select("t.k", F.split("t.text", "\n", -1).alias("_lines"), "m.own", "m.sources")
    line = lambda i: F.when(i <= F.size("_lines"), F.get("_lines", i - 1)).alias("bytes")
    own = F.flatten(F.transform("own", lambda o: F.transform(o["at"], lambda i: F.struct(o["of"].alias("of"), (i + o["d"]).alias("j"), i.alias("i"), line(i)))))
    source = F.transform(F.coalesce("sources", F.array().cast("array<int>")), lambda j: F.struct(F.col("k").alias("of"), j.alias("j"), F.lit(0).alias("i"), line(j)))
    found = kept.put(found.select("k", F.explode(F.concat(own, source)).alias("c")).select("k", "c.*"))
    kept.drop(marks)
    sources = found.where("i = 0").select("of", "j", "bytes").dropDuplicates(["of", "j"])  # rows equal in every column give theirs once
    match = _same_row("a.of", "b.of") & (F.col("a.j") == F.col("b.j")) & (F.col("a.bytes") == F.col("b.bytes"))
    same = found.where("i > 0").alias("a").join(sources.hint("merge").alias("b"), match)
    gone = kept.put(same.groupBy("a.k").agg(F.collect_set("a.i").alias("gone")))
    kept.drop(found)
    out = named.alias("t").join(gone.hint("merge").alias("g"), _same_row("t.k", "g.k"), "left").select("t.doc", "t.text", F.col("g.gone").alias("gone"))
    out = out.withColumn("_lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)))
    left = F.transform(F.array_except(F.sequence(F.lit(1), F.size("_lines")), "gone"), lambda i: F.element_at("_lines", i))
    out = out.withColumn("new", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    fields = [F.col("new").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns]
    if removed:
        fields.append(F.coalesce(F.size("gone"), F.lit(0)).alias(removed))
    return out.select(*fields)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has, and the number of lines taken out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_passages(docs, removed="removed_lines")
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), "removed_lines", F.md5("text").alias("text_md5"))


#: Lines with their running word counts; runs of lines that may be a passage (windows that a line begins or ends, chunks, whole texts); lines of all runs but the first with the same bytes.
OP3_SQL = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents where text is not null),
w as (select *, md5(line) as h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from l),
c as (select *, sum(words) over (partition by doc_id order by i) as upto, sum(words) over (partition by doc_id) as total from w),
t as (select doc_id, list(line order by i) as lines from w group by doc_id),
b as (select *, coalesce(words >= 50 or lag(words) over p >= 50 or i = 1
               or md5(coalesce(lag(h, 2) over p, '') || lag(h) over p)[1:1] in ('0', '1', '2', '3'), true) as begins
      from w window p as (partition by doc_id order by i)),
k as (select doc_id, i, words, sum(begins::int) over (partition by doc_id order by i) as chunk from b),
r as (
  select a.doc_id, 0 as kind, a.i as s, z.i as e from c a join c z on a.doc_id = z.doc_id and a.words > 0
    and z.upto - z.words < a.upto - a.words + 50 and a.upto - a.words + 50 <= z.upto
  union all
  select a.doc_id, 1, z.i, a.i from c a join c z on a.doc_id = z.doc_id and a.words > 0 and z.i < a.i
    and z.upto - z.words < a.upto - 49 and a.upto - 49 <= z.upto
  union all
  select doc_id, 2, min(i), max(i) from k group by doc_id, chunk having count(*) > 1 and sum(words) > 0
  union all
  select doc_id, 3, 1, max(i) from c group by doc_id having max(total) > 0),
n as (select r.doc_id, s, e, row_number() over (partition by kind, array_to_string(lines[s:e], chr(10)) order by r.doc_id, s) as nth from r join t on r.doc_id = t.doc_id),
g as (select distinct doc_id, unnest(generate_series(s, e)) as i from n where nth > 1),
o as (select w.doc_id, string_agg(line, chr(10) order by w.i) filter (where g.i is null) as text, count(g.i) as removed from w left join g on w.doc_id = g.doc_id and w.i = g.i group by w.doc_id)
select d.doc_id, length(case when d.text is null then null else coalesce(o.text, '') end)::bigint as n_chars, coalesce(removed, 0)::int as removed_lines,
       md5(case when d.text is null then null else coalesce(o.text, '') end) as text_md5
from documents d left join o on d.doc_id = o.doc_id
"""
