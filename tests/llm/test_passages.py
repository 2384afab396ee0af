"""Whole repeated passages, however content-defined boundaries cut them."""

import random

from voxmill.llm import line_dedup as L

from .test_line_dedup import WORD, brute, corpus, cut


def passages(docs):
    """Every line of a run of LONG words or more that occurs earlier, of a repeated chunk, or of a repeated text goes."""
    seen, out = set(), {}
    for doc, text in sorted(docs.items()):
        if text is None:
            out[doc] = None
            continue
        lines, gone, at, runs = text.split("\n"), set(), 0, []
        n = [len(WORD.findall(x)) for x in lines]
        for c in cut(text):
            if len(c) > 1 and any(n[at : at + len(c)]):
                runs.append((at, at + len(c), "chunk"))
            at += len(c)
        if any(n):
            runs.append((0, len(lines), "text"))
        for i in range(len(lines)):
            runs += [(i, j, "run") for j in range(i + 1, len(lines) + 1) if n[i] and n[j - 1] and sum(n[i:j]) >= L.LONG]
        for i, j, kind in sorted(runs):
            what = kind, tuple(lines[i:j])
            if what in seen:
                gone.update(range(i, j))
            seen.add(what)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def run(spark, docs):
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)
    return {r.doc_id: r.text for r in L.dedup_passages(frame).collect()}


def test_short_lines_in_differing_contexts(spark):
    """Passages of 2 to 6 lines of under 50 words (over 50 together) between differing neighbours go whole, in every later document."""
    r = random.Random(4)
    docs, own = {}, {}
    for p in range(25):
        n = 2 + p % 5
        passage = [" ".join(f"p{p}l{i}w{j}" for j in range(26 if n == 2 else 9 + 40 // n)) for i in range(n)]
        for c in range(4):
            before, after = ([f"own {r.randrange(10**9)} {k}" for k in range(r.randrange(1, 4))] for _ in range(2))
            docs[100 * c + p], own[100 * c + p] = "\n".join(before + passage + after), "\n".join(before + after)
    got = run(spark, docs)
    assert got == {i: docs[i] if i < 100 else own[i] for i in docs}
    assert brute(docs) != got  # the chunks alone lose passages


def test_head_and_tail_go_with_the_passage(spark):
    """Boundaries at a passage's edges depend on its neighbours; the passage goes whole, from its first to its last line."""
    r = random.Random(6)
    passage = [" ".join(f"p{i}w{j}" for j in range(r.randrange(2, 30))) for i in range(30)]
    around = {c: (f"before {c} {r.random()}", f"after {c} {r.random()}") for c in range(8)}
    docs = {c: "\n".join([a, *passage, b]) for c, (a, b) in around.items()}
    assert run(spark, docs) == {c: docs[c] if c == 0 else "\n".join(around[c]) for c in docs}
    left = {x for c, t in brute(docs).items() if c for x in t.split("\n")}
    assert left & {passage[0], passage[-1]}  # the chunks alone keep edges


def test_equals_plain_python(spark):
    r = random.Random(9)
    docs = corpus()
    line = [" ".join(f"v{i}x{j}" for j in range(r.choice((0, 1, 8, 20, 49, 60)))) for i in range(14)]
    for i in range(100, 140):
        docs[i] = "\n".join(r.choices(line, k=r.randrange(1, 12)))
    docs |= {200: docs[110], 201: "\n\n" + docs[7] + "\n", 202: "\n\n" + docs[7] + "\n", 203: None, 204: "a\n\nb", 205: "a\n\nb"}
    got = run(spark, docs)
    assert got == passages(docs)
    assert got[200] == got[202] == got[205] == "" and got[204]


def test_rows_of_any_kind(spark):
    passage = "\n".join(" ".join(f"p{i}x{j}" for j in range(30)) for i in range(2))
    rows = [(2, f"a\n{passage}", 1, "x"), (2, f"a\n{passage}", 1, "x"), (None, passage, 2, None), (1, None, 3, "x"), (3, "", 4, "x"), (4, f"b\n{passage}", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h int, of string").withColumnRenamed("of", "k")
    got = sorted(((r.doc_id or 99, r.text or "", r.h, r.n) for r in L.dedup_passages(docs, removed="n").collect()), key=str)
    assert got == sorted([(2, f"a\n{passage}", 1, 0)] * 2 + [(99, "", 2, 2), (1, "", 3, 0), (3, "", 4, 0), (4, "b", 5, 2)], key=str)
    assert L.dedup_passages(docs.limit(0)).count() == 0
