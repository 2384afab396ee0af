"""Line chunks against plain Python, and rows of any kind."""

import hashlib
import random
import re

from voxmill.llm import line_dedup as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def md5(x: str) -> str:
    return hashlib.md5(x.encode()).hexdigest()


def cut(text: str) -> list[list[str]]:
    out: list[list[str]] = []
    lines = text.split("\n")
    long = [len(WORD.findall(x)) >= L.LONG for x in lines]
    for i, line in enumerate(lines):
        before = md5(lines[i - 2]) if i > 1 else ""
        if not i or long[i] or long[i - 1] or md5(before + md5(lines[i - 1]))[0] in "0123":
            out.append([])
        out[-1].append(line)
    return out


def brute(docs: dict[int, str | None]) -> dict[int, str | None]:
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        if text is None:
            out[i] = None
            continue
        left = []
        for c in cut(text):
            whole = "\n".join(c)
            fit = len(c) > 1 and WORD.search(whole) or len(WORD.findall(whole)) >= L.LONG
            if not (fit and whole in seen):
                left += c
            if fit:
                seen.add(whole)
        out[i] = "\n".join(left)
    return out


def corpus() -> dict[int, str | None]:
    r = random.Random(8)
    passages = ["\n".join(f"line {r.randrange(10**6)} of passage {p}" for _ in range(r.randrange(2, 12))) for p in range(6)]
    passages += [" ".join(f"w{r.randrange(1000)}" for _ in range(n)) for n in (49, 50, 120)]
    docs: dict[int, str | None] = {0: None, 1: "", 2: "\n", 3: "\n\n\n", 4: "\n\n\n", 5: "one line", 6: "one line"}
    for i in range(7, 60):
        own = [f"own {r.randrange(10**9)}" for _ in range(r.randrange(5))]
        parts = [*own, *r.choices(passages, k=r.randrange(4))]
        r.shuffle(parts)
        docs[i] = "\n".join(parts)
    return docs


def test_equals_plain_python(spark):
    docs = corpus()
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.text for r in L.dedup_lines(frame).collect()}
    assert got == brute(docs)
    assert any(docs[i] and got[i] == "" for i in docs) and any(got[i] == docs[i] and docs[i] for i in docs)


def test_rows_of_any_kind(spark):
    """Null and empty texts stay, rows equal in every column are treated alike, null ids come last, clashing names do no harm."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(2, f"a\n{passage}", 1, "x"), (2, f"a\n{passage}", 1, "x"), (None, passage, 2, None), (1, None, 3, "x"), (3, "", 4, "x"), (4, f"b\n{passage}", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h int, gone string").withColumnRenamed("gone", "k")
    got = sorted(((r.doc_id or 99, r.text or "", r.h, r.n) for r in L.dedup_lines(docs, removed="n").collect()), key=str)
    assert got == sorted([(2, f"a\n{passage}", 1, 0)] * 2 + [(99, "", 2, 1), (1, "", 3, 0), (3, "", 4, 0), (4, "b", 5, 1)], key=str)
    assert L.dedup_lines(docs.limit(0)).count() == 0
