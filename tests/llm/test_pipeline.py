import corpus_pipeline as P
from voxmill.llm import bpe

LANG = "en"


def words(k, n):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_stages_on_a_small_corpus(spark, tmp_path):
    passage = words("shared", 60)
    rows = [(1, words(1, 80), LANG, "a"), (2, words(2, 80) + "\n" + passage, LANG, "b"), (3, words(3, 80) + "\n" + passage + "\n" + words(33, 30), LANG, "b")]
    rows += [(4, words(1, 80), LANG, "c"), (5, None, None, None), (6, "", LANG, "a"), (7, words(7, 300), LANG, None)]
    rows += [(100 + i, words(f"t{i}", 30) + (" nastyword" if i % 3 == 0 else ""), LANG, "a") for i in range(120)]
    df = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, int(i % 3 == 0)) for i in range(110)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = df, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path)).cache()
        if name != "bpe":
            assert out.columns == df.columns
        seen[name] = out.collect()
        docs = out
    after = {k: [r.doc_id for r in v] for k, v in seen.items()}
    toxic = {100 + i for i in range(120) if i % 3 == 0}
    assert not toxic & set(after["toxicity"]) and set(after["toxicity"]) >= {r[0] for r in rows} - toxic
    by_id = {r.doc_id: r for r in seen["line_dedup"]}
    assert passage in by_id[2].text and passage not in by_id[3].text and by_id[3].n_chars == len(by_id[3].text)
    assert 4 not in by_id and by_id[1].text == rows[0][1]  # the copy's only line is a passage
    assert len(after["near_dedup"]) == len(set(after["near_dedup"])) and sum(i in (5, 6) for i in after["near_dedup"]) == 1
    assert set(after["mixing"]) <= set(after["near_dedup"])
    coder = bpe.TreeEncoder(bpe.tokenizer_path())
    texts = {r.doc_id: r.text for r in seen["mixing"]}
    assert sorted(after["bpe"]) == sorted(after["mixing"])
    for r in seen["bpe"]:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == coder.digest(texts[r.doc_id])


def test_one_document_of_each_group_of_exact_copies(spark):
    """Copies of several lines, short ones among them, leave no remnant."""
    rows = [(100 * c + g, "\n".join(words(f"g{g}l{i}", 5 + 7 * (i * g % 6)) for i in range(2 + g)), LANG, "a") for g in range(12) for c in range(4)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    lines = P.drop_repeated_lines(spark, docs, "").cache()
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == [(r[0], r[1]) for r in sorted(rows) if r[0] < 100]
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, lines, "").collect()) == list(range(12))


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def odd_rows(spark):
    """Repeated ids with differing and equal texts, null ids, null and empty texts, null sources, extra columns with names that the stages use."""
    r = [(1, words(1, 80), LANG, "a"), (1, words(2, 80), LANG, "a"), (1, words(1, 80), LANG, "a"), (2, words(3, 90), None, None), (None, words(4, 70), LANG, "b"), (None, words(5, 70), LANG, "b"), (3, None, LANG, "a"), (4, "", LANG, None), (5, words(6, 4), LANG, "b")]
    rows = [(i, t, g, s, len(t or ""), 7, 0.25, "x", k) for k, (i, t, g, s) in enumerate(r)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, score double, node string, _n int")


def test_stages_on_odd_rows(spark, tmp_path):
    """Each stage keeps what its docstring says and the columns as they are."""
    docs = odd_rows(spark)
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = lambda d: sorted((r.text or "") for r in d.collect())
    everything = texts(docs)
    stages = dict(P.STAGES)
    for name in ("toxicity", "line_dedup", "near_dedup", "mixing"):
        out = stages[name](spark, docs, str(tmp_path)).cache()
        assert out.columns == docs.columns, name
        got = texts(out)
        if name == "toxicity":
            assert got == everything
        elif name == "line_dedup":
            assert got == sorted([*everything[:2], *(t for t in set(everything) if t)])
        elif name == "near_dedup":
            assert got == sorted(set(everything))
        else:
            assert set(got) <= set(everything) and all(r.size == 7 and r.node == "x" for r in out.collect())
    assert stages["bpe"](spark, docs, str(tmp_path)).count() == 9


def test_rows_of_one_id_are_told_apart(spark):
    """Two documents that share an id are no near duplicates of each other; a copy of another document's text goes whatever its id."""
    from voxmill.llm import simhash

    rows = [(0, words(0, 60)), (1, words(1, 60)), (1, words(0, 60))]
    docs = spark.createDataFrame([(i, t, LANG, "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for keep in (lambda d: P.drop_near_duplicates(spark, d, ""), simhash.keep_one):
        assert sorted((r.doc_id, r.text) for r in keep(docs).collect()) == [rows[0], rows[1]]
