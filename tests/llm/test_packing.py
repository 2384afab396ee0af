import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxmill.llm import packing as P

from ..oracle import SF

ODD = [
    None, "", " ", "one", "One. Two! Three?\nfour\nfive 3.14 e.g. this \"that.\" (so.) end", "naïve café. Über alles! ÄÖ\x85x\xa0. y", "a\x1cb .\x1c c!\x1f",
    "日本語。テスト！ もう一つ。", "x" * 9000, "word " * 9000, "<|endoftext|> is text. so.", "it's we're they'll. 'tis", ". . . !!! ???\n\n\n", "q.\r\nr!\tz",
]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tok.no_truncation()
    tok.no_padding()
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]


def held(rows, ids_of, length=4096):
    """Checks every promise of the pieces of documents ``ids_of`` (id: its ids, all different); gives the padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(ids_of)
    for i, parts in docs.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids_of[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids_of[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids_of[i])
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_query_packs_every_document_with_little_padding(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ids = {i: library(t) for i, t in texts.items()}
    padding = held(P.op13_packing(spark, SF).collect(), ids)
    assert padding < 0.01 * sum(map(len, ids.values()))


@pytest.mark.parametrize(("length", "chunk"), [(4096, 1 << 20), (64, 200), (16, 1), (100, 5000)])
def test_odd_texts_extra_columns_and_small_chunks(spark, library, length, chunk):
    docs = spark.createDataFrame([(i, t, i, "s") for i, t in enumerate(ODD)], "doc_id long, text string, part int, start string")
    got = P.pack(docs.repartition(2, "doc_id"), length=length, chunk=chunk).collect()
    held(got, {i: library(t) for i, t in enumerate(ODD)}, length)


def test_order_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "b b"), (5, "b b"), (None, "c"), (1, None), (2, "z z z")], "doc_id long, text string").coalesce(1)
    got = sorted(P.pack(docs, length=4).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert [r.doc_id for r in got if r.start == 0] == [5, 5, None, 1, 2]
    assert sum(r.length for r in got) == 3 + 3 + 2 + 1 + 4
    assert P.pack(docs.where("doc_id = 77")).count() == 0


def test_sentences_are_marked():
    coder = P.SentenceEncoder(P.tokenizer_path())
    ends = lambda t: [coder.tokens[i & (P._MARK - 1)] for i in coder.marked(t).tolist() if i & P._MARK]
    assert ends("one 3.14 two. three! four\nfive a.b 7\nsix") == [".</w>", "!</w>", "four</w>", "7</w>"]
    assert ends("日本 語。 x y!") == [coder.tokens[coder.encode_unit("語。")[-1]], "!</w>"]
    assert not ends("no end here, at all; none")


def brute(at, price, length):
    best = {at[0]: 0}
    for i, here in enumerate(at[1:], 1):
        best[here] = min(best[j] + int(price[i]) + P.EACH + (0 if (here - j) & (here - j - 1) == 0 else length - (here - j)) for j in at[:i] if here - j <= length)
    return best[at[-1]]


@pytest.mark.parametrize("seed", range(8))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    length = (16, 64, 100, 33)[seed % 4]
    lengths = rng.integers(1, 3 * length, 12)
    ends = np.unique(rng.integers(1, lengths.sum(), 40))
    at, price = P.places(lengths, ends, length)
    assert np.diff(at).max() <= length and set(np.cumsum(lengths)) <= set(at)
    found = P.cuts(at, price, length)
    assert found[0] == 0 and found[-1] == lengths.sum() and np.diff(found).max() <= length
    of = dict(zip(at.tolist(), price.tolist(), strict=True))
    cost = sum(of[b] + P.EACH + (0 if (b - a) & (b - a - 1) == 0 else length - (b - a)) for a, b in zip(found[:-1].tolist(), found[1:].tolist(), strict=True))
    assert cost == brute(at.tolist(), price, length)
