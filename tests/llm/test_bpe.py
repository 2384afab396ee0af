"""Tree concatenation against the tokenizers library itself."""

import hashlib
import random

import pytest

from voxmill.llm import bpe


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    return tok


def expected(plain, text):
    ids = plain.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))


def texts():
    r = random.Random(5)
    alphabet = "ab é ß 漢 \n\t'1.-_ ́Iİ<|"
    made = ["".join(r.choices(alphabet, k=r.randrange(1, 300))) for _ in range(60)]
    return [
        "", None, " ", "\n\n", "Hello, world! It's 2024.", "<|endoftext|> and <|startoftext|>x", "a" * 5000, "ab" * 3000 + "!" * 700,
        "".join(r.choices("abcdefgh", k=6000)), "漢字" * 900, "é" * 400, "x y z", "\x00\x1f", "👩‍👩‍👧 " * 50, *made,
    ]


@pytest.mark.parametrize("sizes", [{}, {"leaf_text": 32, "leaf_word": 8, "window": 1}], ids=["production", "small leaves"])
def test_digests_equal_the_library(plain, sizes):
    coder = bpe.TreeEncoder(bpe.tokenizer_path(), **sizes)
    for t in texts():
        assert coder.digest(t) == expected(plain, t), repr(t)[:80]
        ids = coder.encode(t)
        assert ids == plain.encode(t or "", add_special_tokens=False).ids
        assert coder.decode(ids) == plain.decode(ids, skip_special_tokens=False)


def test_rows_of_any_kind(spark, plain):
    """Null and empty texts have no tokens, repeated rows stay, a column of an output's name is replaced, others stay."""
    rows = [(1, None, "x", 5), (2, "", "x", 5), (3, "some words", "x", 5), (3, "some words", "x", 5), (None, "w" * 2000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int")
    got = bpe.encode_digests(docs).orderBy("doc_id").collect()
    assert len(got) == 5 and set(got[0].asDict()) == {"doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"}
    for r, t in zip(got, ["w" * 2000, None, "", "some words", "some words"], strict=True):
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(plain, t)
    assert bpe.encode_digests(docs.limit(0)).count() == 0


def test_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: expected(plain, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_bpe_tree(spark, sf).collect()} == want
