import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from voxmill.llm import media as M


def test_round_trips():
    r = np.random.default_rng(0)
    for shape in ((1, 1), (3, 5), (7, 576), (4, 6, 3), (1, 1, 3)):
        p = r.integers(0, 256, shape, dtype=np.uint8)
        assert (M.decode_image(M.encode_pnm(p)) == p).all()
        assert (M.decode_image(M.encode_bmp(p)) == p).all()


def test_plain_and_bit_formats():
    assert M.decode_image(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert M.decode_image(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert M.decode_image(b"P2 2 1 15\n0 15").tolist() == [[0, 255]]
    assert M.decode_image(b"P3 1 1 255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert M.decode_image(b"P5 2 1 65535\n" + struct.pack(">HH", 0, 65535)).tolist() == [[0, 255]]


def test_area_resize_is_exact_mean():
    r = np.random.default_rng(1)
    p = r.integers(0, 256, (12, 18), dtype=np.uint8)
    assert np.allclose(M.area_resize(p, 4, 6), p.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    q = r.integers(0, 256, (5, 7), dtype=np.uint8)
    big = np.kron(q, np.ones((8, 9)))  # whole pixels after scaling
    assert np.allclose(M.area_resize(q, 8, 9), big.reshape(8, 5, 9, 7).mean(axis=(1, 3)))
    assert np.allclose(M.area_resize(q, 1, 1), q.mean())


def test_query_columns(spark):
    texts = [None, "", "a", "é" * 288, "x" * 576, "long words " * 20000, "x" * 576]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in M.media_digests(M.text_to_media(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        stored = M.encode_pnm(np.frombuffer(payload, np.uint8).reshape(-1, 576))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[4].feature == got[6].feature and got[0].feature == got[1].feature
    assert M.media_digests(M.text_to_media(df.where("false"))).count() == 0


def test_media_columns(spark):
    p = np.arange(64, dtype=np.uint8).reshape(8, 8)
    rows = [(1, M.encode_bmp(p)), (2, b"no image"), (3, None), (4, b"P5 9 9 255\nx"), (5, b"")]
    got = {r.id: r for r in M.media_columns(spark.createDataFrame([(i, bytearray(d) if d is not None else None) for i, d in rows], "id long, data binary")).collect()}
    assert (got[1].height, got[1].width, got[1].channels, got[1].dhash) == (8, 8, 1, M.difference_hash(p))
    assert np.load(io.BytesIO(bytes(got[1].tile))).shape == (16, 16)
    assert got[2].error and got[4].error and got[5].error and got[3].error is None and got[3].tile is None


@pytest.mark.parametrize("bad", [b"BM", b"BM" + b"\0" * 60, b"P5", b"P7\n"])
def test_bad_bytes_raise_value_errors(bad):
    with pytest.raises((ValueError, IndexError, struct.error)):
        M.decode_image(bad)


@pytest.mark.parametrize("header", [b"P5 99999999999999999999 9 255", b"P5 9999999 9999999 255 ", b"P4 99999999999 9999999\n", b"P2 0 5 255\n", b"P5 " + b"9" * 5000 + b" 1 255 x"])
def test_oversized_headers_give_an_error_column(spark, header):
    """Headers that claim more than the bytes hold are errors of their row, not of the job."""
    rows = spark.createDataFrame([(1, bytearray(header)), (2, bytearray(M.encode_pnm(np.ones((2, 2), np.uint8))))], "id long, data binary")
    got = {r.id: r for r in M.media_columns(rows).collect()}
    assert got[1].error and got[1].tile is None and got[2].error is None and got[2].height == 2


def test_tall_payloads_are_bmp_and_tiles_are_npy(spark):
    texts = ["short", "y" * 576 * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r.doc_id: bytes(r.media) for r in M.text_to_media(df, tall=64).collect()}
    assert stored[0][:2] == b"P5" and stored[1][:2] == b"BM"
    for r in M.media_digests(M.text_to_media(df, tall=64)).collect():
        payload, _ = M.pack_text(texts[r.doc_id])
        pixels = np.frombuffer(payload, np.uint8).reshape(-1, 576)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert (np.load(io.BytesIO(bytes(r.tile))) == np.clip(np.rint(M.area_resize(pixels, 16, 16)), 0, 255)).all()
