import hashlib
import io
import zlib

import numpy as np
import pytest

from vertexloom.llm import media

RNG = np.random.default_rng(2)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (64, 64), (200, 7)])
def test_stored_forms_come_back(shape):
    pixels = RNG.integers(0, 256, shape, dtype=np.uint8)
    for encode in (media.encode_pgm, media.encode_bmp):
        assert (media.decode(encode(pixels)) == pixels).all()


def test_other_forms():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15\n3 15").tolist() == [[3, 15]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P5 1 2 65535\n" + bytes([1, 0, 0, 2])).tolist() == [[256], [2]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P7 1 1", b"P5 2 2 255\n\x00", b"GIF89a"):
        with pytest.raises((ValueError, IndexError)):
            media.decode(bad)


def test_area_means(monkeypatch):
    image = RNG.integers(0, 256, (37, 23)).astype(np.uint8)
    want = np.zeros((5, 4))
    big = np.kron(image, np.ones((5, 4)))
    for i in range(5):
        for j in range(4):
            want[i, j] = big[i * 37 : (i + 1) * 37, j * 23 : (j + 1) * 23].mean()
    assert np.allclose(media.area_resize(image, (5, 4)), want)
    for strip in (1, 3, 36):
        monkeypatch.setattr(media, "STRIP", strip)
        assert np.allclose(media.area_resize(image, (5, 4)), want)
    assert np.allclose(media.area_resize(image[:1, :1], (8, 9)), image[0, 0])


def test_hash_tells_slopes():
    ramp = np.tile(np.arange(64, dtype=np.uint8), (64, 1))
    assert media.difference_hash(ramp) == "f" * 16 and media.difference_hash(ramp[:, ::-1]) == "0" * 16


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_columns_of_odd_texts(odd, form):
    rows = media.media_columns(odd, form=form).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert media.decode(bytes(r.media)).tobytes() == payload
        assert np.load(io.BytesIO(r.tile_npy)).shape == media.TILE_SHAPE
    assert len({r.dhash for r in rows if r.doc_id in (4, 5)}) == 1 and len({r.media_sha256 for r in rows if r.doc_id in (0, 1)}) == 1


def test_empty_table(none):
    assert media.media_columns(none).count() == 0
