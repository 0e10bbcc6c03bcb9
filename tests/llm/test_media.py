"""Exact round trips, and area means by a plain loop."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from tilewright.llm import entry, media


def test_netpbm_and_bmp_round_trip():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 5), (8, 64), (7, 2)):
        image = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        assert (media.decode(media.encode_netpbm(image)) == image).all()
        assert (media.decode(media.encode_bmp(image)) == image).all()
        assert (media.decode(media.encode_netpbm(image[:, :, :1])) == image[:, :, :1]).all()


def test_other_forms():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n010")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4 3 2\n" + bytes([0b10100000, 0b01000000]))[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1\n15\n15 0").ravel().tolist() == [255, 0]
    assert media.decode(b"P3 1 1 255 7 8 9").ravel().tolist() == [7, 8, 9]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_resize_is_the_mean_over_areas():
    image = np.random.default_rng(2).integers(0, 256, (5, 7, 2)).astype(np.uint8)
    big = image.repeat(3 * 4, 0).repeat(2 * 5, 1).astype(float)  # every output border falls on a cell border
    want = big.reshape(3, 20, 2, 35, 2).mean((1, 3))
    assert np.allclose(media.resize(image, 3, 2), want)
    assert np.allclose(media.resize(image, 5, 7), image)


def test_resize_of_tall_images_by_bands(monkeypatch):
    image = np.random.default_rng(3).integers(0, 256, (1003, 64, 3)).astype(np.uint8)
    whole = media.resize(image, 16, 16)
    monkeypatch.setattr(media, "BAND", 7)
    assert np.allclose(media.resize(image, 16, 16), whole) and whole.mean() == pytest.approx(image.mean())


def test_both_forms_give_the_payload_back():
    rng = np.random.default_rng(4)
    for rows in (1, 2, 7, 4000):
        payload = rng.integers(0, 256, 192 * rows).astype(np.uint8).tobytes()
        stored = {form: media.encode_payload(payload, form) for form in media.FORMS}
        assert stored["netpbm"][:2] == b"P6" and stored["bmp"][:2] == b"BM"
        assert all(media.decode(m).tobytes() == payload for m in stored.values())


def test_query_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").union(spark.createDataFrame([(None, None, ""), (7, "", ""), (7, "é" * random.Random(1).randrange(5000), "")], "doc_id long, text string, lang string"))
    stored = media.features(media.store(docs, ("doc_id", "text")), ("doc_id", "text"))
    for row in stored.collect():
        text = (row.text or "").encode()
        want = text + b" " * (-len(text) % 192 or 192 * (not text))
        assert bytes(row.payload) == want and row.tail_crc32 == zlib.crc32(want[-16:])
        assert np.load(io.BytesIO(row.tile)).shape == (16, 16, 3)
    wide = spark.createDataFrame([(1, "x" * 2_000_003, "m", 2, 3, "f")], "doc_id long, text string, media string, n_bytes int, payload int, feature string")
    assert entry.media_digests(wide).first().payload_bytes == 2_000_003 + -2_000_003 % 192
    digests = entry.media_digests(docs).collect()
    assert len(digests) == docs.count()
    first = next(r for r in digests if r.doc_id is None)
    assert (first.n_bytes, first.payload_bytes, first.payload_sha256) == (0, 192, hashlib.sha256(b" " * 192).hexdigest())
    assert entry.media_digests(docs.limit(0)).count() == 0
