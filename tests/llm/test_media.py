import hashlib
import io
import zlib

import numpy as np
import pytest

from seatloom.llm import media


def test_formats_round_trip():
    rng = np.random.default_rng(1)
    for shape in ((1, 1, 3), (5, 7, 3), (3, 64, 3)):
        pixels = rng.integers(0, 256, shape, np.uint8)
        for encode in (media.encode_netpbm, media.encode_bmp):
            assert (media.decode_image(encode(pixels)) == pixels).all()
        plane = pixels[:, :, 0]
        assert (media.decode_image(media.encode_netpbm(plane)) == plane).all()
        text = f"P3 # remark\n{shape[1]} {shape[0]}\n255\n" + " ".join(map(str, pixels.reshape(-1)))
        assert (media.decode_image(text.encode()) == pixels).all()
        bits = plane % 2
        packed = f"P4\n{shape[1]} {shape[0]}\n".encode() + np.packbits(bits, axis=1).tobytes()
        plain = f"P1\n{shape[1]} {shape[0]}\n" + "".join(map(str, bits.reshape(-1)))
        assert (media.decode_image(packed) == (1 - bits) * 255).all() and (media.decode_image(plain.encode()) == (1 - bits) * 255).all()
    wide = b"P5 2 1 65535\n" + np.array([0, 65535], ">u2").tobytes()
    assert media.decode_image(wide).tolist() == [[0, 255]]


@pytest.mark.parametrize("data", [b"", b"P6", b"P6\n2 2\n255\nxx", b"P9\n1 1\n255\n", b"BM", b"P5\n0 5\n255\n", b"BM" + b"\0" * 60, b"P5 999999999999 9999999999 255 xx", b"P4 99999999 99999999 x", b"P1 2 1 12", b"P2 1 1 9 10", b"P3 1 1 255 1 2 99999999999999999999", b"P2 1 1 9 -1", b"P5 1 1 9 x", b"BM" + b"\xff" * 60])
def test_broken_images_are_value_errors(data):
    with pytest.raises(ValueError):
        media.decode_image(data)


def test_area_resize_is_the_exact_mean():
    rng = np.random.default_rng(2)
    for h, w, oh, ow in ((7, 5, 3, 2), (8, 9, 8, 9), (2, 3, 4, 9), (33, 64, 8, 9)):
        plane = rng.integers(0, 256, (h, w))
        fine = np.kron(plane, np.ones((oh, ow)))  # each cell of the target is a block of these
        want = fine.reshape(oh, h, ow, w).mean((1, 3))
        assert all(np.allclose(media.area_resize(plane, oh, ow, band), want) for band in (1, 13, 1 << 18))


def plain_hash(plane):
    """The difference hash from exact cell means."""
    h, w = plane.shape
    fine = np.kron(plane, np.ones((8, 9), int)).reshape(8, h, 9, w).sum((1, 3))  # means times h * w
    return f"{int(''.join(str(int(a < b)) for row in fine.tolist() for a, b in zip(row, row[1:])), 2):016x}"


def test_difference_hash_is_exact():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (3, 64), (17, 64), (40, 9), (8, 9), (100, 33)):
        plane = rng.integers(0, 256, shape)
        assert media.difference_hash(plane) == plain_hash(plane) and media.difference_hash(plane) == media.difference_hash(plane.astype(np.uint8))
    rgb = rng.integers(0, 256, (50, 64, 3), np.uint8)
    assert media.difference_hash(rgb) == plain_hash(rgb.astype(int) @ [299, 587, 114] // 1000)


def test_form_follows_the_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b" * 193), (3, None)], "doc_id bigint, text string")
    assert {r.doc_id: bytes(r.media[:2]) for r in media.text_images(df).collect()} == {1: b"P6", 2: b"BM", 3: b"P6"}


def test_payloads_come_back(edges, edge_rows, nothing):
    for form in ("ppm", "bmp", None):
        rows = media.media_features(media.text_images(edges, form=form), digests=True, size_col="n_bytes").collect()
        assert len(rows) == len(edge_rows)
        want = []
        for row in edge_rows:
            data = (row[1] or "").encode()
            payload = data + b" " * (-len(data) % 192 if data else 192)
            want.append((row[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
        key = lambda x: str(x)
        assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=key) == sorted(want, key=key)
        assert all(np.load(io.BytesIO(r.tile_npy)).shape == (16, 16) and len(r.dhash) == 16 for r in rows)
        assert media.media_features(media.text_images(nothing, form=form)).count() == 0


def test_unreadable_media_are_null(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id bigint, media binary")
    assert [r.dhash for r in media.media_features(df).collect()] == [None, None]
