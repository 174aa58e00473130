"""Media: decoders, area resize, tiles, and the round trip of texts."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from larderlake.llm import media

RNG = np.random.default_rng(5)


def bmp(x, bits, down=True, palette=None):
    h, w = x.shape[:2]
    rows = []
    for r in x[::-1] if not down else x:
        if bits == 24:
            raw = r[:, ::-1].tobytes()
        elif bits == 32:
            raw = np.concatenate([r[:, ::-1], np.full((w, 1), 255, np.uint8)], 1).tobytes()
        else:
            raw = np.packbits(((r[:, None] >> np.arange(bits)[::-1]) & 1).astype(np.uint8).ravel()).tobytes()
        rows.append(raw + b"\0" * (-len(raw) % 4))
    pal = b"" if palette is None else np.concatenate([palette[:, ::-1], np.zeros((len(palette), 1), np.uint8)], 1).tobytes()
    body = b"".join(rows)
    at = 54 + len(pal)
    return b"BM" + struct.pack("<IHHI", at + len(body), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, -h if down else h, 1, bits, 0, len(body), 0, 0, 0, 0) + pal + body


def test_netpbm():
    x = RNG.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.ppm(x)) == x).all() and (media.decode(media.ppm(x[:, :, :1])) == x[:, :, :1]).all()
    text = b"P3 # c\n7 5\n# more\n255\n" + b" ".join(str(v).encode() for v in x.ravel())
    assert (media.decode(text) == x).all()
    bits = RNG.integers(0, 2, (3, 11), dtype=np.uint8)
    grey = (1 - bits[:, :, None]) * 255
    assert (media.decode(b"P1\n11 3\n" + b"".join(str(b).encode() for b in bits.ravel())) == grey).all()
    assert (media.decode(b"P4\n11 3\n" + np.packbits(bits, axis=1).tobytes()) == grey).all()
    deep = RNG.integers(0, 1001, (4, 4), dtype=np.uint16)
    assert (media.decode(b"P5 4 4 1000\n" + deep.astype(">u2").tobytes())[:, :, 0] == np.floor(deep.astype(int) * 255 / 1000 + 0.5)).all()
    assert (media.decode(b"P2 2 1 15 0 15") == [[[0], [255]]]).all()


@pytest.mark.parametrize("down", [True, False])
def test_bmp(down):
    x = RNG.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(bmp(x, 24, down)) == x).all() and (media.decode(bmp(x, 32, down)) == x).all()
    for bits in (1, 4, 8):
        pal = RNG.integers(0, 256, (1 << bits, 3), dtype=np.uint8)
        i = RNG.integers(0, 1 << bits, (5, 9), dtype=np.uint8)
        assert (media.decode(bmp(i, bits, down, pal)) == pal[i]).all()


@pytest.mark.parametrize("data", [b"", b"P6", b"P6 2 2 255\n123", b"P6 0 1 255\n", b"P5 1 1 0\n1", b"BM", b"BM" + b"\0" * 60, b"GIF89a", b"P2 1 1 5 9", b"P3 1 1 255 1 2"])
def test_bad_media(data):
    with pytest.raises((ValueError, struct.error)):
        media.decode(data)


@pytest.mark.parametrize(("h", "w", "th", "tw"), [(8, 9, 8, 9), (16, 18, 8, 9), (5, 7, 3, 2), (3, 2, 7, 5), (1, 1, 4, 4), (13, 64, 32, 32)])
def test_area_resize(h, w, th, tw):
    x = RNG.integers(0, 256, (h, w, 3), dtype=np.uint8)
    want = np.zeros((th, tw, 3))
    for i in range(th):  # by splitting every pixel into th x tw parts
        for j in range(tw):
            big = x[np.arange(i * h, (i + 1) * h) // th][:, np.arange(j * w, (j + 1) * w) // tw]
            want[i, j] = big.reshape(-1, 3).mean(0)
    assert (media.area_resize(x, th, tw) == np.floor(want + 0.5 + 1e-9)).all()


def test_npy_and_hash():
    x = RNG.integers(0, 256, (32, 32, 3), dtype=np.uint8)
    assert (np.load(io.BytesIO(media.npy(x))) == x).all()
    ramp = np.tile(np.arange(90, dtype=np.uint8), (16, 1))[:, :, None]
    assert media.difference_hash(ramp) == "ff" * 8 and media.difference_hash(ramp[:, ::-1]) == "00" * 8


def test_tiles(spark):
    x = RNG.integers(0, 256, (9, 9, 3), dtype=np.uint8)
    df = spark.createDataFrame([(1, bytearray(media.ppm(x)), "keep"), (2, None, None), (3, bytearray(b"junk"), "keep")], "id int, img binary, media_hash string")
    got = {r.id: r for r in media.media_tiles(df, "img", 4, 4).collect()}
    assert (np.load(io.BytesIO(got[1].media_tile)) == media.area_resize(x, 4, 4)).all() and got[1].media_hash == media.difference_hash(x) and got[1].media_error is None
    assert (got[2].media_tile, got[2].media_hash, got[2].media_error) == (None, None, None) and got[3].media_tile is None and got[3].media_error


def test_texts(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "a", "long " * 40000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in media.media_digests(media.text_media(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        form = media.ppm(np.frombuffer(pad, np.uint8).reshape(-1, 64, 3))
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
    assert got[0][2:] == got[1][2:] and got[2][1:] == got[6][1:]


def test_query(spark, small):
    from larderlake.llm.media import query

    docs = {r.doc_id: r.text for r in spark.read.parquet(small + "/documents.parquet").collect()}
    got = query(spark, small).collect()
    assert {r.doc_id: r.n_bytes for r in got} == {k: len(v.encode()) for k, v in docs.items()}


@pytest.mark.parametrize("data", [b"P2 1 1 255 99999999999999999999999", b"P3 99999999999999999999 1 255 1", b"P5 1 1 99999999999999999999999\n1"])
def test_huge_numbers(data):
    with pytest.raises(ValueError):
        media.decode(data)


def masked(masks, bits, pixels, compression=3):
    rows = b"".join(r + b"\0" * (-len(r) % 4) for r in (x.astype(f"<u{bits // 8}").tobytes() for x in pixels[::-1]))
    h, w = pixels.shape
    more = struct.pack("<III", *masks) if compression == 3 else b""
    at = 54 + len(more)
    return b"BM" + struct.pack("<IHHI", at + len(rows), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, compression, len(rows), 0, 0, 0, 0) + more + rows


def test_bmp_masks():
    pixel = np.array([[10 | 20 << 8 | 30 << 16]])
    assert media.decode(masked((0xFF, 0xFF00, 0xFF0000), 32, pixel)).tolist() == [[[10, 20, 30]]]
    assert media.decode(masked((0xFF0000, 0xFF00, 0xFF), 32, pixel)).tolist() == [[[30, 20, 10]]]
    x = RNG.integers(0, 1 << 16, (3, 5))
    scaled = lambda v, top: (v * 510 + top) // (2 * top)
    assert (media.decode(masked((0xF800, 0x7E0, 0x1F), 16, x)) == np.stack([scaled(x >> 11, 31), scaled(x >> 5 & 63, 63), scaled(x & 31, 31)], 2)).all()
    assert (media.decode(masked((0,) * 3, 16, x, 0)) == np.stack([scaled(x >> 10 & 31, 31), scaled(x >> 5 & 31, 31), scaled(x & 31, 31)], 2)).all()
    with pytest.raises(ValueError):
        media.decode(masked((0xF0F, 0, 0), 32, pixel))


def test_feature_of_texts(spark):
    """Difference hash and tile of texts, by the area of each target pixel in exact fractions."""
    from fractions import Fraction

    def resized(image, height, width):
        h, w, c = image.shape
        out = np.zeros((height, width, c), np.uint8)
        for i in range(height):
            for j in range(width):
                y0, y1, x0, x1 = Fraction(i * h, height), Fraction((i + 1) * h, height), Fraction(j * w, width), Fraction((j + 1) * w, width)
                ys = [(y, min(y1, y + 1) - max(y0, y)) for y in range(int(y0), -int(-y1 // 1))]
                xs = [(x, min(x1, x + 1) - max(x0, x)) for x in range(int(x0), -int(-x1 // 1))]
                for k in range(c):
                    out[i, j, k] = int(sum(int(image[y, x, k]) * a * b for y, a in ys for x, b in xs) / ((y1 - y0) * (x1 - x0)) + Fraction(1, 2))
        return out

    rows = [(1, "some text of an image, repeated " * 30), (2, None), (3, "é漢" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.feature for r in media.media_digests(media.text_media(df)).collect()}
    for d, t in rows:
        image = np.frombuffer(media.payload(t), np.uint8).reshape(-1, 64, 3)
        grey = (image.astype(np.int64) @ np.array([299, 587, 114]) // 1000).astype(np.uint8)[:, :, None]
        small = resized(grey, 8, 9)[:, :, 0]
        tile = io.BytesIO()
        np.lib.format.write_array(tile, resized(image, 32, 32), version=(1, 0))
        assert got[d] == f"{np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()}:{zlib.crc32(tile.getvalue()):08x}"
