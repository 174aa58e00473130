"""Media columns: Netpbm and BMP to arrays, area resize by integral images, NPY tiles with difference hashes.

A decoded image is a uint8 array (height, width, channels), channels 1 or 3.
Null or undecodable media give null columns and an `error`; they never fail
the task. Samples of maxval other than 255 are scaled to 255, rounded half up.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, keep, table

ROW = 192  # bytes of one image row of a stored payload: 64 pixels of 3 samples
_HEAD = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([0-9]+)")


def decode(data: bytes) -> np.ndarray:
    """An image from Netpbm (P1 to P6) or BMP (1, 4, 8, 16, 24 or 32 bits, uncompressed, with colour masks or without). Raises ValueError."""
    try:
        return _decode(data)
    except (struct.error, OverflowError) as e:
        raise ValueError(f"bad number or short header: {e}") from e


def _decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _HEAD.match(data, at)
        if not m:
            raise ValueError("short header")
        head.append(int(m[1]))
        at = m.end()
    (w, h), top = head[:2], head[2] if len(head) == 3 else 1
    channels = 3 if kind in (3, 6) else 1
    n = w * h * channels
    if not n or not 0 < top < 65536:
        raise ValueError("empty image or bad maxval")
    if kind <= 3:
        text = re.sub(rb"#[^\r\n]*", b" ", data[at:])
        x = np.array(list(re.sub(rb"\s", b"", text)[:n]), np.int64) - 48 if kind == 1 else np.array(text.split()[:n], np.int64)
    elif kind == 4:
        row = -(-w // 8)
        raw = np.frombuffer(data, np.uint8, min(row * h, len(data) - at - 1), at + 1)
        if len(raw) < row * h:
            raise ValueError("short samples")
        x = np.unpackbits(raw.reshape(h, row), axis=1)[:, :w].ravel().astype(np.int64)
    else:
        wide = 1 + (top > 255)
        if len(data) - at - 1 < n * wide:
            raise ValueError("short samples")
        x = np.frombuffer(data, np.uint8 if wide == 1 else ">u2", n, at + 1)
    if len(x) < n or x.min() < 0 or x.max() > top:
        raise ValueError("short samples or a sample above maxval")
    if kind in (1, 4):
        x = 1 - x
    if top != 255:
        x = (x.astype(np.int64) * 510 + top) // (2 * top)
    return x.astype(np.uint8).reshape(h, w, channels)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("short header")
    at, size, w, h, _, bits, packed = struct.unpack_from("<4xI", data, 6)[0], *struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0, 3) or w <= 0 or h == 0 or bits not in (1, 4, 8, 16, 24, 32) or (packed == 3 and bits not in (16, 32)):
        raise ValueError("unsupported BMP")
    row, n = (w * bits + 31) // 32 * 4, abs(h)
    if len(data) < at + row * n:
        raise ValueError("short samples")
    x = np.frombuffer(data, np.uint8, row * n, at).reshape(n, row)
    if h > 0:
        x = x[::-1]
    if packed == 3 or bits == 16:
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        return _masked(np.ascontiguousarray(x[:, : w * bits // 8]).view(f"<u{bits // 8}"), masks)
    if bits >= 24:
        return np.ascontiguousarray(x[:, : w * bits // 8].reshape(n, w, bits // 8)[:, :, 2::-1])
    if bits < 8:
        x = np.unpackbits(x, axis=1).reshape(n, -1, bits)
        x = x.dot(1 << np.arange(bits)[::-1]).astype(np.uint8)
    colours = np.frombuffer(data, np.uint8, at - 14 - size, 14 + size)
    colours = colours[: len(colours) // 4 * 4].reshape(-1, 4)
    x = x[:, :w]
    if x.max() >= len(colours):
        raise ValueError("a pixel outside the palette")
    return np.ascontiguousarray(colours[x][:, :, 2::-1])


def _masked(pixels: np.ndarray, masks: tuple[int, ...]) -> np.ndarray:
    """The bits of each colour's mask, scaled to 255 and rounded half up; no mask: 0."""
    out = np.zeros((*pixels.shape, 3), np.uint8)
    for k, mask in enumerate(masks):
        if mask:
            shift = (mask & -mask).bit_length() - 1
            top = mask >> shift
            if top & (top + 1):
                raise ValueError("a colour mask with gaps")
            out[:, :, k] = (((pixels.astype(np.int64) & mask) >> shift) * 510 + top) // (2 * top)
    return out


def ppm(image: np.ndarray) -> bytes:
    """P6 or P5 bytes of an image."""
    h, w, c = image.shape
    return b"P%d\n%d %d\n255\n" % (6 if c == 3 else 5, w, h) + image.tobytes()


def npy(image: np.ndarray) -> bytes:
    """NPY bytes (format 1.0) of a tile."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel (fractional edges weighted), rounded half up."""
    h, w, c = image.shape
    total = np.zeros((h + 1, w + 1, c))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.arange(m + 1) * n  # in m-ths of a pixel, exact
        low = np.minimum(x // m, n - 1)
        return low, low + 1, (x - low * m) / m

    y0, y1, fy = at(h, height)
    x0, x1, fx = at(w, width)
    rows = total[y0] + (total[y1] - total[y0]) * fy[:, None, None]
    edge = rows[:, x0] + (rows[:, x1] - rows[:, x0]) * fx[None, :, None]
    sums = edge[1:, 1:] - edge[:-1, 1:] - edge[1:, :-1] + edge[:-1, :-1]
    return np.clip(np.floor(sums * (height * width / (h * w)) + 0.5 + 1e-9), 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 grey area means is below its right neighbour."""
    grey = image if image.shape[2] == 1 else (image.astype(np.int64) @ np.array([299, 587, 114]) // 1000).astype(np.uint8)[:, :, None]
    small = area_resize(grey, 8, 9)[:, :, 0]
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def media_tiles(df: DataFrame, column: str, height: int = 32, width: int = 32) -> DataFrame:
    """Adds media_tile (NPY bytes), media_hash and media_error to a table with a binary column.

    Null media: null tile, hash and error. Undecodable media: null tile and
    hash, and the reason. All other columns stay, a column of one of these
    three names is replaced.
    """
    from pyspark.sql.types import StructField, StructType, BinaryType, StringType

    base = df.drop("media_tile", "media_hash", "media_error")
    out = StructType([*base.schema.fields, StructField("media_tile", BinaryType()), StructField("media_hash", StringType()), StructField("media_error", StringType())])

    def run(it):
        for b in it:
            tiles, hashes, errors = [], [], []
            for x in b[column].to_pylist():
                tile = digest = error = None
                if x is not None:
                    try:
                        image = decode(x)
                        tile, digest = npy(area_resize(image, height, width)), difference_hash(image)
                    except ValueError as e:
                        error = str(e)
                tiles.append(tile), hashes.append(digest), errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tiles, pa.binary()), pa.array(hashes, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "media_tile", "media_hash", "media_error"])

    return base.mapInArrow(run, out)


def payload(text: str | None) -> bytes:
    """UTF-8 with spaces up to a positive multiple of ROW."""
    x = (text or "").encode()
    return x + b" " * (max(-(-len(x) // ROW), 1) * ROW - len(x))


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a PPM of 64 pixels a row, losslessly.

    Null and empty texts: one row of spaces. A very long text is one tall
    image. Null doc_ids and repeated rows stay; other columns don't matter.
    """

    def run(it):
        for b in it:
            texts = b["text"].to_pylist()
            raw = [payload(x) for x in texts]
            yield {"doc_id": b["doc_id"], "n_bytes": [len((x or "").encode()) for x in texts], "media": [ppm(np.frombuffer(x, np.uint8).reshape(-1, ROW // 3, 3)) for x in raw]}

    return batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Decodes stored media and digests what it reads back; feature: difference hash and the tile's CRC."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(it):
        for b in it:
            rows = {x: [] for x in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for x in b["media"].to_pylist():
                image = decode(x)
                data = image.tobytes()
                tile = npy(area_resize(image, 32, 32))
                for k, v in zip(rows, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(x), hashlib.sha256(x).hexdigest(), f"{difference_hash(image)}:{zlib.crc32(tile):08x}")):
                    rows[k].append(v)
            yield {"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], **rows}

    return batches(media, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: writes every text as media to the shared folder, reads the stored bytes back, digests them."""
    return media_digests(keep(text_media(table(spark, sf_dir, "documents"))))
