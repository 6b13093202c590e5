"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized NPY tiles and difference hashes.

Decoding reads the declared sizes and no more. Area-resizing takes each target pixel as the mean of the
source area under it, from an integral image; only the rows of the integral image at the target's edges
are kept, so memory is bounded by the picture's width however tall it is.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

#: A payload is cut into rows of this many samples; a picture of 24 x 24 samples is the smallest.
WIDTH = 24
UNIT = 576
#: Rows of a picture that are summed at once.
STRIP_ROWS = 1 << 14
TILE = 16
HASH = 8


def _netpbm_header(data: bytes, n: int) -> tuple[list[int], int]:
    """The first n numbers after the magic, comments skipped, and where the samples begin."""
    found: list[int] = []
    at = 2
    while len(found) < n:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = (data.find(b"\n", at) if data[at : at + 1] == b"#" else at) + 1
            if at == 0:
                raise ValueError("the header's comment doesn't end")
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("no number where the header needs one")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def _samples(data: bytes, kind: type | str, n: int, at: int) -> np.ndarray:
    """n samples from at on, if there are as many."""
    if at + n * np.dtype(kind).itemsize > len(data):
        raise ValueError("too few samples")
    return np.frombuffer(data, kind, n, at)


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """P1 to P6 as an array of height x width (x 3), and the largest value. Bitmaps give 0 for black and 255 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bits, depth = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    (width, height, *top), at = _netpbm_header(data, 2 if bits else 3)
    top = top[0] if top else 1
    if not 0 < top < 65536 or width < 1 or height < 1:
        raise ValueError("sizes out of range")
    n = width * height * depth
    if kind == b"P4":
        row = (width + 7) // 8
        packed = _samples(data, np.uint8, row * height, at).reshape(height, row)
        return (1 - np.unpackbits(packed, axis=1)[:, :width]) * np.uint8(255), 255
    if kind == b"P1":
        digits = _samples(bytes(c for c in data[at - 1 :] if c in b"01"), np.uint8, n, 0) - 48
        return ((1 - digits) * np.uint8(255)).reshape(height, width), 255
    if kind in (b"P2", b"P3"):
        words = data[at - 1 :].split(None, n)[:n] if n <= len(data) else []
        if len(words) < n:
            raise ValueError("too few samples")
        if not all(w.isdigit() and len(w) < 9 for w in words):
            raise ValueError("a sample that is no number of 8 digits at most")
        flat = np.array(words).astype(np.int64)
        if flat.max() > top:
            raise ValueError("a sample above the largest value")
        flat = flat.astype(np.uint8 if top < 256 else np.uint16)
    else:
        flat = _samples(data, np.uint8 if top < 256 else ">u2", n, at)
        if top not in (255, 65535) and flat.max() > top:
            raise ValueError("a sample above the largest value")
    return flat.reshape((height, width, 3) if depth == 3 else (height, width)), top


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (by its palette), 24 or 32 bits as height x width x 3 in the order red, green, blue."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    at, head, width, height, _, bits, packing = struct.unpack_from("<I I i i H H I", data, 10)
    if bits not in (8, 24, 32) or packing not in (0, 3) or width < 1 or height == 0:
        raise ValueError("a kind of BMP that isn't read")
    up, height = height > 0, abs(height)
    row = (width * bits // 8 + 3) // 4 * 4
    rows = _samples(data, np.uint8, row * height, at).reshape(height, row)
    rows = rows[::-1] if up else rows
    if bits == 8:
        colors = (struct.unpack_from("<I", data, 46)[0] or 256) if head >= 40 else 256
        palette = _samples(data, np.uint8, colors * 4, 14 + head).reshape(colors, 4)[:, 2::-1]
        return palette[rows[:, :width]]
    return rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)[0]


def shown(picture: np.ndarray, top: int) -> np.ndarray:
    """Samples of 0 to top as those of 0 to 255."""
    return picture if top == 255 else (picture.astype(np.int64) * 510 + top) // (2 * top)


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit samples of height x width as binary PGM."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit samples of height x width x 3 as 24-bit BMP, bottom row first."""
    height, width, _ = samples.shape
    row = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHI IiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0)
    return head + body.tobytes()


def gray(picture: np.ndarray) -> np.ndarray:
    """Integer luma of a picture of three channels (weights 299, 587, 114 of 1000); others as they are."""
    if picture.ndim == 2:
        return picture
    r, g, b = (picture[:, :, i].astype(np.int64) for i in range(3))
    return (299 * r + 587 * g + 114 * b + 500) // 1000


def _at_edges(cumulated: np.ndarray, size: int, target: int) -> np.ndarray:
    """The integral (along axis 0, with a leading zero) at target + 1 edges, linear between samples."""
    edges = np.arange(target + 1) * size / target
    low = np.minimum(edges.astype(np.int64), size - 1)
    return cumulated[low] + (cumulated[low + 1] - cumulated[low]) * (edges - low).reshape(-1, *[1] * (cumulated.ndim - 1))


def area_resize(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel, as float64."""
    rows, cols = picture.shape
    edges = np.arange(height + 1) * rows / height
    need = np.unique(np.concatenate([x := np.minimum(edges.astype(np.int64), rows - 1), x + 1]))
    kept = np.zeros((need.size, cols), np.int64)  # rows of the integral image, summed downwards
    before = np.zeros(cols, np.int64)
    for top in range(0, rows, STRIP_ROWS):
        strip = picture[top : top + STRIP_ROWS]
        inside = (need > top) & (need <= top + len(strip))
        if inside.any():
            kept[inside] = before + np.cumsum(strip, axis=0, dtype=np.int64)[need[inside] - top - 1]
        before = before + strip.sum(axis=0, dtype=np.int64)
    low = np.searchsorted(need, x)
    down = kept[low] + (kept[low + 1] - kept[low]) * (edges - x)[:, None]
    both = _at_edges(np.vstack([np.zeros(height + 1), np.cumsum(down, axis=1).T]), cols, width).T
    return np.diff(np.diff(both, axis=0), axis=1) / (rows / height * cols / width)


def difference_hash(picture: np.ndarray, size: int = HASH) -> str:
    """Hex of size x size bits: whether each pixel of the small picture is darker than its right neighbour."""
    small = area_resize(gray(picture), size, size + 1)
    bits = small[:, 1:] - small[:, :-1] > 1e-9
    return np.packbits(bits).tobytes().hex()


def npy_tile(picture: np.ndarray, size: int = TILE) -> bytes:
    """The picture as an NPY file of size x size bytes."""
    tile = np.floor(area_resize(gray(picture), size, size) + 0.5).clip(0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


def payload_of(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """UTF-8 of text, filled with 255 up to a positive multiple of unit; and its length before."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % unit or (0 if raw else unit)), len(raw)


MEDIA = "struct<media: binary, n_bytes: bigint>"
FEATURES = "struct<payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, tile: binary, dhash: string, error: string>"


def store_text(text: Column | str) -> Column:
    """Arrow function: a text's payload as a PGM picture of 24 samples a row."""

    @F.arrow_udf(MEDIA)
    def run(batch: pa.Array) -> pa.Array:
        rows = [payload_of(t) for t in batch.to_pylist()]
        media = [encode_pgm(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for p, _ in rows]
        return pa.StructArray.from_arrays([pa.array(media, pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["media", "n_bytes"])

    return run(text)


def features_of(data: bytes | None) -> dict:
    """Decoded samples' size and digests, NPY tile and difference hash of media bytes; error if they can't be read. Tile and hash see samples of 0 to 255."""
    if data is None:
        return {}
    own = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    try:
        picture, top = (decode_bmp(data), 255) if data[:2] == b"BM" else decode_netpbm(data)
    except (ValueError, IndexError, struct.error) as e:
        return own | {"error": str(e)}
    samples = np.ascontiguousarray(picture).tobytes()
    return own | {
        "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-32:]),
        "tile": npy_tile(visible := shown(picture, top)), "dhash": difference_hash(visible),
    }


def media_features(media: Column | str) -> Column:
    """Arrow function: features_of a column of Netpbm or BMP bytes. Null gives nulls; bytes that can't be read give error."""

    @F.arrow_udf(FEATURES)
    def run(batch: pa.Array) -> pa.Array:
        kind = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])
        return pa.array([features_of(x) for x in batch.to_pylist()], kind)

    return run(media)


def text_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store each text as a picture, read it back: key, n_bytes, payload and media digests, feature, tile (NPY bytes).

    feature is the difference hash. Nulls: a null text counts as empty (a payload of 576 bytes 255), a null
    key is passed on. Equal texts have equal values, so repeated rows agree. Other columns are not read. An
    empty table gives an empty result. Long texts are stored whole; features take memory for a strip of them.
    """
    ready(docs.sparkSession)
    stored = docs.select(F.col(key), store_text(F.col(text)).alias("_m"))
    done = stored.select(key, F.col("_m.n_bytes").alias("n_bytes"), media_features(F.col("_m.media")).alias("_f"))
    return done.select(
        key, "n_bytes", "_f.payload_bytes", "_f.payload_sha256", "_f.tail_crc32", "_f.media_bytes", "_f.media_sha256",
        F.col("_f.dhash").alias("feature"), F.col("_f.tile").alias("tile"),
    )
