"""Operator 9, media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, written as NPY
tiles with difference hashes.

Cases: a null image gives nulls; bytes that are no image of a known form give ``error`` and null features, no exception. A
null text is an empty payload (64 zero bytes). Repeated rows give equal values; ids are passed through.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.llm import common

#: Bytes of a row of the stored image.
WIDTH = 64


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary greyscale Netpbm (P5) of a matrix of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """Uncompressed 8-bit BMP with a grey palette, rows bottom up."""
    height, width = samples.shape
    rows = np.zeros((height, -(-width // 4) * 4), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    at = 14 + 40 + 1024
    return b"BM" + struct.pack("<IHHI", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def _sized(width: int, height: int, raw: bytes) -> None:
    """Every form takes a bit a sample at least: larger sizes than the bytes can hold are refused before memory is asked for."""
    if width <= 0 or height <= 0 or width * height > 8 * len(raw):
        raise ValueError("sizes do not fit the bytes")


def _header(raw: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers of a Netpbm header after its magic, and where the samples begin; # starts a comment."""
    got, at = [], 2
    while len(got) < fields:
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at : at + 1] == b"#"):
            at = (raw.find(b"\n", at) if raw[at : at + 1] == b"#" else at) + 1 or len(raw)
        to = at
        while to < len(raw) and raw[to : to + 1].isdigit():
            to += 1
        if not 0 < to - at < 10:
            raise ValueError("broken Netpbm header")
        got.append(int(raw[at:to]))
        at = to
    return got, at + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6: height x width (x 3); bits become 0 and 255, samples fill their bytes: the maximum becomes 255, or 65,535 where it is
    over 255. A sample over the maximum is an error."""
    kind = raw[1:2]
    (width, height, *most), at = _header(raw, 2 if kind in b"14" else 3)
    _sized(width, height, raw)
    planes, most = 3 if kind in b"36" else 1, most[0] if most else 1
    if not 0 < most < 65536:
        raise ValueError("Netpbm maximum out of range")
    if kind == b"4":
        stride = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, stride * height, at).reshape(height, stride), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)
    if kind == b"1":
        text = b"".join(line.split(b"#")[0] for line in raw[at:].splitlines())
        bits = np.array([x == 49 for x in text if x in b"01"][: width * height], np.uint8)
        return ((1 - bits.reshape(height, width)) * 255).astype(np.uint8)
    dtype = np.uint8 if most < 256 else np.dtype(">u2")
    if kind in b"23":
        samples = np.array(raw[at:].split()[: width * height * planes], np.int64)
    else:
        samples = np.frombuffer(raw, dtype, width * height * planes, at)
    if samples.size and (samples.max() > most or samples.min() < 0):
        raise ValueError("sample over the maximum")
    top = 255 if most < 256 else 65535
    samples = (samples if most == top else (samples.astype(np.int64) * top + most // 2) // most).astype(dtype)
    return samples.reshape((height, width, 3) if planes == 3 else (height, width))


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; grey palettes give one plane, others red, green, blue."""
    at, head, width, height, _, bits, packing = struct.unpack_from("<I", raw, 10)[0], *struct.unpack_from("<IiiHHI", raw, 14)
    _sized(width, abs(height), raw)  # a height under 0 means rows from the top, a width under 0 nothing
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("BMP form not supported")
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    data = np.frombuffer(raw, np.uint8, stride * rows, at).reshape(rows, stride)
    data = data[::-1] if height > 0 else data
    if bits >= 24:
        return data[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    index = data[:, :width] if bits == 8 else (np.unpackbits(data, axis=1)[:, :width] if bits == 1 else np.stack([data >> 4, data & 15], 2).reshape(rows, -1)[:, :width])
    used = struct.unpack_from("<I", raw, 46)[0] or 1 << bits
    palette = np.frombuffer(raw, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
    grey = (palette[:, :1] == palette).all()
    return palette[:, 0][index] if grey else palette[index]


def decode(raw: bytes) -> np.ndarray:
    if raw[:2] == b"BM":
        return decode_bmp(raw)
    if raw[:1] == b"P" and raw[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return decode_netpbm(raw)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    """One plane: the rounded mean weight 299, 587, 114 per thousand of red, green, blue."""
    return image if image.ndim == 2 else (image.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000


def area_resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact means over the rectangles that tile the plane, parts of samples weighted by their area.

    The integral image is sampled at fractional edges by bilinear interpolation, which is exact for area sums.
    """
    table = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1))
    np.cumsum(np.cumsum(plane, 0, dtype=np.int64), 1, out=table[1:, 1:])

    def at(table: np.ndarray, n: int) -> np.ndarray:
        edge = np.arange(n + 1) * (len(table) - 1) / n
        low = np.minimum(edge.astype(np.int64), len(table) - 2)
        part = (edge - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    sums = at(at(table, height).T, width).T
    cell = plane.shape[0] / height * plane.shape[1] / width
    return (sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]) / cell


def npy_head(size: int = 8) -> str:
    """The NPY header of a tile of bytes, in hex."""
    out = io.BytesIO()
    np.save(out, np.zeros((size, size + 1), np.uint8))
    return out.getvalue()[: -size * (size + 1)].hex()


def tile(raw: bytes, size: int = 8) -> tuple[np.ndarray, bytes, str]:
    """(decoded image, NPY bytes of its size x (size + 1) tile, difference hash in hex)."""
    image = decode(raw)
    small = np.round(area_resize(grey(image), size, size + 1), 6)
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.clip(np.rint(small), 0, 65535).astype(np.uint8 if image.dtype == np.uint8 else np.uint16)))
    return image, out.getvalue(), np.packbits((small[:, 1:] > small[:, :-1]).ravel()).tobytes().hex()


def _tiled(raw: bytes | None) -> tuple:
    """(height, width, planes, NPY tile, difference hash, samples, error); bytes that are no image give an error only."""
    if raw is None:
        return (None,) * 7
    try:
        image, npy, mark = tile(raw)
    except (ValueError, ArithmeticError, LookupError, MemoryError, struct.error) as why:
        return (*(None,) * 6, f"{type(why).__name__}: {why}"[:200])
    return (*image.shape[:2], image.shape[2] if image.ndim > 2 else 1, npy, mark, np.ascontiguousarray(image).tobytes(), None)


def media_tiles(df: DataFrame, ident: str = "image_id", image: str = "image", carry: tuple[str, ...] = ()) -> DataFrame:
    """Decodes a binary column: (id, height, width, planes, npy, dhash, samples, error) and the columns named in ``carry``."""
    slim = df.select(df[ident].alias("id"), df[image].alias("image"), *carry)
    names = ["id", "height", "width", "planes", "npy", "dhash", "samples", "error", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.string())
        for part in common.slices(batches, "image"):
            rows = [_tiled(raw) for raw in part.column("image").to_pylist()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns, *(part.column(c) for c in carry)], names)

    more = "".join(f", `{c}` {slim.schema[c].dataType.simpleString()}" for c in carry)
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, height int, width int, planes int, npy binary, dhash string, samples binary, error string{more}")


def text_images(df: DataFrame, ident: str = "doc_id", text: str = "text", form: str | None = None) -> DataFrame:
    """Stores every whole text as an image: (doc_id, n_bytes, media).

    The payload is the UTF-8 text with zero bytes up to a positive multiple of 64, one image row for each 64 bytes. Without a
    ``form`` (pgm or bmp) the last bit of the payload's SHA-256 chooses: 0 is Netpbm, 1 BMP.
    """
    slim = df.select(df[ident].alias("doc_id"), df[text].cast("string").alias("text"))
    encoders = {"pgm": encode_pgm, "bmp": encode_bmp}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            media, sizes = [], []
            for raw in common.filled(part.column("text")).cast(pa.binary()).to_pylist():
                size = max(1, -(-len(raw) // WIDTH))
                payload = raw.ljust(size * WIDTH, b"\0")
                encode = encoders[form or ("pgm", "bmp")[hashlib.sha256(payload).digest()[-1] & 1]]
                media.append(encode(np.frombuffer(payload, np.uint8).reshape(size, WIDTH)))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")
