"""Media columns: Netpbm and BMP images as numpy arrays, tiles and features."""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_lists

#: A token of a Netpbm header: white space and comments, then the token.
TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")
#: Pixels in a row of a text's picture, three bytes each.
WIDTH = 64


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); 16-bit samples as uint16, bitmaps 1 for black."""
    kind, at, head = data[:2], 2, []
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm image")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = TOKEN.match(data, at)
        if not m:
            raise ValueError("header cut short")
        if not m[1].isdigit() or len(m[1]) > 9:
            raise ValueError("bad number in the header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = head[0], head[1], head[2] if len(head) > 2 else 1
    if not 0 < top < 65536:
        raise ValueError("bad maximum")
    if width * height > 8 * len(data):
        raise ValueError("fewer samples than the header tells")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    kind_of = np.dtype(np.uint8 if top < 256 else ">u2")
    if kind == b"P1":
        flat = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:]), np.uint8) - 48
    elif kind in (b"P2", b"P3"):
        flat = np.array([min(int(x), 65536) for x in re.sub(rb"#[^\n]*", b"", data[at:]).split()], dtype=np.int64)
        if len(flat) and not 0 <= flat.min() <= flat.max() <= top:
            raise ValueError("a sample beyond the maximum")
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * (-(-width // 8)), at + 1).reshape(height, -1)
        flat = np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, kind_of, int(np.prod(shape)), at + 1)
    return flat[: int(np.prod(shape))].astype(kind_of.newbyteorder("=")).reshape(shape)


def encode_ppm(pixels: np.ndarray) -> bytes:
    """P6 (three channels) or P5 of an array of uint8."""
    height, width = pixels.shape[:2]
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel as (height, width, 3) RGB."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    u32 = lambda at: int.from_bytes(data[at : at + 4], "little")
    start, header = u32(10), u32(14)
    width, height = (int.from_bytes(data[a : a + 4], "little", signed=True) for a in (18, 22))
    bits, packed, colours = int.from_bytes(data[28:30], "little"), u32(30), u32(46)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("unsupported BMP")
    stride = (width * bits + 31) // 32 * 4
    if width <= 0 or start + stride * abs(height) > len(data):
        raise ValueError("fewer samples than the header tells")
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    if bits >= 24:
        out = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    else:
        palette = np.frombuffer(data, np.uint8, 4 * (colours or 1 << bits), 14 + header).reshape(-1, 4)[:, 2::-1]
        per = 8 // bits
        shifts = np.arange(per)[::-1] * bits
        index = (rows[:, :, None] >> shifts & (1 << bits) - 1).reshape(abs(height), -1)[:, :width]
        out = palette[index]
    return np.ascontiguousarray(out if height < 0 else out[::-1])


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP of an RGB array."""
    height, width = pixels.shape[:2]
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    body = rows.tobytes()
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = [(40, 4), (width, 4), (height, 4), (1, 2), (24, 2), (0, 4), (len(body), 4), (2835, 4), (2835, 4), (0, 4), (0, 4)]
    return head + b"".join(v.to_bytes(n, "little") for v, n in info) + body


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma as float; one channel stays as it is."""
    return pixels @ np.array([0.299, 0.587, 0.114]) if pixels.ndim == 3 else pixels.astype(float)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel, from an integral image read between its points."""
    table = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0), axis=1, out=table[1:, 1:])

    def lines(a: np.ndarray, n: int) -> np.ndarray:  # of the table at n + 1 even cuts
        cut = np.arange(n + 1) * (a.shape[0] - 1) / n
        low = np.minimum(cut.astype(int), a.shape[0] - 2)
        part = (cut - low)[:, None]
        return a[low] * (1 - part) + a[low + 1] * part

    sums = np.diff(np.diff(lines(lines(table, height).T, width).T, axis=0), axis=1)
    return sums * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """Hexadecimal bits, row by row: whether a cell of the resized image is darker than the one to its right."""
    small = np.round(area_resize(image, size, size + 1), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def tiles(pixels: np.ndarray, size: int = 32) -> list[tuple[int, int, bytes, str]]:
    """(row, column, NPY bytes, difference hash) of an image resized to a multiple of ``size`` no larger than needed to hold it."""
    down, across = (max(1, -(-n // size)) for n in pixels.shape[:2])
    channels = [area_resize(c, down * size, across * size) for c in np.atleast_3d(pixels).transpose(2, 0, 1)]
    whole = np.clip(np.rint(np.stack(channels, axis=-1)), 0, 255).astype(np.uint8)
    parts = [(r, c, whole[r * size : (r + 1) * size, c * size : (c + 1) * size]) for r in range(down) for c in range(across)]
    return [(r, c, npy(tile), difference_hash(grey(tile))) for r, c, tile in parts]


def features_of(blob: bytes, tile: int = 32) -> tuple[np.ndarray, str, list[dict]]:
    """The decoded pixels of an encoded image, its difference hash and its tiles; ValueError where it can't be read."""
    try:
        pixels = decode_image(blob)
    except (IndexError, OverflowError) as e:
        raise ValueError(str(e)) from e
    if not pixels.size:
        raise ValueError("no pixels")
    return pixels, difference_hash(grey(pixels)), [dict(zip(("row", "col", "npy", "hash"), t)) for t in tiles(pixels, tile)]


def media_features(images: DataFrame, id_col: str = "id", bytes_col: str = "data", tile: int = 32) -> DataFrame:
    """id, height, width, feature (difference hash), tiles array<struct<row, col, npy, hash>>, error of encoded images.

    Bytes that are null, empty or no image this module reads give nulls, no
    tiles and the reason in error; repeated rows give repeated rows; other
    columns are not read; an empty table gives an empty result.
    """

    def make():
        def step(ids, blobs):
            out = ids, [], [], [], [], []
            for blob in blobs:
                try:
                    pixels, feature, parts = features_of(blob or b"", tile)
                    found = *pixels.shape[:2], feature, parts, None
                except ValueError as e:
                    found = None, None, None, [], str(e)
                for column, value in zip(out[1:], found):
                    column.append(value)
            return out

        return step

    kind = dict(images.dtypes)[id_col]
    rows = images.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{bytes_col}`").alias("data"))
    return map_lists(rows, make, f"id {kind}, height int, width int, feature string, tiles array<struct<row:int,col:int,npy:binary,hash:string>>, error string")


def text_picture(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 text, and the image that stores it padded with spaces: P6 of ASCII texts, else 24-bit BMP."""
    data = (text or "").encode()
    padded = data + b" " * (-len(data) % (3 * WIDTH) if data else 3 * WIDTH)
    pixels = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH, 3)
    return len(data), encode_ppm(pixels) if data.isascii() else encode_bmp(pixels)


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, data: texts stored losslessly as images. Null text is empty text, one row of spaces."""

    def make():
        def step(ids, texts):
            stored = [text_picture(t) for t in texts]
            return ids, [n for n, _ in stored], [d for _, d in stored]

        return step

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_lists(rows, make, f"doc_id {kind}, n_bytes long, data binary")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored losslessly as images: sizes and digests of what is read back, its difference hash and its NPY tiles' number and digest.

    Null text is empty text, one row of spaces. Null ids, repeated rows and
    equal texts each give a row. Other columns are not read. An empty table
    gives an empty result.
    """

    def make():
        def step(ids, texts):
            out = ids, [], [], [], [], [], [], [], [], []
            for text in texts:
                n, stored = text_picture(text)
                pixels, feature, parts = features_of(stored)
                payload = pixels.tobytes()
                written = hashlib.sha256(b"".join(t["npy"] for t in parts)).hexdigest()
                found = n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(parts), written
                for column, value in zip(out[1:], found):
                    column.append(value)
            return out

        return step

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_lists(rows, make, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles int, tiles_sha256 string")
