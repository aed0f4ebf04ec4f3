"""Operator 9: media columns. Netpbm and BMP images as numpy arrays, area-resized NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.llm.text import byte_column

WIDTH = 64
#: Samples that resizing sums up at a time.
STRIP = 1 << 18


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary Netpbm greymap of 8-bit samples of shape (height, width)."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    found, at = [], 2
    while len(found) < fields:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        found.append(int(data[at:end]))
        at = end
    return found, at


def decode_netpbm(data: bytes, scale: bool = False) -> np.ndarray:
    """P1 to P6 as an array (height, width) or (height, width, 3); uint16 if samples have two bytes. Bitmaps are 0 and 255.

    With scale, samples go from 0 to 255 whatever the greatest one of the file is.
    """
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm file")
    bitmap, colours = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    fields, at = _netpbm_header(data, 2 if bitmap else 3)
    width, height, most = *fields[:2], 1 if bitmap else fields[2]
    shape = (height, width, 3) if colours == 3 else (height, width)
    if not 0 < most < 1 << 16:
        raise ValueError("the greatest sample is out of range")
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * -(-width // 8), at + 1).reshape(height, -1)
        return np.where(np.unpackbits(rows, axis=1)[:, :width] > 0, 0, 255).astype(np.uint8)
    if kind in (b"P5", b"P6"):
        out = np.frombuffer(data, ">u2" if most > 255 else np.uint8, height * width * colours, at + 1)
    else:
        text = b" ".join(line.partition(b"#")[0] for line in data[at:].split(b"\n"))
        values = [int(c) for c in text.decode() if c in "01"] if bitmap else [int(x) for x in text.split()]
        out = np.array(values[: height * width * colours], np.uint16 if most > 255 else np.uint8)
    if out.size and out.max() > most:
        raise ValueError("a sample is greater than the greatest one")
    out = out.reshape(shape)
    if bitmap:
        return np.where(out > 0, 0, 255).astype(np.uint8)
    return out * (255 / most) if scale and most != 255 else out


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits a pixel as (height, width, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or bits not in (8, 24, 32):
        raise ValueError("a kind of BMP that isn't read here")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    if height > 0:
        rows = rows[::-1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)
        return palette[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP of an array (height, width, 3)."""
    height, width = pixels.shape[:2]
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def decode(data: bytes, scale: bool = False) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data, scale)


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def _between(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums up to fractional places, of sums up to whole ones along the last axis."""
    low = np.minimum(at.astype(np.int64), sums.shape[-1] - 2)
    return sums[..., low] + (sums[..., low + 1] - sums[..., low]) * (at - low)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the equal areas of a grid, by the integral image, taken some rows at a time."""
    h, w = pixels.shape
    if not h or not w:
        return np.zeros((height, width))
    x = np.linspace(0, w, width + 1)
    y = np.linspace(0, h, height + 1)
    above = np.zeros(w)
    lines = np.zeros((height + 1, w))
    step = max(1, STRIP // w)
    for a in range(0, h, step):
        part = np.concatenate([above[None], pixels[a : a + step].astype(np.float64)]).cumsum(axis=0)
        inside = np.flatnonzero((y >= a) & ((y < a + len(part) - 1) | (a + step >= h)))
        lines[inside] = _between(part.T, y[inside] - a).T
        above = part[-1]
    sums = _between(np.concatenate([np.zeros((height + 1, 1)), lines.cumsum(axis=1)], axis=1), x)
    return np.diff(np.diff(sums, axis=0), axis=1) / (h / height * w / width)


def tile(pixels: np.ndarray, height: int = 8, width: int = 9) -> np.ndarray:
    return np.clip(np.rint(area_resize(grey(pixels), height, width)), 0, 255).astype(np.uint8)


def difference_hash(small: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 cells is darker than its right neighbour."""
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def image_features(media: DataFrame, column: str = "media", height: int = 8, width: int = 9) -> DataFrame:
    """media with columns height, width, tile (NPY bytes), dhash and error.

    A null, empty or broken image, or one whose header asks for more samples
    than it has, has nulls and says why in error. Rows that repeat stay apart;
    an empty table gives no rows. Columns of media that have one of these names
    give way to them, also the one that holds the images; the others are kept.
    """
    names = [c for c in media.columns if c not in ("height", "width", "tile", "dhash", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ([], [], [], [], [])
            for value in batch.column("image of the row"):
                try:
                    pixels = decode(value.as_py() or b"", scale=True)
                    small = tile(pixels, height, width)
                    row = pixels.shape[0], pixels.shape[1], npy(small), difference_hash(small), None
                except (ValueError, OverflowError, struct.error, IndexError) as e:
                    row = None, None, None, None, str(e)[:200]
                for x, y in zip(rows, row, strict=True):
                    x.append(y)
            new = [pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], [*names, "height", "width", "tile", "dhash", "error"])

    from pyspark.sql import types as T

    schema = T.StructType([media.schema[c] for c in names])
    for name, kind in (("height", T.IntegerType()), ("width", T.IntegerType()), ("tile", T.BinaryType()), ("dhash", T.StringType()), ("error", T.StringType())):
        schema = schema.add(name, kind)
    given = media.select(*names, F.col(column).alias("image of the row"))
    return given.mapInArrow(run, schema)


def texts_as_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): the UTF-8 text, zero-filled to a positive multiple of 64 bytes, as an image 64 wide.

    Samples that fill whole rows of 64 pixels in colour are a 24-bit BMP, others
    a greymap. A null text counts as empty. Rows that repeat stay apart; a null
    id stays null; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            size, out, start = 0, [], 0
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                rows = max(1, -(-len(text) // WIDTH))
                samples = np.zeros(rows * WIDTH, np.uint8)
                samples[: len(text)] = text
                out.append(encode_pgm(samples.reshape(rows, WIDTH)) if rows % 3 else encode_bmp(samples.reshape(rows // 3, WIDTH, 3)))
                size += len(out[-1])
                if size > 8 << 20 or i == batch.num_rows - 1:
                    sizes = np.diff(offsets[start : i + 2])
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, len(out)), pa.array(sizes), pa.array(out, pa.binary())], ["id", "n_bytes", "media"])
                    size, out, start = 0, [], i + 1

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def stored_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the stored images of texts_as_images, of the payload read back from them, and their tiles.

    The images are written to a table in the shared folder, and their tiles, as
    NPY, with the difference hashes to another; everything is computed from
    what these tables hold. feature is the difference hash and the beginning of
    the tile's digest. An empty table gives no rows.
    """
    stored = materialize(texts_as_images(docs, id_col, text_col), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ([], [], [], [], [], [], [])
            for value in batch.column("media"):
                media = value.as_py()
                pixels = decode(media)
                payload = pixels.tobytes()
                small = tile(pixels)
                row = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(small), npy(small)
                for x, y in zip(rows, row, strict=True):
                    x.append(y)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dhash", "tile"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *(pa.array(x, t) for x, t in zip(rows, kinds, strict=True))], ["id", "n_bytes", *names])

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile binary"
    found = materialize(stored.withColumnRenamed(id_col, "id").mapInArrow(run, schema), "tiles")
    feature = F.concat("dhash", F.lit(":"), F.substring(F.sha2("tile", 256), 1, 16)).alias("feature")
    return found.select(F.col("id").alias(id_col), *found.columns[1:-2], feature, "tile")
