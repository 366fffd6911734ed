"""Media columns: Netpbm and BMP bytes to arrays, tiles and difference hashes.

A media column holds whole files as binary values.  ``media_features`` decodes
each to a numpy array, resizes it by integral images (every output cell is the
exact mean of the area it covers, fractions of pixels included), and writes the
result as an NPY tile with horizontal and vertical difference hashes.  One pass,
no shuffle; memory is that of one Arrow batch.  ``text_as_media`` makes such files of
texts; the query writes them as a table and computes all its columns from the bytes
read back.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, frugal, materialize

WIDTH = 24
UNIT = 576  # bytes; a whole number of rows of WIDTH samples
_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1..P6 to ``(height, width)`` or ``(height, width, 3)``; 8 or 16 bits by the file's maximum; P1 and P4 give 0 and 1 (1 is black)."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm file")
    at, fields = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("Netpbm header is cut")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top = (*fields, 1)[:3]
    if width < 1 or height < 1 or not 0 < top < 65536:
        raise ValueError("Netpbm header is out of range")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n = int(np.prod(shape))
    if kind == b"P1":
        bits = re.findall(rb"[01]", re.sub(rb"#[^\r\n]*", b"", data[at:]))[:n]
        values = np.array([int(x) for x in bits], dtype=np.uint8)
    elif kind in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[:n], dtype=np.int64).astype(np.uint8 if top < 256 else np.uint16)
    elif kind == b"P4":
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, offset=at + 1)[: row * height]
        if len(packed) < row * height:
            raise ValueError("Netpbm samples are cut")
        return np.unpackbits(packed.reshape(height, row), axis=1)[:, :width]
    else:
        values = np.frombuffer(data, np.uint8 if top < 256 else np.dtype(">u2"), offset=at + 1, count=-1 if top < 256 else (len(data) - at - 1) // 2)[:n]
    if len(values) < n:
        raise ValueError("Netpbm samples are cut")
    return values.reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (palette), 24- and 32-bit BMP to ``(height, width, 3)`` in RGB; grey palettes give ``(height, width)``."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP file")
    start, head, width, height = struct.unpack_from("<IIii", data, 10)
    bits, packing = struct.unpack_from("<HI", data, 28)
    colours = struct.unpack_from("<I", data, 46)[0]
    if packing not in (0, 3) or bits not in (8, 24, 32) or width < 1 or height == 0:
        raise ValueError("unsupported BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = abs(height)
    raw = np.frombuffer(data, np.uint8, offset=min(start, len(data)))[: stride * rows]
    if len(raw) < stride * rows:
        raise ValueError("BMP samples are cut")
    raw = raw.reshape(rows, stride)[:, : width * bits // 8]
    raw = raw if height < 0 else raw[::-1]
    if bits == 8:
        table = np.frombuffer(data, np.uint8, offset=14 + head, count=4 * (colours or 256)).reshape(-1, 4)[:, 2::-1]
        grey = (table == table[:, :1]).all()
        return table[raw, 0] if grey else table[raw]
    return raw.reshape(rows, width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey or 24-bit RGB, bottom row first."""
    height, width = samples.shape[:2]
    grey = samples.ndim == 2
    body = samples if grey else samples[:, :, ::-1]
    stride = (width * (1 if grey else 3) + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * (1 if grey else 3)] = body.reshape(height, -1)
    table = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros((0, 4), np.uint8)
    start = 54 + table.size
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + rows.size, 0, 0, start, 40, width, height, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, len(table), 0)
    return head + table.tobytes() + rows[::-1].tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, as float64, from the integral image read at fractional corners."""
    grid = image.astype(np.float64)
    grid = grid if grid.ndim == 3 else grid[:, :, None]
    integral = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1, grid.shape[2]))
    integral[1:, 1:] = grid.cumsum(0).cumsum(1)

    def at(table: np.ndarray, n: int, out: int) -> np.ndarray:
        edge = np.arange(out + 1) * (n / out)
        low = np.minimum(edge.astype(np.int64), n - 1)
        part = (edge - low).reshape(-1, *[1] * (table.ndim - 1))
        return np.diff(table[low] * (1 - part) + table[low + 1] * part, axis=0)

    rows = at(integral, grid.shape[0], height)
    cells = at(rows.swapaxes(0, 1), grid.shape[1], width).swapaxes(0, 1)
    cells = cells / (grid.shape[0] / height * grid.shape[1] / width)
    return cells if image.ndim == 3 else cells[:, :, 0]


def difference_hash(image: np.ndarray) -> str:
    """Horizontal then vertical hash, 64 bits each, as 32 hexadecimal digits."""
    grey = image if image.ndim == 2 else image.mean(2)
    across = np.round(area_resize(grey, 8, 9), 6)
    down = np.round(area_resize(grey, 9, 8), 6)
    bits = np.concatenate([(across[:, 1:] > across[:, :-1]).ravel(), (down[1:] > down[:-1]).ravel()])
    return np.packbits(bits).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


FIELDS = [
    ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()),
    ("samples_bytes", pa.int64()), ("samples_sha256", pa.string()), ("samples_tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string()),
]
DDL = "height int, width int, channels int, tile binary, dhash string, samples_bytes long, samples_sha256 string, samples_tail_crc32 long, media_bytes long, media_sha256 string, error string"


def _features(data: bytes | None, side: int) -> tuple:
    if data is None:
        return (None,) * 10 + ("null",)
    whole = (len(data), hashlib.sha256(data).hexdigest())
    try:
        image = decode(data)
    except (ValueError, struct.error, IndexError) as why:
        return (None,) * 8 + (*whole, str(why))
    samples = image.tobytes()
    seen = image if image.dtype == np.uint8 else (image >> 8).astype(np.uint8)
    return (
        image.shape[0], image.shape[1], 1 if image.ndim == 2 else 3, npy_tile(seen, side), difference_hash(seen),
        len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), *whole, None,
    )


def media_features(df: DataFrame, media: str, keep: list[str], side: int = 32) -> DataFrame:
    """``keep`` columns of ``df`` and what its binary column ``media`` decodes to.

    Adds ``height, width, channels, tile`` (NPY, ``side`` x ``side``), ``dhash``, digests of
    the decoded samples and of the stored file, and ``error``.  A null or broken file
    gives nulls and says why in ``error``; equal files give equal values; files of any
    size are decoded whole; an empty table gives no rows.  Columns of ``keep`` with a name
    that is added are left out.
    """
    bounded_batches(df.sparkSession)
    keep = [k for k in keep if k not in {n for n, _ in FIELDS}]
    narrow = df.select(*keep, F.col(media).alias("_media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = list(zip(*(_features(x, side) for x in part.column(len(keep)).to_pylist()), strict=True))
                made = [pa.array(v, t) for v, (_, t) in zip(got, FIELDS, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, *[n for n, _ in FIELDS]])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(keep)])
    return narrow.mapInArrow(frugal(run), f"{kept}, {DDL}")


def stored_form(raw: bytes) -> bytes:
    """A file that holds ``raw``, padded with 255 to a positive multiple of ``UNIT``, as samples in rows of 24: P5 or BMP, by its checksum."""
    padded = raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")
    samples = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
    return encode_bmp(samples) if zlib.crc32(raw) & 1 else encode_pgm(samples)


def text_as_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of ``docs(doc_id, text)``: UTF-8 bytes as files of 8-bit samples; null is empty."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                cols = [part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([stored_form(r) for r in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "media"])

    return narrow.mapInArrow(frugal(run), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(text_as_media(documents(spark, sf_dir)), "media-stored", "zstd")
    return media_features(stored, "media", ["doc_id", "n_bytes"], side=16).select(
        "doc_id",
        "n_bytes",
        F.col("samples_bytes").alias("payload_bytes"),
        F.col("samples_sha256").alias("payload_sha256"),
        F.col("samples_tail_crc32").alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.col("dhash").alias("feature"),
        "height",
        "tile",
    )
