"""Images as pixel rows: binary files, decoders (PNG of every depth, interlaced or not; BMP; PNM) and gates as findings."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.shipping import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MOST_PIXELS, LEAST_SIDE = 100_000_000, 64
#: First column and row, and steps, of the seven passes of an interlaced PNG file; without interlace there is one.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """(h, 1 + n) filtered lines to (h, n) bytes. All five filters at once along diagonals: a byte needs only those left of and above it."""
    h, n = lines.shape[0], lines.shape[1] - 1
    kinds, w = lines[:, 0].astype(np.int64), -(-n // step)
    if (kinds > 4).any():
        raise ValueError("damaged PNG file: unknown filter")
    raw = np.zeros((h, w * step), np.int64)
    raw[:, :n] = lines[:, 1:]
    raw = raw.reshape(h, w, step)
    if not kinds.any():
        return lines[:, 1:]
    out = np.zeros((h + 1, w + 1, step), np.int64)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y, None]
        p = left + up - corner
        da, db, dc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        out[y + 1, x + 1] = (raw[y, x] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, paeth], 0)) & 255
    return out[1:, 1:].reshape(h, -1)[:, :n].astype(np.uint8)


def _samples(rows: np.ndarray, width: int, channels: int, bits: int) -> np.ndarray:
    """(h, width, channels) whole numbers from packed bytes."""
    if bits == 16:
        return rows.reshape(len(rows), width, channels, 2).astype(np.int64) @ np.array([256, 1])
    if bits == 8:
        return rows.reshape(len(rows), width, channels)
    each = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits) @ (1 << np.arange(bits - 1, -1, -1))
    return each[:, :width, None]


def png_size(data: bytes) -> tuple[int, int]:
    """(width, height) from the header alone, before anything is inflated."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or len(data) < 33:
        raise ValueError("not a PNG file")
    return struct.unpack_from(">II", data, 16)


def read_png(data: bytes) -> np.ndarray:
    """height x width x 3 floats in [0, 1]; alpha lies over white; an Exif orientation is applied."""
    png_size(data)
    at, chunks = 8, {}
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        chunks.setdefault(kind, []).append(data[at + 8 : at + 8 + n])
        at += 12 + n
    chunks = {k: b"".join(v) for k, v in chunks.items()}
    try:
        w, h, bits, form, _, _, interlace = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
        step = CHANNELS[form]
        if bits not in (1, 2, 4, 8, 16) or (bits < 8 and form not in (0, 3)) or not w or not h:
            raise ValueError(f"no PNG file has {bits} bits in form {form}")
        parts = [(x, y, dx, dy, -(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in (PASSES if interlace else ((0, 0, 1, 1),)) if w > x and h > y]
        need = sum(ph * (1 + -(-pw * step * bits // 8)) for *_, pw, ph in parts)
        raw = zlib.decompressobj().decompress(chunks[b"IDAT"], need)  # never more than the header asks for
    except (KeyError, struct.error, zlib.error) as e:
        raise ValueError(f"damaged PNG file: {e}") from e
    if len(raw) < need:
        raise ValueError("damaged PNG file: too little data")
    px, at = np.zeros((h, w, step), np.int64), 0
    for x, y, dx, dy, pw, ph in parts:
        line = 1 + -(-pw * step * bits // 8)
        rows = _unfilter(np.frombuffer(raw, np.uint8, ph * line, at).reshape(ph, line), max(1, step * bits // 8))
        px[y::dy, x::dx] = _samples(rows, pw, step, bits)
        at += ph * line
    if form == 3:
        table = np.frombuffer(chunks.get(b"PLTE", b""), np.uint8)[: len(chunks.get(b"PLTE", b"")) // 3 * 3].reshape(-1, 3) / 255.0
        if px.max() >= len(table):
            raise ValueError("damaged PNG file: a colour is not in the palette")
        alpha = np.ones(len(table))
        given = np.frombuffer(chunks.get(b"tRNS", b""), np.uint8)[: len(table)]
        alpha[: len(given)] = given / 255.0
        out = over_white(table, alpha[:, None])[px[:, :, 0]]
    else:
        px = px / float((1 << bits) - 1)
        out = over_white(px[:, :, :-1], px[:, :, -1:]) if form in (4, 6) else px
        out = np.repeat(out, 3, 2) if out.shape[2] == 1 else out
    return oriented(out, orientation(chunks.get(b"eXIf", b"")))


def over_white(colour: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return colour * alpha + (1 - alpha)


def orientation(exif: bytes) -> int:
    """Tag 0x0112 of the first directory, 1 to 8; 1 if there is none."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    try:
        if order:
            (at,) = struct.unpack_from(order + "I", exif, 4)
            for i in range(struct.unpack_from(order + "H", exif, at)[0]):
                tag, kind, _, value = struct.unpack_from(order + "HHIH", exif, at + 2 + 12 * i)
                if tag == 0x0112 and kind == 3 and 1 <= value <= 8:
                    return value
    except struct.error:
        pass
    return 1


def oriented(px: np.ndarray, how: int) -> np.ndarray:
    """The picture as it is meant to be seen: 2, 4 mirror, 3 turns by half, 5 to 8 also swap rows and columns."""
    if how >= 5:
        px = px.swapaxes(0, 1)
    if how in (2, 3, 6, 7):
        px = px[:, ::-1]
    if how in (3, 4, 7, 8):
        px = px[::-1]
    return px


def read_bmp(data: bytes, most: int) -> np.ndarray:
    """Uncompressed BMP files of 8 (palette), 24 or 32 bits."""
    try:
        begin, size, w, h, _, bits, packed = struct.unpack_from("<4xI" + "IiiHHI", data, 6)
    except struct.error as e:
        raise ValueError(f"damaged BMP file: {e}") from e
    if packed not in (0, 3) or bits not in (8, 24, 32) or w < 1 or h == 0:
        raise ValueError("only uncompressed BMP files of 8, 24 and 32 bits are read")
    _gate(w, abs(h), most, 1)
    line = (w * bits // 8 + 3) // 4 * 4
    if len(data) < begin + line * abs(h):
        raise ValueError("damaged BMP file: too little data")
    px = np.frombuffer(data, np.uint8, line * abs(h), begin).reshape(abs(h), line)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    px = px[::-1] if h > 0 else px
    if bits == 8:
        table = np.frombuffer(data, np.uint8, begin - 14 - size, 14 + size).reshape(-1, 4)[:, 2::-1]
        return table[np.minimum(px[:, :, 0], len(table) - 1)] / 255.0
    return px[:, :, 2::-1] / 255.0


def read_pnm(data: bytes, most: int) -> np.ndarray:
    """Binary PGM and PPM files of 8 or 16 bits."""
    words, at = [], 0
    while len(words) < 4:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("damaged PNM file")
        words.append(data[at:end])
        at = end
    if not all(v.isdigit() for v in words[1:]):
        raise ValueError("damaged PNM file")
    n, (w, h, top) = 1 if words[0] == b"P5" else 3, (int(v) for v in words[1:])
    _gate(w, h, most, 1)
    kind = np.dtype(">u2" if top > 255 else "u1")
    if not top or len(data) < at + 1 + w * h * n * kind.itemsize:
        raise ValueError("damaged PNM file: too little data")
    px = np.frombuffer(data, kind, w * h * n, at + 1).reshape(h, w, n) / top
    return np.repeat(px, 3, 2) if n == 1 else px


def _gate(w: int, h: int, most: int, least_side: int) -> None:
    if w * h > most or min(w, h) < least_side:
        raise ValueError(f"{w}x{h} pixels are outside the limits")


def decode(data: bytes, most: int = MOST_PIXELS, least_side: int = LEAST_SIDE) -> np.ndarray:
    """height x width x 3 floats in [0, 1] of a PNG, BMP, PGM or PPM file; size gates apply before anything is inflated."""
    if not data:
        raise ValueError("the file is empty")
    if data[:8] == SIGNATURE:
        _gate(*png_size(data), most, least_side)
        out = read_png(data)
    elif data[:2] == b"BM":
        out = read_bmp(data, most)
    elif data[:2] in (b"P5", b"P6"):
        out = read_pnm(data, most)
    else:
        raise ValueError("not a PNG, BMP or PNM file")
    _gate(out.shape[1], out.shape[0], most, least_side)
    return out


def mask_grid(text: str, height: int, width: int) -> np.ndarray:
    """A base64 image (a data URI or not) as a boolean grid of the given size: nearest samples, masked from half brightness on."""
    try:
        px = decode(base64.b64decode(text.split(",", 1)[-1], validate=False), least_side=1)
    except (ValueError, base64.binascii.Error) as e:
        raise ValueError(f"the mask is no image: {e}") from e
    light = np.rint((px @ np.array([0.299, 0.587, 0.114])) * 255)
    at = lambda n, t: np.minimum(((np.arange(t) + 0.5) * n / t).astype(int), n - 1)
    return light[at(px.shape[0], height)][:, at(px.shape[1], width)] >= 128


def write_png(rgb: np.ndarray) -> bytes:
    """An 8-bit PNG file of height x width x 3 bytes; the same pixels give the same file."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("path").alias("image"), "content", F.sha2("content", 256).alias("source_hash"))


def files(spark: SparkSession, path: str, pattern: str = "*.{png,bmp,pgm,ppm}") -> DataFrame:
    """(image, content, source_hash) of files below path. Spark's reader never lists empty files; empty content from elsewhere gets its finding from the decoder."""
    return _named(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def stream(spark: SparkSession, path: str, pattern: str = "*.{png,bmp,pgm,ppm}") -> DataFrame:
    """files() as a stream of those that arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _named(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path))


def pixels(images: DataFrame, most: int = MOST_PIXELS, least_side: int = LEAST_SIDE) -> DataFrame:
    """(image, y, x, r, g, b, error): pixel rows, or one row with the reason for an image that fails a gate or the decoder.

    Rows leave a worker in bands of lines, so an image's pixels are never one batch.
    """
    ship(images.sparkSession)
    names = ["image", "y", "x", "r", "g", "b", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    px = decode(data or b"", most, least_side)
                except ValueError as e:
                    none = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), *[pa.float64()] * 3)]
                    yield pa.RecordBatch.from_arrays([pa.array([image]), *none, pa.array([str(e)])], names)
                    continue
                h, w, _ = px.shape
                band = max(1, 50_000 // w)
                for y in range(0, h, band):
                    part = px[y : y + band].reshape(-1, 3)
                    n = len(part)
                    at = np.arange(n, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([image] * n), pa.array(at // w + np.int32(y)), pa.array(at % w), *[pa.array(np.ascontiguousarray(part[:, k])) for k in range(3)], pa.nulls(n, pa.string())], names
                    )

    return images.select("image", "content").mapInArrow(run, "image string, y int, x int, r double, g double, b double, error string")
