"""TIFF pages: a reader for uncompressed, PackBits, LZW and deflate strips and tiles with predictors, and a writer.

The reader follows the chain of image directories and gives one page each. It handles both byte orders, 8- and 16-bit
unsigned samples, any number of samples a pixel in chunky or planar order, and predictor 2 (horizontal differences).
Bytes that are not such a file raise ValueError; pages() turns that into one row with the error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_text, only
from gridloom.plans.shipping import ship

# Fixed values of the format: tags, field types (size, struct code), compressions.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325}
TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, STOP = 256, 257


@dataclass
class Page:
    pixels: np.ndarray  # height x width x samples, uint8 or uint16
    compression: int
    predictor: int


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        end = i + 1
        while end < n and end - i < 128 and not (end + 2 < n and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out.append(end - i - 1)
        out += data[i:end]
        i = end
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    out, bits, held, pos, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = []
    last = b""
    while True:
        while held < width:
            if pos >= len(data):
                return bytes(out)
            bits = bits << 8 | data[pos]
            pos, held = pos + 1, held + 8
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == STOP:
            return bytes(out)
        if code == CLEAR:
            table, width, last = [], 9, b""
            continue
        if code < 256:
            word = bytes((code,))
        elif code - 258 < len(table):
            word = table[code - 258]
        elif code - 258 == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        # the width grows one code early in this format
        width = min(12, max(9, (len(table) + 259).bit_length()))


def pack_lzw(data: bytes) -> bytes:
    out, bits, held = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width = 9

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    put(CLEAR)
    word = b""
    code_of = lambda w: w[0] if len(w) == 1 else table[w]
    for b in data:
        longer = word + bytes((b,))
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(code_of(word))
        table[longer] = 258 + len(table)
        # the reader's table is one entry behind the writer's
        width = min(12, max(9, (len(table) + 258).bit_length()))
        if len(table) + 258 >= 4094:
            put(CLEAR)
            table, width = {}, 9
        word = longer[-1:]
    if word:
        put(code_of(word))
        width = min(12, max(9, (len(table) + 259).bit_length()))
    put(STOP)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def _expand(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unpack_lzw(data)
    raise ValueError(f"compression {compression} is not supported")


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("the directories form a loop or leave the file")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in TYPES:
                continue
            size, code = TYPES[kind]
            place = at + 10 + 12 * i
            if size * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + size * count > len(data):
                raise ValueError("a field leaves the file")
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_tiff(data: bytes) -> list[Page]:
    """The file's pages, in the order of its directories."""
    try:
        return [_page(data, order, tags) for order, tags in _directories(data)]
    except (struct.error, KeyError, IndexError, zlib.error) as e:
        raise ValueError(f"damaged TIFF file: {e}") from e


def _page(data: bytes, order: str, tags: dict[int, tuple]) -> Page:
    get = lambda name, default=None: tags.get(TAGS[name], default)
    width, height = get("width")[0], get("height")[0]
    bits, samples = get("bits", (1,)), get("samples", (1,))[0]
    if set(bits) not in ({8}, {16}):
        raise ValueError(f"samples of {bits} bits are not supported")
    kind = np.dtype(np.uint8 if bits[0] == 8 else order + "u2")
    compression, predictor, planar = get("compression", (NONE,))[0], get("predictor", (1,))[0], get("planar", (1,))[0]
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not supported")
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    if TAGS["tile_width"] in tags:
        offsets, counts = get("tile_offsets"), get("tile_counts")
        block_w, block_h = get("tile_width")[0], get("tile_height")[0]
    else:
        offsets, counts = get("strip_offsets"), get("strip_counts")
        block_w, block_h = width, min(height, get("rows_per_strip", (height,))[0])
    across, down = -(-width // block_w), -(-height // block_h)
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for i in range(planes * down * across):
        plane, rest = divmod(i, down * across)
        y, x = rest // across * block_h, rest % across * block_w
        rows = block_h if TAGS["tile_width"] in tags else min(block_h, height - y)
        raw = _expand(data[offsets[i] : offsets[i] + counts[i]], compression)
        need = rows * block_w * deep * kind.itemsize
        if len(raw) < need:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(raw, kind, rows * block_w * deep).reshape(rows, block_w, deep)
        if predictor == 2:
            block = np.add.accumulate(block.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
        h, w = min(rows, height - y), min(block_w, width - x)
        out[y : y + h, x : x + w, plane : plane + deep] = block[:h, :w]
    return Page(out, compression, predictor)


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 64, big_endian: bool = False) -> bytes:
    """A TIFF file of the pages (height x width [x samples], uint8 or uint16). The same pages give the same bytes."""
    order = ">" if big_endian else "<"
    out = bytearray((b"MM" if big_endian else b"II") + struct.pack(order + "HI", 42, 0))
    link = 4
    squeeze = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, 6), PACKBITS: pack_bits, LZW: pack_lzw}[compression]
    for image in pages:
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, samples = image.shape
        kind = np.dtype(np.uint8 if image.dtype == np.uint8 else order + "u2")
        step_y, step_x = tile or (rows_per_strip, width)
        offsets, counts = [], []
        for y in range(0, height, step_y):
            for x in range(0, width, step_x):
                block = image[y : y + step_y, x : x + step_x]
                if tile:
                    block = np.pad(block, ((0, step_y - block.shape[0]), (0, step_x - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = block.copy()
                    block[:, 1:] -= block[:, :-1].copy()
                packed = squeeze(np.ascontiguousarray(block, kind).tobytes())
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed
        fields = [("width", 4, [width]), ("height", 4, [height]), ("bits", 3, [8 * kind.itemsize] * samples), ("compression", 3, [compression]), ("photometric", 3, [2 if samples == 3 else 1]), ("samples", 3, [samples]), ("planar", 3, [1]), ("predictor", 3, [predictor])]
        if tile:
            fields += [("tile_width", 4, [step_x]), ("tile_height", 4, [step_y]), ("tile_offsets", 4, offsets), ("tile_counts", 4, counts)]
        else:
            fields += [("strip_offsets", 4, offsets), ("rows_per_strip", 4, [step_y]), ("strip_counts", 4, counts)]
        entries = []
        for name, form, values in sorted(fields, key=lambda f: TAGS[f[0]]):
            packed = struct.pack(f"{order}{len(values)}{TYPES[form][1]}", *values)
            if len(packed) > 4:
                out += b"\0" * (len(out) % 2)
                place_at = struct.pack(order + "I", len(out))
                out += packed
                packed = place_at
            entries.append(struct.pack(order + "HHI", TAGS[name], form, len(values)) + packed.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


#: A stored text: pages of WIDTH samples a row and at most PAGE_ROWS rows.
WIDTH, PAGE_ROWS = 576, 4096


def text_payload(text: bytes) -> bytes:
    """The text's bytes, then bytes 255 up to a positive multiple of WIDTH."""
    return text + b"\xff" * (-len(text) % WIDTH if text else WIDTH)


def store_text(text: bytes) -> bytes:
    """A grey 8-bit TIFF that holds the text's payload."""
    rows = np.frombuffer(text_payload(text), np.uint8).reshape(-1, WIDTH)
    return write_tiff([rows[y : y + PAGE_ROWS] for y in range(0, len(rows), PAGE_ROWS)])


def page_feature(pixels: np.ndarray) -> str:
    """Size, mean, deviation and an 8x8 grid of block means against their median, as hex bits."""
    grey = pixels.mean(axis=2) if pixels.shape[2] > 1 else pixels[:, :, 0]
    h, w = grey.shape
    ys, xs = np.linspace(0, h, 9).astype(int)[:8], np.linspace(0, w, 9).astype(int)[:8]
    cells = grey[np.minimum(ys, h - 1)][:, np.minimum(xs, w - 1)] if h < 8 or w < 8 else np.add.reduceat(np.add.reduceat(grey.astype(np.float64), ys, 0), xs, 1)
    bits = (cells > np.median(cells)).ravel()
    return f"{w}x{h}:{grey.mean():.3f}:{grey.std():.3f}:{np.packbits(bits).tobytes().hex()}"


def pages(media: DataFrame, key: str, column: str) -> DataFrame:
    """(key, page, width, height, samples, bits, compression, predictor, pixels, error): one row for each page of column.

    Samples of 16 bits are little-endian in pixels. Null, empty or damaged media give one row with page null and error.
    """
    schema = f"{key} {dict(media.dtypes)[key]}, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = read_tiff(data or b"")
                    rows = [(k, i, p.pixels.shape[1], p.pixels.shape[0], p.pixels.shape[2], 8 * p.pixels.dtype.itemsize, p.compression, p.predictor, p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes(), None) for i, p in enumerate(found)]
                except ValueError as e:
                    rows = [(k, *[None] * 8, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]
    ship(media.sparkSession)
    return media.select(key, F.col(column)).mapInArrow(run, schema)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as a TIFF file."""
    return map_text(only(docs, "doc_id", "text"), ["doc_id", "text"], lambda keys, texts: {"doc_id": keys["doc_id"], "media": [store_text(t) for t in texts]}, "doc_id long, media binary")


def stored_digests(docs: DataFrame) -> DataFrame:
    """Stores each text, reads the file's pages back and digests both. A null text counts as empty; repeated rows each give one."""

    def run(keys, texts):
        rows = []
        for t in texts:
            media = store_text(t)
            read = read_tiff(media)
            payload = b"".join(p.pixels.tobytes() for p in read)
            rows.append((len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(read)};" + ";".join(page_feature(p.pixels) for p in read)))
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        return {"doc_id": keys["doc_id"]} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return map_text(
        only(docs, "doc_id", "text"), ["doc_id", "text"], run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
