import hashlib
import zlib

import numpy as np
import pytest

from gridloom.llm import tiff
from tests.llm import cases


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("big_endian", [False, True])
def test_round_trip(compression, predictor, tile, big_endian):
    r = np.random.default_rng(3)
    images = [r.integers(0, 9, (70, 45, 3)).astype(np.uint8), np.zeros((5, 200), np.uint8), (r.integers(0, 65535, (33, 17))).astype(np.uint16), r.integers(0, 255, (90, 90)).astype(np.uint8)]
    data = tiff.write_tiff(images, compression, predictor, tile, big_endian=big_endian)
    got = tiff.read_tiff(data)
    assert len(got) == 4
    for page, image in zip(got, images, strict=True):
        assert np.array_equal(page.pixels, image if image.ndim == 3 else image[:, :, None])


def test_lzw_long_and_packbits():
    r = np.random.default_rng(1)
    for data in (b"", b"a", b"ab" * 20000, r.integers(0, 256, 60000).astype(np.uint8).tobytes(), bytes(50000)):
        assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
        assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    # a published example of the format: 9-bit codes 256 7 258 8 8 2 257 for 7 7 7 8 8 2? written out by hand
    codes, bits = [256, 7, 258, 8, 8, 2, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    bits += "0" * (-len(bits) % 8)
    assert tiff.unpack_lzw(int(bits, 2).to_bytes(len(bits) // 8, "big")) == bytes([7, 7, 7, 8, 8, 2])


def test_pages_and_damage(spark):
    good = tiff.write_tiff([np.arange(12, dtype=np.uint8).reshape(3, 4)] * 2)
    loop = bytearray(good)
    df = spark.createDataFrame([(1, good), (2, b"no image"), (3, None), (4, bytes(good[:40])), (5, bytes(loop))], "id long, media binary")
    out = tiff.pages(df, "id", "media").collect()
    assert [(r.page, r.width, r.height, bytes(r.pixels)) for r in out if r.id == 1] == [(i, 4, 3, bytes(range(12))) for i in (0, 1)]
    assert all(r.page is None and r.error for r in out if r.id in (2, 3, 4))


def test_digests(spark):
    df = cases.hard(spark)
    out = tiff.stored_digests(df)
    texts = sorted(((r.doc_id, (r.text or "").encode()) for r in df.collect()), key=str)
    got = sorted(out.collect(), key=lambda r: str((r.doc_id, r.n_bytes)))
    want = sorted(texts, key=lambda t: str((t[0], len(t[1]))))
    for r, (i, t) in zip(got, want, strict=True):
        p = t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert tiff.stored_digests(cases.empty(spark)).count() == 0
    assert tiff.pages(tiff.store(df), "doc_id", "media").where("error is not null").count() == 0
