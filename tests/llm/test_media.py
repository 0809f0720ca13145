from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import media, tiff

RNG = np.random.default_rng(1)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(compression, predictor, tile, order):
    for kind in (np.uint8, np.uint16):
        pages = [RNG.integers(0, 50, (7, 11, 3)).astype(kind), np.repeat(RNG.integers(0, 255, (50, 1, 1)), 37, 1).astype(kind), RNG.integers(0, 255, (33, 64, 1)).astype(kind)]
        got = list(tiff.read_pages(tiff.write_pages(pages, compression, predictor, tile, None if tile else 5, order=order)))
        assert [g.index for g in got] == [0, 1, 2]
        for g, page in zip(got, pages, strict=True):
            assert (g.width, g.height, g.samples, g.compression, g.predictor) == (page.shape[1], page.shape[0], page.shape[2], compression, predictor)
            assert (g.pixels == page).all()


@settings(deadline=None)
@given(st.binary(max_size=3000))
def test_coders(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_long_lzw_data():
    for top in (4, 256):
        data = RNG.integers(0, top, 120_000).astype(np.uint8).tobytes()
        assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_known_codes():
    # The example of the PackBits note, and the LZW example of the format's specification (7 7 7 8 8 7 7 6 6).
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unpack_lzw(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("data", [b"", b"II*\0", b"GIF89a..", b"II*\0\x08\0\0\0", tiff.write_pages([np.zeros((3, 3, 1), np.uint8)])[:-30]])
def test_broken_files(data):
    with pytest.raises(ValueError):
        list(tiff.read_pages(data))


def test_media_query(spark):
    texts = ["", None, "a", "x" * 576, "x" * 577, "é" * 700_000, "a", "tab\tnew\nline"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    files = media.store_documents(docs)
    got = {r.doc_id: r for r in media.stored_features(files).collect()}
    stored = {r.doc_id: bytes(r.media) for r in files.collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    assert got[2][1:] == got[6][1:] and "pages=2" in got[5].feature
    pages = media.tiff_pages(files.unionAll(spark.createDataFrame([(90, 0, bytearray(b"junk")), (91, 0, None)], files.schema))).collect()
    assert [p.error is not None for p in pages if p.doc_id == 90] == [True] and not [p for p in pages if p.doc_id == 91]
    joined = b"".join(bytes(p.pixels) for p in sorted((p for p in pages if p.doc_id == 5), key=lambda p: p.page))
    assert hashlib.sha256(joined).hexdigest() == got[5].payload_sha256
    assert media.stored_features(media.store_documents(docs.filter("false"))).collect() == []


def header(entries, order="<"):
    """A file of one directory with these (tag, kind, count, value) entries."""
    body = b"".join(struct.pack(order + "HHII", *e) for e in entries)
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(entries)) + body + struct.pack("<I", 0)


@pytest.mark.parametrize(
    "entries",
    [
        [(256, 4, 1, 4_000_000), (257, 4, 1, 1_000_000), (258, 3, 1, 8), (259, 3, 1, 8), (273, 4, 1, 8), (278, 4, 1, 1_000_000), (279, 4, 1, 4_000_000_000)],
        [(256, 4, 1, 4), (257, 4, 1, 4), (258, 3, 1, 8), (322, 4, 1, 4), (323, 4, 1, 4), (324, 4, 1, 8)],  # tiles without sizes
        [(256, 4, 0, 0), (257, 4, 1, 4), (258, 3, 1, 8)],  # a width of no value
        [(256, 9, 1, 0xFFFFFFFF), (257, 4, 1, 4), (258, 3, 1, 8), (273, 4, 1, 8), (279, 4, 1, 4)],  # a negative width
        [(256, 4, 1, 4), (257, 4, 1, 4), (258, 3, 1, 8), (259, 3, 1, 99), (273, 4, 1, 8), (279, 4, 1, 40)],  # an unknown compression
        [(256, 4, 1, 1), (257, 4, 1, 1), (258, 3, 1, 8), (322, 4, 1, 1 << 20), (323, 4, 1, 1 << 20), (324, 4, 1, 8), (325, 4, 1, 16)],  # a vast tile
    ],
)
def test_malformed_files_raise_only_value_errors(entries):
    with pytest.raises(ValueError):
        list(tiff.read_pages(header(entries)))


def test_no_more_is_unpacked_than_a_page_needs():
    bomb = zlib.compress(bytes(50_000_000), 9)
    assert len(tiff._unpack(bomb, tiff.DEFLATE, 100)) == 100
    assert len(tiff._unpack(tiff.pack_bits(bytes(100_000)), tiff.PACKBITS, 100)) <= 300
    assert len(tiff._unpack(tiff.pack_lzw(bytes(1_000_000)), tiff.LZW, 100)) < 5_000


def test_features_of_a_null_file(spark):
    files = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [tuple(r) for r in media.stored_features(files).collect()] == [(1, 0, *[None] * 6)]
