"""TIFF: known code streams, round trips in every form, other byte order and planes, broken files."""

import random
import struct

import numpy as np
import pytest

from provider_analytics.llm import tiff


def test_known_streams():
    # The PackBits example of the format's description.
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpack_bits(packed, len(plain)) == plain
    assert tiff.unpack_bits(b"\x80" + packed, len(plain)) == plain
    # And its LZW example: the codes clear 7 258 8 8 258 6 6 end, nine bits each.
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    stream = int(codes.ljust(-(-len(codes) // 8) * 8, "0"), 2).to_bytes(-(-len(codes) // 8))
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(data) == stream and tiff.lzw_decode(stream, len(data)) == data


@pytest.mark.parametrize("alphabet", [1, 2, 5, 256])
@pytest.mark.parametrize("size", [0, 1, 2, 255, 4000, 40_000])
def test_codecs(alphabet, size):
    rnd = random.Random(size + alphabet)
    data = bytes(rnd.randrange(alphabet) for _ in range(size))
    assert tiff.lzw_decode(tiff.lzw_encode(data), size) == data
    assert tiff.unpack_bits(tiff.pack_bits(data), size) == data


@pytest.mark.parametrize("compression", ["none", "packbits", "lzw", "deflate"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [(0, 0), (16, 32)])
def test_pages(compression, predictor, tile):
    rng = np.random.default_rng(4)
    pages = [tiff.Page(rng.integers(0, 256, (rng.integers(1, 70), rng.integers(1, 70), s), np.uint8), compression, predictor, 13, tile)
             for s in (1, 3, 4)]
    found = list(tiff.read_tiff(tiff.write_tiff(pages)))
    assert len(found) == 3
    for page, other in zip(pages, found, strict=True):
        assert (page.pixels == other.pixels).all()
        assert (other.compression, other.predictor, other.tile) == (compression, predictor, tile)


def big_endian_planes():
    """Two planes of 2 x 3 samples, big-endian, one strip each."""
    planes = [bytes(range(6)), bytes(range(100, 106))]
    data = b"MM\0*" + struct.pack(">I", 20) + planes[0] + planes[1]
    tags = [(256, 3, 1, struct.pack(">HH", 3, 0)), (257, 3, 1, struct.pack(">HH", 2, 0)), (258, 3, 2, struct.pack(">HH", 8, 8)),
            (273, 3, 2, struct.pack(">HH", 8, 14)), (277, 3, 1, struct.pack(">HH", 2, 0)), (279, 3, 2, struct.pack(">HH", 6, 6)),
            (284, 3, 1, struct.pack(">HH", 2, 0)), (305, 2, 3, b"ab\0\0"), (999, 12, 1, b"\0\0\0\0")]
    return data + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", *t[:3]) + t[3] for t in tags) + b"\0\0\0\0"


def test_other_byte_order_and_planes():
    (page,) = tiff.read_tiff(big_endian_planes())
    assert page.pixels.shape == (2, 3, 2)
    assert page.pixels[..., 0].ravel().tolist() == list(range(6)) and page.pixels[..., 1].ravel().tolist() == list(range(100, 106))


def broken_files():
    good = tiff.write_tiff([tiff.Page(np.zeros((4, 4, 1), np.uint8))])
    loop = bytearray(good)
    struct.pack_into("<I", loop, len(loop) - 4, struct.unpack_from("<I", good, 4)[0])
    deep = bytearray(good)
    deep[deep.index(struct.pack("<HHI", 258, 3, 1)) + 8] = 16
    return [b"", b"GIF89a..", good[:30], bytes(loop), bytes(deep), good[:4] + b"\xff\xff\xff\x00"]


def test_broken_files():
    for data in broken_files():
        with pytest.raises(ValueError):
            list(tiff.read_tiff(data))


def test_one_row_for_each_page(spark):
    two = tiff.write_tiff([tiff.Page(np.full((2, 3, 1), 7, np.uint8), "lzw"), tiff.Page(np.full((1, 1, 3), 9, np.uint8))])
    rows = [(1, two), (2, None), (1, two), *((3, d) for d in broken_files())]
    df = spark.createDataFrame(rows, "doc_id int, media binary").selectExpr("*", "'x' AS page")
    found = tiff.with_features(tiff.pages_of(df, keep=("doc_id",))).collect()
    ok = [(r.doc_id, r.page, r.width, r.height, r.samples, bytes(r.pixels)) for r in found if r.error is None]
    # The file whose directories form a loop has one page before it breaks off.
    assert sorted(ok) == [(1, 0, 3, 2, 1, b"\7" * 6)] * 2 + [(1, 1, 1, 1, 3, b"\11" * 3)] * 2 + [(3, 0, 4, 4, 1, b"\0" * 16)]
    bad = [r for r in found if r.error is not None]
    assert len(bad) == len(broken_files()) and all(r.pixels is None and r.feature is None for r in bad)
    with pytest.raises(ValueError):
        tiff.pages_of(df, keep=("doc_id", "page"))


def test_texts_round_trip(spark):
    rnd = random.Random(8)
    texts = [None, "", "a" * 192, "é" * 97, " " * 191, "x" * 193, "\n" * 100_000, "".join(chr(rnd.randrange(32, 1000)) for _ in range(50_000))]
    df = spark.createDataFrame([(i % len(texts), t) for i, t in enumerate(texts * 2)], "doc_id bigint, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    stored = tiff.store_texts(df)
    pages = tiff.with_features(tiff.pages_of(stored, keep=("doc_id", "n_bytes"))).collect()
    assert len(pages) == 2 * len(texts)
    features = {}
    for r in pages:
        raw = (texts[r.doc_id] or "").encode()
        payload = bytes(r.pixels)
        assert r.n_bytes == len(raw) and payload[: len(raw)] == raw and not payload[len(raw):].strip(b" ")
        assert len(payload) % 192 == 0 and len(payload) == max(192, -(-len(raw) // 192) * 192)
        assert features.setdefault(r.doc_id, r.feature) == r.feature
    assert len({r.compression for r in pages}) > 1
    assert tiff.store_texts(df.limit(0)).collect() == []


def header(width, height, offsets=(8,), counts=(1,)):
    """A file with one directory that claims a size."""
    import struct

    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 1, offsets[0]), (279, 4, 1, counts[0])]
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"


def test_a_header_that_claims_too_much_gives_an_error_row(spark):
    good = tiff.payload_image(b"fine")
    rows = [(1, header(300_000, 300_000)), (2, good), (3, header(0, 5)), (4, header(40_000, 20_000)), (5, header(300_000, 300_000) + b"x")]
    found = {r.id: r for r in tiff.pages_of(spark.createDataFrame(rows, "id int, media binary"), keep=("id",)).collect()}
    assert found[2].error is None and found[2].pixels is not None
    assert all(found[i].error and found[i].pixels is None for i in (1, 3, 4, 5))


def test_pages_leave_in_parts(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(tiff, "HELD", 1)
    pages = [tiff.Page(np.full((4, 6, 1), n, np.uint8), "deflate", 1, 4) for n in range(5)]
    found = tiff.pages_of(spark.createDataFrame([(1, tiff.write_tiff(pages)), (2, b"x"), (3, None)], "id int, media binary"), keep=("id",)).collect()
    assert [(r.id, r.page) for r in sorted(found, key=lambda r: (r.id, r.page))] == [(1, n) for n in range(5)] + [(2, 0)]
    assert all(set(bytes(r.pixels)) == {r.page} for r in found if r.id == 1)
