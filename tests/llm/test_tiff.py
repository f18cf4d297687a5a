import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from verity.llm import tiff


def samples():
    rng = random.Random(3)
    yield b""
    yield b"a"
    yield b"a" * 5000
    yield bytes(rng.randrange(256) for _ in range(9000))
    yield b"".join(rng.choice([b"the ", b"of ", b"\0" * 200, b"x"]) for _ in range(6000))


@pytest.mark.parametrize("data", samples())
def test_codecs_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS, tiff.OLD_DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
def test_pages_round_trip(order, codec, predictor):
    rng = np.random.default_rng(4)
    payload = rng.integers(0, 40, tiff.ROW * 9000 if codec in (tiff.NONE, tiff.DEFLATE) else tiff.ROW * 700, dtype=np.uint8).tobytes()
    data = tiff.encode(payload, codec, predictor, order)
    pages = [tiff.decode_page(data, o, tags) for o, tags in tiff.directories(data)]
    assert b"".join(p.tobytes() for p in pages) == payload
    assert len(pages) == -(-len(payload) // (tiff.ROW * tiff.PAGE_ROWS))


def planar_16_bit():
    """Two planes of 16-bit samples in a big-endian file, written by hand."""
    image = (np.arange(2 * 3 * 2).reshape(2, 3, 2) * 1000).astype(">u2")
    planes = [image[:, :, k].tobytes() for k in range(2)]
    head = b"MM" + struct.pack(">HL", 42, 8 + 24)
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, (16, 16)), (259, 3, 1), (273, 4, None), (277, 3, 2), (278, 3, 2), (279, 4, None), (284, 3, 2)]
    at = 8 + 24 + 2 + 12 * len(tags) + 4
    entries = b""
    for tag, kind, value in tags:
        if tag in (273, 279):
            entries += struct.pack(">HHLL", tag, kind, 2, at + (0 if tag == 273 else 8))
        elif isinstance(value, tuple):
            entries += struct.pack(">HHLHH", tag, kind, 2, *value)
        else:
            entries += struct.pack(">HHLHH", tag, kind, 1, value, 0)
    return image, head + b"".join(planes) + struct.pack(">H", len(tags)) + entries + b"\0" * 4 + struct.pack(">LLLL", 8, 20, 12, 12)


def test_planar_16_bit():
    image, data = planar_16_bit()
    ((order, tags),) = tiff.directories(data)
    assert (tiff.decode_page(data, order, tags) == image).all()


def test_pages_of_a_table(spark):
    payload = bytes(range(96)) * 5000
    good = tiff.encode(payload, tiff.DEFLATE, 2)
    circle = bytearray(tiff.encode(b"\1" * 96, tiff.NONE))
    circle[-4:] = circle[4:8]
    rows = [(1, good, "x"), (1, good, "x"), (2, good[:-40], "x"), (3, b"", "x"), (4, None, "x"), (5, b"GIF89a", "x"), (None, bytes(circle), "x")]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary, error string"), "doc_id", "media").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert b"".join(bytes(r.pixels) for r in sorted(by[1], key=lambda r: r.page)[::2]) == payload and len(by[1]) == 4
    assert 3 not in by and 4 not in by
    assert by[5][0].error and by[2][-1].error
    assert [r.error is None for r in by[None]] == [True, False]


def broken_files():
    """LZW code 258 after a clear code, no width, more pixels than any block can hold, and a field that ends nowhere."""
    good = tiff.encode(bytes(range(96)) * 6, tiff.LZW)
    ((_, tags),) = tiff.directories(good)
    at = tags[tiff.STRIP_OFFSETS][0]
    bits = f"{256:09b}{258:09b}".ljust(24, "0")
    yield good[:at] + int(bits, 2).to_bytes(3, "big") + good[at + 3 :]
    for tag, value in ((tiff.WIDTH, 0), (tiff.LENGTH, 0), (tiff.WIDTH, 1 << 20), (tiff.LENGTH, 1 << 24), (tiff.ROWS_PER_STRIP, 0), (tiff.SAMPLES_PER_PIXEL, 0), (tiff.STRIP_OFFSETS, 1 << 31)):
        entry = good.index(struct.pack("<HHL", tag, 3 if tag == tiff.SAMPLES_PER_PIXEL else 4, 1)) + 8
        yield good[:entry] + struct.pack("<L", value) + good[entry + 4 :]
    entry = good.index(struct.pack("<HHL", tiff.WIDTH, 4, 1)) + 4
    yield good[:entry] + struct.pack("<L", 1 << 31) + good[entry + 4 :]


def test_broken_files_give_error_rows(spark):
    files = list(broken_files())
    two = bytearray(tiff.encode(bytes(96) * (tiff.PAGE_ROWS + 5), tiff.NONE))
    first = two.index(struct.pack("<HHL", tiff.COMPRESSION, 3, 1)) + 8
    two[first : first + 2] = struct.pack("<H", 7)  # an unknown codec of the first page alone
    rows = [(k, bytes(x)) for k, x in enumerate([*files, two])]
    got = {}
    for r in tiff.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary"), "doc_id", "media").collect():
        got.setdefault(r.doc_id, []).append((r.page, r.error is None))
    odd = [k for k in range(len(files)) if got.get(k) and got[k] != [(0, False)]]
    assert len(got) == len(rows) and set(odd) <= {5}  # a strip without a number of rows is read as one row at a time, or is an error
    assert sorted(got[len(files)]) == [(0, False), (1, True)]


def test_every_codec_is_used_at_every_size():
    for size in (1, 30, 400):
        used = {tuple((t[tiff.COMPRESSION][0], t[tiff.PREDICTOR][0], o, tiff.TILE_OFFSETS in t) for o, t in tiff.directories(tiff.pack(bytes([k]) * 576 * size))) for k in range(256)}
        assert {x[0][0] for x in used} == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE} and len(used) > 15


def test_text_media_against_the_contract(spark):
    texts = [(1, None), (2, ""), (3, "ä" * 288), (4, "b" * 577), (5, "c" * 1500), (6, "word " * 100_000), (7, "word " * 100_000), (None, "x")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, feature int")
    got = {r.doc_id: r for r in tiff.text_media(docs, keep_media=True).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert got[6][1:] == got[7][1:]
    pages = tiff.tiff_pages(tiff.text_media(docs, keep_media=True), "doc_id", "media")
    whole = {}
    for r in sorted(pages.collect(), key=lambda r: r.page):
        whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.pixels)
    assert hashlib.sha256(whole[6]).hexdigest() == got[6].payload_sha256


def test_empty_table(spark):
    assert tiff.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
