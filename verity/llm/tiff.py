"""TIFF files as columns: write bytes as grey pages, walk image directories, decode pages."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 format: tag numbers, field sizes by type, compression codes.
WIDTH, LENGTH, BITS_PER_SAMPLE, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES_PER_PIXEL, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "L", 6: "b", 8: "h", 9: "l"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

#: Payloads are padded to a multiple of this many bytes.
UNIT = 576
#: Pixels in a row of the pages that are written, and rows in a page at most.
ROW, PAGE_ROWS = 96, 4096
STRIP_ROWS, TILE_ROWS = 512, 256
#: A block of n bytes holds at most so many times n bytes of samples, whatever its codec.
GREATEST_RATIO = 2048
#: What broken bytes can raise while a page is read.
BROKEN = (ValueError, LookupError, ArithmeticError, TypeError, MemoryError, struct.error)


class TiffError(ValueError):
    """The bytes are no TIFF file that can be read whole."""


RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three bytes or more as a count and the byte, all else as literals of 128 bytes at most."""
    out, at = bytearray(), 0

    def literals(stop: int) -> None:
        for i in range(at, stop, 128):
            own = data[i : min(i + 128, stop)]
            out.append(len(own) - 1)
            out.extend(own)

    for run in RUN.finditer(data):
        literals(run.start())
        out += bytes((257 - (run.end() - run.start()), data[run.start()]))
        at = run.end()
    literals(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


CLEAR, END = 256, 257


@cache
def _digits(width: int) -> list[str]:
    return [f"{code:0{width}b}" for code in range(1 << width)]


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, wider one code early."""
    digits = _digits(9)
    out, table, following = [digits[CLEAR]], {}, 258
    have = -1
    for byte in data:
        if have < 0:
            have = byte
            continue
        longer = have << 8 | byte
        if (known := table.get(longer)) is not None:
            have = known
            continue
        out.append(digits[have])
        table[longer] = following
        following += 1
        if following == 4095:
            out.append(digits[CLEAR])
            table, following, digits = {}, 258, _digits(9)
        elif following in (512, 1024, 2048):
            digits = _digits(following.bit_length())
        have = byte
    if have >= 0:
        out.append(digits[have])
        if following + 1 in (512, 1024, 2048):
            digits = _digits((following + 1).bit_length())
    out.append(digits[END])
    bits = "".join(out)
    pad = -len(bits) % 8
    return int(bits + "0" * pad, 2).to_bytes((len(bits) + pad) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    out = bytearray()
    table: list[bytes] = []
    width, held, n_held, last = 9, 0, 0, b""
    for byte in data:
        held, n_held = held << 8 | byte, n_held + 8
        if n_held < width:
            continue
        n_held -= width
        code, held = held >> n_held, held & ((1 << n_held) - 1)
        if code == END or len(out) >= size:
            break
        if code == CLEAR:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table or code > len(table):
            raise TiffError("LZW code out of order")
        if not last:
            if code >= CLEAR:
                raise TiffError("LZW code out of order")
            last = table[code]
            out += last
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        table.append(last + entry[:1])
        if len(table) in (511, 1023, 2047):
            width += 1
        last = entry
    return bytes(out)


def _squeeze(block: np.ndarray, codec: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
    raw = block.tobytes()
    if codec == LZW:
        return lzw_encode(raw)
    if codec == PACKBITS:
        return b"".join(packbits_encode(raw[i : i + block.shape[1]]) for i in range(0, len(raw), block.shape[1]))
    return zlib.compress(raw, 6) if codec in (DEFLATE, OLD_DEFLATE) else raw


def encode(payload: bytes, codec: int, predictor: int = 1, order: str = "<", first_tiled: bool = False) -> bytes:
    """A TIFF file whose grey 8-bit samples, page by page, are ``payload`` (a multiple of ROW bytes).
    Pages are cut into strips and into tiles by turns."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HL", 42, 0))
    link = 4
    for page, top in enumerate(range(0, len(pixels), PAGE_ROWS)):
        image = pixels[top : top + PAGE_ROWS]
        tiled = page % 2 != first_tiled
        height = TILE_ROWS if tiled else STRIP_ROWS
        offsets, sizes = [], []
        for at in range(0, len(image), height):
            block = image[at : at + height]
            if tiled and len(block) < height:
                block = np.vstack([block, np.zeros((height - len(block), ROW), np.uint8)])
            data = _squeeze(block, codec, predictor)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = [(WIDTH, 4, [ROW]), (LENGTH, 4, [len(image)]), (BITS_PER_SAMPLE, 3, [8]), (COMPRESSION, 3, [codec]), (PHOTOMETRIC, 3, [1]), (SAMPLES_PER_PIXEL, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [ROW]), (TILE_LENGTH, 4, [height]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tiled else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [height]), (STRIP_BYTES, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{TYPE_CODE[kind]}", *values)
            if len(raw) > 4:
                entries.append(struct.pack(order + "HHLL", tag, kind, len(values), len(out)))
                out += raw
            else:
                entries.append(struct.pack(order + "HHL", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "L", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, {tag: values}) of each image directory, in file order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    try:
        if not order or struct.unpack_from(order + "H", data, 2) != (42,):
            raise TiffError("no TIFF header")
        (at,) = struct.unpack_from(order + "L", data, 4)
        seen = set()
        while at:
            if at in seen:
                raise TiffError("directories form a circle")
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", data, at)
            tags = {}
            for i in range(n):
                entry = at + 2 + 12 * i
                tag, kind, count = struct.unpack_from(order + "HHL", data, entry)
                if kind in TYPE_CODE:
                    size = TYPE_SIZE[kind] * count
                    where = entry + 8 if size <= 4 else struct.unpack_from(order + "L", data, entry + 8)[0]
                    tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, where)
            yield order, tags
            (at,) = struct.unpack_from(order + "L", data, at + 2 + 12 * n)
    except struct.error as e:
        raise TiffError(f"truncated: {e}") from None


def _expand(data: bytes, codec: int, size: int) -> bytes:
    if codec == NONE:
        return data
    if codec == LZW:
        return lzw_decode(data, size)
    if codec == PACKBITS:
        return packbits_decode(data, size)
    if codec in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(str(e)) from None
    raise TiffError(f"compression {codec}")


def decode_page(data: bytes, order: str, tags: dict[int, tuple]) -> np.ndarray:
    """Samples of a page as (rows, columns, samples), 8 or 16 bits each."""
    if WIDTH not in tags or LENGTH not in tags:
        raise TiffError("no image size")
    width, length = tags[WIDTH][0], tags[LENGTH][0]
    samples = tags.get(SAMPLES_PER_PIXEL, (1,))[0]
    bits = set(tags.get(BITS_PER_SAMPLE, (1,)))
    if bits not in ({8}, {16}):
        raise TiffError(f"{sorted(bits)} bits in a sample")
    depth = np.dtype(order + "u2") if bits == {16} else np.dtype("u1")
    codec, predictor = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
    planes = samples if tags.get(PLANAR, (1,))[0] == 2 else 1
    each = samples // planes
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor}")
    if not width or not length or not samples:
        raise TiffError("no pixels")
    tiled = TILE_OFFSETS in tags
    wide = tags[TILE_WIDTH][0] if tiled else width
    high = tags[TILE_LENGTH][0] if tiled else min(tags.get(ROWS_PER_STRIP, (length,))[0], length) or 1
    offsets, sizes = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS), tags.get(TILE_BYTES if tiled else STRIP_BYTES)
    if not wide or not high:
        raise TiffError("blocks without pixels")
    across, down = -(-width // wide), -(-length // high)
    if not offsets or not sizes or len(offsets) < across * down * planes or len(sizes) < len(offsets):
        raise TiffError("blocks are missing")
    held = sum(min(n, max(0, len(data) - at)) for at, n in zip(offsets, sizes, strict=False))
    if max(length * width * samples, across * down * planes * wide * each) * depth.itemsize > GREATEST_RATIO * held:
        raise TiffError("more pixels than the blocks can hold")
    image = np.zeros((length, width, samples), depth)
    for k in range(across * down * planes):
        plane, at = divmod(k, across * down)
        top, left = at // across * high, at % across * wide
        rows = high if tiled else min(high, length - top)
        need = rows * wide * each * depth.itemsize
        if need > GREATEST_RATIO * sizes[k]:
            raise TiffError("more pixels than a block can hold")
        raw = _expand(data[offsets[k] : offsets[k] + sizes[k]], codec, need)
        if len(raw) < need:
            raise TiffError("a block is too short")
        block = np.frombuffer(raw, depth, rows * wide * each).reshape(rows, wide, each)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=depth.newbyteorder("="))
        h, w = min(rows, length - top), min(wide, width - left)
        image[top : top + h, left : left + w, plane * each : (plane + 1) * each] = block[:h, :w]
    return image


PAGES = "page int, width int, length int, samples int, bits int, compression int, pixels binary, error string"


def read_pages(data: bytes) -> Iterator[tuple[np.ndarray | None, int | None, str | None]]:
    """(samples, compression, error) of each page. A page that cannot be decoded gives an error, and the
    next one follows; a chain of directories that breaks off gives an error and ends."""
    chain = directories(data)
    while True:
        try:
            order, tags = next(chain)
        except StopIteration:
            return
        except BROKEN as e:
            yield None, None, str(e) or type(e).__name__
            return
        try:
            yield decode_page(data, order, tags), tags.get(COMPRESSION, (NONE,))[0], None
        except BROKEN as e:
            yield None, None, str(e) or type(e).__name__


#: Rows, and bytes of pixels, from which a batch of pages is handed on.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def tiff_pages(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of every file: the id, ``page`` (from 0), its size, ``pixels`` (row by row,
    the file's byte order for 16 bits) and ``error``.

    Null or empty media gives no row. A page that cannot be decoded gives a row with ``error`` and
    without pixels, and the next pages follow; a file that breaks off gives the pages before, then such
    a row. Other columns are not looked at; repeated rows repeat.
    """
    ids = media.schema[id_col]
    schema = pa.schema([(id_col, _arrow(ids.dataType)), ("page", pa.int32()), ("width", pa.int32()), ("length", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])

    def rows_of(one: object, data: bytes) -> Iterator[tuple]:
        for page, (image, codec, error) in enumerate(read_pages(data)):
            if image is None:
                yield one, page, None, None, None, None, None, None, error
            else:
                yield one, page, image.shape[1], image.shape[0], image.shape[2], image.dtype.itemsize * 8, codec, image.tobytes(), None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for one, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in rows_of(one, data.as_py()) if data.is_valid and len(data.as_py()) else ():
                    held.append(row)
                    size += len(row[7] or b"")
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    return media.select(id_col, media_col).mapInArrow(over, f"`{id_col}` {ids.dataType.simpleString()}, {PAGES}")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def pack(payload: bytes) -> bytes:
    """Codec, predictor, byte order and layout follow from a hash of the payload, whatever its size."""
    h = zlib.crc32(payload)
    return encode(payload, (LZW, PACKBITS, DEFLATE, DEFLATE)[h % 4], 1 + (h >> 2) % 2, "<>"[(h >> 3) % 2], bool((h >> 4) % 2))


def features(pages: list[np.ndarray]) -> str:
    """Pages, rows, mean and variance of the samples and the share of each quarter of their range."""
    flat = np.concatenate([p.ravel() for p in pages])
    counts = np.bincount(flat, minlength=256)
    values = np.arange(256)
    total = int(counts.sum())
    mean = int((counts * values).sum()) / total
    var = int((counts * values * values).sum()) / total - mean * mean
    quarters = ",".join(f"{int(q.sum()) / total:.6f}" for q in np.split(counts, 4))
    return f"pages={len(pages)};rows={sum(len(p) for p in pages)};mean={mean:.6f};var={var:.6f};quarters={quarters}"


TEXT_MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every whole text as a TIFF file, read the file back and describe what was read.

    The payload is the UTF-8 text, padded with bytes 255 to a positive multiple of 576; null counts
    as empty. Digests, tail checksum and feature are of the samples decoded from the stored bytes.
    ``keep_media`` adds the file as column ``media``. Equal texts give equal values; other columns
    are not looked at; repeated rows repeat; an empty table gives an empty result.
    """
    ids = docs.schema[id_col]
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    fields += [("media", pa.binary())] * keep_media
    schema = pa.schema([(id_col, _arrow(ids.dataType)), *fields])

    def one(text: str | None) -> tuple:
        payload, n = padded(text)
        media = pack(payload)
        pages = [image for image, _, _ in read_pages(media)]
        back = b"".join(p.tobytes() for p in pages)
        row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(pages))
        return (*row, media) if keep_media else row

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [one(t) for t in part.column(1).to_pylist()]
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema.field(0).type), *columns], schema=schema)

    made = TEXT_MEDIA + ", media binary" * keep_media
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(over, f"`{id_col}` {ids.dataType.simpleString()}, {made}")
