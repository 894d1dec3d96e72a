"""TIFF columns: writing and reading images inside binary columns.

The reader walks the chain of image directories and emits one row for each page: it undoes PackBits, LZW or deflate
strip by strip or tile by tile and then the horizontal predictor. The writer makes the same forms. Baseline layout
with 8-bit samples, chunky or planar; classic files, so offsets have 32 bits."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tag numbers, field types and compression codes.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC = 256, 257, 258, 259, 262
_STRIP_OFFSETS, _SAMPLES, _ROWS_PER_STRIP, _STRIP_COUNTS, _PLANAR, _PREDICTOR = 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS = 322, 323, 324, 325
_FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}
_CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
_NAMES = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
_CLEAR, _END, _FIRST, _LAST = 256, 257, 258, 4094

_REPEAT = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(row: bytes) -> bytes:
    out, at = bytearray(), 0
    for m in [*_REPEAT.finditer(row), None]:
        end = len(row) if m is None else m.start()
        for a in range(at, end, 128):
            part = row[a:min(a + 128, end)]
            out.append(len(part) - 1)
            out += part
        if m is not None:
            out.append(257 - (m.end() - m.start()))
            out.append(row[m.start()])
            at = m.end()
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(data):
            raise ValueError("PackBits data ends early")
        n = data[at]
        if n < 128:
            out += data[at + 1:at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1:at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out[:size])


# A code's width follows from its place after the last clear code: the table grows by one entry a code, and codes get
# a bit longer one code before the table needs it.
_LZW_WIDTHS = np.repeat(np.array([9, 10, 11, 12]), [254, 512, 1024, _LAST - _FIRST + 2 - 1790])
_LZW_STARTS = np.concatenate([[0], np.cumsum(_LZW_WIDTHS)])


def lzw_encode(data: bytes) -> bytes:
    """Codes most significant bit first, a clear code at the start and whenever entry 4094 is used."""
    codes, runs = [], []
    table: dict[int, int] = {}
    free, prefix = _FIRST, -1
    find, emit = table.get, codes.append
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = find(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        table[key] = free
        prefix = byte
        if free == _LAST:
            emit(_CLEAR)
            runs.append(len(codes))
            table.clear()
            free = _FIRST
        else:
            free += 1
    if prefix >= 0:
        emit(prefix)
    emit(_END)
    runs.append(len(codes))
    widths = [np.array([9])]
    for a, b in zip([0, *runs], runs, strict=False):
        widths.append(_LZW_WIDTHS[: b - a])
    return _bits(np.array([_CLEAR, *codes]), np.concatenate(widths))


def _bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths one after the other, most significant bit first. No two share a bit, so the bytes
    that a code touches can be summed up."""
    ends = np.cumsum(widths)
    starts = ends - widths
    words = codes << (24 - widths - (starts & 7))
    at = starts >> 3
    out = np.zeros((int(ends[-1]) + 7 >> 3) + 3, np.float64)
    for k in range(3):
        out += np.bincount(at + k, words >> (16 - 8 * k) & 255, len(out))
    return out.astype(np.uint8)[:-3].tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total = 8 * len(data)
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    made, bit = 0, 0
    while made < size:
        n = int(np.searchsorted(_LZW_STARTS, total - bit, side="right")) - 1
        if n <= 0:
            break
        starts, widths = bit + _LZW_STARTS[:n], _LZW_WIDTHS[:n]
        at = starts >> 3
        words = (raw[at] << 16) | (raw[at + 1] << 8) | raw[at + 2]
        codes = (words >> (24 - widths - (starts & 7))) & ((1 << widths) - 1)
        table, prev, used = singles.copy(), None, n
        add = table.append
        for place, code in enumerate(codes.tolist()):
            if code == _CLEAR or code == _END:
                used = place + 1
                break
            if prev is None:
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = prev + prev[:1]
                else:
                    raise ValueError("LZW code out of range")
                add(prev + entry[:1])
            out.append(entry)
            made += len(entry)
            prev = entry
        if codes[used - 1] == _END:
            break
        if codes[used - 1] != _CLEAR and used < len(_LZW_WIDTHS):
            break
        bit = int(bit + _LZW_STARTS[used])
    if made < size:
        raise ValueError("LZW data ends early")
    return b"".join(out)[:size]


def _compress(rows: np.ndarray, compression: str) -> bytes:
    if compression == "packbits":
        return b"".join(pack_bits(row.tobytes()) for row in rows)
    data = rows.tobytes()
    return {"none": bytes, "lzw": lzw_encode, "deflate": lambda d: zlib.compress(d, 6)}[compression](data)


def _decompress(data: bytes, compression: str, size: int) -> bytes:
    if compression == "deflate":
        data = zlib.decompress(data)
    elif compression == "packbits":
        return unpack_bits(data, size)
    elif compression == "lzw":
        return lzw_decode(data, size)
    if len(data) < size:
        raise ValueError("strip or tile is too short")
    return data[:size]


@dataclass
class Page:
    """An image: pixels[height, width, samples] of uint8, and how it is or was stored. tile (0, 0) means strips."""

    pixels: np.ndarray
    compression: str = "none"
    predictor: int = 1
    rows_per_strip: int = 64
    tile: tuple[int, int] = (0, 0)


def _blocks(page: Page) -> Iterator[np.ndarray]:
    height, width, _ = page.pixels.shape
    if not all(page.tile):
        for y in range(0, height, page.rows_per_strip):
            yield page.pixels[y:y + page.rows_per_strip]
        return
    tall, wide = page.tile
    for y in range(0, height, tall):
        for x in range(0, width, wide):
            part = page.pixels[y:y + tall, x:x + wide]
            yield np.pad(part, ((0, tall - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))


def write_tiff(pages: list[Page]) -> bytes:
    """A little-endian file of all pages in order."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width, samples = page.pixels.shape
        offsets, counts = [], []
        for block in _blocks(page):
            if page.predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            data = _compress(np.ascontiguousarray(block).reshape(block.shape[0], -1), page.compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags = {_WIDTH: [width], _HEIGHT: [height], _BITS: [8] * samples, _COMPRESSION: [_CODES[page.compression]],
                _PHOTOMETRIC: [2 if samples == 3 else 1], _SAMPLES: [samples], _PLANAR: [1], _PREDICTOR: [page.predictor]}
        if all(page.tile):
            tags |= {_TILE_WIDTH: [page.tile[1]], _TILE_HEIGHT: [page.tile[0]], _TILE_OFFSETS: offsets, _TILE_COUNTS: counts}
        else:
            tags |= {_STRIP_OFFSETS: offsets, _ROWS_PER_STRIP: [page.rows_per_strip], _STRIP_COUNTS: counts}
        short = {_BITS, _COMPRESSION, _PHOTOMETRIC, _SAMPLES, _PLANAR, _PREDICTOR}
        entries = bytearray()
        for tag, values in sorted(tags.items()):
            kind, letter = (3, "H") if tag in short else (4, "I")
            packed = struct.pack(f"<{len(values)}{letter}", *values)
            if len(packed) > 4:
                at = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
        if len(out) >= 2**32:
            raise ValueError("a classic TIFF holds at most 4 GB")
    return bytes(out)


#: Bytes of samples that a page may have, and pages a task holds before it hands them on.
MAX_PAGE, HELD = 1 << 30, 16 << 20


def read_tiff(data: bytes, max_page: int = MAX_PAGE) -> Iterator[Page]:
    """The pages of a file of either byte order, directory by directory. Raises ValueError on what is not TIFF, breaks
    off early, loops, has samples that are not 8 bits wide, or claims a page of more than `max_page` bytes. What a
    header claims is held against its strips before memory is taken."""
    if data[:4] not in (b"II*\0", b"MM\0*") or len(data) < 8:
        raise ValueError("not a TIFF file")
    order = "<" if data[:1] == b"I" else ">"
    try:
        at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
        while at:
            if at in seen:
                raise ValueError("directories form a loop")
            seen.add(at)
            tags, at = _directory(data, at, order)
            yield _page(data, tags, max_page)
    except (struct.error, KeyError, zlib.error, IndexError) as error:
        raise ValueError(f"broken TIFF: {error!r}") from error


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    tags = {}
    (n,) = struct.unpack_from(order + "H", data, at)
    for place in range(at + 2, at + 2 + 12 * n, 12):
        tag, kind, count = struct.unpack_from(order + "HHI", data, place)
        if kind not in _FIELD:
            continue
        size = struct.calcsize(order + _FIELD[kind]) * count
        start = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
        tags[tag] = struct.unpack_from(f"{order}{count}{_FIELD[kind]}", data, start)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict[int, tuple], max_page: int) -> Page:
    width, height, samples = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_SAMPLES, (1,))[0]
    compression, predictor = _NAMES.get(tags.get(_COMPRESSION, (1,))[0]), tags.get(_PREDICTOR, (1,))[0]
    if set(tags.get(_BITS, (1,))) != {8}:
        raise ValueError("samples are not 8 bits wide")
    if compression is None or predictor not in (1, 2):
        raise ValueError("unknown compression or predictor")
    planes = samples if tags.get(_PLANAR, (1,))[0] == 2 else 1
    depth = samples // planes
    tiled = _TILE_OFFSETS in tags
    rows = tags.get(_ROWS_PER_STRIP, (height,))[0]
    tall, wide = (tags[_TILE_HEIGHT][0], tags[_TILE_WIDTH][0]) if tiled else (max(1, min(rows, height)), width)
    offsets = tags[_TILE_OFFSETS if tiled else _STRIP_OFFSETS]
    counts = tags[_TILE_COUNTS if tiled else _STRIP_COUNTS]
    if min(width, height, samples, tall, wide) < 1:
        raise ValueError("a page or tile without samples")
    if max(width * height * samples, tall * wide * depth) > max_page:
        raise ValueError(f"a page of more than {max_page} bytes")
    if planes * -(-height // tall) * -(-width // wide) > min(len(offsets), len(counts)):
        raise ValueError("strips or tiles are missing")
    places = [(p, y, x) for p in range(planes) for y in range(0, height, tall) for x in range(0, width, wide)]
    pixels = np.empty((height, width, samples), np.uint8)
    for (plane, y, x), start, count in zip(places, offsets, counts, strict=False):
        high = tall if tiled else min(tall, height - y)
        if start + count > len(data):
            raise ValueError("strip or tile lies outside the file")
        raw = _decompress(data[start:start + count], compression, high * wide * depth)
        block = np.frombuffer(raw, np.uint8).reshape(high, wide, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        block = block[: height - y, : width - x]
        pixels[y:y + block.shape[0], x:x + block.shape[1], plane * depth:(plane + 1) * depth] = block
    return Page(pixels, compression, predictor, tall, (tall, wide) if tiled else (0, 0))


#: A payload is a whole number of rows of 192 samples: 192 grey or 64 coloured pixels wide.
ROW = 192
#: How payloads are stored; their crc32 picks one, so equal payloads are stored alike.
FORMS = (
    {"samples": 1, "compression": "packbits", "predictor": 1, "rows_per_strip": 42},
    {"samples": 3, "compression": "lzw", "predictor": 1, "rows_per_strip": 42},
    {"samples": 1, "compression": "deflate", "predictor": 2, "tile": (32, 96)},
    {"samples": 3, "compression": "deflate", "predictor": 1, "rows_per_strip": 170},
)


def payload_image(text: bytes) -> bytes:
    """The text, padded with spaces to a positive multiple of ROW, as a one-page file."""
    payload = text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b" ")
    form = dict(FORMS[zlib.crc32(payload) % len(FORMS)])
    samples = form.pop("samples")
    return write_tiff([Page(np.frombuffer(payload, np.uint8).reshape(-1, ROW // samples, samples), **form)])


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media: every whole text as a TIFF file. A null text counts as empty and becomes one row of
    spaces. Only the two named columns are read; repeated rows stay repeated."""
    kind = df.schema[id_col].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            media = pa.array([payload_image(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), media], ["id", "n_bytes", "media"])

    picked = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    return picked.mapInArrow(store, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def pages_of(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = (), max_page: int = MAX_PAGE) -> DataFrame:
    """One row for each page of every file: the columns in `keep`, page (from 0), width, height, samples, compression,
    predictor, tiled, pixels (rows, then columns, then samples), error. A null file has no pages. What cannot be read
    gives one row, at the page where it broke, with null pixels and the reason in error; pages before it stay. So does a
    page of more than `max_page` bytes or one there is no memory for."""
    taken = {"page", "width", "height", "samples", "compression", "predictor", "tiled", "pixels", "error"} & set(keep)
    if taken:
        raise ValueError(f"columns in keep clash with the result: {sorted(taken)}")
    fields = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.string()),
              ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())]
    names = [n for n, _ in fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source: list[int] = []
            rows: list[tuple] = []

            def result(batch=batch, source=source, rows=rows) -> pa.RecordBatch:
                kept = batch.select(list(range(batch.num_columns - 1))).take(pa.array(source, pa.int64()))
                columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)]
                source.clear(), rows.clear()
                return pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, *names])

            held = 0
            for at, media in enumerate(batch.column(batch.num_columns - 1)):
                number = 0
                try:
                    for p in read_tiff(media.as_py(), max_page) if media.is_valid else ():
                        height, width, samples = p.pixels.shape
                        rows.append((number, width, height, samples, p.compression, p.predictor, all(p.tile), p.pixels.tobytes(), None))
                        source.append(at)
                        number, held = number + 1, held + p.pixels.nbytes
                        if held > HELD:
                            held = 0
                            yield result()
                except (ValueError, MemoryError) as error:
                    rows.append((number, None, None, None, None, None, None, None, str(error) or "no memory for the page"))
                    source.append(at)
            yield result()

    schema = [f"`{name}` {df.schema[name].dataType.simpleString()}" for name in keep]
    schema += ["page int, width int, height int, samples int, compression string, predictor int, tiled boolean, pixels binary, error string"]
    return df.select(*keep, F.col(media_col).alias("_media")).mapInArrow(read, ", ".join(schema))


def pixel_feature(pixels: bytes, width: int, height: int, samples: int) -> str:
    """Size, mean, spread and number of distinct values of an image."""
    counts = np.bincount(np.frombuffer(pixels, np.uint8), minlength=256).astype(np.int64)
    n, values = max(1, int(counts.sum())), np.arange(256)
    mean = int((counts * values).sum()) / n
    spread = int((counts * values * values).sum()) / n - mean * mean
    return f"{width}x{height}x{samples};mean={mean:.4f};variance={spread:.4f};values={int((counts > 0).sum())}"


def with_features(pages: DataFrame) -> DataFrame:
    """Add `feature` to the rows of pages_of; null where there are no pixels."""
    @F.pandas_udf("string")
    def feature(pixels: pd.Series, width: pd.Series, height: pd.Series, samples: pd.Series) -> pd.Series:
        rows = zip(pixels, width, height, samples, strict=True)
        return pd.Series([None if p is None else pixel_feature(p, int(w), int(h), int(s)) for p, w, h, s in rows], dtype=object)

    return pages.withColumn("feature", feature("pixels", "width", "height", "samples"))
