"""TIFF columns: pages of baseline and common extended TIFF files as rows.

Reads both byte orders, strips and tiles, no compression, PackBits, LZW and
deflate, horizontal predictors, chunky and planar samples of 1, 2, 4, 8 and 16
bits. Samples come as stored: palettes aren't applied and white-is-zero isn't
turned; ``photometric`` tells them. BigTIFF, floats and other schemes are faults.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import strings, text_batches

# Fixed values of the format: tags, sizes of field types, compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


class TiffError(ValueError):
    """The file breaks the format or uses a part of it that isn't read."""


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    photometric: int
    pixels: bytes  # row by row, samples of a pixel together, a byte each or 16 bits little-endian


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early."""
    out, table, last, width, held, n = bytearray(), [], None, 9, 0, 0
    for byte in data:
        held, n = (held << 8 | byte) & 0xFFFFFFFF, n + 8
        if n < width:
            continue
        n -= width
        code = held >> n & ((1 << width) - 1)
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], None, 9
            continue
        if code == 257 or len(out) >= size:
            break
        if not table:
            raise TiffError("LZW data don't begin with a clear code")
        if last is None:
            if code > 255:
                raise TiffError("LZW code out of range")
            word = table[code]
        else:
            if code > len(table):
                raise TiffError("LZW code out of range")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out[:size])


def inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size) if size else b""
    except zlib.error as e:
        raise TiffError(str(e)) from None


#: Bytes that one stored byte can give at most, by scheme.
MOST = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}
UNPACK = {NONE: lambda d, n: d[:n], PACKBITS: unpack_bits, LZW: unpack_lzw, DEFLATE: inflate, OLD_DEFLATE: inflate}


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    """Byte order and fields of each image directory, in the file's order."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or at < 8 or at + 2 > len(data):
            raise TiffError("directories form a loop or lie outside the file")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * n > len(data):
            raise TiffError("directory outside the file")
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in TYPES:
                if count > len(data):
                    raise TiffError(f"field {tag} outside the file")
                form = f"{order}{count}{TYPES[kind]}"
                place = at + 10 + 12 * i
                if struct.calcsize(form) > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                if place + struct.calcsize(form) > len(data):
                    raise TiffError(f"field {tag} outside the file")
                fields[tag] = struct.unpack_from(form, data, place)
        yield order, fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_pages(data: bytes) -> Iterator[Page]:
    """Pages in the file's order; TiffError at the first fault. No more memory is
    taken than the stored bytes can fill."""
    for number, (order, tags) in enumerate(directories(data)):
        one = lambda tag, default=None, t=tags: t[tag][0] if t.get(tag) else default
        width, height, samples, bits = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(BITS, 1)
        scheme, planar, predictor, photometric = one(COMPRESSION, 1), one(PLANAR, 1), one(PREDICTOR, 1), one(PHOTOMETRIC, 1)
        if not width or not height or not samples or bits not in (1, 2, 4, 8, 16) or set(tags.get(BITS, (1,))) != {bits} or scheme not in UNPACK or predictor not in (1, 2) or planar not in (1, 2):
            raise TiffError("size, depth, compression or predictor not read")
        if predictor == 2 and bits < 8 or any(x != 1 for x in tags.get(SAMPLE_FORMAT, ())):
            raise TiffError("sample format not read")
        tiled = TILE_OFFSETS in tags
        w, h = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        if not w or not h:
            raise TiffError("strips or tiles without size")
        at, sizes = (tags[TILE_OFFSETS], tags.get(TILE_BYTES, ())) if tiled else (tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_BYTES, ()))
        inside, planes = (1, samples) if planar == 2 else (samples, 1)
        across, down = -(-width // w), -(-height // h)
        if len(at) != across * down * planes or len(sizes) != len(at):
            raise TiffError("strips or tiles are missing")
        kind = np.dtype(np.uint8 if bits <= 8 else order + "u2")
        line = -(-w * inside * bits // 8)  # bytes of a stored row
        needs = [(h if tiled else min(h, height - i % (across * down) // across * h)) * line for i in range(len(at))]
        if any(start + size > len(data) or need > size * MOST[scheme] for start, size, need in zip(at, sizes, needs)) or height * width * samples * bits > 8 * sum(needs):
            raise TiffError("strip or tile too short")
        image = np.zeros((height, width, samples), "<u2" if bits == 16 else np.uint8)
        for i, (start, size, need) in enumerate(zip(at, sizes, needs)):
            plane, cell = divmod(i, across * down)
            y, x = cell // across * h, cell % across * w
            raw = UNPACK[scheme](data[start : start + size], need)
            if len(raw) != need:
                raise TiffError("strip or tile too short")
            if bits < 8:
                values = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(need // line, line), axis=1)
                values = values[:, : w * inside * bits].reshape(need // line, w, inside, bits)
                part = (values << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(-1, dtype=np.uint8)
            else:
                part = np.frombuffer(raw, kind).reshape(need // line, w, inside).astype(image.dtype)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=part.dtype)
            part = part[: height - y, : width - x]
            image[y : y + part.shape[0], x : x + part.shape[1], plane : plane + inside] = part
        yield Page(number, width, height, samples, bits, scheme, photometric, image.tobytes())


def write_pages(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 1024) -> bytes:
    """Grey 8-bit pages (height x width) in strips, one directory each."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for image in images:
        height, width = image.shape
        at, sizes = [], []
        for y in range(0, height, rows):
            part = image[y : y + rows]
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            data = part.tobytes()
            data = zlib.compress(data, 1) if compression == DEFLATE else data
            at.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tables = []
        for values in (at, sizes):
            tables.append(values[0] if len(values) == 1 else len(out))
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        fields = [(WIDTH, 4, 1, width), (LENGTH, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (STRIP_OFFSETS, 4, len(at), tables[0]), (SAMPLES, 3, 1, 1), (ROWS_PER_STRIP, 4, 1, rows), (STRIP_BYTES, 4, len(at), tables[1]), (PREDICTOR, 3, 1, predictor)]
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# -- columns --------------------------------------------------------------------

PAGE_SCHEMA = "doc_id long, page int, width int, height int, samples int, bits int, compression int, photometric int, pixels binary, error string"


def _pages(batches):
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    types = [pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.string()]
    for batch in batches:
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            try:
                if data is None:
                    raise TiffError("null")
                for p in read_pages(data):
                    rows.append((doc, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.photometric, p.pixels, None))
            except TiffError as e:
                rows.append((doc, *[None] * 8, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def tiff_pages(media: DataFrame) -> DataFrame:
    """One row per page of each file of ``media`` (doc_id, media). Pages before a
    fault are given, then a row with ``error``; null media is a fault as well."""
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(_pages, PAGE_SCHEMA)


SIDE = 64
PAGE_ROWS = 1 << 14


def payload(text: str) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of 64."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\0" * (SIDE - len(data) % SIDE if data else SIDE) if len(data) % SIDE or not data else data


def store(data: bytes) -> bytes:
    """A payload as grey pages, 64 samples wide and at most PAGE_ROWS high."""
    image = np.frombuffer(data, np.uint8).reshape(-1, SIDE)
    return write_pages([image[i : i + PAGE_ROWS] for i in range(0, len(image), PAGE_ROWS)])


def _store(batches):
    for batch in batches:
        ids, texts = batch.column(0), strings(batch.column(1))
        for i in range(0, len(texts), 500):
            part = texts[i : i + 500]
            yield pa.RecordBatch.from_arrays([ids.slice(i, len(part)), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in part], pa.int64()), pa.array([store(payload(t)) for t in part], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a TIFF file, null as empty."""
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def feature(pages: list[Page]) -> str:
    """Number and size of pages, mean and spread of samples, busiest sample."""
    counts = np.zeros(256, np.int64)
    for p in pages:
        counts += np.bincount(np.frombuffer(p.pixels, np.uint8), minlength=256)
    n, values = counts.sum(), np.arange(256)
    mean = int((counts * values).sum()) / n
    spread = int((counts * values * values).sum()) / n - mean * mean
    return f"pages={len(pages)};size={pages[0].width}x{sum(p.height for p in pages)};mean={mean:.6f};var={spread:.6f};mode={int(counts.argmax())}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for media in batch.column(2).to_pylist():
            pages = list(read_pages(media))
            data = b"".join(p.pixels for p in pages)
            for c, v in zip(cols, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-SIDE:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages))):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols)], [x.split()[0] for x in DIGEST.split(", ")]).cast(pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in DIGEST.split(", "))]))


def media_digest(stored: DataFrame) -> DataFrame:
    """What is read back from stored media, as digests, and features of it."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_digest, DIGEST)


def op9_media_tiff(spark, sf_dir):
    """Every text of ``documents`` stored as TIFF and read back from the stored
    bytes; repeated rows stay, other columns are ignored."""
    return media_digest(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
