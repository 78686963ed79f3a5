"""Bytes of archives and vector tiles: gzip members, varints, tile features.

Plain functions on bytes; ``tessera.sources.archive`` applies them to tables.
Anything malformed raises ``ValueError`` and makes the whole tile fail.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np

#: Codes of compressions in archive headers
COMPRESSIONS = ("unknown", "none", "gzip", "brotli", "zstd")
#: Codes of geometry types in tiles
GEOMETRIES = ("unknown", "point", "linestring", "polygon")
MAX_DIRECTORY = 64 << 20
MAX_TILE = 64 << 20


def varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at ``at`` (64 bits) and the place after it."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad varint")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def varints(data: bytes) -> list[int]:
    """All numbers of packed bytes; many of them at once."""
    if len(data) < 48:
        out, at = [], 0
        while at < len(data):
            value, at = varint(data, at)
            out.append(value)
        return out
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise ValueError("bad varint")
    starts = np.concatenate([[0], ends[:-1] + 1])
    longest = int((ends - starts).max()) + 1
    if longest > 10:
        raise ValueError("bad varint")
    total = np.zeros(len(ends), np.uint64)
    for i in range(longest):
        at = starts + i
        held = at <= ends
        total[held] |= (raw[at[held]] & 0x7F).astype(np.uint64) << np.uint64(7 * i)
    return total.tolist()


def to_varint(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes(out) + bytes([value])


def unzigzag(value: int) -> int:
    return value >> 1 ^ -(value & 1)


def zigzag(value: int) -> int:
    return value << 1 if value >= 0 else (-value << 1) - 1


def decompress(data: bytes, compression: str, limit: int) -> bytes:
    """At most ``limit`` bytes; a gzip member is whole, of the size and checksum
    that its end states. Other compressions than none and gzip are refused."""
    if compression == "none":
        if len(data) > limit:
            raise ValueError("too large")
        return data
    if compression != "gzip":
        raise ValueError(f"compression {compression}")
    if len(data) < 18 or data[:3] != b"\x1f\x8b\x08":
        raise ValueError("no gzip member")
    crc, size = struct.unpack("<II", data[-8:])
    if size > limit:
        raise ValueError("too large")
    machine = zlib.decompressobj(31)
    try:
        out = machine.decompress(data, limit + 1)
    except zlib.error as e:  # checks checksum and size as well
        raise ValueError("bad gzip member") from e
    if not machine.eof or machine.unused_data or len(out) != size or zlib.crc32(out) != crc:
        raise ValueError("bad gzip member")
    return out


def gzip_report(data: bytes | None, limit: int) -> tuple[str, int | None, bool | None]:
    """How a gzip member ends: (status, bytes, crc_ok), for readers that go forward
    only and check nothing. Status is ok, large, or broken; the bytes that could
    be unpacked are counted, and whether checksum and size at the end agree."""
    if data is None or len(data) < 18 or data[:3] != b"\x1f\x8b\x08":
        return "broken", None, None
    try:
        machine = zlib.decompressobj(-15)
        out = machine.decompress(data[_gzip_body(data) :], limit + 1)
    except (zlib.error, ValueError):
        return "broken", None, None
    if len(out) > limit:
        return "large", None, None
    if not machine.eof or len(machine.unused_data) < 8:
        return "broken", None, None
    crc, size = struct.unpack("<II", machine.unused_data[:8])
    return "ok", len(out), crc == zlib.crc32(out) and size == len(out) & 0xFFFFFFFF


def _gzip_body(data: bytes) -> int:
    """Where the compressed part of a member begins: after its header's fields."""
    flags, at = data[3], 10
    if flags & 4:
        at += 2 + int.from_bytes(data[10:12], "little")
    for bit in (8, 16):
        if flags & bit:
            at = data.index(b"\0", at) + 1
    return at + 2 * (flags >> 1 & 1)


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Number, wire type and value of each field of a message. Groups fail."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size, at = varint(data, at)
            if size is None or size > len(data) - at:
                raise ValueError("bad field")
            value, at = data[at : at + size], at + size
        yield tag >> 3, kind, value


def _need(kind: int, wanted: int) -> None:
    if kind != wanted:
        raise ValueError("wrong wire type")


def value(data: bytes) -> dict:
    """A property value: ``t`` names the member that is set. The last field wins;
    none: ``t`` is null."""
    out = dict.fromkeys("tsdiub")
    for number, kind, x in fields(data):
        if not 1 <= number <= 7:
            continue
        _need(kind, {1: 2, 2: 5, 3: 1}.get(number, 0))
        out = dict.fromkeys("tsdiub")
        if number == 1:
            out |= {"t": "string", "s": x.decode("utf-8", "replace")}
        elif number in (2, 3):
            out |= {"t": "double", "d": struct.unpack("<f" if number == 2 else "<d", x)[0]}
        elif number == 5:
            out |= {"t": "uint", "u": Decimal(x)}
        elif number == 7:
            out |= {"t": "bool", "b": x != 0}
        else:
            out |= {"t": "int", "i": unzigzag(x) if number == 6 else x - (x >> 63 << 64)}
    return out


def paths(commands: list[int]) -> list[list[dict]]:
    """Paths of drawing commands. The cursor goes on over paths; points of one
    move command are one path; a closed ring doesn't repeat its first point."""
    out: list[list[dict]] = []
    x = y = at = 0
    while at < len(commands):
        command, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if command == 7:
            if count != 1:
                raise ValueError("bad close")
            continue
        if command not in (1, 2) or (command == 2 and not out) or 2 * count > len(commands) - at:
            raise ValueError("bad command")
        if command == 1:
            out.append([])
        for i in range(at, at + 2 * count, 2):
            x, y = (((v + unzigzag(d) + (1 << 31)) & 0xFFFFFFFF) - (1 << 31) for v, d in ((x, commands[i]), (y, commands[i + 1])))
            out[-1].append({"x": x, "y": y})
        at += 2 * count
    return out


def decode_tile(data: bytes, include: Callable[[str], bool] = lambda layer: True, max_part: int | None = None) -> list[dict]:
    """Features of a tile in its order. Layers that ``include`` refuses need a
    name only. With ``max_part``, a larger name, key, value or feature fails."""
    out = []
    for ordinal, (number, kind, layer) in enumerate(f for f in fields(data) if f[0] == 3):
        _need(kind, 2)
        name, extent, version, raw, keys, values = None, 4096, 1, [], [], []
        for number, kind, x in fields(layer):
            if number in (1, 2, 3, 4):
                _need(kind, 2)
                if max_part is not None and len(x) > max_part:
                    raise ValueError("part too large")
            elif number in (5, 15):
                _need(kind, 0)
            if number == 1:
                name = x.decode("utf-8", "replace")
            elif number == 2:
                raw.append(x)
            elif number == 3:
                keys.append(x.decode("utf-8", "replace"))
            elif number == 4:
                values.append(value(x))
            elif number == 5:
                extent = x & 0xFFFFFFFF
            elif number == 15:
                version = x & 0xFFFFFFFF
        if name is None:
            raise ValueError("layer without name")
        if not include(name):
            continue
        for i, feature in enumerate(raw):
            ident, geometry, tags, commands = 0, 0, [], []
            for number, kind, x in fields(feature):
                if number in (1, 3):
                    _need(kind, 0)
                elif number in (2, 4):
                    _need(kind, 2)
                if number == 1:
                    ident = x
                elif number == 2:
                    tags = varints(x)
                elif number == 3:
                    geometry = x
                elif number == 4:
                    commands = varints(x)
            if geometry > 3 or len(tags) % 2 or any(k >= len(keys) for k in tags[::2]) or any(v >= len(values) for v in tags[1::2]):
                raise ValueError("bad feature")
            props = [{"key": keys[k], "value": values[v]} for k, v in zip(tags[::2], tags[1::2])]
            out.append({"layer_ordinal": ordinal, "feature_ordinal": i, "layer": name, "layer_version": version, "extent": extent or 4096, "feature_id": Decimal(ident), "geom_type": GEOMETRIES[geometry], "paths": paths(commands), "props": props})
    return out


# -- encoding -------------------------------------------------------------------


def field(number: int, x: int | bytes) -> bytes:
    if isinstance(x, int):
        return to_varint(number << 3) + to_varint(x)
    return to_varint(number << 3 | 2) + to_varint(len(x)) + x


def encode_value(x) -> bytes:
    if isinstance(x, bool):
        return field(7, int(x))
    if isinstance(x, int):
        return field(6, zigzag(x))
    if isinstance(x, float):
        return to_varint(3 << 3 | 1) + struct.pack("<d", x)
    return field(1, x.encode())


def encode_tile(layers: list[tuple[str, list[tuple[str, list[list[tuple[int, int]]], dict]]]]) -> bytes:
    """A tile of layers (name, features); a feature is geometry type, paths and
    properties."""
    out = b""
    for name, features in layers:
        keys: dict = {}
        values: dict = {}
        body = field(15, 2) + field(1, name.encode())
        for geometry, lines, props in features:
            x = y = 0
            commands: list[int] = []
            for line in lines:
                runs = [(1, line)] if geometry == "point" else [(1, line[:1]), (2, line[1:])]
                for command, points in runs:
                    if points:
                        commands.append(len(points) << 3 | command)
                    for a, b in points:
                        commands += [zigzag(a - x), zigzag(b - y)]
                        x, y = a, b
                if geometry == "polygon":
                    commands.append(15)
            tags = [i for k, v in props.items() for i in (keys.setdefault(k, len(keys)), values.setdefault(encode_value(v), len(values)))]
            body += field(2, field(2, b"".join(map(to_varint, tags))) + field(3, GEOMETRIES.index(geometry)) + field(4, b"".join(map(to_varint, commands))))
        body += b"".join(field(3, k.encode()) for k in keys) + b"".join(field(4, v) for v in values)
        out += field(3, body + field(5, 4096))
    return out
