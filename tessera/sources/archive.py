"""Tile archives (PMTiles version 3) as a Spark data source, and their features.

``spark.read.format("tile_archive").option("part", ...).load(path)`` with a file
or a folder of ``*.pmtiles``. Parts: ``header``, ``metadata``, ``directory`` (one
row per entry, leaves resolved) and ``tiles`` (entries with their stored bytes).
The driver reads headers and root directories only, at most 16 KB for each
archive; a task takes neighbouring leaf directories, up to about ``TASK_ENTRIES``
entries or ``TASK_BYTES`` of tiles as the header counts them, and no leaf is cut.
``first_tile`` and ``last_tile`` bound the ids: leaves and bytes outside aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions import geo, wire

#: Layout of the header after the magic bytes
HEADER = struct.Struct("<7sB11Q6B4iB2i")
NAMES = ("version root_dir_offset root_dir_length metadata_offset metadata_length leaf_dirs_offset leaf_dirs_length tile_data_offset tile_data_length addressed_tiles_count tile_entries_count tile_contents_count clustered internal_compression tile_compression tile_type min_zoom max_zoom min_lon_e7 min_lat_e7 max_lon_e7 max_lat_e7 center_zoom center_lon_e7 center_lat_e7").split()
MAX_ROOT, MAX_HOPS, MAX_METADATA = 16_384, 8, 64 << 20
READ_AHEAD = 4 << 20
TASK_ENTRIES, TASK_BYTES, TASK_DIRECTORIES = 1 << 14, 32 << 20, 1 << 20

SCHEMAS = {
    "header": "archive string, " + ", ".join(f"{n} {'string' if n.endswith('_compression') else 'boolean' if n == 'clustered' else 'int' if n.endswith('_e7') or n.endswith('zoom') or n in ('version', 'tile_type') else 'long'}" for n in NAMES),
    "metadata": "archive string, metadata string",
    "directory": "archive string, tile_id long, run_length long, offset long, length long",
    "tiles": "archive string, tile_id long, run_length long, offset long, length long, tile_compression string, payload binary",
}


def _at(data: bytes) -> dict:
    """The header of an archive."""
    if len(data) < HEADER.size or data[:7] != b"PMTiles":
        raise ValueError("no tile archive")
    out = dict(zip(NAMES, HEADER.unpack(data[: HEADER.size])[1:]))
    if out["version"] != 3 or out["root_dir_length"] > MAX_ROOT:
        raise ValueError("not an archive of version 3 with a small root directory")
    out["clustered"] = out["clustered"] != 0
    for n in ("internal_compression", "tile_compression"):
        out[n] = wire.COMPRESSIONS[out[n]] if out[n] < len(wire.COMPRESSIONS) else "unknown"
    return out


def entries(data: bytes) -> list[tuple[int, int, int, int]]:
    """tile_id, run_length, length, offset of a directory's entries."""
    numbers = wire.varints(data)
    if not numbers or len(numbers) < 1 + 4 * numbers[0]:
        raise ValueError("directory cut off")
    n = numbers[0]
    steps, runs, lengths, raw = (numbers[1 + i * n : 1 + (i + 1) * n] for i in range(4))
    offsets: list[int] = []
    for i, x in enumerate(raw):
        if x == 0 and i == 0:
            raise ValueError("first offset follows nothing")
        offsets.append(x - 1 if x else offsets[-1] + lengths[i - 1])
    return list(zip(accumulate(steps), runs, lengths, offsets))


def encode_entries(rows: list[tuple[int, int, int, int]]) -> bytes:
    steps = [b[0] - a[0] for a, b in zip([(0,), *rows], rows)]
    offsets = [0 if i and r[3] == rows[i - 1][3] + rows[i - 1][2] else r[3] + 1 for i, r in enumerate(rows)]
    return b"".join(map(wire.to_varint, [len(rows), *steps, *(r[1] for r in rows), *(r[2] for r in rows), *offsets]))


def tile_id(z: int, x: int, y: int) -> int:
    """Number of a tile along the curve; no tile: an error."""
    if not (0 <= z <= geo.MAX_ZOOM and 0 <= x < 1 << z and 0 <= y < 1 << z):
        raise ValueError(f"no tile {z}/{x}/{y}")
    place, side = 0, 1 << z >> 1
    while side:
        right, low = x & side > 0, y & side > 0
        place += side * side * ((3 if right else 0) ^ (1 if low else 0))
        if not low:
            if right:
                x, y = side - 1 - (x & side - 1), side - 1 - (y & side - 1)
            x, y = y, x
        x, y, side = x & side - 1, y & side - 1, side >> 1
    return (4**z - 1) // 3 + place


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        files, path = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    else:
        files = fs.LocalFileSystem()
    return files, path


def _archives(path: str) -> list[str]:
    files, inner = _open(path)
    if files.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in files.get_file_info(fs.FileSelector(inner)) if f.is_file and f.extension == "pmtiles")
    return [f"{path.rstrip('/')}/{n}" for n in names]


class _Piece(InputPartition):
    """Leaf directories of an archive (offset, length), or (without them) entries of
    its root."""

    def __init__(self, archive: str, head: dict, rows: list | None, leaves: list[tuple[int, int]] | None):
        self.archive, self.head, self.rows, self.leaves = archive, head, rows, leaves


def _dealt(head: dict, leaves: list[tuple[int, int]], whole: int) -> Iterator[list[tuple[int, int]]]:
    """``leaves`` in their order, as many together as a task takes. The header's
    counts are spread over the ``whole`` bytes of leaves that the root names; where
    it counts nothing, the bytes of leaves alone are bounded."""
    share = max(head["tile_entries_count"] / TASK_ENTRIES, head["tile_data_length"] / TASK_BYTES, whole / TASK_DIRECTORIES) / max(1, whole)
    held, load = [], 0.0
    for leaf in leaves:
        if held and load + leaf[1] * share > 1:
            yield held
            held, load = [], 0.0
        held.append(leaf)
        load += leaf[1] * share
    if held:
        yield held


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.part = options.get("part", "tiles")
        if self.part not in SCHEMAS:
            raise ValueError(f"part must be one of {', '.join(SCHEMAS)}")
        self.path = options["path"]
        self.first, self.last = int(options.get("first_tile", 0)), int(options.get("last_tile", (1 << 63) - 1))
        self.wanted = sorted({tile_id(*map(int, t.split("/"))) for t in options["tiles"].split(",")}) if options.get("tiles") else None
        if self.wanted is not None:
            self.first, self.last = max(self.first, self.wanted[0]), min(self.last, self.wanted[-1])

    def asked(self, first: int, end: int) -> bool:
        """Whether a tile from ``first`` up to, without, ``end`` is asked for."""
        if end <= self.first or first > self.last:
            return False
        return self.wanted is None or bisect_left(self.wanted, first) < bisect_left(self.wanted, end)

    def partitions(self):
        out = []
        for archive in _archives(self.path):
            files, inner = _open(archive)
            with files.open_input_file(inner) as f:
                head = _at(f.read_at(HEADER.size, 0))
                if self.part in ("header", "metadata"):
                    out.append(_Piece(archive, head, None, None))
                    continue
                root = self._load(f.read_at(head["root_dir_length"], head["root_dir_offset"]), head)
            if rows := [r for r in root if r[1]]:
                out.append(_Piece(archive, head, rows, None))
            ends = [r[0] - 1 for r in root[1:]] + [(1 << 63) - 1]
            leaves = [(r[3], r[2]) for r, end in zip(root, ends) if not r[1] and self.asked(r[0], end + 1)]
            out.extend(_Piece(archive, head, None, some) for some in _dealt(head, leaves, sum(r[2] for r in root if not r[1])))
        return out or [_Piece("", {}, [], None)]

    @staticmethod
    def _load(data, head):
        return entries(wire.decompress(data, head["internal_compression"], wire.MAX_DIRECTORY))

    def _leaves(self, f, head, leaves, hops):
        """Entries of ``leaves``; those that lie side by side are read at once."""
        if hops > MAX_HOPS:
            raise ValueError("directories nest too deep")
        at = 0
        while at < len(leaves):
            end, (start, size) = at + 1, leaves[at]
            while end < len(leaves) and leaves[end][0] == start + size and size + leaves[end][1] <= READ_AHEAD:
                size += leaves[end][1]
                end += 1
            held = f.read_at(size, head["leaf_dirs_offset"] + start)
            for offset, length in leaves[at:end]:
                for r in self._load(held[offset - start : offset - start + length], head):
                    if r[1]:
                        yield r
                    else:
                        yield from self._leaves(f, head, [(r[3], r[2])], hops + 1)
            at = end

    def read(self, piece: _Piece) -> Iterator[tuple]:
        head = piece.head
        if not head:
            return
        if self.part == "header":
            yield (piece.archive, *(head[n] for n in NAMES))
            return
        files, inner = _open(piece.archive)
        with files.open_input_file(inner) as f:
            if self.part == "metadata":
                raw = f.read_at(head["metadata_length"], head["metadata_offset"])
                yield piece.archive, wire.decompress(raw, head["internal_compression"], MAX_METADATA).decode("utf-8", "replace") if raw else ""
                return
            rows = piece.rows if piece.leaves is None else self._leaves(f, head, piece.leaves, 1)
            rows = [r for r in rows if self.asked(r[0], r[0] + r[1])]
            if self.part == "directory":
                for tile, run, length, offset in rows:
                    yield piece.archive, tile, run, offset, length
                return
            start, held = 0, b""
            for tile, run, length, offset in sorted(rows, key=lambda r: r[3]):
                if not start <= offset <= offset + length <= start + len(held):
                    start, held = offset, f.read_at(max(length, min(READ_AHEAD, head["tile_data_length"] - offset)), head["tile_data_offset"] + offset)
                payload = held[offset - start : offset - start + length]
                if len(payload) != length:
                    raise ValueError("archive cut off")
                yield piece.archive, tile, run, offset, length, head["tile_compression"], payload


class TileArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_archive"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "tiles")]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_archive(spark: SparkSession, path: str, part: str = "tiles", **options) -> DataFrame:
    spark.dataSource.register(TileArchive)
    return spark.read.format("tile_archive").options(part=part, **options).load(path)


def _pack(data: bytes, compression: str) -> bytes:
    if compression not in ("none", "gzip"):
        raise ValueError(f"compression {compression}")
    return gzip.compress(data, mtime=0) if compression == "gzip" else bytes(data)


class _Builder:
    """Entries of one archive as its tiles come by id: equal neighbours share a run,
    equal payloads their bytes. Payloads go to ``sink`` at once; what is held are
    entries, and a digest for each different payload."""

    def __init__(self, sink, compression: str):
        self.sink, self.compression = sink, compression
        self.rows: list[list[int]] = []
        self.where: dict[bytes, int] = {}
        self.size = self.tiles = 0

    def add(self, tile: int, raw: bytes) -> None:
        if self.rows and tile < self.rows[-1][0] + self.rows[-1][1]:
            raise ValueError(f"tile {tile} comes twice or out of order")
        payload = _pack(raw, self.compression)
        key = hashlib.sha256(payload).digest()
        at = self.where.get(key)
        if at is None:
            at = self.where[key] = self.size
            self.sink.write(payload)
            self.size += len(payload)
        self.tiles += 1
        last = self.rows[-1] if self.rows else None
        if last and last[3] == at and last[2] == len(payload) and last[0] + last[1] == tile:
            last[1] += 1
        else:
            self.rows.append([tile, 1, len(payload), at])

    def front(self, metadata: str, leaf_size: int | None) -> bytes:
        """All that stands before the payloads. Without ``leaf_size``, entries are
        in the root if they fit there, else in the smallest leaves that do."""
        own, code = [tuple(r) for r in self.rows], wire.COMPRESSIONS.index(self.compression)
        sizes = [leaf_size] if leaf_size else [0, *(1 << i for i in range(9, 40))]
        for size in sizes:
            root, leaves = own, b""
            if size:
                root = []
                for i in range(0, len(own), size):
                    leaf = _pack(encode_entries(own[i : i + size]), self.compression)
                    root.append((own[i][0], 0, len(leaf), len(leaves)))
                    leaves += leaf
            top = _pack(encode_entries(root), self.compression)
            if len(top) <= MAX_ROOT:
                break
        else:
            raise ValueError("the root directory is too large")
        meta = _pack(metadata.encode(), self.compression)
        zoom = np.searchsorted(_BEFORE, [own[0][0], own[-1][0] + own[-1][1] - 1], "right") - 1 if own else [0, 0]
        at = list(accumulate((HEADER.size, len(top), len(meta), len(leaves))))
        head = HEADER.pack(b"PMTiles", 3, at[0], len(top), at[1], len(meta), at[2], len(leaves), at[3], self.size, self.tiles, len(own), len(self.where), 1, code, code, 1, int(zoom[0]), int(zoom[1]), -1800000000, -850511300, 1800000000, 850511300, 0, 0, 0)
        return head + top + meta + leaves


def encode_archive(tiles: dict[int, bytes], metadata: str = "{}", leaf_size: int | None = None, compression: str = "none") -> bytes:
    """A small archive in memory, for exports and tests."""
    data = io.BytesIO()
    builder = _Builder(data, compression)
    for tile, raw in sorted(tiles.items()):
        builder.add(tile, raw)
    return builder.front(metadata, leaf_size) + data.getvalue()


def write_archives(tiles: DataFrame, directory: str, metadata: str = "{}", leaf_size: int | None = None, compression: str = "gzip") -> DataFrame:
    """Write ``tiles`` (archive, tile_id, payload) as ``directory``/<archive>.pmtiles
    and return archive, tiles, entries, contents, bytes of each.

    Archives are dealt to tasks and written side by side; an archive is one task's
    file, in the order of its tiles, and its payloads are on disk, not in memory. A
    file has its name only when it is whole, so a task that is lost and begun again
    does no harm. A tile that comes twice is an error. The directory is one that
    all executors share."""

    def run(batches):
        name = builder = sink = None

        def done():
            sink.close()
            files, where = _open(f"{directory.rstrip('/')}/{name}.pmtiles")
            parts, rest = _open(part)
            with files.open_output_stream(where + mark) as out, parts.open_input_stream(rest) as held:
                front = builder.front(metadata, leaf_size)
                out.write(front)
                while piece := held.read(READ_AHEAD):
                    out.write(piece)
            files.move(where + mark, where)
            parts.delete_file(rest)
            return pa.RecordBatch.from_pylist([{"archive": name, "tiles": builder.tiles, "entries": len(builder.rows), "contents": len(builder.where), "bytes": len(front) + builder.size}])

        for batch in batches:
            for archive, tile, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    if builder:
                        yield done()
                    name, mark = archive, f".{uuid.uuid4().hex}"
                    part = f"{directory.rstrip('/')}/.{name}{mark}"
                    files, where = _open(part)
                    files.create_dir(where.rpartition("/")[0], recursive=True)
                    sink = files.open_output_stream(where)
                    builder = _Builder(sink, compression)
                builder.add(tile, payload)
        if builder:
            yield done()

    rows = tiles.select(F.col("archive").cast("string"), F.col("tile_id").cast("long"), F.col("payload").cast("binary"))
    told = rows.repartition("archive").sortWithinPartitions("archive", "tile_id").mapInArrow(run, "archive string, tiles long, entries long, contents long, bytes long")
    held = told.toArrow()  # a row for each file
    return tiles.sparkSession.createDataFrame(held)


# -- tiles and features -------------------------------------------------------

_BEFORE = np.array([(4**i - 1) // 3 for i in range(geo.MAX_ZOOM + 1)], np.int64)


def tile_places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """zoom, x, y of tile ids: the walk of ``geo.hilbert`` backwards."""
    zoom = np.searchsorted(_BEFORE, ids, "right") - 1
    place = ids - _BEFORE[zoom]
    x, y = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    swap, flip = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    for bit in range(int(zoom.max(initial=0)) - 1, -1, -1):
        on = zoom > bit
        digit = place >> (2 * bit) & 3
        rx, ry = digit >= 2, (digit == 1) | (digit == 2)
        u, v = rx ^ flip, ry ^ flip
        x |= np.where(on, np.where(swap, v, u).astype(np.int64) << bit, 0)
        y |= np.where(on, np.where(swap, u, v).astype(np.int64) << bit, 0)
        flip ^= on & rx & ~ry
        swap ^= on & ~ry
    return zoom, x, y


def _places(ids: pd.Series) -> pd.DataFrame:
    zoom, x, y = tile_places(ids.to_numpy(np.int64))
    return pd.DataFrame({"z": zoom.astype(np.int32), "x": x, "y": y})


def place(tile_id: Column) -> Column:
    """Struct z, x, y of a tile id."""
    return F.pandas_udf(_places, "struct<z: int, x: long, y: long>")(tile_id)


def tiles(stored: DataFrame) -> DataFrame:
    """One row per addressed tile: runs of ``part=tiles`` or ``directory`` spread."""
    rows = stored.withColumn("tile_id", F.explode(F.expr("sequence(tile_id, tile_id + run_length - 1)"))).drop("run_length")
    return rows.withColumn("__p", place(F.col("tile_id"))).select("*", "__p.z", "__p.x", "__p.y").drop("__p")


FEATURES = (
    "archive string, tile_id long, run_length long, status string, layer_ordinal int, feature_ordinal int, layer string, layer_version int, extent int, feature_id decimal(20,0), geom_type string, "
    "paths array<array<struct<x: int, y: int>>>, props array<struct<key: string, value: struct<t: string, s: string, d: double, i: bigint, u: decimal(20,0), b: boolean>>>"
)


def features(stored: DataFrame, layers: list[str] | None = None, without: list[str] = (), max_part: int | None = None, most: int | None = None) -> DataFrame:
    """Features of ``part=tiles``, one row each; a stored tile is decoded once and
    keeps its run. ``status`` is ok, or for a tile that fails (one row, other
    columns null) the reason. ``layers`` and ``without`` choose layers before
    features are decoded. Null payloads fail; empty ones have no rows. ``most``
    ends the decoding of a tile after so many features."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = to_arrow_schema(_parse_datatype_string(FEATURES))
    include = lambda n: (layers is None or n in layers) and n not in without

    def run(batches):
        for batch in batches:
            for archive, tile, n, compression, payload in zip(*(batch.column(i).to_pylist() for i in range(5))):
                key = {"archive": archive, "tile_id": tile, "run_length": n}
                try:
                    if payload is None:
                        raise ValueError("no payload")
                    got = wire.decode_tile(wire.decompress(payload, compression, wire.MAX_TILE), include, max_part)[:most]
                except ValueError as e:
                    got, key = [{}], key | {"status": str(e)}
                else:
                    key["status"] = "ok"
                for i in range(0, len(got), 5000):
                    yield pa.RecordBatch.from_pylist([key | g for g in got[i : i + 5000]], schema=shape)

    return stored.select("archive", "tile_id", "run_length", "tile_compression", "payload").mapInArrow(run, FEATURES)
