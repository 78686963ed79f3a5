"""Archives and vector tiles: round trips and malformed bytes."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, wire
from tessera.sources import archive as A

TILE = [
    ("water", [("polygon", [[(0, 0), (4, 0), (4, 4), (0, 4)]], {"kind": "lake", "area": 12.5})]),
    ("road", [("linestring", [[(0, 0), (5, 5), (10, 0)]], {"class": "primary", "oneway": True, "lanes": 2})]),
    ("place", [("point", [[(5, 5)]], {"name": "Testville", "rank": 3})]),
]


def test_gzip():
    data = gzip.compress(b"tile " * 100)
    assert wire.decompress(data, "gzip", 500) == b"tile " * 100
    bad = [data[:17], data[:-1] + bytes([data[-1] ^ 1]), data[:-8] + bytes([data[-8] ^ 1]) + data[-7:], b"x" + data, data + data, data[:20] + data[-8:]]
    for x in bad:
        with pytest.raises(ValueError):
            wire.decompress(x, "gzip", 500)
    for kind, limit in (("gzip", 499), ("none", 3), ("brotli", 500), ("unknown", 500)):
        with pytest.raises(ValueError):
            wire.decompress(data, kind, limit)


def test_tile_round_trip():
    water, road, place = wire.decode_tile(wire.encode_tile(TILE))
    assert [(p["x"], p["y"]) for p in water["paths"][0]] == TILE[0][1][0][1][0]
    assert (water["geom_type"], water["extent"], water["layer_version"]) == ("polygon", 4096, 2)
    assert {p["key"]: p["value"]["t"] for p in road["props"]} == {"class": "string", "oneway": "bool", "lanes": "int"}
    assert place["props"][1]["value"]["i"] == 3
    assert [f["layer_ordinal"] for f in wire.decode_tile(wire.encode_tile(TILE), lambda n: n != "road")] == [0, 2]
    assert wire.decode_tile(b"") == []


def test_malformed_tiles_fail():
    good = wire.encode_tile(TILE)
    layer = lambda feature: wire.field(3, wire.field(1, b"a") + wire.field(2, feature))
    bad = [good[:-1], wire.field(3, b""), layer(wire.field(3, 4)), layer(wire.field(2, b"\x00")), layer(wire.field(2, b"\x00\x00")), layer(wire.field(4, bytes([2 << 3 | 2, 0, 0]))), layer(wire.field(4, bytes([1 << 3 | 1, 0]))), layer(wire.field(4, bytes([23]))), layer(wire.field(4, bytes([8 | 3]))), b"\x1b"]
    for x in bad:
        with pytest.raises(ValueError):
            wire.decode_tile(x)
    with pytest.raises(ValueError):
        wire.decode_tile(good, max_part=8)
    rng = random.Random(3)
    for _ in range(500):  # any bytes either decode or fail cleanly
        x = bytearray(good)
        x[rng.randrange(len(x))] = rng.randrange(256)
        try:
            wire.decode_tile(bytes(x))
        except ValueError:
            pass


def test_ids_go_back_to_places():
    rng = np.random.default_rng(1)
    zoom = rng.integers(0, 25, 2000)
    x, y = (rng.integers(0, 1 << 24, 2000) % (1 << zoom) for _ in range(2))
    ids = geo.tile_ids(zoom, x, y).astype(np.int64)
    assert [a.tolist() for a in A.tile_places(ids)] == [zoom.tolist(), x.tolist(), y.tolist()]


def test_directory_entries():
    rows = [(3, 1, 10, 0), (4, 5, 7, 10), (20, 1, 7, 10), (21, 2, 3, 17)]
    assert A.entries(A.encode_entries(rows)) == rows
    for x in (b"", b"\x02\x01", b"\x01\x00\x01\x05\x00"):
        with pytest.raises(ValueError):
            A.entries(x)


@pytest.mark.parametrize("leaf_size", [None, 3])
@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archive(spark, tmp_path, leaf_size, compression):
    raw = {i: wire.encode_tile(TILE) if i % 3 else b"" if compression == "none" and i == 9 else wire.encode_tile(TILE[:1]) for i in [*range(12), *range(40, 60)]}
    (tmp_path / "a.pmtiles").write_bytes(A.encode_archive(raw, '{"name": "é"}', leaf_size, compression))
    (tmp_path / "b.pmtiles").write_bytes(A.encode_archive({0: b"not a tile"}))
    (tmp_path / "c.txt").write_text("other")
    d = str(tmp_path)
    heads = {r.archive[-9:]: r for r in A.read_archive(spark, d, "header").collect()}
    assert heads["a.pmtiles"].addressed_tiles_count == 32 and heads["a.pmtiles"].tile_compression == compression and heads["b.pmtiles"].max_zoom == 0
    one = f"{d}/a.pmtiles"
    assert A.read_archive(spark, one, "metadata").first().metadata == '{"name": "é"}'
    stored = A.read_archive(spark, one)
    got = {r.tile_id: bytes(r.payload) for r in A.tiles(stored).collect()}
    assert {k: wire.decompress(v, compression, 1 << 20) for k, v in got.items()} == raw
    some = A.tiles(A.read_archive(spark, one, "directory", first_tile=43, last_tile=45)).filter("tile_id between 43 and 45")
    assert sorted((r.tile_id, r.z) for r in some.collect()) == [(43, 3), (44, 3), (45, 3)]
    want = sum(len(wire.decode_tile(v)) for v in raw.values())
    feats = A.features(stored)
    assert feats.filter("status = 'ok'").agg(F.sum("run_length")).first()[0] == want
    assert {r.layer for r in A.features(stored, without=["road"]).select("layer").distinct().collect()} == {"water", "place"}
    assert [r.status != "ok" and r.layer is None for r in A.features(A.read_archive(spark, f"{d}/b.pmtiles")).collect()] == [True]


def test_bad_archives_fail(spark, tmp_path):
    (tmp_path / "x.pmtiles").write_bytes(b"PMTiles\x02" + bytes(200))
    with pytest.raises(Exception, match="version 3"):
        A.read_archive(spark, str(tmp_path / "x.pmtiles"), "header").collect()


def test_neighbouring_leaves_share_a_task(tmp_path, monkeypatch):
    raw = {3 * i: b"tile %d" % (i % 7) for i in range(4000)}
    (tmp_path / "a.pmtiles").write_bytes(A.encode_archive(raw, leaf_size=4, compression="gzip"))
    reader = lambda **options: A._Reader({"path": str(tmp_path / "a.pmtiles")} | options)
    held = lambda r: sorted((row[1], wire.decompress(row[6], "gzip", 99)) for piece in r.partitions() for row in r.read(piece))
    assert len(reader().partitions()) == 1  # of 1,000 leaves
    assert held(reader()) == sorted(raw.items())
    z, x, y = A.tile_places(np.array([0, 5997, 11997]))
    for entries, size, least in ((400, 1 << 30, 10), (1 << 30, 40, 2), (1, 1, 1000)):
        monkeypatch.setattr(A, "TASK_ENTRIES", entries)
        monkeypatch.setattr(A, "TASK_BYTES", size)
        assert least <= len(reader().partitions()) <= 1.5 * least + 3
        assert held(reader()) == sorted(raw.items())
        assert held(reader(first_tile="300", last_tile="6000")) == [(k, v) for k, v in raw.items() if 300 <= k <= 6000]
        assert held(reader(tiles=",".join(map("{}/{}/{}".format, z, x, y)))) == [(k, raw[k]) for k in (0, 5997, 11997)]
    uncounted = {"tile_entries_count": 0, "tile_data_length": 0}
    assert list(A._dealt(uncounted, [(0, 10), (10, 10)], 20)) == [[(0, 10), (10, 10)]]
    assert len(list(A._dealt(uncounted, [(i << 19, 1 << 19) for i in range(8)], 8 << 19))) == 4
